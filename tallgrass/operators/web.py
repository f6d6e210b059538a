"""Web pages to titles and texts."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags whose text is left out, in either form, and the most signs of the second.
SKIP = frozenset(("script", "style", "noscript"))
SKIP_MORE = frozenset(("script", "style", "nav", "footer", "header"))
MOST = 30_000


class _Events(HTMLParser):
    """What a page consists of, in order: (start, tag), (end, tag) and (text, data)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag))

    def handle_endtag(self, tag):
        self.found.append(("end", tag))

    def handle_data(self, data):
        self.found.append(("text", data))


def events(html: str) -> list[tuple[str, str]]:
    parser = _Events()
    parser.feed(html)
    parser.close()
    return parser.found


def plain(found: list[tuple[str, str]]) -> tuple[str, str]:
    """(title, text): words between single spaces. A title counts even in a skipped tag, and the first end of
    a skipped tag ends skipping, however many had begun."""
    out: dict[str, list[str]] = {"title": [], "body": [], "left out": []}
    title = skipped = False
    for kind, value in found:
        if kind != "text":
            title = kind == "start" if value == "title" else title
            skipped = kind == "start" if value in SKIP else skipped
        elif words := value.split():
            out["title" if title else "left out" if skipped else "body"].append(" ".join(words))
    return "".join(out["title"]).strip(), "\n".join(out["body"])


def spaced(found: list[tuple[str, str]]) -> tuple[str, str]:
    """(title, text) of the second form: skipped tags count in depth, and text keeps its own spaces."""
    depth, title, names, parts = 0, False, [], []
    for kind, value in found:
        if kind == "text":
            if not depth:
                parts.append(value)
                names += [value] if title else []
        elif value in SKIP_MORE:
            depth = depth + 1 if kind == "start" else max(0, depth - 1)
        if kind != "text" and value == "title":
            title = kind == "start"
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(parts)))
    return "".join(names).strip(), text[:MOST]


def read_page(html: str, more: bool = False) -> tuple[str, str]:
    return (spaced if more else plain)(events(html))


def is_html(url: Column, content_type: Column) -> Column:
    """Whether an answer is read as HTML: its type says so, or its url ends with .html or a slash; null is neither."""
    return F.coalesce(F.contains(content_type, F.lit("text/html")), F.lit(False)) | F.coalesce(F.lower(url).rlike(r"(\.html|/)\z"), F.lit(False))


def last_of_path(url: Column) -> Column:
    """What follows the last slash of the path of a url; the url where that is nothing."""
    path = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*", ""), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", "")
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?s);.*", "")
    return F.when(last != "", last).otherwise(url)


def page_texts(pages: DataFrame, more: bool = False, content_type: str | None = None) -> DataFrame:
    """page_id, url, title and text of each page; a title falls back to the host as the url names it (with user and port), or to the url.

    With the name of a column of content types, pages that are not HTML keep their text as it is and are titled by their
    path; without one all are read as HTML. A null page has an empty text.
    """

    def rows(batches):
        for b in batches:
            found = [read_page(h or "", more) if web else (None, h or "") for h, web in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), b.column(3)], ["page_id", "url", "title", "text", "is_html"])

    web = is_html(F.col("url"), F.col(content_type)) if content_type else F.lit(True)
    out = pages.select("page_id", "url", "html", web.alias("is_html")).mapInArrow(rows, "page_id long, url string, title string, text string, is_html boolean")
    fallback = F.col("url") if more else F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.col("url"))
    title = F.when(~F.col("is_html"), last_of_path(F.col("url"))).when(F.col("title") != "", F.col("title")).otherwise(fallback)
    return out.withColumn("title", title).drop("is_html")
