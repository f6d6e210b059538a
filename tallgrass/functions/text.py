"""Column builders for text: all are built-in expressions, so they stay in generated code, but for vocabularies of many terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrass.functions.terms import found


def lits(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def trim(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def occurrences(text: Column, term: Column) -> Column:
    """How often term is in text, without overlaps; 0 for an empty term."""
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.when(F.length(term) > 0, n).otherwise(0).cast("int")


def hits(text: Column, terms: Iterable[str]) -> Column:
    """The terms that are somewhere in text, in lower case, sorted."""
    return found(F.lower(text), sorted(set(terms)))


def query_terms(query: str) -> list[str]:
    """Terms of a keyword query: parts between white space with over two signs, repeats kept."""
    return [t.lower() for t in query.split() if len(t) > 2]


def keyword_score(text: Column, query: str) -> Column:
    low, total = F.lower(text), F.lit(0)
    for t in query_terms(query):
        total = total + occurrences(low, F.lit(t))
    return total


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("uncategorized")).otherwise(F.substring(s, 1, 80))


def file_slug(name: Column) -> Column:
    s = F.replace(trim(F.regexp_replace(name, "[^a-zA-Z0-9._ -]+", "")), F.lit(" "), F.lit("_"))
    return F.when(s == "", F.lit("untitled")).otherwise(F.substring(s, 1, 80))


def lesson_slug(name: Column) -> Column:
    s = F.replace(F.substring(trim(F.regexp_replace(name, r"(?U)[^\p{L}\p{N} \-_]", "")), 1, 80), F.lit("  "), F.lit(" "))
    return F.when(s == "", F.lit("Lesson")).otherwise(s)


def note_name(name: Column) -> Column:
    s = F.substring(trim(F.regexp_replace(name, "[^A-Za-z0-9 _-]+", "")), 1, 90)
    return F.replace(F.when(s == "", F.lit("Research Note")).otherwise(s), F.lit("  "), F.lit(" "))


def iso(seconds: Column) -> Column:
    """Epoch seconds, as a number or text, to ISO text in UTC; '' for what is neither."""
    t = F.timestamp_micros(F.round(F.expr("try_cast({} as double)".format(_sql(seconds))) * 1_000_000).cast("long"))
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(t, "SSSSSS")
    return F.coalesce(F.when(part == "000000", F.concat(whole, F.lit("+00:00"))).otherwise(F.concat(whole, F.lit("."), part, F.lit("+00:00"))), F.lit(""))


def _sql(c: Column | str) -> str:
    return c if isinstance(c, str) else c._jc.toString()


def json_list(c: Column) -> Column:
    """An array of strings from JSON text; empty for what is not a list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def safe_list(c: Column, limit: int = 12, size: int = 300) -> Column:
    """Trimmed items that are not blank, cut to size, the first limit of them."""
    return F.slice(F.transform(F.filter(F.transform(c, trim), lambda x: x != ""), lambda x: F.substring(x, 1, size)), 1, limit)


def truncate(c: Column, limit: int) -> Column:
    more = F.concat(F.substring(c, 1, limit), F.lit("\n\n... truncated "), (F.length(c) - limit).cast("string"), F.lit(" chars ..."))
    return F.when(F.length(c) > limit, more).otherwise(c)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def markdown_line(c: Column) -> Column:
    return F.replace(trim(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit("|"), F.lit("\\|"))


#: The kinds of reader a note can have.
AUDIENCES = ("AI-LEARN", "READ-ME")


def front_matter(title: Column, audience: Column, tags: Column, purpose: Column) -> Column:
    """A front-matter block; null for an unknown audience."""
    lines = [F.lit("---"), F.concat(F.lit('title: "'), title, F.lit('"')), F.concat(F.lit("audience: "), audience), F.lit("tags:")]
    lines += [F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n")]
    lines += [F.when(F.coalesce(purpose, F.lit("")) != "", F.concat(F.lit('purpose: "'), purpose, F.lit('"'))), F.lit("---")]
    return F.when(audience.isin(*AUDIENCES), F.concat_ws("\n", *lines))


def excerpt(c: Column, size: int = 900) -> Column:
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, size)


#: What ends a line in text editors.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def lines(c: Column, ends: str = LINE_ENDS) -> Column:
    """Lines as text editors see them: also after other line ends, and none after the last end."""
    parts = F.split(c, ends, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
