"""Behaviours that the queries over the tables do not reach."""

import hashlib
import io
import re
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import terms as M
from tallgrass.functions import text as T
from tallgrass.operators import archive, assets, chunking, classify, compose, embed, reports, scan, search, web
from tallgrass.sources import digests, ranged, readers
from tallgrass.streaming import imports


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


def test_branch_follows_parents_and_stops_at_a_cycle():
    nodes = {"a": (None, None), "b": ("a", {"role": "user", "text": " hi "}), "c": ("b", {"role": None, "text": "yes"}), "x": ("b", {"role": "user", "text": "lost"})}
    assert [(m["pos"], m["role"], m["text"]) for m in archive.branch("c", nodes)] == [(0, "user", "hi"), (1, "unknown", "yes")]
    assert [m["text"] for m in archive.branch("p", {"p": ("q", {"text": "1"}), "q": ("p", {"text": "2"})})] == ["2", "1"]
    assert archive.branch(None, nodes) == [] and archive.branch("gone", nodes) == []
    long = {str(k): (str(k - 1) if k else None, {"role": "user", "text": str(k)}) for k in range(500)}
    assert len(archive.branch("499", long)) == 500


def test_paragraphs_are_packed_and_long_ones_cut():
    assert chunking.split_message("a\n\n \nb\n\nc", 100) == ["a\n\nb\n\nc"]
    assert chunking.split_message("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.split_message("  \n\n ") == []


def test_chunks_overlap_by_one_unit_where_it_fits():
    m = [{"pos": k, "role": "user", "text": c * 1200} for k, c in enumerate("abcd")]
    got = chunking.chat_chunks(m)
    assert [(i, a, b) for i, a, b, _ in got] == [(0, 0, 1), (1, 1, 3)]
    assert got[1][3].startswith("[user] bbb") and chunking.chat_chunks([]) == []
    assert [x[1:3] for x in chunking.chat_chunks(m, target=100)] == [(0, 0), (0, 1), (1, 2), (2, 3)]


def test_windows_of_edges(spark):
    assert one(spark, chunking.fixed_windows(F.col("v"), 3), "abcdefgh") == ["abc", "def", "gh"]
    assert one(spark, chunking.fixed_windows(F.col("v"), 3), "") == [""]
    assert one(spark, chunking.overlapping(F.col("v"), 4, 1), "abcdefg") == ["abcd", "defg", "g"]
    assert one(spark, chunking.overlapping(F.col("v")), "  \n") == []


def test_lines_end_as_editors_end_them(spark):
    assert one(spark, T.lines(F.col("v")), "a b\r\nc d\x0be\n") == ["a b", "c", "d", "e"]
    assert one(spark, T.lines(F.col("v")), "") == []


def test_scalars(spark):
    assert one(spark, T.iso("v"), "1700000000.25") == "2023-11-14T22:13:20.250000+00:00"
    assert one(spark, T.iso("v"), "soon") == "" and one(spark, T.iso("v"), None) == ""
    assert one(spark, T.slugify(F.col("v")), "  Ünder / Score ") == "nder-score" and one(spark, T.slugify(F.col("v")), "!!") == "uncategorized"
    assert one(spark, T.occurrences(F.col("v"), F.lit("aa")), "aaaa") == 2
    assert one(spark, T.json_list(F.col("v")), '["a"]') == ["a"] and one(spark, T.json_list(F.col("v")), "{") == []
    assert one(spark, T.front_matter(F.col("v"), F.lit("NOBODY"), F.array(F.lit("t")), F.lit("")), "x") is None


def test_labels(spark):
    k = lambda text: one(spark, classify.by_keywords(F.col("v")), text)
    assert k("Linux server with docker and ssh").label == "TECHNICAL" and k("Linux server with docker and ssh").confidence >= 0.8
    assert k("wallpaper with glitter and wings, emo").label == "CREATIVE"
    assert (k("hello").label, k("hello").confidence) == ("UNKNOWN", 0.25)


def test_merge_is_idempotent(spark):
    rows = [(k, f"t{k}", f"d{k}") for k in range(20)]
    new = spark.createDataFrame(rows, "conversation_id long, title string, digest string")
    stored = new.withColumns({"state": F.lit("done"), "attempts": F.lit(1), "last_error": F.lit("e"), "notes": F.lit("n")})
    assert {r.change for r in archive.diff(new, stored).collect()} == {"unchanged"}
    assert {r.state for r in archive.merge(new, stored).collect()} == {"done"}
    assert archive.merge(new, stored.limit(0)).filter("state = 'pending'").count() == 20
    changed = archive.merge(new.withColumn("digest", F.lit("other")), stored).first()
    assert (changed.state, changed.attempts, changed.last_error, changed.notes) == ("pending", 0, None, "n")


def test_banner_is_put_once(spark):
    put = lambda t: one(spark, scan.with_banner(F.col("v"), "BANNER\n", "BANNER"), t)
    assert put("---\na: 1\n---\nbody") == "---\na: 1\n---\n\nBANNER\nbody"
    assert put("body") == "BANNER\nbody" and put(put("body")) == "BANNER\nbody"
    assert put("---\nnever closed") == "BANNER\n---\nnever closed"


def test_pages():
    html = "<title>A</title><title>B</title><style>x</style><script>var a='<p>no</p>';</script><p> one  two </p><noscript>no</noscript>three"
    assert web.read_page(html) == ("AB", "one two\nthree")
    assert "menu" not in web.read_page("<nav>menu<header>x</header>menu</nav><p>text</p>", more=True)[1]
    assert web.read_page("") == ("", "")
    assert web.read_page("<noscript>x<title>T</title>y</noscript>z") == ("T", "z")


def test_page_titles_fall_back_to_the_host(spark):
    df = spark.createDataFrame([(1, "http://me@site.example:8080/a?b", "<p>x</p>"), (2, "no url", None)], "page_id long, url string, html string")
    assert {r.page_id: r.title for r in web.page_texts(df).collect()} == {1: "me@site.example:8080", 2: "no url"}


def test_pages_that_are_not_html_are_kept(spark):
    raw = "<title>T</title>\n\n\n\n# as  it is"
    rows = [("http://h/a/notes.md?v=1#x", "text/plain"), ("http://h/a/page.HTML", None), ("http://h/dir/", "text/plain"), ("http://h", None), ("http://h/x", "TEXT/HTML"), ("http://h/x", "text/html; charset=utf-8"), ("http://h/a;b=c", ""), (None, None), ("http://h/f?q=a/", None), ("http://h/a.html\n", "")]
    df = spark.createDataFrame([(k, u, raw, t) for k, (u, t) in enumerate(rows)] + [(20, "http://h/f.txt", None, None)], "page_id long, url string, html string, kind string")
    got = {r.page_id: (r.title, r.text) for r in web.page_texts(df, content_type="kind").collect()}
    as_html = ("T", web.read_page(raw)[1])
    assert got[0] == ("notes.md", raw) and got[1] == got[2] == got[5] == as_html and got[3] == ("http://h", raw) and got[4] == ("x", raw)
    assert got[6] == ("a", raw) and got[7] == (None, raw) and got[8] == as_html and got[20] == ("f.txt", "")
    assert got[9][1] == raw and len(got) == len(rows) + 1
    assert all(r.text == as_html[1] for r in web.page_texts(df.filter("page_id < 20")).collect())


def test_long_texts_are_cut_in_one_pass(spark):
    text = "".join(chr(97 + k % 26) for k in range(7_000)) + " é😀 " * 900
    want = [p for k in range(0, len(text.strip()), 2100) if (p := text.strip()[k : k + 2400].strip())]
    assert one(spark, chunking.overlapping(F.col("v")), text) == want
    assert one(spark, chunking.overlapping(F.col("v"), 10, 7, False), text[:60]) == [p for k in range(0, 60, 3) if (p := text[:60][k : k + 10].strip())]
    assert one(spark, chunking.fixed_windows(F.col("v"), 1000), text) == [text[k : k + 1000] for k in range(0, len(text), 1000)]


def test_compose_syntax():
    text = """services:
  web:
    image: "a#b"  # not a comment in quotes
    ports:
      - "[::1]:8080:80"
      - target: 443
        published: 8443
        host_ip: 10.0.0.1
        protocol: udp
      - 9000
    volumes:
      - ./data:/data:ro
      - named:/x
  db:
    image: pg
volumes:
  named:
"""
    got = compose.read_compose(text)
    assert [(g["service"], g["kind"], g["raw"]) for g in got] == [("web", "service", None), ("web", "port", "[::1]:8080:80"), ("web", "port", "host_ip=10.0.0.1 published=8443 target=443/udp"), ("web", "port", "9000"), ("web", "volume", "./data:/data:ro"), ("web", "volume", "named:/x"), ("db", "service", None)]
    assert got[1]["line_no"] == 5


def test_long_ports_are_told_as_such(spark):
    text = "services:\n  db:\n    ports:\n      - target: 5432\n        published: 5433\n      - target: 1\n      - published: 7\n        target: 8\n  plex:\n    ports:\n      - target: 1\n        published: 2\n        host_ip: 127.0.0.1\n"
    got = compose.ports(compose.parse(spark.createDataFrame([("p", text)], "path string, text string"))).orderBy("line_no").collect()
    assert [(r.service, r.host_ip, r.host_port, r.container_port, r.exposure) for r in got] == [("db", "", "5433", "5432", "LAN_EXPOSED"), ("plex", "127.0.0.1", "2", "1", "LOOPBACK_ONLY")]
    assert got[0].suggestion == "Consider long syntax host_ip: 127.0.0.1 for published port 5433." and got[1].suggestion == "Already loopback-only."


def test_documents_in_archives():
    raw = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<d xmlns:w="{w}"><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></d>')
    assert assets.extract(raw.getvalue(), "application/zip") == (assets.DOCX, "one two\n\nthree", "extracted")
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", "x")
    assert assets.extract(plain.getvalue(), "application/zip")[1:] == ("Archive contents:\na.txt", "extracted")
    assert assets.extract(b"PK", "application/zip")[2] == "error:BadZipFile" and assets.extract(b"", "image/png")[2] == "metadata-only"


def test_references_are_found_in_every_string():
    m = {"content": {"parts": [{"asset_pointer": "file-service://file-ABCDEFGH1"}, "see FILE-SERVICE://file_abcdefgh2 and file-notthisone"]}, "metadata": {"attachments": [{"id": "file-ABCDEFGH1", "name": "p.png"}], "note": "file-plaintext9"}}
    got = assets.references(m)
    assert sorted(a for a, _ in got) == ["abcdefgh1", "abcdefgh1", "abcdefgh2", "notthisone"]
    assert {"id": "file-ABCDEFGH1", "name": "p.png"} in [x for _, x in got]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    got = {r.chunk_id: round(r.c, 3) for r in df.select("chunk_id", search.cosine(F.col("embedding"), search.vector([1.0, 0.0])).alias("c")).collect()}
    assert got == {1: 1.0, 2: -1.0, 3: -1.0, 4: -1.0, 5: 0.707}
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, vector array<float>")
    for parts in (1, 3):
        best = search.search_many(df.repartition(parts), q, limit=2).orderBy("query_id", "place").collect()
        assert [(r.query_id, r.chunk_id) for r in best] == [(8, 5), (8, 1), (9, 1), (9, 5)]


def test_a_failing_model_gives_error_rows(spark):
    def broken(prompts: pd.Series) -> list[str]:
        raise RuntimeError("no model")

    r = classify.predicted(spark.createDataFrame([("a",)], "text string"), "text", broken).first()
    assert r.answer is None and r.error == "RuntimeError: no model"


def test_embedding_is_tried_again(spark):
    state = {"n": 0}

    def flaky(texts: pd.Series) -> list[list[float]]:
        state["n"] += 1
        if state["n"] < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([("a",)], "text string")
    assert embed.embedded(df, "text", flaky, pause=0).first().embedding == [1.0]

    def refused(texts: pd.Series) -> list[list[float]]:
        e = OSError("no such model")
        e.code = 404
        raise e

    with pytest.raises(Exception, match="no such model"):
        embed.embedded(df, "text", refused, pause=60).collect()


def test_metadata_alone_is_not_embedded(spark):
    rows = [(1, "a", "metadata", None, None), (2, "b", "extracted_text", None, None), (3, "c", "extracted_text", [5.0], "m")]
    df = spark.createDataFrame(rows, "id long, text string, content_kind string, embedding array<float>, embedding_model string")
    got = {r.id: r.embedding for r in embed.embed_missing(df, "text", embed.hashing_embedder(2), "m").collect()}
    assert got[1] is None and got[2] is not None and got[3] == [5.0]


def test_a_source_without_chunks_loses_those_it_had(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "source_id long, text string")
    assert embed.replace_sources(old.limit(0), old, touched=old.filter("source_id = 1")).collect() == [(2, "y")]


def test_stored_vectors_are_fetched_by_place(spark, tmp_path, monkeypatch):
    new = spark.createDataFrame([(k, h) for k, h in enumerate(["a", "b", "c", "d", "a", None, "tie"])], "id long, chunk_hash string")
    old = [("a", 1, "m", [1.0, 2.0]), ("a", 2, "x", [9.0, 9.0]), ("b", 1, "x", [3.0, 3.0]), ("c", 1, "m", None), ("d", 3, "m", [4.0, 4.0]), ("d", 5, "m", [5.0, 5.0]), ("unused", 1, "m", [7.0, 7.0]), (None, 1, "m", [8.0, 8.0]), ("tie", 1, None, [6.0, 6.0])]
    folder = str(tmp_path / "index")
    spark.createDataFrame(old, "chunk_hash string, chunk_index int, embedding_model string, embedding array<float>").repartition(3).write.parquet(folder)
    stored = embed.stored_vectors(spark, folder)
    for most in (embed.SENT_POINTERS, 0):  # places sent to the scan, and by a shuffle
        monkeypatch.setattr(embed, "SENT_POINTERS", most)
        for on in (True, False):
            at = embed.located(new, stored, "m", on)
            got = {r.id: (r.embedding, r.embedding_model, r.reused) for r in embed.fetched(at, stored).collect()}
            want = {r.id: (r.embedding, r.embedding_model, r.reused) for r in embed.reuse(new, spark.read.parquet(folder), "m", on).collect()}
            assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and got[0] == got[4] == ([1.0, 2.0], "m", True)
            assert got[3][0] == [5.0, 5.0] and got[1] == (([3.0, 3.0], "x", True) if not on else (None, "m", False)) and got[2] == got[5] == (None, "m", False)
        empty = embed.fetched(embed.located(new.limit(0), stored, "m"), stored)
        assert empty.collect() == [] and empty.columns == ["id", "chunk_hash", "embedding_model", "reused", "embedding"]
    plan = embed.located(new, stored, "m")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip())]
    assert dealt and not any(re.search(r"embedding#", part) for part in dealt)


def test_an_import_starts_changed_conversations_again(spark, tmp_path):
    folder = f"file://{tmp_path}/import"
    kind = "conversation_id long, title string, created_at string, messages array<struct<pos:int,role:string,text:string>>"
    talk = lambda k, text: (k, f"t{k}", "", [(0, "user", text), (1, "assistant", "and an answer")])
    imports.import_batch(spark.createDataFrame([talk(k, f"question {k}") for k in range(5)], kind), folder)
    done = imports.current(spark, folder, "conversations").withColumn("state", F.lit("done"))
    imports.put(done, folder, "conversations")
    imports.put(done.select("conversation_id", F.lit("fact").alias("fact")), folder, "facts")
    imports.import_batch(spark.createDataFrame([talk(0, "question 0"), talk(1, "another question"), talk(9, "new")], kind), folder, derived=("facts",))
    assert {r.conversation_id: r.state for r in imports.current(spark, folder, "conversations").collect()} == {0: "done", 1: "pending", 2: "done", 3: "done", 4: "done", 9: "pending"}
    assert {r.conversation_id for r in imports.current(spark, folder, "facts").collect()} == {0, 2, 3, 4}
    chunks = {r.conversation_id: r.text for r in imports.current(spark, folder, "chunks").collect()}
    assert set(chunks) == {0, 1, 2, 3, 4, 9} and "another question" in chunks[1] and imports.current(spark, folder, "chunks").filter("embedding is null").count() == 0


def test_labels_by_a_model_are_guarded(spark):
    weak, strong = ("UNKNOWN", 0.25, []), ("TECHNICAL", 0.86, [])
    df = spark.createDataFrame([(1, "shared", 0.9, weak), (2, "creative", 0.9, strong), (3, "technical", 0.0, strong), (4, "what", 2.0, strong), (5, None, None, weak)], "id long, l string, c double, k struct<label:string,confidence:double,reasons:array<string>>")
    got = {r.id: (r.g.label, r.g.confidence) for r in df.select("id", classify.guarded(F.col("l"), F.col("c"), F.col("k")).alias("g")).collect()}
    assert got == {1: ("SHARED", 0.69), 2: ("UNKNOWN", 0.30), 3: ("TECHNICAL", 0.86), 4: ("TECHNICAL", 1.0), 5: ("UNKNOWN", 0.25)}


def test_references_carry_what_their_message_says(spark):
    m = '{"id": "m1", "content": {"parts": [{"asset_pointer": "file-service://file-ABCDEFGH1", "size": 7}, "look at this"]}, "metadata": {"attachments": [{"id": "file-ABCDEFGH1", "name": "p.png", "size": 8}]}}'
    found = assets.found_references(spark.createDataFrame([("c", "n", m)], "conversation_id string, node_id string, message string"))
    r = assets.linked(found, spark.createDataFrame([("abcdefgh1", "a")], "alias string, asset_id string")).first()
    assert (r.original_name, r.context) == ("p.png", "look at this")
    assert r.metadata_json == '{"asset_pointer": "file-service://file-ABCDEFGH1", "id": "file-ABCDEFGH1", "name": "p.png", "size": 7}'


def test_line_diff(spark):
    df = spark.createDataFrame([("g", 1, "a\nb"), ("g", 2, "a\nc"), ("h", 1, "x")], "grp string, n int, text string")
    got = reports.line_diff(reports.pairs_of_newest(df, "grp", "text", "n"), "grp").collect()
    assert [(r.grp, r["diff"].splitlines()[-2:]) for r in got] == [("g", ["-b", "+c"])]


def test_the_stand_in_for_a_model(spark):
    """Equal texts have equal vectors of unit length: words counted with a sign at places that their hashes give."""
    def plain(text, dim):
        v = [0.0] * dim
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h >> 31 else -1
        size = sum(x * x for x in v) ** 0.5
        return [x / size if size else 0.0 for x in v]

    texts = ["one two two", "One two TWO", "", "É 日本"]
    got = embed.embedded(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", embed.hashing_embedder(16)).collect()
    assert all(abs(a - b) < 1e-6 for r in got for a, b in zip(r.embedding, plain(texts[r.id], 16)))
    by = {r.id: r.embedding for r in got}
    assert by[0] == by[1] != by[3]


def test_index_reads_and_opens_little(spark, tmp_path):
    """Only rows of the asked terms are read, spans below the best so far stay closed, and the order of segments does not matter."""
    from tallgrass.operators import postings, search

    rows = [(k, f"usual words {'often' if k % 3 else ''} {'rare ' * (k % 7) if k % 2000 == 11 else ''}" + " filler" * (k % 40)) for k in range(20_000)]
    items = spark.createDataFrame(rows, "id long, text string").repartition(4)
    folder = str(tmp_path / "index")
    assert postings.read(spark, folder) is None
    for part in ("id % 5 = 0", "id % 5 > 0"):
        postings.add_segment(items.filter(part), folder, ["text"])
    index = postings.read(spark, folder)
    for query, mode in (("rare usual", "or"), ("often rare", "and"), ("absent usual", "and"), ("absent usual", "or"), ("", "and"), ("usual", "and")):
        want = [(r.id, round(r.rank, 9)) for r in search.full_text(items, query, ["text"], mode, 10).collect()]
        assert [(r.id, round(r.rank, 9)) for r in postings.full_text(index, query, mode, 10).collect()] == want
    s = postings.Search(index, "rare usual", "or")
    best = [r.score for r in s.scores(None).orderBy(F.desc("score")).limit(5).collect()]
    spans, near = s.bounds().count(), s.bounds().filter(F.col("bound") >= best[-1] - 1e-9).count()
    assert 0 < near <= spans / 2
    assert "In(term, [" in s.scores(None)._jdf.queryExecution().toString()
    allowed = items.filter("id % 2 = 1").select("id")
    odd = [r.id for r in postings.full_text(index, "rare usual", "or", 10, allowed).collect()]
    assert odd == [r.id for r in search.full_text(items, "rare usual", ["text"], "or", 10, F.col("id") % 2 == 1).collect()]


def test_imports_lose_nothing_and_take_the_last_version(spark, tmp_path):
    """Turns in several runs make up the whole conversation, and of two versions the later one by file and position holds, however rows are dealt."""
    folder, kind = f"file://{tmp_path}/a", "conversation_id long, title string, created_at string, messages array<struct<pos:int,role:string,text:string>>"
    part = lambda *m: spark.createDataFrame([(1, "t", "", [(k, "user", x) for k, x in m])], kind)
    for messages in ([(0, "a"), (1, "b")], [(2, "c")], [(1, "B")]):
        imports.import_batch(part(*messages), folder, unite=True)
    assert [(m.pos, m.text) for m in imports.current(spark, folder, "conversations").first().messages] == [(0, "a"), (1, "B"), (2, "c")]
    assert "B" in imports.current(spark, folder, "chunks").first().text and imports.current(spark, folder, "chunks").count() == 1
    imports.import_batch(part((0, "only")), folder)
    assert [m.text for m in imports.current(spark, folder, "conversations").first().messages] == ["only"]
    versions = [(k, "t", "", [(0, "user", f"{f}{p}")], f, p) for k in range(30) for f in ("a.json", "b.json") for p in range(3)]
    for parts in (1, 5):
        to = f"file://{tmp_path}/v{parts}"
        imports.import_batch(spark.createDataFrame(versions[::-1] if parts == 5 else versions, kind + ", source_file string, position int").repartition(parts), to)
        assert {r.messages[0].text for r in imports.current(spark, to, "conversations").collect()} == {"b.json2"}


def test_versioned_tables_split_merge_and_clear(spark, tmp_path, monkeypatch):
    """Buckets split as they grow, deltas count over what is below them, and files that no manifest names go."""
    import os

    from tallgrass.sources import versioned

    monkeypatch.setattr(versioned, "BUCKET_ROWS", 40)
    monkeypatch.setattr(versioned, "MOST_DELTAS", 2)
    folder, want = f"file://{tmp_path}/t", {}
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    for run in range(7):
        rows = {k: [f"{run}-{k}-{i}" for i in range(k % 3)] for k in range(run * 20, run * 20 + 60)}
        want |= rows
        touched = frame([(k, "") for k in rows])
        versioned.Store(spark, folder, "k").commit({"t": (frame([(k, v) for k, vs in rows.items() for v in vs]), touched)})
        store = versioned.Store(spark, folder, "k")
        got = {}
        for r in store.read("t").collect():
            got.setdefault(r.k, set()).add(r.v)
        assert got == {k: set(v) for k, v in want.items() if v}
    leaves = store._leaves("t")
    assert len(leaves) > 2 and all(sum(r.rows for r in v if r.base) <= 80 for v in leaves.values())
    assert sum(0.5 ** d for d, _ in leaves) == 1  # buckets cover all keys, each once
    near = store.read("t", near=frame([(130, "")]))
    assert {r.v for r in near.filter("k = 130").collect()} == set(want[130]) and near.count() < store.read("t").count()
    named = {r.path for v in store._versions() for r in store._manifest(v)} - {None}
    there = {f"file://{d}" for d, _, _ in os.walk(tmp_path) if "_bucket=" in d}
    assert there == named and len(store._versions()) == versioned.KEPT
    first, second = versioned.Store(spark, folder, "k"), versioned.Store(spark, folder, "k")
    first.commit({"t": (frame([(1, "x")]), frame([(1, "")]))})
    with pytest.raises(RuntimeError):
        second.commit({"t": (frame([(1, "y")]), frame([(1, "")]))})


def test_arrays_are_read_by_many_tasks(spark, tmp_path):
    """Elements of arrays that are cut anywhere, inside strings, escapes and nested values too, are those of a plain parser."""
    import json

    from tallgrass.sources import json_arrays, readers

    tricky = ['a "quoted" }{ [ ] , \\', "\\\\\" } ]", "}" * 40, "{" * 9, "é日本 😀 }", "\n\t}", '\\"}\\"', ""]
    rows = [{"id": f"c{k}", "title": tricky[k % 8] * (k % 5), "mapping": {f"n{j}": {"parent": None, "message": {"author": {"role": "user"}, "content": {"parts": [tricky[(k + j) % 8] * (j + 1), {"text": "}"}]}}} for j in range(k % 4)}} for k in range(120)]
    rows.append({"id": "long", "title": "x}" * 3000, "mapping": {}})
    for name, value in (("conversations-1.json", json.dumps(rows)), ("conversations-2.json", json.dumps(rows[:40], indent=2, ensure_ascii=False)), ("conversations-3.json", json.dumps(rows[5])), ("conversations-4.json", "[]"), ("conversations-5.json", ""), ("conversations-6.json", "[\n" + json.dumps(rows[7]) + "\n]\n")):
        (tmp_path / name).write_text(value)
    want = sorted(json.dumps(r, sort_keys=True) for part in (rows, rows[:40], rows[5:6], rows[7:8]) for r in part)
    plain = lambda df: sorted((r.conversation_id, r.title, str(sorted((n.node_id, n.text) for n in r.nodes))) for r in df.collect())
    read = spark.read.schema(readers.EXPORT).option("multiLine", True).option("pathGlobFilter", "conversations*.json").json(str(tmp_path))
    whole = plain(readers.exports(read.withColumn("source_file", F.col("_metadata.file_path"))))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (97, 401, 5000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = json_arrays.elements(spark, str(tmp_path), "conversations*.json")
            if size == 401:
                assert got.rdd.getNumPartitions() > 50
            assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in got.collect()) == want, size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        assert plain(readers.chat_exports(spark, str(tmp_path))) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_places_across_tasks(spark, few, monkeypatch):
    """A key with nearly all rows is dealt to many tasks, with the places and sums of one window."""
    import random

    from tallgrass.operators import ranks
    from tallgrass.operators.ranks import numbered

    monkeypatch.setattr(ranks, "FEW", few)

    rnd = random.Random(7)
    rows = [(None if k % 50 == 3 else "hot" if k % 10 else f"k{k % 7}", rnd.randrange(300), k % 13, k) for k in range(6000)]
    df = spark.createDataFrame(rows, "key string, o int, v long, id int").repartition(5)
    got = numbered(df, ["key"], ["o"], "v")
    assert got.columns == ["key", "o", "v", "id", "_place", "_total"]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.key or "", r._place)):
        found.setdefault(r.key, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for rs in found.values():
        assert [r._place for r in rs] == list(range(1, len(rs) + 1)) and [r.o for r in rs] == sorted(r.o for r in rs)
        total = 0
        for r in rs:
            total += r.v
            assert r._total == total
    assert numbered(df.limit(0), ["key"], ["o"]).collect() == []


def test_large_archives_are_inflated_step_by_step():
    """A document whose text would fill gigabytes costs what its first signs do; broken ones are errors."""
    import tracemalloc

    def docx(*parts):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open("word/document.xml", "w", force_zip64=True) as f:
            for part, times in parts:
                for _ in range(times):
                    f.write(part)
        return raw.getvalue()

    head, word = b'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">', b"<w:t> " + b"x" * 99_994 + b"</w:t>"
    many = docx((head, 1), (b"<w:p><w:r>" + word + b"</w:r></w:p>", 3000), (b"</w:document>", 1))
    one = docx((head + b"<w:p>", 1), (word, 3000), (b"</w:p></w:document>", 1))
    blank = docx((head + b"<w:p><w:t>", 1), (b" " * 100_000, 300), (b"end</w:t></w:p></w:document>", 1))
    tracemalloc.start()
    for content in (many, one):
        mime, text, status = assets.extract(content, assets.DOCX)
        assert (mime, status, len(text)) == (assets.DOCX, "extracted", assets.MOST_TEXT) and text.startswith("xxx")
    assert assets.extract(blank, assets.DOCX)[1] == "end"
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert assets.extract(docx((head + b"<w:p>", 1)), assets.DOCX)[2] == "error:ParseError"
    assert assets.extract("é".encode() * 1_500_000, "text/plain")[1] == "é" * 1_000_000


def test_chunk_borders():
    import random

    rnd = random.Random(3)
    for _ in range(200):
        sizes, target = [rnd.choice((1, 10, 500, 1000, 2598, 2599, 3210)) for _ in range(rnd.randrange(12))], 2600
        groups = []
        for n in sizes:
            if groups and sum(groups[-1]) + 2 * len(groups[-1]) + n + 2 <= target:
                groups[-1].append(n)
            else:
                groups.append([n])
        assert [sizes[i:j] for i, j in chunking.borders(np.array(sizes, np.int64), target)] == groups


@pytest.mark.parametrize("text, want", [
    ("services:\n  web:\n      ports:\n        - 80:80\n", [("web", "service"), ("web", "80:80")]),
    ("services:\n    web:\n      ports:\n      - '1:2'  # why\n", [("web", "service"), ("web", "1:2")]),
    ("x:\n  services:\n    a:\n     ports:\n       - target: 80\n         published: \"8080\"\n         host_ip: 127.0.0.1\n    b:\n     volumes:\n     - /x:/y\n", [("a", "service"), ("a", "host_ip=127.0.0.1 published=8080 target=80/tcp"), ("b", "service"), ("b", "/x:/y")]),
    ("services:\n a:\n  image: x\n  ports:\n  - target: 1\n  - 5:5\n  environment:\n  - A=1:2\n  volumes:\n  - ./d:/d\n", [("a", "service"), ("a", "5:5"), ("a", "./d:/d")]),
    ("name: x\nports:\n - 1:1\n", []), ("services:\n# none\n\n", []), ("", []),
])
def test_compose_of_any_indentation(text, want):
    from tallgrass.operators import compose

    assert [(r["service"], "service" if r["kind"] == "service" else r["raw"]) for r in compose.read_compose(text)] == want


def test_references_without_names_or_dates(spark):
    files = spark.createDataFrame([("a", ".txt", "text/plain", "")], "asset_id string, ext string, mime string, text string")
    refs = spark.createDataFrame([("a", "", "t", "2", 1, ""), ("a", "n", None, None, 2, "c")], "asset_id string, original_name string, title string, created_at string, conversation_id int, context string")
    assert assets.asset_texts(files, refs).first().text == "Asset file_a.txt\nMIME type: text/plain\n\nConversation references:\nOriginal name: n\nConversation:  () id=2\nc\nConversation: t (2) id=1"


def test_upsert_does_not_depend_on_parts(spark):
    from tallgrass.sources import tables

    new = spark.createDataFrame([(1, k, f"v{k % 3}") for k in range(5)], "key int, n int, v string")
    old = spark.createDataFrame([(1, 9, "old"), (2, 9, "old")], "key int, n int, v string")
    for parts in (1, 2, 5):
        assert sorted(map(tuple, tables.upserted(old, new.repartition(parts), "key").collect())) == [(1, 4, "v1"), (2, 9, "old")]
        tie = new.withColumn("seq", F.lit(3)).repartition(parts)
        assert sorted(map(tuple, tables.upserted(old.withColumn("seq", F.lit(3)), tie, "key", "seq").select("key", "n", "v").collect())) == [(1, 4, "v1"), (2, 9, "old")]


def test_queries_come_in_blocks_of_bytes(spark, sf):
    """Blocks of a few vectors give what one block does; no queries give nothing."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    chunks, q = e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = lambda size: sorted((r.query_id, r.place, r.chunk_id) for r in search.search_many(chunks, q, broadcast_bytes=size).collect())
    assert rows(1500) == rows(64 << 20) != []
    assert search.search_many(chunks, q.limit(0)).collect() == []


def test_terms_of_large_vocabularies(spark):
    """The automaton gives what looking for each term gives: overlapping, nested, repeated and empty ones, in any script."""
    texts = ["ushers", "she said he", "", None, "naïve 漢字かな", "a" * 50, "aab" * 20, "\U0001f600 x\ny"]
    terms = ("he", "she", "hers", "us", "", "aa", "aaa", "ab", "漢字", "字か", "\U0001f600", "x\ny", "he", "absent")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    for some in (terms, ("", ""), ("he",), ()):
        want = {k: [] if s is None else [t for t in some if t in s] for k, s in enumerate(texts)}
        for many in (0, 64):
            assert {r.k: r.f for r in df.select("k", M.found(F.col("v"), some, many).alias("f")).collect()} == want
    table = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    for size in (2, None):
        got = {r.k: r.terms for r in M.found_of(df, F.col("v"), table, size=size).collect()}
        assert got == {k: [] if s is None else sorted(t for t in set(terms) if t in s) for k, s in enumerate(texts)}
    assert M.found_of(df, F.col("v"), table.limit(0)).filter(F.size("terms") > 0).count() == 0


def test_labels_and_scans_by_large_vocabularies(spark, monkeypatch):
    """Labels, projects, risks and lines are the same by the automaton."""
    df = spark.createDataFrame([(1, "Docker on Linux\nrm -rf / and sudo rm\n"), (2, "glitter wings\n| bash curl \n"), (3, None), (4, "")], "k int, text string")
    names = {"One": ("docker", "linux"), "Two": ("wings",), "None": ()}
    def every():
        labels = df.select("k", classify.by_keywords(F.col("text")).alias("l"), classify.projects_for(F.array(F.lit("x")), F.col("text"), names).alias("p"))
        return labels.orderBy("k").collect(), scan.evaluate(df, "k").orderBy("k").collect(), scan.line_hits(df, "k", "text").orderBy("k", "line_no", "pattern").collect()
    plain = every()
    monkeypatch.setattr(M, "MANY", 0)
    assert every() == plain and len(plain[2]) == 4


def test_files_of_any_size_are_hashed(spark, tmp_path, monkeypatch):
    """One digest whatever way a file is read; a file that no value can hold takes steps."""
    (tmp_path / "empty.txt").touch()  # no reader of Spark lists it
    held = {"a.txt": b"a", "b c.txt": b"abc" * 1000, "d%20e.txt": b"x" * 5000, "f.zip": b"PK\x03\x04" + bytes(6000), "chat.html": b"no attachment"}
    (tmp_path / "in").mkdir()
    for name, content in held.items():
        (tmp_path / "in" / name).write_bytes(content)
    monkeypatch.setattr(digests, "STEP", 700)
    for largest in (-1, 4000, 1 << 28):
        monkeypatch.setattr(digests, "LARGEST", largest)
        got = {r.path.split("/")[-1]: r for r in digests.contents(spark, str(tmp_path), head=1000).collect()}
        assert {k: r.sha for k, r in got.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in held.items()}
        for k, v in held.items():
            assert got[k].size == len(v) and got[k].whole == (len(v) <= largest) and bytes(got[k].content) == (v if got[k].whole else v[:1000])
        found = readers.attachments(spark, str(tmp_path)).select("path", "sha", assets.mime(F.col("path"), F.col("content")).alias("mime")).collect()
        assert {(r.path.split("/")[-1], r.mime) for r in found} == {("a.txt", "text/plain"), ("b c.txt", "text/plain"), ("d%20e.txt", "text/plain"), ("f.zip", "application/zip")}


def test_a_file_beyond_two_gib(spark, tmp_path):
    with open(tmp_path / "large.dat", "wb") as f:
        f.truncate((1 << 31) + 10)
    digest = hashlib.sha256()
    for _ in range(1 << 11):
        digest.update(bytes(1 << 20))
    digest.update(bytes(10))
    (row,) = readers.file_hashes(spark, str(tmp_path)).collect()
    assert row.sha == digest.hexdigest()
    (row,) = readers.attachments(spark, str(tmp_path)).select("size", "whole", F.length("content").alias("n")).collect()
    assert (row["size"], row.whole, row.n) == ((1 << 31) + 10, False, digests.HEAD)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_merges_write_few_files_anew(spark, tmp_path, kind):
    """One per cent of changed keys in a range; one result under any partitioning; new columns; a merge that comes too late."""
    key = F.col("id").cast(kind) if kind == "long" else F.lpad(F.col("id").cast("string"), 6, "0")
    base = spark.range(10_000).select(key.alias("k"), F.lit(0).alias("seq"), F.concat(F.lit("v"), "id").alias("v"))
    table = lambda: ranged.Ranged(spark, str(tmp_path), "k", "seq", 100)
    assert table().read() is None and table().merge(base.limit(0)) == {"files": 0, "rewritten": 0, "rows": 0}
    table().merge(base.unionByName(base.limit(1).withColumn("k", F.lit(None).cast(kind))))
    late, store = table(), table()
    assert 80 <= len(store.files) <= 130 and sum(f.rows for f in store.files) == 10_000
    assert all(a.largest < b.least for a, b in zip(store.files, store.files[1:]))
    some = base.filter(F.col("v").isin(*[f"v{k}" for k in range(4000, 4100)]))
    changes = some.select("k", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seq"), F.lit("x").alias("v"), F.lit("more").alias("w")).withColumn("v", F.concat("v", "seq"))
    tied = changes.filter("seq = 5").withColumn("v", F.lit("x49"))
    before = {f.path for f in store.files}
    said = store.merge(changes.unionByName(tied).repartition(7))
    assert said["files"] == len(before) and said["rewritten"] <= 4 and len(before - {f.path for f in store.files}) == said["rewritten"]
    got = {r.k: (r.seq, r.v, r.w) for r in table().read().collect()}
    mine = {r.k for r in some.select("k").collect()}
    assert sorted(table().read().columns) == ["k", "seq", "v", "w"]
    assert len(got) == 10_000 and all(got[k] == (5, "x5", "more") for k in mine)
    assert all(v[0] == 0 and v[2] is None for k, v in got.items() if k not in mine)
    with pytest.raises(RuntimeError):
        late.merge(some)
    store.merge(some.withColumn("seq", F.lit(3)))  # older than what is stored
    assert {r.v for r in store.read().filter(F.col("k").isin(*mine)).collect()} == {"x5"}
    beyond = spark.range(20_000, 20_350).select(key.alias("k"), F.lit(1).alias("seq"), F.lit("n").alias("v"))
    store.merge(beyond)
    assert store.read().count() == 10_350 and all(a.largest < b.least for a, b in zip(store.files, store.files[1:]))
    assert max(f.rows for f in store.files) < 300


def test_many_small_files_are_dealt_and_read_as_bytes(spark, tmp_path):
    """the writers of many files were a single task, and each whole text looked for codecs."""
    from tallgrass.plans import files

    df = spark.range(200).select((F.col("id") % 5).alias("brand"), (F.col("id") % 20).alias("part"), F.concat(F.lit("Ä "), F.col("id").cast("string")).alias("text"))
    folder = str(tmp_path / "many")
    files._many(files._dealt(df, 20, "brand", "part").write).partitionBy("brand", "part").text(folder)
    written = list((tmp_path / "many").rglob("part-*.txt"))
    assert len({p.name.split("-")[1] for p in written}) > 4 and len({p.parent for p in written}) == 20
    before = spark.conf.get(readers.LISTER_KEY)
    got = readers.compose_files(spark, folder, "*.txt", ())
    assert spark.conf.get(readers.LISTER_KEY) == before
    assert "binaryFile" in got._jdf.queryExecution().toString()
    assert sorted(x for r in got.collect() for x in r.text.splitlines()) == sorted(f"Ä {k}" for k in range(200))
    plain = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("_metadata.file_path", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_spans_are_large_and_words_are_those_of_the_pattern(spark, tmp_path):
    """an index of short spans has a row for nearly every term and span."""
    import pyarrow as pa

    from tallgrass.operators import postings

    texts = ["", " the of", "it's é1 b2_c3  ", "日本 x日y", "of of  of", "\x00tab\tnew\nline-"]
    code, text, terms = postings._tokens(pa.array(["no", *texts]).slice(1))
    found = [[terms[c] for c, t in zip(code, text) if t == k] for k in range(len(texts))]
    assert found == [re.findall("[a-z0-9]+", t) for t in texts] and not len(postings._tokens(pa.array([], pa.string()))[0])
    items = spark.range(3000).coalesce(1).select("id", F.lit("common words here").alias("text"))
    postings.add_segment(items, str(tmp_path / "index"), ["text"])
    assert postings.read(spark, str(tmp_path / "index")).count() == 4  # three terms and what is known of the span


def test_rows_of_a_commit_are_made_once(spark, tmp_path):
    """a commit made its rows again to see which keys have none, and an import its chunks, which it then split."""
    from tallgrass.sources.versioned import Store

    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(40).withColumn("v", F.col("id") * 2).mapInPandas(work, "id long, v long")
    Store(spark, str(tmp_path), "id").commit({"t": (rows, spark.range(50))})
    assert made.value == 40
    Store(spark, str(tmp_path), "id").commit({"t": (spark.range(0).withColumn("v", F.lit(1).cast("long")), spark.range(10, 20))})
    assert sorted(r.id for r in Store(spark, str(tmp_path), "id").read("t").collect()) == [*range(10), *range(20, 40)]


def test_a_merge_without_the_rest_leaves_stored_texts_where_they_are(spark):
    """what an import does not name was read and shuffled, only to be left out."""
    schema = "conversation_id int, digest string, hash_version string, title string, state string, attempts int, last_error string"
    old = spark.createDataFrame([(1, "a", "analysis-v1", "t", "done", 2, None), (2, "b", "analysis-v1", "t", "done", 1, "e"), (3, "c", "analysis-v1", "t", "done", 1, None)], schema)
    new = spark.createDataFrame([(1, "a", "analysis-v1", "T"), (2, "z", "analysis-v1", "T"), (4, "d", "analysis-v1", "T")], schema.split(", state")[0])
    want = archive.merge(new, old).join(new.select("conversation_id"), "conversation_id", "left_semi")
    got = archive.merge(new, old, rest=False)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_items_with_fingerprints_are_dealt_once(spark):
    """facts were dealt by their texts and then again by fingerprint."""
    from tallgrass.operators import knowledge

    rows = [(k, f"c{k % 3}", ("P one", "p-one", None)[k % 3 if k % 7 else 2], "bug" if k % 2 else "error", f"s{k % 4}" if k % 11 else None, f"e{k}", "current", "HIGH", "d") for k in range(60)]
    facts = spark.createDataFrame(rows, "id long, source_conversation_id string, project string, category string, statement string, evidence string, temporal_status string, confidence string, source_date string")
    normal = knowledge.fingerprinted(facts)
    assert sorted(map(str, normal.drop("fingerprint").collect())) == sorted(map(str, knowledge.items(facts).collect()))
    empty = knowledge.items(facts).limit(0).select(F.lit("").alias("fingerprint"), "source_conversation_id", F.lit("").alias("slug"), "category", "title", "statement", "evidence", "status", "confidence", "source_date")
    got, want = knowledge.upsert(normal, empty), knowledge.upsert(knowledge.items(facts), empty)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_routed_bodies_stay_where_they_are(spark, monkeypatch):
    """rows met their parts, and bodies their projects, by shuffles."""
    from tallgrass.operators import ranks

    facts = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("project"), F.when(F.col("id") % 2 > 0, "error").otherwise("fact").alias("category"), "id", F.concat(F.lit("s"), "id").alias("statement"))
    projects = spark.createDataFrame([("p1",), ("p2",), ("none",), (None,)], "project string")
    docs = {"A": ("error", "fact"), "B": ("missing",)}
    few = sorted(map(str, reports.routed(facts, docs, projects).collect()))
    monkeypatch.setattr(ranks, "FEW", 10)
    plan = (df := reports.routed(facts, docs, projects))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sorted(map(str, df.collect())) == few and plan.count("SortMergeJoin") == 1  # that of names without bodies
    monkeypatch.setattr(ranks, "SENT_PARTS", 0)
    monkeypatch.setattr(reports, "SENT_PARTS", 0)
    assert sorted(map(str, reports.routed(facts, docs, projects).collect())) == few


def test_models_and_cutters_get_few_texts_at_a_time(spark):
    """F6, F8: batches were of 10,000 texts, and workers kept the memory."""
    from tallgrass.sources import batches

    before = spark.conf.get(batches.BATCH_KEY)
    try:
        for made in (lambda df: embed.embedded(df, "text", lambda texts: [[float(len(texts))]] * len(texts)), lambda df: chunking.split_messages(df, "id", "text")):
            spark.conf.set(batches.BATCH_KEY, "10000")
            got = made(spark.range(2000).coalesce(1).withColumn("text", F.lit("a word"))).collect()
            assert len(got) == 2000 and spark.conf.get(batches.BATCH_KEY) == str(batches.BATCH_ROWS)
            assert all(r.embedding[0] <= batches.BATCH_ROWS for r in got if "embedding" in r)
    finally:
        spark.conf.set(batches.BATCH_KEY, before)
