"""The training-data operators against brute force, and on the edges of their inputs."""

import collections
import hashlib
import inspect
import math
import os
import re
import struct
import sys
import time
import tracemalloc
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import components, ctw, decontaminate, langid, licences, line_dedup, media, minhash, packing, quality, token_store, tokens
from tallgrass.llm import queries as Q
from tallgrass.llm import vectors as V

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import compare  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = "One passage that many documents share, word for word, with enough words to be a window of its own in any of them."
#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves.
EDGES = [
    (1, "Alpha beta gamma delta epsilon zeta.\n" + SHARED), (2, None), (3, ""), (4, " \n\t "), (5, "word"), (6, SHARED), (6, SHARED), (7, SHARED), (7, "another text under the same id, quite unlike the first one"),
    (None, SHARED), (None, None), (8, "tab\tand  double  spaces\r\nnbsp here   x."), (9, "x " * 30_000), (10, "É È ü ß 日本語 Σας. don't I'm 12.5 a.b, c., <|endoftext|>"), (11, "%%% $$$ !!!"), (12, SHARED.replace("many", "several")),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "d": F.lit(0), "same": F.lit(1), "mark": F.lit(0.1), "row": F.lit(9), "gone": F.lit(0), "of_id": F.lit(0), "lost": F.lit(1), "kept_text": F.lit("k"), "dw": F.lit("z"), "u": F.lit(1), "h": F.lit("h"), "n": F.lit(2), "band": F.lit(0), "component": F.lit(5), "score": F.lit(0.5), "w": F.lit("w"), "pos": F.lit(1), "rep": F.lit(3)}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, EDGES).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (6, 1), (11, 0), (None, 1), (9, None), (12, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(Q.sql()))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = db.sql(Q.sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert compare.digest([tuple(r[c] for c in cols) for r in df.collect()]) == compare.digest([tuple(x[i] for i in at) for x in want.fetchall()])


# 1


def removed_by_force(rows, percent=80):
    """Lines with an earlier one of enough similarity; rows are (doc_id, text)."""
    lines = [((-1 << 63) if d is None else d, k, set(words(line))) for d, t in set(rows) for k, line in enumerate((t or "").split("\n")) if words(line)]
    out = set()
    for d, k, s in lines:
        for e, m, z in lines:
            if (e, m) < (d, k) and 100 * len(s & z) >= percent * len(s | z):
                out.add((d, k))
    return out


def test_line_dedup_by_force(spark, documents, edges):
    for df in (documents.limit(60), edges):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        fixed = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {(r.doc_id, r.line) for r in line_dedup.removed_lines(fixed).collect()}
        assert got == removed_by_force(rows)


def test_line_dedup_keeps_rows_and_columns(edges, empty):
    out = line_dedup.dedup_lines(edges)
    assert out.count() == len(EDGES) and set(edges.columns) <= set(out.columns)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (None, SHARED) in got  # a row without an id comes first
    assert (6, "") in got and (7, "") in got and (2, None) in got
    kept = line_dedup.without_repeats(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.filter("doc_id in (6, 12)").collect()} == set()
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("sent", [1 << 22, -1])
def test_line_dedup_tells_rows_of_one_id_apart(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", sent)  # below it tables are sent to every task, beyond it they are joined
    alone = [(7, "third start here\nunlike anything else given"), (None, "north south\neast west up")]
    rows = [(1, "first of them\nalpha beta gamma delta"), (7, "another start\nalpha beta gamma delta"), (None, "red green blue\nred green blue"), *alone]
    twins = [(None, "kappa lambda mu nu"), (None, "kappa lambda mu nu\nxi omicron pi"), (None, "kappa lambda mu nu"), (9, "rho sigma tau\nchi"), (9, "rho sigma tau\npsi")]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows + twins, SCHEMA).repartition(3)).collect()]
    assert set(alone) < set(got) and (7, "another start") in got and (None, "red green blue") in got and len(got) == len(rows + twins)
    lines = [x for _, t in got for x in t.split("\n")]
    assert lines.count("kappa lambda mu nu") == lines.count("rho sigma tau") == 1 and {"xi omicron pi", "chi", "psi"} < set(lines)
    kept = {(r.doc_id, r.text) for r in line_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(alone) < kept


def test_line_dedup_with_many_candidates(spark):
    base = [f"w{k}" for k in range(20)]
    rows = [(k, " ".join(base[:19] + [f"v{k % 40}"]) + "\n" + " ".join(base[:12] + [f"x{k}_{j}" for j in range(8)])) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {(r.doc_id, r.line) for r in line_dedup.removed_lines(df).collect()} == removed_by_force(rows)


def thue_morse(n):
    """A word and its complement, which hashes that are polynomials modulo 2 ** 64 cannot tell apart."""
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join("ab"[x] for x in out[:n]), "".join("ba"[x] for x in out[:n])


@pytest.mark.parametrize("n", [512, 1000, 1024, 4096])
def test_words_of_one_form_are_told_apart(spark, n):
    a, b = thue_morse(n)
    buf = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    h = V.hashes(buf, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert h[0] != h[1]
    texts = [f"{a} and words", f"{b} and words"]
    for path, end in ((tokens.BYTE_BPE, 2), (tokens.WORD_BPE, 1)):  # 4, 8
        for k, ids in tokens.encoded(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0, path, path == tokens.WORD_BPE, end):
            assert ids.tolist() == ids_by_force(path, texts[k], end)
    if n != 1024:
        return
    df = spark.createDataFrame([(k, x) for k, x in enumerate((a, b))], SCHEMA)
    assert line_dedup.removed_lines(df).count() == 0  # 1
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0, 1}  # 6
    train = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 != 2][0]
    held = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    got = {r.doc_id: r.n_known for r in ctw.scores(spark.createDataFrame([(train, a), (held, b)], SCHEMA)).collect()}
    assert got == {train: 2, held: 1}  # 5: of the other word the end alone is known


def test_parts_with_one_hash_get_ids_of_their_own(monkeypatch):
    texts = ["one two three four", "five six two one", "two. six, one"]
    want = [ids_by_force(tokens.WORD_BPE, x, 1) for x in texts]
    enc = tokens.Encoder(tokens.WORD_BPE, True, 1)
    monkeypatch.setattr(V, "hashes", lambda buf, s, e, lower=True: (e - s).astype(np.uint64))
    buf, off = V.text_bytes(pa.array(texts))
    ids, at = enc.encode(buf, off)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want


# 2


def contaminated_by_force(rows, items, width=13):
    cut = lambda t: re.findall(decontaminate.WORD, (t or "").translate(LOWER))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            n = min(width, len(w))
            for k in range(len(w) - n + 1):
                wins[n, tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, ids = cut(t), set(), set()
        for n in {n for n, _ in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get((n, tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination_by_force(spark, edges, empty):
    items = [(1, SHARED), (2, "word"), (3, None), (4, ""), (None, SHARED), (5, "x x x x x x x x x x x x x x"), (6, "delta epsilon"), (7, SHARED)]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    for most in (200_000, 0):  # broadcast, and not
        got = decontaminate.contamination(edges, b, broadcast_rows=most).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got], key=str) == contaminated_by_force(rows, items)
    assert decontaminate.contamination(empty, b).count() == 0 and decontaminate.contamination(edges, b.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.clean(edges, b)
    assert kept.columns == edges.columns and kept.count() == sum(not x[4] for x in contaminated_by_force(rows, items))


def test_decontamination_is_native(edges, spark):
    plan = decontaminate.contamination(edges.select("doc_id", "text"), edges.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_clashing_names(spark, edges, labels):
    """Columns whose names operators use themselves are passed on as they are."""
    taken = edges.withColumns({c: F.lit(c) for c in ("_gone", "_id", "_d", "_h", "_same", "n_lines", "n_removed", "H", "Mark")})
    benchmark = spark.createDataFrame([(1, SHARED)], "item_id long, text string")
    for out in (line_dedup.without_repeats(taken), decontaminate.clean(taken, benchmark), minhash.one_of_each(taken), quality.accepted(taken, labels)):
        assert out.columns == taken.columns and {r["_gone"] for r in out.collect()} <= {"_gone"}
    out = line_dedup.dedup_lines(taken)
    assert out.columns == [*taken.columns, "n_lines_", "n_removed_"] and {r.n_lines for r in out.collect()} == {"n_lines"}


# 3, 7


def test_languages(spark, edges, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    out = {(r.doc_id, r.lang_pred) for r in langid.languages(edges).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (11, "und"), (None, "und"), (10, "en")} <= out
    assert langid.languages(edges).count() == len(EDGES) and langid.languages(empty).count() == 0


def test_languages_by_force(spark):
    """Each step with plain dictionaries: counts, IDF, unit vectors, centroids that are the texts themselves, cosine."""
    rows = [(k, text, lang) for k, (text, lang) in enumerate([("der hund und die katze", "de"), ("le chien et la chatte", "fr"), ("the dog and the cat", "en"), ("il cane e la gatta", "it")] * 3)]
    part = lambda d: zlib.crc32(str(d).encode()) % 4
    train = [(t, g) for d, t, g in rows if part(d) != 2]

    def grams(text):
        data, out = bytes(langid.FOLD[list(text.encode())]), collections.Counter()
        for k in range(len(data)):
            for n, mark in ((1, 1 << 24), (2, 1 << 25), (3, 0)):
                if k + n <= len(data):
                    out[((int.from_bytes(data[k : k + n], "big") + mark) * 0x9E3779B1 % (1 << 32)) >> (32 - 13)] += 1
        return out

    df = collections.Counter(p for t, _ in train for p in grams(t))
    idf = lambda p: math.log((1 + len(train)) / (1 + df[p])) + 1

    def unit(text):
        v = {p: math.log1p(n) * idf(p) for p, n in grams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {p: x / size for p, x in v.items()}

    centres = {(g, t): unit(t) for t, g in set(train)}
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    for r in got:
        v = unit(rows[r.doc_id][1])
        near = {g: max(sum(x * c.get(p, 0) for p, x in v.items()) for (h, _), c in centres.items() if h == g) for g, _ in centres}
        assert abs(r.score - max(near.values())) < 1e-3 and r.lang_pred == max(near, key=near.get)


def test_many_languages_and_ties(spark):
    rows = [(k, f"language{k % 300:03d} " * 3 + chr(0x4E00 + 7 * (k % 300)) * 8, f"l{k % 300:03d}") for k in range(1200)] + [(5000 + k, "same words here", g) for k in range(40) for g in ("aa", "bb")]
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()}
    plain = [(d, g) for d, _, g in rows[:1200] if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(x in got for x in plain) >= 0.98 * len(plain)
    assert {g for d, g in got if d >= 5000} == {"aa"}  # the first in order


def test_samples_are_bounded_under_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    monkeypatch.setattr(quality, "SAMPLE", 20)
    rows = [(1, "one row many times", "en")] * 3000 + [(k, f"row {k}", "en") for k in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))).collect()
    assert len(got) == 20 and len({r.text for r in got}) == 20
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 400)], "doc_id long, quality int")
    assert quality.classify(df, marks).count() == len(rows)


def test_quality_by_force(spark):
    """A document's score by a plain forward pass: passages, encoder, gated attention, logistic layer."""
    sf = "/root/testdata/sf0.001"
    df, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = {k: v.astype(np.float64) for k, v in quality.learn(df, marks.filter(~quality.held_out())).items()}
    rows = df.select("doc_id", "text").limit(40).collect()
    got = {r.doc_id: r.score for r in quality.score(df, {k: v.astype(np.float32) for k, v in m.items()}).collect()}
    squash = lambda z: 1 / (1 + math.exp(-z))
    for r in rows:
        x, _ = quality.passages(*V.text_bytes(pa.array([r.text])))
        bag, marks_of = [], []
        for p in x.astype(np.float64):
            h = [math.tanh(sum(p[i] * m["W"][i, j] for i in range(len(p))) + m["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * m["V"][i, j] for i in range(len(h)))) * squash(sum(h[i] * m["U"][i, j] for i in range(len(h)))) for j in range(quality.GATE)]
            bag.append(h)
            marks_of.append(math.exp(sum(g * w for g, w in zip(gate, m["w"]))))
        z = [sum(a * h[j] for a, h in zip(marks_of, bag)) / sum(marks_of) for j in range(quality.HIDDEN)]
        assert abs(got[r.doc_id] - squash(sum(a * b for a, b in zip(z, m["c"])) + float(m["d"]))) < 1e-3


@pytest.mark.parametrize("run", [64, 777, 5000])
def test_quality_of_long_texts_comes_in_runs(documents, monkeypatch, run):
    """Runs give the passages of the whole text, and their folded score; a text's passages don't depend on its neighbours."""
    texts = [r.text for r in documents.select("text").limit(60).collect()] + [None, "", "   ", " a", "x" * 9000, "é " * 300, "a\n" * 51]
    buf, off = V.text_bytes(pa.array(texts, pa.string()))
    x, at = quality.passages(buf, off)
    rng = np.random.default_rng(0)
    shapes = {"W": (quality.DIM, 8), "b": 8, "V": (8, 4), "U": (8, 4), "w": 4, "c": 8, "d": ()}
    m = {k: np.float32(rng.normal(size=s)) for k, s in shapes.items()}
    whole = quality.forward(m, x, at)["p"]
    monkeypatch.setattr(quality, "RUN", run)
    monkeypatch.setattr(quality, "BAG", 3)
    for k, text in enumerate(texts):
        own = np.concatenate(list(quality.runs(buf[off[k] : off[k + 1]])))
        assert (own == x[at[k] : at[k + 1]]).all() and len(own) == max(1, -(-len((text or "").encode().split()) // quality.PASSAGE))
    assert np.abs(quality.scores(m, buf, off) - whole).max() < 1e-5
    held = list(quality.bags(buf, off))
    assert np.concatenate([n for _, n in held]).tolist() == np.minimum(np.diff(at), 3).tolist() and all(len(a) == n.sum() for a, n in held)


def test_quality_of_a_very_long_text_takes_bounded_memory():
    rng = np.random.default_rng(1)
    m = {k: np.float32(rng.normal(size=s)) for k, s in {"W": (quality.DIM, 32), "b": 32, "V": (32, 16), "U": (32, 16), "w": 16, "c": 32, "d": ()}.items()}
    buf = np.frombuffer(b"Some words, and 12 more of them.\n" * 1_000_000, np.uint8)
    tracemalloc.start()
    p = quality.scores(m, buf, np.array([0, len(buf)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= p[0] <= 1 and peak < 150 << 20


def test_language_is_no_input(spark, edges):
    model = langid.learn(edges)
    a = {(r.doc_id, r.score) for r in langid.predict(edges, model).collect()}
    assert a == {(r.doc_id, r.score) for r in langid.predict(edges.withColumn("lang", F.lit("zz")), model).collect()}


def test_quality(spark, edges, empty, labels):
    sf = "/root/testdata/sf0.01"
    df, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(df, marks).join(marks, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(edges, labels).count() == len(EDGES) and quality.classify(empty, labels).count() == 0
    assert {round(r.score, 6) for r in quality.classify(edges, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.classify(edges, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(edges, labels).columns == edges.columns


def test_gradients():
    rng = np.random.default_rng(0)
    m = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.float64(0.3)}
    x, at, y = rng.normal(size=(6, 5)), np.array([0, 2, 3, 6]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := quality.forward(m, x, at)["p"]) + (1 - y) * np.log(1 - p))
    g = quality.gradients(m, x, at, y)
    for k in m:
        flat, exact = np.atleast_1d(m[k]).ravel(), np.atleast_1d(g[k]).ravel()
        for i in range(len(flat)):
            was = m[k].copy() if m[k].ndim else m[k]
            step = np.zeros_like(np.atleast_1d(was), dtype=float).ravel()
            step[i] = 1e-6
            m[k] = was + step.reshape(np.shape(was))
            up = loss()
            m[k] = was - step.reshape(np.shape(was))
            down = loss()
            m[k] = was
            assert abs((up - down) / 2e-6 - exact[i]) < 1e-6


# 4, 8


def ids_by_force(path, text, end):
    return tokens.encoder(path, path == tokens.WORD_BPE, end).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("path,end", [(tokens.BYTE_BPE, 2), (tokens.WORD_BPE, 1)])
def test_parts_give_the_ids_of_the_whole(documents, path, end):
    texts = [t for _, t in EDGES] + [r.text for r in documents.select("text").limit(80).collect()]
    texts += ["a  b", " a", "a ", "it's x.'s 'sam", "a.b, c., d.", "«é» ½x", "é. É. ́a", "a\n\nb", "　x. y", "x\x1cy z", "A.", ".", "a. .b", "é. ño"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for k, ids in tokens.encoded(batch, 0, path, path == tokens.WORD_BPE, end):
        assert ids.tolist() == ids_by_force(path, texts[k], end), repr((texts[k] or "")[:60])


def test_store_round_trip(spark, edges, empty, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write(edges, folder)
    got = token_store.read(spark, folder).orderBy("start").collect()
    want = collections.Counter((d, len(i := ids_by_force(tokens.BYTE_BPE, t, 2)), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in EDGES)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    known = [r.doc_id for r in got]
    assert known == sorted(known, key=lambda d: -1 if d is None else d)
    some = token_store.read(spark, folder, [5, 12]).collect()
    assert {r.doc_id: list(r.ids) for r in some} == {5: ids_by_force(tokens.BYTE_BPE, "word", 2), 12: ids_by_force(tokens.BYTE_BPE, EDGES[-1][1], 2)}
    token_store.write(empty, f"{folder}-empty")
    assert token_store.read(spark, f"{folder}-empty").count() == 0


def check_packing(rows, texts, capacity=4096):
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    want = collections.defaultdict(list)
    for d, t in texts:
        ids = np.array(ids_by_force(tokens.WORD_BPE, t, 1), "<u4")
        want[d] += [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1]) and sum(n for _, n in p) <= capacity
    total = sum(n for p in places.values() for _, n in p)
    return len(places), -(-total // capacity)


def test_packing(edges, empty, documents):
    check_packing(packing.pack(edges).collect(), EDGES)
    used, least = check_packing(packing.pack(documents).collect(), [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    assert used <= least + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_packing_is_found_by_the_search(spark, folder):
    """Crossovers make the solutions that stand, and some of them moved between islands."""
    items = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select(F.col("doc_id").alias("u"), (F.length("text") / 3 % 4095 + 1).cast("long").alias("length"))
    best = packing.solve(items, packing.CAPACITY, "test").collect()
    for r in best:
        size, bins = np.frombuffer(r["size"], np.int32), np.frombuffer(r.best.bins, np.int32)
        assert np.bincount(bins, size).max() <= packing.CAPACITY and bins.max() + 1 <= -(-int(size.sum()) // packing.CAPACITY) + 1
        assert r.best.crossovers > 0 and r.best.generation > 0
    assert sum(r.migrants for r in best) > 0


def test_starts_of_the_search_are_unfinished():
    size = np.random.default_rng(0).integers(1, 3000, 500)
    least = -(-int(size.sum()) // 4096)
    starts = [packing.fitness(size, packing.next_fit(size, np.random.default_rng(k).permutation(500), 4096), 4096)[0] for k in range(6)]
    herd = packing.evolve(size, [], 0, 1)
    assert min(starts) > herd[0][0][0] >= least and herd[0][3] > 0


def plain_best_fit(size, capacity=4096):
    """Bins of best fit decreasing, by looking at every open bin."""
    rooms = []
    for n in sorted(size.tolist(), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("kind", ["triplets", "cuts", "uniform", "small"])
def test_search_is_never_worse_than_best_fit(kind):
    rng = np.random.default_rng(5)
    two = rng.integers(1025, 2048, (1000, 2))
    cut = np.sort(rng.choice(np.arange(1, 4096), (1000, 2)), axis=1)
    size = {"triplets": np.concatenate([two.ravel(), 4096 - two.sum(axis=1)]), "cuts": np.concatenate([cut[:, 0], cut[:, 1] - cut[:, 0], 4096 - cut[:, 1]]), "uniform": rng.integers(1, 4096, 1500), "small": rng.integers(1, 200, 1500)}[kind].astype(np.int64)
    size = rng.permutation(size[size > 0])
    best = min((packing.evolve(size, [], 0, k)[0] for k in range(2)), key=lambda s: s[0])
    assert np.bincount(best[1], size).max() <= 4096 and len(best[1]) == len(size)
    assert -(-int(size.sum()) // 4096) <= best[0][0] <= plain_best_fit(size)
    if kind == "triplets":
        assert best[0][0] <= 1015


def test_exchange_moves_no_piece_twice():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 60, 300).astype(np.int64)
    bins = packing.next_fit(size, rng.permutation(300), 100).astype(np.int64)
    bins[bins % 3 == 0] = -1
    for _ in range(4):
        load = np.bincount(bins[bins >= 0], size[bins >= 0], minlength=bins.max() + 1).astype(np.int64)
        before = load.copy()
        out = packing.exchange(size, bins, np.flatnonzero(bins < 0), load, 100, rng)
        assert sorted(out.tolist()) == np.flatnonzero(bins < 0).tolist()
        assert (load == np.bincount(bins[bins >= 0], size[bins >= 0], minlength=len(load))).all() and (load >= before).all() and load.max() <= 100


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 60, 200)
    order = np.argsort(-size)
    a, b = np.zeros(200, np.int64), np.zeros(200, np.int64)
    packing.best_fit(size, order, a, [], 0, 100)
    packing.best_fit(size, rng.permutation(200), b, [], 0, 100)
    child = packing.cross(size, packing.tidy(a), packing.tidy(b), 100, rng)
    assert (child >= 0).all() and np.bincount(child, size).max() <= 100 and len(np.unique(child)) == child.max() + 1


# 5


def test_base_score_by_force(spark, edges, empty, documents):
    for df in (documents, edges):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        part = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
        count = collections.Counter(w for d, t in rows if d is not None and part(d) != 2 for w in [*words(t), "\n"])
        n, v = sum(count.values()), len(count)
        want = collections.Counter((d, part(d) == 2, len(w := [*words(t), "\n"]), sum(count[x] > 0 for x in w), n, f"{sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w):.6e}") for d, t in rows)
        got = ctw.scores(df).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6e}") for r in got) == want
        assert all(r.score < 0 for r in got)
    assert ctw.scores(empty).count() == 0


class PlainTrees:
    """Context trees as dictionaries, by the recursion of their block probabilities."""

    def __init__(self, texts):
        self.count, self.kids = collections.Counter(), collections.defaultdict(set)
        for text in texts:
            for ctx, byte in self.places(text):
                for j, bit in self.decisions(byte):
                    for d in range(ctw.DEPTH + 1):
                        self.count[j, ctx[:d], bit] += 1
                        if d:
                            self.kids[j, ctx[: d - 1]].add(ctx[:d])
        self.block = {}
        for j, ctx in sorted({(j, c) for j, c, _ in self.count}, key=lambda x: -len(x[1])):
            self.block[j, ctx] = self.weighted(self.own(j, ctx), sum(self.block[j, k] for k in self.kids[j, ctx]), len(ctx))

    @staticmethod
    def places(text):
        data = bytes(ctw.DEPTH) + text.translate(LOWER).encode() + b"\xff"
        return [(tuple(data[k - d] for d in range(1, ctw.DEPTH + 1)), data[k]) for k in range(ctw.DEPTH, len(data))]

    @staticmethod
    def decisions(byte):
        return [((1 << level) | (byte >> (8 - level)), byte >> (7 - level) & 1) for level in range(8)]

    def own(self, j, ctx, more=(0, 0)):
        a, b = self.count[j, ctx, 0] + more[0], self.count[j, ctx, 1] + more[1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @staticmethod
    def weighted(own, below, depth):
        return own if depth == ctw.DEPTH else float(np.logaddexp(own, below) - math.log(2))

    def score(self, text):
        """log10 of its probability: of each decision the ratio of the root's block with it and without."""
        total = 0.0
        for ctx, byte in self.places(text):
            for j, bit in self.decisions(byte):
                new = old = 0.0
                for d in range(ctw.DEPTH, -1, -1):
                    was = self.block.get((j, ctx[:d]), 0.0)
                    below = sum(self.block[j, k] for k in self.kids[j, ctx[:d]]) + new - old
                    new, old = self.weighted(self.own(j, ctx[:d], (1 - bit, bit)), below, d), was
                total += (new - old) / math.log(10)
        return total


def test_scores_are_those_of_plain_context_trees(spark):
    part = lambda d: zlib.crc32(str(d).encode()) % 7
    rows = [(k, ("the cat sat on the mat, and " * (1 + k % 3) + f"dog {k} É")[: 20 + 7 * k]) for k in range(14)] + [(50, None), (51, ""), (None, "no id at all"), (52, "zzzz qqq ß unseen")]
    assert {part(d) == 2 for d, _ in rows if d is not None} == {True, False}
    plain = PlainTrees([t or "" for d, t in rows if d is not None and part(d) != 2])
    got = ctw.scores(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == sorted((str(d), round(plain.score(t or ""), 3)) for d, t in rows)
    assert all(abs(r.bits_per_byte + r.score / math.log10(2) / (len((dict(rows)[r.doc_id] or "").encode()) + 1)) < 1e-6 for r in got)


def test_every_context_is_learned(spark):
    """A context that is spread evenly, once in a long stretch of other text, still tells what follows."""
    rng = np.random.default_rng(4)
    noise = lambda k: "".join(rng.choice(list("abcdefgh "), 3000))
    part = lambda d: zlib.crc32(str(d).encode()) % 7
    rows = [(k, noise(k) + "XYZXYZ9" + noise(k)) for k in range(60) if part(k) != 2]
    held = [k for k in range(60, 200) if part(k) == 2][:2]
    rows += [(held[0], "XYZXYZ9"), (held[1], "XYZXYZ8")]
    got = {r.doc_id: r.score for r in ctw.scores(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got[held[0]] > got[held[1]] + 1


class Frame:
    """Stands for tables and keeps what tasks would run."""

    def __init__(self):
        self.tasks = []

    def __getattr__(self, name):
        return lambda *args: (self.tasks.append(args[0]) if name in ("mapInArrow", "applyInArrow") else None, self)[1]


def context_tasks(monkeypatch, shards=12):
    """What a task of ctw.gather() and one of ctw.score() run."""
    docs, answered = Frame(), Frame()
    monkeypatch.setattr(ctw, "settle", lambda df, name: df)
    monkeypatch.setattr(ctw, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    ctw.gather(docs, shards)
    ctw.score(answered, answered, shards)
    return docs.tasks[0], answered.tasks[0]


def context_batches(texts, rows=512):
    for i in range(0, len(texts), rows):
        part = texts[i : i + rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(part)), pa.int64()), pa.array(part, pa.string()), pa.array([k % 3 > 0 for k in range(len(part))])], ["doc_id", "text", "train"])


def context_answers(rows):
    """Rows of texts as they are, and for those of places and words something told by their keys."""
    for r in rows:
        keys = None if r["kind"] == ctw.TEXT else V.mix(ctw.unpack(r["a"], np.uint64, True))
        some = keys if keys is None else (-(keys % np.uint64(1000)).astype(np.float32) if r["kind"] == ctw.PLACE else (keys % np.uint64(5)).astype(np.int64))
        yield tuple(r.values()) if keys is None else (r["kind"], r["shard"], r["grp"], 0, b"", ctw.pack(some))


def test_places_are_the_same_in_pieces_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["The cat É sat ", "", None, "x", "ab " * 400, *("".join(rng.choice(list("aBc dé\n"), n)) for n in rng.integers(0, 300, 60))]
    data = [bytes(ctw.DEPTH) + (t or "").translate(LOWER).encode() + b"\xff" for t in texts]
    codes = [[int.from_bytes(d[k - ctw.DEPTH : k], "little") << 8 | d[k] for k in range(ctw.DEPTH, len(d))] for d in data]
    seen = []
    for piece, some, held, sent in ((ctw.PIECE, ctw.RANGE, ctw.HELD, ctw.SENT), (300, 64, 2, 100)):
        for name, x in (("PIECE", piece), ("RANGE", some), ("HELD", held), ("SENT", sent)):
            monkeypatch.setattr(ctw, name, x)
        gather, group = context_tasks(monkeypatch)
        rows = [r for b in gather(context_batches(texts, 20)) for r in b.to_pylist()]
        count = collections.Counter()
        for r in rows:
            if r["kind"] == ctw.PLACE:
                count.update(dict(zip(ctw.unpack(r["a"], np.uint64, True).tolist(), ctw.unpack(r["b"], np.uint32).tolist())))
        assert count == collections.Counter(c for k, x in enumerate(codes) for c in x if k % 20 % 3) and set(count) == {c for x in codes for c in x}
        got = group(pa.Table.from_batches([ctw._batch(list(context_answers(rows)))])).to_pylist()
        value = lambda x: -int((V.mix(np.array(x, np.uint64)) % np.uint64(1000)).sum())
        assert [(r["doc_id"], r["score"]) for r in got] == [(k, float(value(x))) for k, x in enumerate(codes)]
        seen.append((rows, got))
    assert seen[1:] == seen[:-1]


def test_keys_are_merged_range_by_range():
    rng = np.random.default_rng(5)
    held = [ctw.tally(np.concatenate((rng.integers(0, top, n), np.full(3, 7))).astype(np.uint64), rng.random(n + 3) < 0.5) for n, top in ((300_000, 1 << 50), (200_000, 1 << 18), (9, 9), (0, 1), (150_000, 1 << 50))]
    count = collections.Counter()
    for k, n in held:
        count.update(dict(zip(k.tolist(), n.tolist())))
    keys, n = ctw.added(held)
    assert keys.tolist() == sorted(count) and n.tolist() == [count[k] for k in sorted(count)]
    assert np.array_equal(ctw.different([k for k, _ in held]), keys)
    parts = [sum(s.stop - s.start for s in p) for p in ctw.ranges([k for k, _ in held])]
    assert sum(parts) == sum(len(k) for k, _ in held) and max(parts) < 1.5 * ctw.RANGE
    for kind in (ctw.PLACE, ctw.WORD):
        dealt = dict(ctw.by_shard(kind, keys, 50))
        assert list(dealt) == sorted(dealt) and np.array_equal(np.sort(np.concatenate(list(dealt.values()))), np.arange(len(keys)))
        of = V.mix(keys >> np.uint64(8 * (ctw.DEPTH + 1 - ctw.TOP)) if kind == ctw.PLACE else keys) % np.uint64(50)
        assert all(np.array_equal(at, np.flatnonzero(of == s)) for s, at in dealt.items())


def traced_peak(run):
    """Bytes that run() holds at most above what was there."""
    tracemalloc.start(1)
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_group_of_contexts_takes_little_memory(spark, monkeypatch):
    """Two tasks and the JVM of an executor of 3 GB share it: a task's own arrays stay below 20 bytes for a byte of its group."""
    rng = np.random.default_rng(6)
    known = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(2, 9, 20_000)]
    texts = [" ".join(known[k] for k in rng.integers(0, len(known), 240)) for _ in range(ctw.GROUP // 1200)]
    gather, _ = context_tasks(monkeypatch)
    assert traced_peak(lambda: [len(b) for b in gather(context_batches(texts))]) < 20 * ctw.GROUP


def test_trees_hold_one_level_of_decisions():
    keys = V.keys_of(np.random.default_rng(7).integers(0, 1 << 56, 100_000).astype(np.uint64) & np.uint64(0x0F1F0F1F0F1F0F))
    n = np.arange(len(keys)) % 5
    upper = {}
    for level, nodes in enumerate(ctw.trees(keys, n)):
        known = nodes[0]["key"]
        upper[level] = known, np.full(len(known), 0.3), np.full(len(known), 0.4)
    del nodes
    assert traced_peak(lambda: ctw.logs(keys, n, upper)) < 600 * len(keys)


# 6


def components_by_force(rows, width, percent):
    sets = collections.defaultdict(list)
    for d, t in rows:
        w = words(t)
        sets[d].append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]))
    up = {d: d for d in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and any(s and z and 100 * len(s & z) >= percent * len(s | z) for s in sets[a] for z in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sets, {d: root(d) for d in up}


def components_by_force_indexed(rows, width, percent):
    """components_by_force() for more rows: only documents with a shingle in common are compared."""
    sets, at = {}, collections.defaultdict(list)
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])
        for s in sets[d]:
            at[s].append(d)
    f = components.Forest()
    for d, s in sets.items():
        common = collections.Counter(e for x in s for e in at[x] if e < d)
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                f.join(d, e)
    return sets, {d: f.root(d) for d in sets}


def test_distinct_keys_take_no_longer_than_sorts():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 2_000_000).astype(np.uint64)
    keys[::3] = keys[0]
    start = time.perf_counter()
    np.sort(keys)
    one = time.perf_counter() - start
    start = time.perf_counter()
    got = V.keys_of(keys)
    assert time.perf_counter() - start < 5 * one + 0.1
    assert np.array_equal(got, np.array(sorted(set(keys.tolist())), np.uint64)) and len(V.keys_of(keys[:0])) == 0
    # The answers to a group are looked up by keys in the same way.
    assert "np.unique" not in inspect.getsource(ctw.score)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_by_force(spark, edges, documents, width, percent):
    base = SHARED.split() * 2
    copies = [(1000 + k, " ".join(base[: k % 17] + [f"new{k % 5}"] + base[k % 17 :] + [f"end{k}"] * (k % 3))) for k in range(80)]
    for rows in ([(r.doc_id, r.text) for r in edges.collect()], copies + [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(60).collect()]):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        sets, want = components_by_force(rows, width, percent)
        got = minhash.near_duplicates(df, width, percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None) and r.n_shingles in {len(s) for s in sets[r.doc_id]}
            assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_recall_of_near_duplicates(spark):
    """All pairs of a table by an inverted index, against the links that components keep: at least 0.9, and printed."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    _, want = components_by_force_indexed(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    linked = [d for d in want if want[d] != d]
    recall = sum(got[d] == want[d] for d in linked) / len(linked)
    print(f"op6 on sf0.01: {recall:.4f} of {len(linked)} linked documents are in their component")
    assert recall >= 0.9 and all(got[d] == d for d in want if want[d] == d and d not in want.values())


def test_one_of_each(edges, empty):
    out = minhash.one_of_each(edges, 3, 85)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == edges.columns and ids.count(6) == 1 and 7 not in ids and ids.count(None) == 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.one_of_each(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    shared, errors = rng.integers(0, 1 << 62, 300, dtype=np.uint64), []
    for k in range(30):
        a, b = (np.unique(np.concatenate((shared[: 10 * k], rng.integers(0, 1 << 62, 120, dtype=np.uint64)))) for _ in range(2))
        s = minhash.super_minhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        errors.append((s[0] == s[1]).mean() - V.overlap(a, b) / (len(a) + len(b) - V.overlap(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(k, k + 1) for k in range(500, 620)] + [(None, 3), (7, 7)] + [(900, k) for k in range(901, 1000)]
    f = components.Forest()
    for a, b in pairs:
        if a is not None:
            f.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long").repartition(7)).collect()}
    nodes = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert got == {x: f.root(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 9, 10


def test_licences(spark, edges, empty):
    mit = dict(licences.TEXTS)["MIT"]
    rows = [(1, f"Copyright (c) 2020 Someone\n\n{mit}"), (2, mit.replace("\"", "''").replace("software", "SOFTWARE")), (3, mit + " more"), (4, "text\nreleased under the mit licence\nLicensed under CC BY-NC 4.0"), (5, None), (6, "...")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, SCHEMA), licences.known(spark, licences.TEXTS)).collect()}
    assert [got[k].license_id for k in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    assert got[4].notice_ids == "CC-BY-NC-4.0,MIT" and got[5].digest is None and got[6].digest is None
    known = licences.known(spark, licences.TEXTS)
    assert licences.scan(edges, known).count() == len(EDGES) and licences.scan(empty, known).count() == 0


def test_licence_files_as_published(spark):
    texts = dict(licences.TEXTS + licences.FURTHER[::-1])
    wrapped = texts["MIT"].replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE").replace("The above", "\n\nThe above")
    rows = [(1, f"MIT License\n\nCopyright (c) 2020 Someone\n\n{wrapped}"), (2, f"ISC License\n\nCopyright 2021, A. Person\n\n{texts['ISC']}"), (3, f"Copyright (c) 2019, A\nAll rights reserved.\n\n{texts['BSD-3-Clause']}"), (4, f"BSD 2-Clause License\n\n{texts['BSD-2-Clause']}")]
    known = licences.known(spark, licences.TEXTS + licences.FURTHER)
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, SCHEMA), known).collect()}
    assert got == {1: "MIT", 2: "ISC", 3: "BSD-3-Clause", 4: "BSD-2-Clause"} and known.count() == known.select("digest").distinct().count()


def test_spellings_are_of_whole_words(spark):
    same = [("wilful", "willful"), ("wilfull", "willful"), ("the licences, licences", "the licenses licenses"), ("organisation", "ORGANIZATION"), ("copyright holder", "copyright owner"), ("sub-licence", "sublicense")]
    apart = [("programmer", "programr"), ("programmers", "programrs"), ("relicence", "relicense")]
    form = lambda x: spark.createDataFrame([(x,)], "t string").select(licences.canonical(F.col("t")).alias("c")).first().c
    assert all(form(a) == form(b) for a, b in same) and all(form(a) != form(b) for a, b in apart)
    assert re.fullmatch(licences.alternation(["ab", "abc", "x"]), "abc") and not re.fullmatch(licences.alternation(["ab", "abc", "x"]), "a")


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/MPL-2.0"), reason="no licence texts here")
def test_longer_licences_are_known(spark):
    known = licences.known(spark, licences.TEXTS, licences.DIGESTS)
    rows = [(k, open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read()) for k, n in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"))]
    rows += [(10 + k, "\n\n   " + t.replace("\n", "\n  ").upper()) for k, t in rows] + [(20, rows[0][1] + "more")]
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, SCHEMA), known).collect()}
    assert [got[k] for k in range(6)] == [got[10 + k] for k in range(6)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"] and got[20] is None


def test_media(spark, edges, empty):
    got = media.digests(media.store_texts(edges)).collect()
    assert len(got) == len(EDGES) and media.digests(media.store_texts(empty)).count() == 0
    want = []
    for d, t in EDGES:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        file, n = media.wrap(p), len(p) // 576
        start = len(file) - len(p)
        keys = [(start + 576 * k, start + 576 * (k + 1)) for k in range(0, n, media.SYNC)]
        ranges = hashlib.sha256(",".join(f"{a}-{b}" for a, b in keys).encode()).hexdigest()[:32]
        feature = f"codec=raw;seconds={len(p) / media.RATE:.6f};samples={n};keyframes={len(keys)};ranges={ranges}"
        want.append((str(d), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, "raw ", media.RATE, len(p), n, keys))
    assert sorted(want) == sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.codec, r.timescale, r.duration, r.samples, [(k.start, k.end) for k in r.keyframes]) for r in got)


def test_crafted_media_are_errors(spark):
    nest = b""
    for _ in range(3000):
        nest = media.box(b"moov", nest)
    good = media.wrap(media.pad(b"x" * 6000))
    at = good.index(b"stsz") + 8
    many = bytearray(good)
    many[at : at + 8] = media.numbers(576, (1 << 32) - 1)
    at = good.index(b"stss") + 8
    none, far = bytearray(good), bytearray(good)
    none[at + 4 : at + 8], far[at + 4 : at + 8] = media.numbers(0), media.numbers(99)
    found = [media.describe(bytes(x)) for x in (nest, many, none, far)]
    assert all(x["error"] and x["keyframes"] is None for x in found) and "deep" in found[0]["error"] and "sync sample" in found[2]["error"]


def test_broken_media(spark):
    good = media.wrap(media.pad(b"x" * 6000))
    found = media.describe(good)
    assert found["codec"] == "raw " and found["samples"] == 11 and [good[k["start"] : k["end"]][:1] for k in found["keyframes"]] == [b"x", b"x"]
    files = [(1, None), (2, b""), (3, good[:200]), (4, good[: len(good) - 700]), (5, b"\0\0\0\x08free"), (6, good), (7, b"junk" * 50)]
    rows = {r.id: r for r in media.probe(spark.createDataFrame(files, "id long, data binary"), "data", ["id"]).collect()}
    assert all(rows[k].error for k in (1, 2, 3, 4, 5, 7)) and rows[6].error is None and rows[6].duration == 11 * 576
    big = np.random.default_rng(0)
    for _ in range(200):
        b = bytearray(good[:700])
        for k in big.integers(0, 700, 3):
            b[k] = big.integers(0, 256)
        media.describe(bytes(b))


def read_plainly(file):
    """Payload, timescale, duration and sync samples of a one-track file by another reader: tables are found by name, not by walking."""
    at = lambda name, k=0: file.index(name) + 8 + k
    u32 = lambda p, n=1: [int.from_bytes(file[p + 4 * k : p + 4 * k + 4], "big") for k in range(n)]
    even, n = u32(at(b"stsz"), 2)
    chunks = u32(at(b"co64"))[0]
    starts = [int.from_bytes(file[at(b"co64", 4 + 8 * k) :][:8], "big") for k in range(chunks)]
    runs = [u32(at(b"stsc", 4 + 12 * k), 3) for k in range(u32(at(b"stsc"))[0])]
    per = [max(r for r in runs if r[0] <= k + 1)[1] for k in range(chunks)]
    samples = [(s + even * j, s + even * (j + 1)) for s, c in zip(starts, per) for j in range(c)]
    assert len(samples) == n
    sync = u32(at(b"stss", 4), u32(at(b"stss"))[0])
    scale, duration = u32(at(b"mdhd", 16))[0], int.from_bytes(file[at(b"mdhd", 20) :][:8], "big")
    return b"".join(file[a:b] for a, b in samples), scale, duration, [samples[k - 1] for k in sync]


def test_stored_texts_by_another_reader():
    for n in (0, 1, 576, 577, 8 * 576, 50_000):
        p = media.pad(bytes(k % 251 for k in range(n)))
        file = media.wrap(p)
        payload, scale, duration, keys = read_plainly(file)
        d = media.describe(file)
        assert payload == p == media.read_payload(file) and (scale, duration) == (d["timescale"], d["duration"]) == (48_000, len(p))
        assert keys == [(k["start"], k["end"]) for k in d["keyframes"]] and d["tracks"][0]["handler"] == "soun" and len(d["tracks"]) == 1


def movie(tracks, extra=b""):
    """A file of tracks (id, handler, codec, timescale, duration, sizes of samples, sync samples), all bytes in one mdat."""
    def moov(base):
        out = []
        for ident, handler, codec, scale, duration, sizes, sync in tracks:
            table = [media.full(b"stsd", media.numbers(1), media.box(codec, bytes(8))), media.full(b"stts", media.numbers(1, len(sizes), 10))]
            table += [media.full(b"stsz", media.numbers(0, len(sizes), *sizes)), media.full(b"stsc", media.numbers(1, 1, len(sizes), 1)), media.full(b"stco", media.numbers(1, base))]
            table += [media.full(b"stss", media.numbers(len(sync), *sync))] if sync is not None else []
            mdia = media.box(b"mdia", media.full(b"mdhd", media.numbers(0, 0, scale, duration)), media.full(b"hdlr", media.numbers(0), handler), media.box(b"minf", media.box(b"stbl", *table)))
            out.append(media.box(b"trak", media.full(b"tkhd", media.numbers(0, 0, ident)), mdia))
            base += sum(sizes)
        return media.box(b"moov", *out, extra)

    head = media.box(b"ftyp", b"isom")
    return head + moov(len(head) + len(moov(0)) + 8) + media.box(b"mdat", bytes(sum(sum(t[5]) for t in tracks)))


def flagged(kind, flags, *values):
    return media.box(kind, media.numbers(flags, *values))


def test_all_tracks_of_a_file(spark):
    file = movie([(7, b"soun", b"mp4a", 44100, 30, [5, 6, 7], None), (9, b"vide", b"avc1", 90000, 40, [50, 20, 30, 60], [1, 4]), (11, b"text", b"tx3g", 1000, 0, [], None)])
    base = len(file) - 178
    d = media.describe(file)
    assert d["error"] is None and (d["codec"], d["samples"], d["duration"]) == ("avc1", 4, 40)
    assert [(k["start"] - base, k["end"] - base) for k in d["keyframes"]] == [(18, 68), (118, 178)]
    assert [(t["track_id"], t["handler"], t["codec"], t["timescale"], t["samples"], len(t["keyframes"])) for t in d["tracks"]] == [(7, "soun", "mp4a", 44100, 3, 3), (9, "vide", "avc1", 90000, 4, 2), (11, "text", "tx3g", 1000, 0, 0)]
    row = media.probe(spark.createDataFrame([(1, file), (2, None)], "id long, data binary"), "data", ["id"]).orderBy("id").collect()
    assert [t.codec for t in row[0].tracks] == ["mp4a", "avc1", "tx3g"] and row[1].tracks is None and row[0].codec == "avc1"
    sound = media.describe(movie([(1, b"vide", b"avc1", 1, 0, [], None), (2, b"soun", b"mp4a", 8000, 2, [4, 4], None)]))
    assert sound["codec"] == "mp4a" and sound["samples"] == 2  # a video track without samples doesn't stand for the file


def test_sample_sizes_of_few_bits():
    for bits, body in ((4, b"\x53\x70"), (8, b"\x05\x03\x07"), (16, b"\0\x05\0\x03\0\x07")):
        table = media.full(b"stz2", bytes(3) + bytes([bits]), media.numbers(3), body)
        start = table.index(b"stz2") + 4
        assert media.sample_sizes(table, {b"stz2": (start, len(table))}) == [5, 3, 7]
    with pytest.raises(ValueError):
        media.sample_sizes(table[:-1], {b"stz2": (start, len(table) - 1)})


def test_fragments_have_samples():
    """Two fragments of two tracks: bases, defaults of trex and tfhd, sizes by sample, first flags and both kinds of marks."""
    trex = lambda ident, d, s, f: media.full(b"trex", media.numbers(ident, 1, d, s, f))
    head = movie([(1, b"soun", b"mp4a", 100, 0, [], None), (2, b"vide", b"avc1", 1000, 0xFFFFFFFF, [], [])], media.box(b"mvex", trex(1, 20, 4, 0), trex(2, 40, 10, media.NO_SYNC)))
    # The first: data after the box; the sound's run follows the video's by default.
    def first(offset):
        video = media.box(b"traf", flagged(b"tfhd", 0x20000, 2), flagged(b"trun", 0x1 | 0x4, 3, offset, 0))  # first flags: sync
        sound = media.box(b"traf", flagged(b"tfhd", 0, 1), flagged(b"trun", 0x200, 2, 6, 8))
        return media.box(b"moof", media.full(b"mfhd", media.numbers(1)), video, sound)

    one = first(len(first(0)) + 8) + media.box(b"mdat", bytes(30 + 14))
    at = len(head) + len(first(0)) + 8
    # The second: an absolute base, durations, sizes and marks of each sample, then a run that goes on after it.
    def second(base):
        runs = [flagged(b"trun", 0x100 | 0x200 | 0x400, 2, 7, 3, media.NO_SYNC, 9, 5, 0), flagged(b"trun", 0, 1)]
        return media.box(b"moof", media.box(b"traf", media.box(b"tfhd", struct.pack(">IIQI", 0x1 | 0x10, 2, base, 11)), *runs))

    late = len(head) + len(one) + len(second(0)) + 8
    file = head + one + second(late) + media.box(b"mdat", bytes(19))
    d = media.describe(file)
    assert d["error"] is None and (d["codec"], d["samples"], d["duration"], d["timescale"]) == ("avc1", 6, 3 * 40 + 7 + 9 + 40, 1000)
    assert [(k["start"], k["end"]) for k in d["keyframes"]] == [(at, at + 10), (late + 3, late + 8)]
    sound = d["tracks"][0]
    assert (sound["samples"], sound["duration"]) == (2, 40) and [(k["start"], k["end"]) for k in sound["keyframes"]] == [(at + 30, at + 36), (at + 36, at + 44)]
    # What is wrong is an error and stops nothing: no such track, data beyond the file, more samples than bytes.
    wrong = [media.box(b"traf", flagged(b"tfhd", 0x20000, 5), flagged(b"trun", 0, 1)), media.box(b"traf", flagged(b"tfhd", 0x20000, 2), flagged(b"trun", 0x1, 1, 1 << 30))]
    wrong += [media.box(b"traf", flagged(b"tfhd", 0x20000 | 0x10, 2, 0), flagged(b"trun", 0, 1 << 31)), media.box(b"traf", flagged(b"trun", 0, 1))]
    wrong += [media.box(b"traf", flagged(b"tfhd", 0x20000, 2), flagged(b"trun", 0x200, 1 << 8))]
    for traf in wrong:
        d = media.describe(head + media.box(b"moof", traf) + bytes(0))
        assert d["error"] and d["keyframes"] is None and d["tracks"] is None
    random = np.random.default_rng(1)
    for _ in range(300):
        b = bytearray(file)
        for k in random.integers(len(head) - 100, len(file), 3):
            b[k] = random.integers(0, 256)
        media.describe(bytes(b))


def test_pipeline(spark, edges, empty, sf, labels):
    """Which documents each stage keeps, against its operator or brute force, and that rows keep their columns."""
    import corpus_pipeline as P

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edges.select(*names), empty.select(*names)):
        for name, stage in P.STAGES[:-1]:
            before = docs.collect()
            docs = stage(spark, docs, sf)
            rows = docs.collect()
            assert docs.columns == names and {r.doc_id for r in rows} <= {r.doc_id for r in before}
            if name == "quality":
                marks = spark.read.parquet(f"{sf}/labels.parquet")
                scored = quality.classify(spark.createDataFrame(before, docs.schema), marks).collect()
                assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in scored if r.predicted)
            elif name == "line_dedup":
                gone = removed_by_force([(r.doc_id, r.text) for r in before if r.doc_id is not None])
                left = {(r.doc_id, line) for r in before if r.doc_id is not None for k, line in enumerate((r.text or "").split("\n")) if (r.doc_id, k) not in gone and words(line)}
                assert {(r.doc_id, line) for r in rows if r.doc_id is not None for line in (r.text or "").split("\n") if words(line)} <= left | {(7, x) for x in EDGES[8][1].split("\n")}
            elif name == "near_dedup":
                kept = [r for r in minhash.near_duplicates(spark.createDataFrame(before, docs.schema)).collect() if r.first]
                assert len({(r.doc_id, r.h) for r in kept if r.doc_id is not None}) == sum(r.doc_id is not None for r in rows)
            else:
                items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
                bad = {x[0] for x in contaminated_by_force([(r.doc_id, r.text) for r in before], items) if x[4]}
                assert [str(r.doc_id) for r in rows if r.doc_id in bad] == [] and len(rows) == sum(r.doc_id not in bad for r in before)
            docs = spark.createDataFrame(rows, docs.schema)
        check_packing(P.STAGES[-1][1](spark, docs, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    out = P.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_stages_keep_and_remove_exactly(spark, sf, documents):
    """Line dedup, near-dedup and decontamination against brute force on both sides: texts, ids and signs, no more and no fewer."""
    import corpus_pipeline as P

    stages, names = dict(P.STAGES), ["doc_id", "text", "lang", "source", "n_chars"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = " ".join(f"own{k}" for k in range(60))
    planted = [(5000, own + "\n" + SHARED), (5001, own.replace("own7 ", "other ")), (5002, "Fresh line of words here.\n" + SHARED + "\nLast line of it."), (5003, SHARED), (5004, "Before it " + items[0][1] + " and after"), (5005, None), (5006, ""), (5007, own + "\n" + SHARED + " end")]
    rows = planted + [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(120).collect()]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as bigint) n_chars").repartition(3)

    gone, want = removed_by_force(rows), {}
    for d, text in rows:
        lines = (text or "").split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines) or words("\n".join(left)):
            want[d] = text if len(left) == len(lines) else "\n".join(left)
    assert len(gone) >= 3 and not {5003, 5007} & set(want) and want[5002] == "Fresh line of words here.\nLast line of it."
    out = stages["line_dedup"](spark, docs, sf)
    got = out.collect()
    assert out.columns == names and {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)

    for name in ("near_dedup", "decontamination"):  # of the texts as they are, so that copies are there
        if name == "near_dedup":
            _, of = components_by_force_indexed(rows, 5, 80)
            keep = {d for d, c in of.items() if c == d}
            assert {5000, 5001} <= keep and 5007 not in keep
        else:
            keep = {d for d, _ in rows} - {x[0] for x in contaminated_by_force(rows, items) if x[4]}
            assert 5004 not in keep
        out = stages[name](spark, docs, sf)
        got = out.collect()
        assert out.columns == names and sorted((r.doc_id, r.text) for r in got if r.text is not None) == sorted((d, x) for d, x in rows if d in keep and x is not None)
        assert {r.doc_id for r in got} == keep and len(got) == len(keep)
