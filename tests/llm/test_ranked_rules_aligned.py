"""Lexical search, quality rules and cross-tokenizer alignment against brute force, and on the edges of their inputs."""

import bisect
import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import alignment, divergence, lexical
from tallgrass.llm import vectors as V

from test_llm import EDGES, frame, labels  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, EDGES).limit(0)


# 11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked_by_force(docs, items):
    """(item_id, rank, doc_id, score) in order; docs and items are (id, text)."""
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for i, text in items:
        found = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w, k in collections.Counter(terms(text)).items() if w in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:10])]
    return out


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


ITEMS = [(1, "many documents share alpha alpha"), (2, None), (3, "..."), (4, "x"), (5, "absent"), (1, "many documents share alpha alpha"), (6, "unlike TEXT id 日本語")]


def test_search_edges(spark, edges, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"score": F.lit(1), "query": F.lit("q"), "shard": F.lit(2)})
    found = lexical.search(lexical.build(edges), items)
    assert rows(found, "item_id", "rank", "doc_id", "score") == sorted(ranked_by_force(EDGES, ITEMS), key=str)
    assert lexical.search(lexical.build(empty), items).collect() == []
    assert lexical.search(lexical.build(edges), items.limit(0)).collect() == []


def test_search_small_shards_and_item_blocks(spark, documents, sf, monkeypatch):
    """Shards of a few texts, pages of a few terms and several blocks of items give the same."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(lexical, "ITEM_BYTES", 3000)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = sorted(ranked_by_force(docs, [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert rows(lexical.search(lexical.build(documents.repartition(7)), items), "item_id", "rank", "doc_id", "score") == want


def test_index_takes_further_shards(spark, documents):
    """The union of two indexes is the index of all documents, with statistics of both."""
    items = [(1, "the of and"), (2, "de la que")]
    a, b = documents.filter("doc_id % 3 = 0"), documents.filter("doc_id % 3 > 0")
    one = lexical.build(a).withColumn("shard", F.col("shard") + F.lit(1 << 50))
    found = lexical.search(one.unionByName(lexical.build(b)), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found, "item_id", "rank", "doc_id", "score") == sorted(ranked_by_force([(r.doc_id, r.text) for r in documents.collect()], items), key=str)


def plain_best(lists, m, best):
    score = np.zeros(len(m), np.int64)
    for w, p in lists:
        docs, parts = p.some(range(len(p.last)), m)
        score[docs] += w * parts
    order = np.lexsort((np.arange(len(m)), -score))[:best]
    return [(d, s) for d, s in zip(order.tolist(), score[order].tolist()) if s > 0]


def test_blocks_are_rejected_unopened():
    """Long lists of little weight are looked up block by block, and most of their blocks stay closed."""
    rng = np.random.default_rng(5)
    texts = [" ".join([*("rare%d" % k for k in range(4) if rng.random() < 0.001), *["common"] * int(rng.integers(0, 3)), *("usual" for _ in range(int(rng.random() < 0.8))), *("w%d" % k for k in rng.integers(0, 50, rng.integers(5, 60)))]) for _ in range(20_000)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    head, *pages = lexical.shard_rows(0, [lexical.counted(buf, off)], list(range(len(texts))))
    lengths = head.column(2)[0].values.to_numpy()
    n, total = len(lengths), int(lengths.sum())
    m = lexical.length_part(lengths, n, total)

    class Shared:
        value = np.array([t for t, _ in lexical.item_terms("rare0 rare1 rare2 rare3 common usual w1 w2")], np.int64)

    wanted = lexical._picked(Shared)
    lists = []
    for b in wanted(iter(pages)):
        for r in b.to_pylist():
            cells = [np.array(r[c], np.int64) for c in ("last", "most", "least", "width")]
            lists.append((lexical.term_weight(n, r["df"]), lexical.Postings(r["df"], *cells, r["packed"], n, total)))
    assert len(lists) == 8
    seen = {}
    got = lexical.best_of_shard(lists, m, 10, seen)
    assert list(zip(got[0].tolist(), got[1].tolist())) == plain_best(lists, m, 10)
    assert 0 < seen["opened"] < seen["blocks"] / 2
    for k in (1, 3, 50, 30_000):
        got = lexical.best_of_shard(lists, m, k)
        assert list(zip(got[0].tolist(), got[1].tolist())) == plain_best(lists, m, k)


# 12


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts_by_force(text):
    w = words(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(hit), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
MORE = [(20, "a b c d e f g h i j " * 6), (21, "one\n\none\n one\none\n\n"), (22, "\n".join(["the same line of eight words is here", "x"] * 9)), (23, "a " * 19 + "b"), (24, "w\x00x \x85 \xa0 é | <>#"), (25, " ".join(f"w{k}" for k in range(20)))]


def test_rules_counts_by_force(spark, documents, edges, empty):
    for df in (documents, edges, frame(spark, MORE), documents.drop("lang")):
        got = rows(divergence.rules(df), "doc_id", *COUNTS)
        assert got == sorted(((r.doc_id, *counts_by_force(r.text)) for r in df.collect()), key=str)
    assert divergence.rules(empty).collect() == []
    assert all(not r.kept for r in divergence.rules(documents).filter("base_failed").collect())


def distance(p, q):
    total = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        total += sum(x / 2 * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0)
    return total


def sign_class(c):
    tables = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\v\f\r", ".,;:!?'\"-()"]
    for k, t in enumerate(tables):
        if c in t:
            return k
    return (6 if 0x20 < ord(c) < 0x7F else 7) if ord(c) < 0x80 else 7 + len(c.encode()) - 1


def shares(counter):
    n = sum(counter.values())
    return {k: v / n for k, v in counter.items()} if n else {}


def test_rules_distances_by_force(documents):
    """Distances from the nearest language, computed from plain counters."""
    docs = [(r.doc_id, r.text or "", r.lang) for r in documents.collect()]
    fold = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.translate(LOWER))
    total = {lang: (collections.Counter(), collections.Counter()) for _, _, lang in docs}
    for _, text, lang in docs:
        total[lang][0].update(fold(text))
        total[lang][1].update(map(sign_class, text))
    every = sum(sum(w.values()) for w, _ in total.values())
    known = {}
    for lang, (w, c) in total.items():
        n = sum(w.values())
        if n * divergence.FEW >= every:
            common = {k: v / n for k, v in w.items() if v * divergence.RARE >= n}
            known[lang] = (common, shares(c))
    most = max(len(c) for c, _ in known.values())
    for r in divergence.rules(documents).collect():
        text = next(t for d, t, _ in docs if d == r.doc_id)
        w, c = collections.Counter(fold(text)), collections.Counter(map(sign_class, text))
        n, signs = sum(w.values()), sum(c.values())
        near = []
        for common, q in known.values():
            p = {k: w[k] / n for k in common if n and w[k]}
            rest = {**p, None: 1 - sum(p.values())}
            by_words = distance(rest, {**common, None: 1 - sum(common.values())})
            by_signs = distance(shares(c), q) if signs else distance({}, q)
            near.append((round(by_words + by_signs, 9), by_signs, by_words))
        _, s, d = min(near)
        if n and signs:
            assert (r.sign_distance, r.word_distance) == (pytest.approx(math.sqrt(s), abs=2e-5), pytest.approx(math.sqrt(d), abs=2e-5))
        noise = lambda groups, k: (groups - 1) / (8 * math.log(2) * max(k, 1))
        far = (signs >= divergence.LEAST_SIGNS and s > divergence.FAR_SIGNS**2 + noise(11, signs)) or (n >= divergence.LEAST_WORDS and d > divergence.FAR_WORDS**2 + noise(most + 1, n))
        assert r.kept == (not r.base_failed and not far), (r, s, d)


def test_rules_keep_clean_documents(spark, documents, sf):
    """Nearly all rows that are labelled good and have enough words stay; shouted and studded ones of some length go."""
    q = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = divergence.rules(documents).join(q, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    assert np.mean(good) > 0.98
    assert sum(not r.kept for r in got if r.quality == 0) > 0
    shout = [(1000 + k, " ".join(w.upper() + "!!" for w in t.split())) for k, t in enumerate(r.text for r in documents.filter("length(text) > 900 and lang = 'en'").limit(5).collect())]
    new = spark.createDataFrame(shout, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert not any(r.kept for r in divergence.rules(documents.select("doc_id", "text", "lang").unionByName(new)).filter("doc_id >= 1000").collect())


def test_languages_without_reference_and_texts_without_language(spark, documents):
    """A language with few words has no reference, and a document of it is only judged by counts."""
    odd = "Ж" * 30 + " " + " ".join(f"ж{k}" for k in range(60))
    extra = spark.createDataFrame([(5000, odd, "xx"), (5001, odd, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in divergence.rules(documents.select("doc_id", "text", "lang").unionByName(extra)).filter("doc_id >= 5000").collect()}
    assert got == {5000: True, 5001: False}


# 13


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = alignment.byte_signs()
    a_bytes = lambda i: bytes(signs[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def groups_by_force(text, tokenizers):
    """[(a ids, b ids)] of a text."""
    a, b, a_bytes, b_bytes = tokenizers
    if not text:
        return []
    x, y, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    p, q = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
    if b"".join(p) != want or b"".join(q) != want:
        return []
    ends = lambda parts: np.cumsum([len(v) for v in parts]).tolist()
    ea, eb = ends(p), ends(q)
    both = sorted({*ea} & {*eb})
    out = [([], []) for _ in both]
    for ids, e, k in ((x, ea, 0), (y, eb, 1)):
        for i, end in zip(ids, e):
            out[bisect.bisect_left(both, end)][k].append(i)
    return out


def aligned_by_force(docs, tokenizers):
    of = {t: groups_by_force(t, tokenizers) for t in {t for _, t in docs}}
    pairs = {t: collections.Counter((i, j) for a, b in g for i in a for j in b) for t, g in of.items()}
    n = collections.Counter(p for _, t in docs for p in pairs[t])
    most = {}
    for (i, _), k in n.items():
        most[i] = max(most.get(i, 0), k)
    out = []
    for d, t in docs:
        g, c = of[t], pairs[t]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(k for p, k in c.items() if n[p] == most[p[0]]), sum(k * n[p] for p, k in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (30, "x▁y"), (31, " lead"), (32, "trail \n\n  two"), (33, "<s></s><unk><0x0A><|endoftext|>"), (34, "\x00\x01 tab\there"), (35, "日本語のテキスト、です。 😀👩‍👩‍👧 é"), (36, "=" * 700 + " " * 9 + "-" * 300), (37, "a\nb\n\nc"), (38, "nbsp\xa0here   wide"),
    (39, "don't we'll I'm 12345678 $%^"), (40, "\n"), (41, "a" * 5000), (42, "ﬁ ² Å ﻿ ﷺ"),
]


def test_alignment_by_force(spark, documents, edges, empty, tokenizers):
    for df in (documents, edges.unionByName(frame(spark, ODD)).unionByName(edges)):
        want = aligned_by_force([(r.doc_id, r.text) for r in df.collect()], tokenizers)
        assert rows(alignment.align(df), *ALIGNED) == want
    assert alignment.align(empty).collect() == []


def test_small_caches_blocks_and_large_groups(spark, documents, tokenizers, monkeypatch):
    """Parts that are forgotten, many blocks, and groups listed by distinct ids give the same."""
    texts = [r.text for r in documents.limit(40).collect()] + [t for _, t in ODD]
    data = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
    pair = alignment.pair(alignment.BYTE_BPE, alignment.PIECE_BPE)
    want = alignment.aligned(pair, buf, off)
    monkeypatch.setattr(alignment, "GROUP", 1)
    monkeypatch.setattr(alignment, "CACHE", 100)
    got = alignment.aligned(pair, buf, off)
    assert all(list(want[c]) == list(got[c]) for c in want)
    for k, t in enumerate(texts):
        c = collections.Counter((i, j) for a, b in groups_by_force(t, tokenizers) for i in a for j in b)
        i, j = want["first"][k : k + 2]
        assert dict(zip(want["key"][i:j].tolist(), want["times"][i:j].tolist())) == {a << 32 | b: n for (a, b), n in c.items()}


def test_decimal():
    ids = np.array([0, 9, 10, 99, 100, 50256, 7, 999999])
    out, off = alignment.decimal(ids, np.array([44, 59, 0, 124, 44, 44, 0, 0], np.uint8))
    assert bytes(out) == b"0,9;1099|100,50256,7999999" and off[-1] == len(out)
    assert len(V.words(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]) == 0


# 10


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def crafted(version, ticks, fragments=False):
    """A file of one track of 4-byte samples, written box by box by the format's description."""
    n32 = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    long = n32(version << 24) + bytes(16 if version else 8) + n32(1000) + ticks.to_bytes(8 if version else 4, "big") + bytes(4)
    count = 0 if fragments else 2
    data = b"abcdefgh"
    table = lambda at: box(b"stbl", box(b"stsd", n32(0, 1), box(b"raw ", bytes(28))), box(b"stts", n32(0, 1, count, 1)), box(b"stsc", n32(0, 0 if fragments else 1), b"" if fragments else n32(1, 2, 1)), box(b"stsz", n32(0, 0, count), n32(*[4] * count)), box(b"stco", n32(0, 0 if fragments else 1), b"" if fragments else n32(at)))
    moov = lambda at: box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", long), box(b"minf", table(at)))))
    head = box(b"ftyp", b"isom", bytes(4))
    return head + moov(len(head) + len(moov(0)) + 8) + (box(b"moof", box(b"mfhd", n32(0, 1))) if fragments else b"") + box(b"mdat", data)


def test_unknown_durations_and_fragments(spark):
    from tallgrass.llm import media

    files = [(1, crafted(1, (1 << 64) - 1)), (2, crafted(0, 0xFFFFFFFF)), (3, crafted(1, 5000)), (4, crafted(0, 7, True)), (5, crafted(1, 1 << 63))]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files], "id int, media binary")
    got = {r.id: r for r in media.probe(df, "media", ["id"]).collect()}
    assert [got[k].duration for k in (1, 2, 3, 5)] == [None, None, 5000, None] and all(got[k].error is None for k in (1, 2, 3, 5))
    assert [files[2][1][a.start : a.end] for a in got[3].keyframes] == [b"abcd", b"efgh"] and got[3].codec == "raw "
    assert got[4].error == "samples in fragments" and got[4].samples is None
