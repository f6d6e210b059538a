"""Ranked lexical search over an inverted index: Block-Max MaxScore.

An index is a table of shards, each of about ``SHARD`` bytes of texts. A shard has a row with its documents (ids in
order, lengths) and rows of ``PAGE`` terms at most. A term's postings are blocks of ``AT_ONCE`` documents: the last
document of each, its largest count and the length of its shortest document, by which a bound of the score holds for any
statistics, and the postings themselves, packed as gaps and counts of one, two or four bytes. New documents are
further shards; statistics are sums over shards.

A search takes items in blocks of ``ITEM_BYTES``. Postings of the items' terms are picked from the pages, their
documents are counted over all shards, and each shard is searched by one task:

1. Lists of an item are taken from the highest bound down. While documents that only the rest has might still reach the
   tenth best score so far, a list is essential: all its blocks are opened.
2. Other lists are only looked up for documents found so far: one whose score, with the block maxima of these lists
   at its place, stays below the tenth best is rejected before any block is opened.
3. The best of each shard are merged by score, then doc_id.

Defined results: texts that are null or without terms are no documents of the index, and items without terms have no
rows. Rows that repeat count and rank one by one; a missing doc_id comes after all others where scores are equal. Rows of
items that repeat are searched one by one too. Other columns do not matter, whatever their names. Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as V
from .common import settle, trimmed

#: Bytes of texts of a shard, terms of a page, documents of a block, bytes of items that are searched at once, results.
SHARD, PAGE, AT_ONCE, ITEM_BYTES, BEST = 24 << 20, 2048, 128, 8 << 20, 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The constants of the score.
UNIT, FREE, SHARE = 1_000_000_000, 100, 75
INDEX = "shard long, ids array<long>, lengths array<int>, terms array<long>, df array<int>, last array<int>, most array<int>, least array<int>, width array<int>, packed binary"
PICKED = "shard long, ids array<long>, lengths array<int>, term long, df int, last array<int>, most array<int>, least array<int>, width array<int>, packed binary"


def counted(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, count) of each term of each row, and terms of each row."""
    s, e, row = V.words(buf, off, V.ALNUM)
    h = V.hashes(buf, s, e)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h))), np.bincount(row, minlength=len(off) - 1)


def packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each value in width little-endian bytes at at."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = values[some] >> 8 * k & 255


def opened(data: np.ndarray, at: int, n: int, width: int) -> np.ndarray:
    """n values of width bytes at at."""
    return np.frombuffer(data[at : at + n * width].tobytes(), f"<u{width}").astype(np.int64)


def shard_rows(number: int, spans: list[tuple], ids: list) -> Iterator[pa.RecordBatch]:
    """Rows of INDEX from counted() of runs of texts."""
    lengths = np.concatenate([s[3] for s in spans])
    key = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
    missing = np.array([i is None for i in ids], bool)
    # Documents in order of their ids, those without terms left out.
    order = np.lexsort((key, missing))
    order = order[lengths[order] > 0]
    if not len(order):
        return
    place = np.full(len(ids), -1, np.int64)
    place[order] = np.arange(len(order))
    starts = np.cumsum([0, *(len(s[3]) for s in spans)])
    term = np.concatenate([s[0] for s in spans])
    doc = place[np.concatenate([s[1] + k for s, k in zip(spans, starts)])]
    tf = np.concatenate([s[2] for s in spans])
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    df = np.diff(np.append(first, len(term)))
    # Blocks: AT_ONCE postings of one term.
    rank = np.arange(len(term)) - np.repeat(first, df)
    opens = np.flatnonzero(rank % AT_ONCE == 0)
    n = np.diff(np.append(opens, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    length = lengths[order][doc]
    most, least, widest = np.maximum.reduceat(tf, opens), np.minimum.reduceat(length, opens), np.maximum.reduceat(gap, opens)
    size = lambda x: np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4))
    wg, wt = size(widest), size(most)
    start = np.cumsum(n * (wg + wt)) - n * (wg + wt)
    inner = np.arange(len(term)) - np.repeat(opens, n)
    data = np.zeros(int((n * (wg + wt)).sum()), np.uint8)
    g, t = np.repeat(wg, n), np.repeat(wt, n)
    packed(gap, g, np.repeat(start, n) + inner * g, data)
    packed(tf, t, np.repeat(start + n * wg, n) + inner * t, data)
    last, blocks = doc[opens + n - 1], -(-df // AT_ONCE)
    bounds = np.concatenate(([0], np.cumsum(blocks)))
    bytes_ = np.append(start, len(data))
    one = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind))
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5, pa.binary()]
    known = pa.array([[None if missing[k] else int(key[k]) for k in order]], pa.list_(pa.int64()))
    head = [pa.array([number]), known, one(lengths[order], pa.int32()), *(pa.nulls(1, k) for k in kinds[3:])]
    yield pa.RecordBatch.from_arrays(head, names)
    for i in range(0, len(first), PAGE):
        j = min(i + PAGE, len(first))
        a, b = bounds[i], bounds[j]
        cells = [one(term[first[i:j]].view(np.int64), pa.int64()), one(df[i:j], pa.int32()), *(one(v[a:b], pa.int32()) for v in (last, most, least, wg << 4 | wt)), pa.array([data[bytes_[a] : bytes_[b]].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, kinds[1]), pa.nulls(1, kinds[2]), *cells], names)


@trimmed
def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, spans, ids, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        buf, off = V.text_bytes(batch.column(1))
        found = batch.column(0).to_pylist()
        for i, j in V.spans(off):
            spans.append(counted(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
            ids += found[i:j]
            size += off[j] - off[i]
            if size >= SHARD:
                yield from shard_rows(number, spans, ids)
                number, spans, ids, size = number + 1, [], [], 0
    if spans:
        yield from shard_rows(number, spans, ids)


def build(docs: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text), as a written table."""
    return settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_shards, INDEX), "index")


def _picked(shared):
    """Postings of the wanted terms alone, a row for each, and the rows of documents."""

    @trimmed
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        names = [c.split(" ")[0] for c in PICKED.split(", ")]
        for batch in batches:
            for r in range(batch.num_rows):
                cell = dict(zip(batch.schema.names, (c[r] for c in batch.columns)))
                if cell["ids"].is_valid:
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(r, 1) for k in range(3)] + [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 4, pa.binary())], names)
                    continue
                v = {c: cell[c].values.to_numpy(zero_copy_only=False) for c in ("terms", "df", "last", "most", "least", "width")}
                hit = np.flatnonzero(np.isin(v["terms"], wanted))
                if not len(hit):
                    continue
                bounds = np.concatenate(([0], np.cumsum(-(-v["df"] // AT_ONCE))))
                at = np.concatenate(([0], np.cumsum(_block_bytes(v["df"], bounds, v["width"]))))
                data = cell["packed"].as_buffer()
                cut = lambda c: pa.array([v[c][bounds[k] : bounds[k + 1]] for k in hit], pa.list_(pa.int32()))
                n = len(hit)
                out = [pa.array([cell["shard"].as_py()] * n), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.array(v["terms"][hit]), pa.array(v["df"][hit], pa.int32()), *(cut(c) for c in ("last", "most", "least", "width"))]
                yield pa.RecordBatch.from_arrays([*out, pa.array([data[at[bounds[k]] : at[bounds[k + 1]]].to_pybytes() for k in hit], pa.binary())], names)

    return rows


def _block_bytes(df: np.ndarray, bounds: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes of each block of terms with df documents, whose blocks start at bounds."""
    n = np.full(bounds[-1], AT_ONCE, np.int64)
    n[bounds[1:] - 1] = (df - 1) % AT_ONCE + 1
    return n * ((width >> 4) + (width & 15))


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_part(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return FREE - SHARE + (SHARE * lengths.astype(np.int64) * n) // total


def count_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (UNIT * tf) // (1000 * tf + 8 * m)


class Postings:
    """The list of a term in a shard; blocks are opened when they are needed, and once."""

    def __init__(self, df: int, last: np.ndarray, most: np.ndarray, least: np.ndarray, width: np.ndarray, data: bytes, n: int, total: int) -> None:
        self.last, self.width, self.data = last, width, np.frombuffer(data, np.uint8)
        self.bound = count_part(most.astype(np.int64), length_part(least, n, total))
        self.size = np.full(len(last), AT_ONCE, np.int64)
        self.size[-1] = (df - 1) % AT_ONCE + 1
        self.start = np.cumsum(_block_bytes(np.array([df]), np.array([0, len(last)]), width))
        self.start = np.concatenate(([0], self.start))
        self.top, self.blocks = int(self.bound.max()), {}

    def block(self, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, parts of the score) of a block."""
        if k not in self.blocks:
            n, at, wg, wt = int(self.size[k]), int(self.start[k]), int(self.width[k]) >> 4, int(self.width[k]) & 15
            docs = np.cumsum(opened(self.data, at, n, wg)) + (self.last[k - 1] if k else 0)
            self.blocks[k] = docs, count_part(opened(self.data, at + n * wg, n, wt), m[docs])
        return self.blocks[k]

    def some(self, ks, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, parts = zip(*(self.block(int(k), m) for k in ks))
        return np.concatenate(docs), np.concatenate(parts)


def best_of_shard(lists: list[tuple[int, Postings]], m: np.ndarray, best: int = BEST, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the best of a shard for the lists (weight with repeats, postings) of an item.

    seen, if given, is told how many blocks of non-essential lists there are and how many were opened.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: -x[0] * x[1].top)
    rest = np.append(np.cumsum([w * p.top for w, p in lists][::-1])[::-1], 0)
    score, found, least, i = np.zeros(len(m), np.int64), np.zeros(len(m), bool), 1, 0
    while i < len(lists) and rest[i] >= least:
        w, p = lists[i]
        docs, parts = p.some(range(len(p.last)), m)
        score[docs] += w * parts
        found[docs] = True
        i += 1
        least = max(least, _tenth(score[found], best))
    cand = np.flatnonzero(found & (score + rest[i] >= least))
    other = lists[i:]
    if other and len(cand):
        blocks = np.array([np.searchsorted(p.last, cand) for _, p in other])
        bounds = np.array([np.append(w * p.bound, 0)[b] for (w, p), b in zip(other, blocks)])
        whole = score[cand] + bounds.sum(0)
        for (w, p), b, bound in zip(other, blocks, bounds):
            keep = whole >= least
            at = np.flatnonzero(keep & (b < len(p.last)))
            ks = np.unique(b[at])
            if seen is not None:
                seen["blocks"], seen["opened"] = seen.get("blocks", 0) + len(p.last), seen.get("opened", 0) + len(ks)
            whole[keep] -= bound[keep]
            if len(ks):
                docs, parts = p.some(ks, m)
                k = np.minimum(np.searchsorted(docs, cand[at]), len(docs) - 1)
                add = np.where(docs[k] == cand[at], w * parts[k], 0)
                score[cand[at]] += add
                whole[at] += add
                least = max(least, _tenth(score[cand[keep]], best))
        cand = cand[whole >= least]
    cand = cand[score[cand] > 0]
    order = np.lexsort((cand, -score[cand]))[:best]
    return cand[order], score[cand[order]]


def _tenth(scores: np.ndarray, best: int) -> int:
    return int(np.partition(scores, -best)[-best]) if len(scores) >= best else 0


FOUND = "query long, doc_id long, score long"


def _searched(shared, best: int):
    def rows(table: pa.Table) -> pa.Table:
        items, weight, n, total = shared.value
        head = table.column("ids").is_valid().combine_chunks()
        top = table.filter(head)
        ids, lengths = top.column("ids").combine_chunks().flatten(), top.column("lengths").combine_chunks().flatten().to_numpy()
        m = length_part(lengths, n, total)
        lists = {}
        for batch in table.filter(pc.invert(head)).to_batches():
            term, df, data = (batch.column(c).to_pylist() for c in ("term", "df", "packed"))
            cells = [batch.column(c) for c in ("last", "most", "least", "width")]
            for r in range(batch.num_rows):
                lists[term[r]] = Postings(df[r], *(c[r].values.to_numpy() for c in cells), data[r], n, total)
        out = []
        for q, terms in items:
            docs, scores = best_of_shard([(k * weight[t], lists[t]) for t, k in terms if t in lists], m, best)
            out.append((np.full(len(docs), q), ids.take(pa.array(docs)), scores))
        q, d, s = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(np.concatenate(q), pa.int64()), pa.chunked_array(d, pa.int64()), pa.array(np.concatenate(s), pa.int64())], ["query", "doc_id", "score"])

    return rows


def item_terms(text: str | None) -> list[tuple[int, int]]:
    """(term, times) of an item."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    h, _, n, _ = counted(buf, np.array([0, len(buf)]))
    return list(zip(h.view(np.int64).tolist(), n.tolist()))


def search(index: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each of items (item_id, text)."""
    spark, out = index.sparkSession, None
    kind = items.schema["item_id"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    n, total = index.filter("ids is not null").agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    for k in range(blocks):
        part = items.select("item_id", "text") if blocks == 1 else items.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        asked = [(r.item_id, item_terms(r.text)) for r in part.collect()]  # ITEM_BYTES or so
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], f"query long, item_id {kind}")
        wanted = np.array(sorted({t for _, ts in asked for t, _ in ts}), np.int64)
        picked = settle(index.mapInArrow(_picked(spark.sparkContext.broadcast(wanted)), PICKED), "picked")
        df = {r.term: r.df for r in picked.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # terms of a block of items
        weight = {t: term_weight(n, d) for t, d in df.items()}
        shared = spark.sparkContext.broadcast(([(q, ts) for q, (_, ts) in enumerate(asked)], weight, n, total))
        found = picked.groupBy("shard").applyInArrow(_searched(shared, best), FOUND)
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        merged = found.withColumn("rank", rank).filter(F.col("rank") <= best).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = merged if out is None else out.unionByName(merged)
    return out

