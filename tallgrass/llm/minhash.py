"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds its distinct runs of ``width`` words (A-Z lower-cased); one with
fewer words has its whole sequence as its only run. Documents whose sets reach the
similarity are linked, and linked documents make a component.

1. One pass over the texts gives each document a fingerprint of its set and the hashes
   of its signature's bands. Equal sets are one class from here on, so that a group of
   copies, however large, costs one row.
2. Each class is compared with the first class of a bucket it is in (a star), on full sets.
3. Buckets that still hold several components are then settled completely, in blocks where
   a bucket is large: members that may be similar to one of another component, by their
   signatures, come together with their sets, and every such pair is compared. Only links
   are emitted, one for each union.

Before sets are fetched a pair must agree in a share of signature places of at least
``SLACK`` below the similarity, 4.5 standard deviations at 0.85.

With 16 bands of 4 a pair at 0.85 shares no bucket with a chance of 7e-6; at 0.8 of 2e-4.
Sets are compared as sets of 64-bit hashes.

Defined results. A null text, or one without words, has an empty set and is linked with
nothing. Rows that share an id are one document: a link of either is a link of both.
A row without an id is linked with nothing and kept. Repeated rows are kept one for one.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import bloom, fresh, settle, trimmed
from .components import components

#: Length of a signature, rows of a band, and members of a block of a large bucket.
LENGTH, ROWS, BLOCK, SLACK = 64, 4, 512, 0.2
EMPTY = np.uint64(V.M64)


def super_minhash(h: np.ndarray, off: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A signature for each row of distinct hashes h[off[i]:off[i + 1]].

    At step j every element offers the value j + r at the j-th place of its own random
    permutation, so an element's ranks are spread over all places. A row needs no more
    steps once each place has a value, for a later one is larger.
    """
    rows = len(off) - 1
    size = np.diff(off)
    sig = np.full(rows * length, EMPTY, np.uint64)
    row = np.repeat(np.arange(rows), size)
    perm = None
    for j in range(length):
        x = V.mix(h + np.uint64((0xA0761D6478BD642F * (j + 1)) & V.M64))
        k = ((x >> np.uint64(32)) * np.uint64(length - j) >> np.uint64(32)).astype(np.int64) + j
        if perm is None:
            place = k
        else:
            at = np.arange(len(h))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, j]
        np.minimum.at(sig, row * length + place, np.uint64(j << 32) | (x & np.uint64(0xFFFFFFFF)))
        open_rows = (sig.reshape(rows, length) == EMPTY).any(axis=1) & (size > 0)
        if not open_rows.any():
            break
        more = open_rows[row]
        if perm is None:
            h, row, k = h[more], row[more], k[more]
            perm = np.tile(np.arange(length, dtype=np.uint8), (len(h), 1))
            perm[np.arange(len(h)), k] = 0
        elif not more.all():
            h, row, perm = h[more], row[more], perm[more]
    return sig.reshape(rows, length)


def sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    s, e, row = V.words(buf, off)
    x, r = V.shingles(V.hashes(buf, s, e), row, len(off) - 1, width)
    return V.distinct(x, r, len(off) - 1)


def fold(h: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """The sum of the mixed hashes of each row."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(V.mix(h ^ np.uint64(seed)), dtype=np.uint64)))
    return total[off[1:]] - total[off[:-1]]


def _batches(batches, width: int, make):
    """make() of the columns before the text, and of the sets, about a megabyte at a time."""
    for b in batches:
        buf, off = V.text_bytes(b.columns[-1])
        for i, j in V.spans(off):
            with np.errstate(over="ignore"):
                h, o = sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                yield make([c.slice(i, j - i) for c in b.columns[:-1]], h, o)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h (a hash of the text), n (size of the set), f1 and f2 (its fingerprint), bands, sketch (a byte of each place)."""
    bands = LENGTH // ROWS

    def make(first, h, o):
        sig, rows = super_minhash(h, o), len(o) - 1
        key = np.zeros((rows, bands), np.uint64)
        for r in range(ROWS):
            key = V.mix(key * np.uint64(31) + sig[:, r::ROWS] + np.uint64(r))
        out = [*first, pa.array(np.diff(o)), pa.array(fold(h, o, 0x5851F42D4C957F2D).view(np.int64)), pa.array(fold(h, o, 0x14057B7EF767814F).view(np.int64)), V.lists(key.ravel(), np.arange(rows + 1) * bands), pa.array([x.tobytes() for x in (V.mix(sig) & np.uint64(255)).astype(np.uint8)], pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "h", "n", "f1", "f2", "bands", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(trimmed(lambda it: _batches(it, width, make)), "doc_id long, h long, n long, f1 long, f2 long, bands array<long>, sketch binary")


def set_rows(rows: DataFrame, width: int) -> DataFrame:
    """u and the set of text as bytes of sorted 64-bit values."""

    def make(first, h, o):
        raw = h.tobytes()
        return pa.RecordBatch.from_arrays([*first, pa.array([raw[a * 8 : b * 8] for a, b in zip(o[:-1], o[1:])], pa.binary())], ["u", "hashes"])

    return rows.select("u", "text").mapInArrow(trimmed(lambda it: _batches(it, width, make)), "u long, hashes binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = V.overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose sets reach the similarity."""
    named = lambda k: sets_of.select(F.col("u").alias(k), F.col("hashes").alias(f"h{k}"))

    def rows(batches):
        for b in batches:
            u, v, x, y = b.columns
            good = [_similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(named("v"), "v").join(named("u"), "u").select("u", "v", "hu", "hv").mapInArrow(rows, "u long, v long")


def promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose signatures and sizes allow the similarity."""
    named = lambda k: reps.select(F.col("u").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}"))

    def rows(batches):
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, LENGTH) for k in (2, 3))
            n, m = b.column(4).to_numpy(), b.column(5).to_numpy()
            good = ((s == t).mean(axis=1) >= percent / 100 - SLACK) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(good))

    return pairs.join(named("v"), "v").join(named("u"), "u").select("u", "v", "su", "sv", "nu", "nv").mapInArrow(rows, "u long, v long")


def _members(t: pa.Table, percent: int):
    """The members of one bucket, or of two blocks of it, and which pairs of them are to be compared there."""
    t = t.sort_by("u")
    band, i, j = (t.column(c)[0].as_py() for c in ("band", "i", "j"))
    block, n = t.column("block").to_numpy(), t.column("n").to_numpy()
    bands = np.array(t.column("bands").to_pylist(), np.int64)

    def can(a: int, comp: np.ndarray) -> np.ndarray:
        ok = (comp != comp[a]) & (100 * n >= percent * n[a]) & (100 * n[a] >= percent * n)
        ok[: a + 1] = False
        if i != j:
            ok &= block != block[a]
        if band and ok.any():  # a pair is compared in the first bucket that it shares
            ok &= ~(bands[:, :band] == bands[a, :band]).any(axis=1)
        return ok

    return t, can


def _hopeful(percent: int):
    """Members with a pair in different components that their signatures allow."""

    def pick(t: pa.Table) -> pa.Table:
        t, can = _members(t, percent)
        comp, sketch = t.column("comp").to_numpy(), np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, LENGTH)
        some = np.zeros(len(comp), bool)
        for a in range(len(comp)):
            b = np.flatnonzero(can(a, comp))
            b = b[(sketch[b] == sketch[a]).mean(axis=1) >= percent / 100 - SLACK]
            some[b] = True
            some[a] |= len(b) > 0
        return t.drop_columns(["sketch"]).filter(pa.array(some))

    return pick


def _settle_block(percent: int):
    """Links between members of one bucket (or of two blocks of it) in different components."""

    def links(t: pa.Table) -> pa.Table:
        t, can = _members(t, percent)
        ids, comp = t.column("u").to_numpy(), t.column("comp").to_numpy().copy()
        own, found = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()], []
        for a in range(len(ids)):
            for b in np.flatnonzero(can(a, comp)):
                if comp[a] != comp[b] and _similar(own[a], own[b], percent):
                    found.append((ids[b], ids[a]))
                    comp[comp == comp[b]] = comp[a]
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links


def _sets_of(docs: DataFrame, sig: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """u and set of each u wanted; a row is found again by its id and the hash of its text."""
    keys = settle(sig.select("u", "doc_id", "h").join(wanted.distinct(), "u"), "wanted")
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return settle(set_rows(bloom(texts, F.xxhash64("doc_id", "h"), keys, F.xxhash64("doc_id", "h")).join(keys, ["doc_id", "h"]), width).dropDuplicates(["u"]), "sets")


MEMBER = "band int, hash long, i int, j int, block int, u long, n long, comp long, bands array<long>"


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each of docs: doc_id, h (a hash of the text), n_shingles, component_id (the smallest linked id), kept
    (doc_id is component_id) and first (true for one row of each component)."""
    docs = docs.select("doc_id", "text")
    sig = settle(signatures(docs, width).withColumn("u", F.monotonically_increasing_id()), "signatures")
    some = sig.filter("n > 0 and doc_id is not null")
    first = some.groupBy("f1", "f2", "n").agg(F.min("u").alias("rep"))
    copies = some.join(first, ["f1", "f2", "n"])
    reps = settle(copies.filter("u = rep").select("u", "n", "bands", "sketch"), "classes")
    rows = reps.select("u", F.posexplode("bands").alias("band", "hash"))
    buckets = rows.groupBy("band", "hash").agg(F.min("u").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    shared = settle(rows.join(buckets, ["band", "hash"]), "buckets")
    star = shared.filter("u <> lead").groupBy("u").agg(F.min("lead").alias("v"))
    star = settle(promising(star, reps, percent), "stars")
    links = settle(verified(star, _sets_of(docs, sig, star.select("u").union(star.select("v")), width), percent), "links")
    comp = settle(components(links), "components")
    open_members = shared.join(comp.select(F.col("node").alias("u"), "component"), "u", "left").withColumn("comp", F.coalesce("component", "u"))
    still = open_members.groupBy("band", "hash").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("band", "hash")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = open_members.join(still, ["band", "hash"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("u", "hash"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    members = members.join(reps, "u").select(*[x.split()[0] for x in MEMBER.split(", ")], "sketch")
    hopeful = settle(members.groupBy("band", "hash", "i", "j").applyInArrow(_hopeful(percent), MEMBER), "hopeful")
    wide = hopeful.join(_sets_of(docs, sig, hopeful.select("u"), width), "u").select(*hopeful.columns, "hashes")
    more = wide.groupBy("band", "hash", "i", "j").applyInArrow(_settle_block(percent), "u long, v long")
    again = some.groupBy("doc_id").agg(F.min("u").alias("v"), F.max("u").alias("u")).filter("u <> v").select("doc_id", "v")
    same_id = some.select("doc_id", "u").join(again, "doc_id").filter("u <> v").select("u", "v")
    edges = links.unionByName(more).unionByName(copies.filter("u <> rep").select("u", F.col("rep").alias("v"))).unionByName(same_id)
    final = settle(components(settle(edges, "edges")).join(sig.select(F.col("u").alias("node"), "doc_id"), "node"), "components")
    names = final.groupBy("component").agg(F.min(F.struct("doc_id", F.col("node").alias("u"))).alias("least"))
    named = final.join(names, "component").select(F.col("node").alias("u"), F.col("least.doc_id").alias("component_id"), (F.col("node") == F.col("least.u")).alias("first"))
    out = sig.select("u", "doc_id", "h", F.col("n").alias("n_shingles")).join(named, "u", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept, first = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)), F.coalesce("first", F.lit(True))
    return out.select("doc_id", "h", "n_shingles", "component_id", kept.alias("kept"), first.alias("first"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns of docs; rows without an id stay."""
    same, d, h = fresh(docs, "same", "d", "h")
    out = near_duplicates(docs, width, percent).filter("first and doc_id is not null").select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    some = docs.withColumn(same, F.xxhash64("text")).join(out, (docs["doc_id"] == F.col(d)) & (F.col(same) == F.col(h)), "left_semi")
    return some.dropDuplicates(["doc_id", same]).drop(same).unionByName(docs.filter(docs["doc_id"].isNull()))
