"""LM scoring: context-tree weighting over bytes, and a base score of word counts.

The model. A text is its bytes (A-Z lower-cased) and an end mark (byte 255). Each byte is
eight binary decisions; each of the 255 decision nodes has its own context tree over the
``DEPTH`` bytes before, nearest first. A tree node's block probability is half its
Krichevsky-Trofimov estimate plus half the product of its children's, so what a text gets
is the mixture over all depths. Every context of every depth that the training texts have
is in the trees, so the model grows with the corpus. ``bits_per_byte`` is the code length.

How it is spread. No task holds the model.

1. Texts are put into groups of about ``GROUP`` bytes. A group's distinct places (the DEPTH
   bytes before a byte, and the byte) and distinct words are sent, with how often training
   texts of the group have them, to shards: places by their nearest ``TOP`` bytes, words by
   their hash.
2. A shard adds counts up. Its trees are whole from depth TOP on; their block probabilities
   there are summed to depths 2 and 1 by grouping, and to the root on the driver, where
   there are 256 * 255 nodes at most.
3. A shard gets what the upper depths say of its contexts, computes the probability of each
   of its places, and answers the groups one after the other.
4. A group looks the answers up place by place and adds them up for each text.

The base score takes word counts from the same shards. Words are told apart by 64-bit
hashes, places exactly.

Defined results. A null text is an empty one: its end alone. Repeated rows and rows without
an id are scored one for one; a row without an id is not learned from. Without training
rows every bit has a half. An empty table gives an empty one. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import crc_of_id, let_go, release, settle, trimmed

DEPTH, TOP, GROUP, SHARD, MOST_SHARDS = 6, 3, 16 << 20, 8 << 20, 1 << 14
#: Framed bytes whose places are computed at a time, keys that are merged at a time, sorted arrays that wait to be merged,
#: and bytes of rows in a batch.
PIECE, RANGE, HELD, SENT = 5 << 16, 1 << 16, 16, 1 << 20
END_BYTE = 255
END_WORD = np.uint64(0x6A09E667F3BCC909)
#: Kinds of rows: texts of a group, places, words, and what upper depths say of a shard's contexts.
TEXT, PLACE, WORD, UPPER = 0, 1, 2, 3
ROW = "kind int, shard int, grp long, seq int, a binary, b binary"
NAMES = ["kind", "shard", "grp", "seq", "a", "b"]


def framed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with DEPTH zeros before and an end mark after each text, which of them to predict, offsets of texts among those)."""
    rows, size = len(off) - 1, np.diff(off)
    out = np.zeros(len(buf) + rows * (DEPTH + 1), np.uint8)
    ends = off[1:] + np.arange(1, rows + 1) * (DEPTH + 1) - 1
    mask = np.ones(len(out), bool)
    mask[(off[:-1] + np.arange(rows) * (DEPTH + 1))[:, None] + np.arange(DEPTH)] = False
    mask[ends] = False
    out[mask] = V.LOWER[buf]
    out[ends], mask[ends] = END_BYTE, True
    return out, mask, np.concatenate(([0], np.cumsum(size + 1)))


def places(t: np.ndarray, mask: np.ndarray) -> Iterator[np.ndarray]:
    """A number for each place, PIECE bytes at a time: the bytes before it, the nearest first, then the byte itself."""
    for k in range(DEPTH, len(t), PIECE):
        near = V.eights(t[k - DEPTH : k + PIECE])[np.flatnonzero(mask[k : k + PIECE])]
        codes = near & V.KEEP[DEPTH]
        codes <<= np.uint64(8)
        near >>= np.uint64(8 * DEPTH)
        near &= np.uint64(255)
        codes |= near
        yield codes


def tally_places(codes: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As tally(), with the mark sorted along in the code's lowest bit; codes are overwritten."""
    codes <<= np.uint64(1)
    codes |= counted
    codes.sort()
    marks = (codes & np.uint64(1)).astype(np.uint8)
    codes >>= np.uint64(1)
    start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[start], np.add.reduceat(marks, start, dtype=np.int64)


def text_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, and of the end of each row."""
    s, e, row = V.words(buf, off)
    rows = len(off) - 1
    return np.append(V.hashes(buf, s, e), np.full(rows, END_WORD)), np.append(row, np.arange(rows))


def tally(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how many of each are counted)."""
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(counted[order].astype(np.int64), start) if len(start) else start


def ranges(held: list[np.ndarray]) -> Iterator[list[slice]]:
    """Slices of sorted arrays, one of each, that hold the same range of keys: about RANGE of them, whatever they are."""
    step = RANGE >> 6
    cuts = np.sort(np.concatenate([k[::step] for k in held]))[64::64]
    bounds = [np.concatenate(([0], np.searchsorted(k, cuts), [len(k)])).tolist() for k in held]
    for i in range(len(cuts) + 1):
        yield [slice(b[i], b[i + 1]) for b in bounds]


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the sum of their counts) of some such pairs, merged range by range."""
    if len(held) == 1:
        return held[0]
    kind = held[0][1].dtype
    out = []
    for part in ranges([k for k, _ in held]):
        keys, n = tally(np.concatenate([k[i] for (k, _), i in zip(held, part)]), np.concatenate([n[i] for (_, n), i in zip(held, part)]))
        out.append((keys, n.astype(kind)))
    return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


def different(held: list[np.ndarray]) -> np.ndarray:
    """The different keys of some sorted arrays, in order, merged range by range."""
    return np.concatenate([V.keys_of(np.concatenate([k[i] for k, i in zip(held, part)])) for part in ranges(held)]) if len(held) != 1 else held[0]


def pack(x: np.ndarray, is_sorted: bool = False) -> bytes:
    """Numbers as bytes, all low parts first; sorted ones as steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if is_sorted else np.ascontiguousarray(x)
    planes = x.view(np.uint16).reshape(len(x), -1)
    return zstandard.compress(b"".join(planes[:, i].tobytes() for i in range(planes.shape[1])), 1)


def unpack(raw: bytes, kind, is_sorted: bool = False) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(raw), np.uint16)
    out = np.empty(len(data) * 2 // np.dtype(kind).itemsize, kind)
    planes = out.view(np.uint16).reshape(len(out), -1)
    for i in range(planes.shape[1]):
        planes[:, i] = data[i * len(out) : (i + 1) * len(out)]
    return np.cumsum(out, dtype=kind) if is_sorted else out


def by_shard(kind: int, keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, where its keys are) of sorted keys, for each shard that has any."""
    if not len(keys):
        return
    dealt = keys >> np.uint64(8 * (DEPTH + 1 - TOP)) if kind == PLACE else keys
    start = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1])))  # of keys that stay together
    shard = (V.mix(dealt[start]) % np.uint64(shards)).astype(np.int32)
    size = np.diff(start, append=len(keys))
    order = np.argsort(shard, kind="stable")
    shard, start, size = shard[order], start[order], size[order]
    bounds = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
    for i, j in zip(bounds[:-1], bounds[1:]):
        n = size[i:j]
        yield int(shard[i]), np.repeat(start[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], NAMES)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW in batches of about SENT bytes."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r[4]) + len(r[5])
        if size >= SENT:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def gather(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of ROW from doc_id, text and train: the texts of groups, and the places and words of each, by shard."""

    def keep(some, keys, n):
        some.append((keys, n.astype(np.uint32)))
        if len(some) > HELD:
            some[:] = [added(some)]

    def flush(held, grp):
        for kind, some in held.items():
            if some:
                keys, n = added(some)
                some.clear()
                yield from _batches((kind, s, grp, 0, pack(keys[at], True), pack(n[at])) for s, at in by_shard(kind, keys, shards))

    def rows(batches):
        grp, seq, size, held = TaskContext.get().partitionId() << 32, 0, 0, {PLACE: [], WORD: []}
        for b in batches:
            text, bounds = V.text_bytes(b.column(1))
            ids, known = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            train = b.column(2).to_numpy(zero_copy_only=False)
            for i, j in V.spans(bounds):
                buf, off = text[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                t, mask, o = framed(buf, off)
                counted, done = np.repeat(train[i:j], np.diff(o)), 0
                for codes in places(t, mask):
                    done += len(codes)
                    if len(codes):
                        keep(held[PLACE], *tally_places(codes, counted[done - len(codes) : done]))
                h, row = text_words(buf, off)
                keep(held[WORD], *tally(h, train[i:j][row]))
                head = np.array([j - i], np.int64).tobytes() + ids[i:j].tobytes() + off.tobytes() + known[i:j].tobytes()
                yield _batch([(TEXT, -1, grp, seq, zstandard.compress(buf.tobytes(), 3), zstandard.compress(head, 1))])
                size, seq = size + len(buf), seq + 1
                if size >= GROUP:
                    yield from flush(held, grp)
                    grp, seq, size, held = grp + 1, 0, 0, {PLACE: [], WORD: []}
        yield from flush(held, grp)

    return settle(docs.select("doc_id", "text", "train").mapInArrow(trimmed(rows), ROW), "groups")


def _runs(batches):
    """(kind, shard) and an iterator over the rows of each, in which they come one after the other."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row is not None:
        key = row[:2]

        def own(key=key):
            nonlocal row
            while row is not None and row[:2] == key:
                yield row
                row = next(rows, None)

        mine = own()
        yield key, mine
        for _ in mine:
            pass


MODEL = f"{ROW}, total long, known long"


def model(gathered: DataFrame, shards: int) -> DataFrame:
    """A row of ROW for each kind and shard: all its keys and their counts; with the sum of counts and how many are not 0."""

    def rows(batches):
        for (kind, shard), mine in _runs(batches):
            held, size = [], 0
            for r in mine:
                held.append((unpack(r[4], np.uint64, True), unpack(r[5], np.uint32).astype(np.int64)))
                size += len(held[-1][0])
                if len(held) > 8 and size > 1 << 20:
                    held = [added(held)]
                    size = 0
            keys, n = added(held)
            yield pa.RecordBatch.from_arrays([*_batch([(kind, shard, -1, 0, pack(keys, True), pack(n))]).columns, pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], [*NAMES, "total", "known"])

    sent = gathered.filter(F.col("kind") != TEXT).repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard")
    return settle(sent.mapInArrow(trimmed(rows), MODEL), "shards")


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5: Stirling's series eight steps up."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_formula(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


SMALL = 64
KT = kt_formula(*np.meshgrid(np.arange(SMALL, dtype=np.float64), np.arange(SMALL, dtype=np.float64), indexing="ij"))


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log block probability of a zeros and b ones."""
    out = KT[np.minimum(a, SMALL - 1).astype(np.int64), np.minimum(b, SMALL - 1).astype(np.int64)]
    big = np.flatnonzero((a >= SMALL) | (b >= SMALL))
    out[big] = kt_formula(a[big].astype(np.float64), b[big].astype(np.float64))
    return out


def above(key: np.ndarray, level: int) -> np.ndarray:
    """The node of one depth less: a node's number is its context, then the decisions so far."""
    low, high = np.uint64((1 << level) - 1), np.uint64(level + 8)
    return key >> high << np.uint64(level) | key & low


def shorter(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with a context one byte shorter, and their counts."""
    u, at = np.unique(keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255), return_inverse=True)
    return u, np.bincount(at, n, minlength=len(u)).astype(np.int64)


def trees(keys: np.ndarray, n: np.ndarray) -> Iterator[list[dict]]:
    """For each level of decisions, one after the other, the nodes of depths TOP to DEPTH: key, zeros, ones, block and
    stop (what is left to a node's own estimate), and up, each node's place among those above."""
    by_depth = {DEPTH: (keys, n)}
    for d in range(DEPTH - 1, TOP - 1, -1):
        by_depth[d] = shorter(*by_depth[d + 1])
    for level in range(8):
        nodes: list[dict] = []
        for d in range(DEPTH, TOP - 1, -1):
            k, c = by_depth[d]
            node = k >> np.uint64(8 - level)
            new = np.ones(len(k), bool)
            new[1:] = node[1:] != node[:-1]
            start = np.flatnonzero(new)
            ones = np.add.reduceat(np.where(k >> np.uint64(7 - level) & np.uint64(1), c, 0), start) if len(k) else start
            zeros = (np.add.reduceat(c, start) if len(k) else start) - ones
            x = {"key": node[start], "zeros": zeros, "ones": ones, "own": kt(zeros, ones)}
            if d == DEPTH:
                x |= {"block": x["own"], "stop": np.ones(len(start)), "of": np.cumsum(new) - 1}
            else:
                below = nodes[-1]
                below["up"] = np.searchsorted(x["key"], above(below["key"], level))
                weigh(x, np.bincount(below["up"], below["block"], minlength=len(start)))
            nodes.append(x)
        yield nodes[::-1]


def weigh(x: dict, below: np.ndarray) -> None:
    """Set block and stop of nodes whose children's blocks have the logarithm below."""
    x["block"] = np.logaddexp(x["own"], below) - np.log(2)
    x["stop"] = np.exp(x["own"] - np.log(2) - x["block"])


def one(x: dict) -> np.ndarray:
    return (x["ones"] + 0.5) / (x["zeros"] + x["ones"] + 1)


def down(x: dict, said: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what nodes and those above say of a one, the weight left to those below), from that of those above."""
    return said + left * x["stop"] * one(x), left * (1 - x["stop"])


def logs(keys: np.ndarray, n: np.ndarray, upper: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of each place; upper has for each level the nodes of depth TOP, and said and left above them."""
    out = np.zeros(len(keys))
    for level, nodes in enumerate(trees(keys, n)):
        known, said, left = upper[level]
        at = np.searchsorted(known, nodes[0]["key"])
        said, left = said[at], left[at]
        for d, x in enumerate(nodes):
            said, left = down(x, said, left) if d == 0 else down(x, said[x["up"]], left[x["up"]])
        p = np.where(keys >> np.uint64(7 - level) & np.uint64(1), said[nodes[-1]["of"]], 1 - said[nodes[-1]["of"]])
        out += np.log10(np.clip(p, 1e-300, 1))
        del nodes, x  # before those of the next level are made
    return out


NODE = "level int, key long, zeros long, ones long, block double"


def top_nodes(shard_model: DataFrame) -> DataFrame:
    """NODE of each node of depth TOP, with its shard."""

    def rows(batches):
        for b in batches:
            for shard, keys, n in zip(*(c.to_pylist() for c in b.columns)):
                for level, nodes in enumerate(trees(unpack(keys, np.uint64, True), unpack(n, np.int64))):
                    x = nodes[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x["key"]), v, np.int32)) for v in (shard, level)] + [pa.array(x["key"].view(np.int64)), pa.array(x["zeros"]), pa.array(x["ones"]), pa.array(x["block"])], ["shard", "level", "key", "zeros", "ones", "block"])

    return settle(shard_model.filter(F.col("kind") == PLACE).select("shard", "a", "b").mapInArrow(trimmed(rows), f"shard int, {NODE}"), "top-nodes")


def _above(key: str) -> str:
    return f"shiftleft(shiftrightunsigned({key}, level + 8), level) | ({key} & (shiftleft(1L, level) - 1))"


def _summed(nodes: DataFrame) -> DataFrame:
    """level, key, zeros, ones and below of the nodes one depth above."""
    return nodes.groupBy("level", F.expr(_above("key")).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("block").alias("below"))


def upper_rows(nodes: DataFrame) -> DataFrame:
    """Rows of ROW, UPPER of each shard: for its nodes of depth TOP what the root and depths 1 and 2 say, and leave."""

    def weighed(batches):
        for b in batches:
            level, key, zeros, ones, below = (c.to_numpy() for c in b.columns)
            x = {"zeros": zeros, "ones": ones, "own": kt(zeros, ones)}
            weigh(x, below)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(x["block"]), pa.array(x["stop"])], ["level", "key", "zeros", "ones", "block", "stop"])

    two = settle(_summed(nodes).select("level", "key", "zeros", "ones", "below").mapInArrow(weighed, f"{NODE}, stop double"), "two")
    first = _summed(two).toPandas()  # 256 * 255 rows at most
    table: dict[tuple[int, int], tuple[float, float]] = {}
    for level in range(8):
        rows = first[first["level"] == level]
        x = {k: rows[k].to_numpy(kind) for k, kind in (("key", np.int64), ("zeros", np.int64), ("ones", np.int64), ("below", np.float64))}
        x["own"] = kt(x["zeros"], x["ones"])
        weigh(x, x["below"])
        up, at = np.unique(above(x["key"].astype(np.uint64), level), return_inverse=True)
        root = {k: np.bincount(at, x[k], minlength=len(up)) for k in ("zeros", "ones")}
        root["own"] = kt(root["zeros"], root["ones"])
        weigh(root, np.bincount(at, x["block"], minlength=len(up)))
        said, left = down(root, np.zeros(len(up)), np.ones(len(up)))
        said, left = down(x, said[at], left[at])
        table |= {(level, k): v for k, v in zip(x["key"].tolist(), zip(said.tolist(), left.tolist()))}

    def lowered(batches):
        for b in batches:
            level, key, zeros, ones, stop = (c.to_numpy() for c in b.columns)
            up = [table[lv, k >> (lv + 8) << lv | k & ((1 << lv) - 1)] for lv, k in zip(level.tolist(), key.tolist())]
            said, left = down({"zeros": zeros, "ones": ones, "stop": stop}, np.array([u[0] for u in up]), np.array([u[1] for u in up]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said), pa.array(left)], ["level", "up", "said", "left"])

    told = two.select("level", "key", "zeros", "ones", "stop").mapInArrow(lowered, "level int, up long, said double, left double")

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by([("level", "ascending"), ("key", "ascending")])
        level = t.column("level").to_numpy().astype(np.int64)
        a = np.concatenate((np.bincount(level, minlength=8).astype(np.int64), t.column("key").to_numpy()))
        b = np.concatenate((t.column("said").to_numpy(), t.column("left").to_numpy()))
        return pa.Table.from_batches([_batch([(PLACE, t.column("shard")[0].as_py(), -1, 0, zstandard.compress(a.tobytes(), 1), zstandard.compress(b.tobytes(), 1))])])

    joined = nodes.select("shard", "level", "key", F.expr(_above("key")).alias("up")).join(told, ["level", "up"])
    return joined.select("shard", "level", "key", "said", "left").groupBy("shard").applyInArrow(together, ROW)


def read_upper(a: bytes, b: bytes) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    head, values = np.frombuffer(zstandard.decompress(a), np.int64), np.frombuffer(zstandard.decompress(b), np.float64)
    bounds, keys = np.concatenate(([0], np.cumsum(head[:8]))), head[8:].view(np.uint64)
    return {k: (keys[i:j], values[i:j], values[len(keys) + i : len(keys) + j]) for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:]))}


def answers(gathered: DataFrame, shard_model: DataFrame, upper: DataFrame, shards: int) -> DataFrame:
    """Rows of ROW for each row of places or words of a group: in b the logs of places, or the counts of words."""
    first = lambda df, turn: df.select(*NAMES, F.lit(turn).alias("turn"))
    every = first(shard_model, 0).unionByName(first(upper, 1)).unionByName(first(gathered.filter(F.col("kind") != TEXT), 2))

    def rows(batches):
        for (kind, shard), mine in _runs(batches):
            r = next(mine)
            keys, values = unpack(r[4], np.uint64, True), unpack(r[5], np.int64)
            for r in mine:
                if r[6] == 1:
                    values = logs(keys, values, read_upper(r[4], r[5])).astype(np.float32)
                else:
                    found = values[np.searchsorted(keys, unpack(r[4], np.uint64, True))]
                    yield _batch([(kind, shard, r[2], 0, b"", pack(found))])

    return every.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard", "turn").mapInArrow(trimmed(rows), ROW)


class Spots:
    """Where keys are in a sorted array: by a table of their hashes, and by search for those that share a hash."""

    BITS = 22

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.table = keys, np.zeros(1 << self.BITS, np.int32)
        for i in range(0, len(keys), RANGE):
            part = keys[i : i + RANGE]
            self.table[self.slot(part)] = np.arange(i, i + len(part), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        x >>= np.uint64(64 - self.BITS)
        return x.view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, all of which are there."""
        at = self.table[self.slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return at


SCORED = "doc_id long, n_bytes long, n_tokens long, n_known long, logs double, score double"


def score(gathered: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """SCORED of each text: its log10 probability, its words, those known, and the sum of log10(count + 1) of its words."""

    def one_group(t: pa.Table) -> pa.Table:
        kinds, which, seq = (t.column(c).to_pylist() for c in ("kind", "shard", "seq"))
        order = sorted(range(len(kinds)), key=lambda i: (kinds[i], seq[i], which[i]))
        of = {k: [i for i in order if kinds[i] == k] for k in (TEXT, PLACE, WORD)}
        a, b = t.column("a"), t.column("b")
        slices = []
        for i in of[TEXT]:
            head = zstandard.decompress(b[i].as_buffer())
            n = int(np.frombuffer(head, np.int64, 1)[0])
            ids, off, known = np.frombuffer(head, np.int64, n, 8), np.frombuffer(head, np.int64, n + 1, 8 + 8 * n), np.frombuffer(head, bool, n, 16 + 16 * n)
            slices.append((np.frombuffer(zstandard.decompress(a[i].as_buffer()), np.uint8), off, ids, known))
        # The keys of the group as it sent them, which the answers follow.
        table = {}
        for kind, make in ((PLACE, lambda buf, off: places(*framed(buf, off)[:2])), (WORD, lambda buf, off: [text_words(buf, off)[0]])):
            held = []
            for buf, off, _, _ in slices:
                for keys in make(buf, off):
                    held.append(V.keys_of(keys))
                    if len(held) > HELD:
                        held = [different(held)]
            keys = different(held)
            del held
            found = np.zeros(len(keys), np.float32 if kind == PLACE else np.int64)
            for i, (shard, at) in zip(of[kind], by_shard(kind, keys, shards)):
                assert which[i] == shard
                found[at] = unpack(b[i].as_buffer(), found.dtype)
            table[kind] = keys, found
        out, spots = [], Spots(table[PLACE][0])
        for buf, off, ids, known in slices:
            n = len(ids)
            u, mask, o = framed(buf, off)
            run, done, total = np.zeros(n + 1), 0, 0.0  # run: of the slice, up to each text's end
            for codes in places(u, mask):
                sums = np.cumsum(np.concatenate(([total], table[PLACE][1][spots.find(codes)])))
                i, j = np.searchsorted(o, (done, done + len(codes)), "right")
                run[i:j] = sums[o[i:j] - done]
                done, total = done + len(codes), sums[-1]
            h, row = text_words(buf, off)
            c = table[WORD][1][np.searchsorted(table[WORD][0], h)]
            counts = [np.bincount(row, w, minlength=n) for w in (None, c > 0, np.log10(c + 1.0))]
            cols = [pa.array(ids, mask=~known), pa.array(np.diff(o) - 1), pa.array(counts[0].astype(np.int64)), pa.array(counts[1].astype(np.int64)), pa.array(counts[2]), pa.array(run[1:] - run[:-1])]
            out.append(pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORED.split(", ")]))
        release()
        return pa.Table.from_batches(out)

    return gathered.filter(F.col("kind") == TEXT).unionByName(answered).groupBy("grp").applyInArrow(one_group, SCORED)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row.

    Rows whose crc32(doc_id) mod 7 is 2 are held out; the others with an id are learned from.
    """
    part = crc_of_id(F.col("doc_id")) % 7
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD))
    gathered = gather(docs.select("doc_id", "text", F.coalesce(part != 2, F.lit(False)).alias("train")), shards)
    shard_model = model(gathered, shards)
    let_go(shard_model)
    n, v = shard_model.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    upper = upper_rows(top_nodes(shard_model))
    out = score(gathered, answers(gathered, shard_model, upper, shards), shards)
    return out.select(
        "doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
