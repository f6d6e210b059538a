"""Line dedup: an exact set-similarity join of lines.

A line's set holds its distinct words (A-Z lower-cased). A line is removed if an earlier
one, in the order of doc_id, line number and row, has a Jaccard similarity of ``percent``
or more with it, whether or not that one is removed too.

1. The texts are read once. Their lines become sets of word hashes, written in slices of
   about a megabyte of text: a dictionary of the slice's words and, for each line, places
   in it. Lines with equal sets are one class; of a class a task writes the earliest line,
   and knows that the later ones are removed.
2. Counts over all lines give the rarity of words, in ``SLOTS`` counters that words share by
   their hash. A word's number has the logarithm of its counter in front and its hash behind,
   so that numbers are in order of rarity.
3. Each class posts its rarest words, as many as must include a word that a similar set
   also posts. Rows of one word are compared under bounds on length, on what can still
   follow the common word's positions, and on the parity bits of the two sets, of which
   no more can differ than words do. Words too common for one task are dealt into blocks
   whose pairs go to different tasks.
4. Pairs that remain are verified on full sets. A task names for each line at most
   ``AT_ONCE`` earlier partners, the earliest first; lines for which none of them holds
   and which had more are looked at again with ``MORE`` times as many, until none is left.

Sets are compared as sets of 64-bit hashes.

Defined results. A null or empty text has no lines. Lines without words are never removed.
Rows equal in id and text are one document given several times, and are treated alike;
texts that share an id are told apart by their 64-bit hashes (``row``), which order lines
of one number among them. Rows without an id come first; each is a document of its own,
in the order in which they were read. An empty table gives an empty one. Columns other
than doc_id and text are passed on as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import bloom, fresh, let_go, release, settle, trimmed

BLOCK, MOST_BLOCKS, AT_ONCE, MORE, PERCENT, PART, LONG = 1 << 13, 1 << 12, 8, 256, 80, 1 << 19, 100
#: Counters of words, the parts in which they are added up, steps of the logarithm, and bits of a number behind it.
SLOTS, SLOT_PARTS, STEPS, HASH_BITS = 1 << 21, 64, 1024, np.uint64(48)
#: Places of sets, or numbers of removed lines, that are sent to every task (some 16 MB); more are joined.
BROADCAST_PLACES = 1 << 22
PAIR_BITS = np.uint64((1 << 40) - 1)
NO_ID = -(1 << 63)


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells rows apart that share an id: the hash of the text, or a
    number from a written table where there is no id; 0 where an id has one text."""
    unnamed = settle(docs.filter(docs["doc_id"].isNull()).withColumn(name, F.monotonically_increasing_id()), "unnamed")
    named, h = docs.filter(docs["doc_id"].isNotNull()), F.xxhash64("text")
    shared = settle(named.select("doc_id", h.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return named.withColumn(name, F.lit(0).cast("long")).unionByName(unnamed)
    (mark,) = fresh(named, "mark")
    return bloom(named, F.col("doc_id"), shared, F.col("doc_id"), mark=mark).withColumn(name, F.when(F.col(mark), h).otherwise(0)).drop(mark).unionByName(unnamed)


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of all lines, document of each, number of each in its document)."""
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.unique(np.concatenate((off[:-1], breaks + 1)))
    starts = starts[starts < len(buf)] if len(buf) else starts[:0]
    doc = np.searchsorted(off, starts, "right") - 1
    before = np.searchsorted(breaks, starts) - np.searchsorted(breaks, off[doc])
    return np.append(starts, len(buf)), doc, before


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at start, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


#: The keys of the lines of a slice.
KEYS = {"size": np.uint32, "doc_id": np.int64, "row": np.int64, "line": np.int32, "f": np.int64}


def _pack(words: np.ndarray, place: np.ndarray, o: np.ndarray, keys: dict) -> bytes:
    """Words, which are sorted, as steps, and places as steps in their line; both with all low parts first."""
    head, first = np.array([len(words), len(keys["f"]), len(place)], np.int64), o[:-1]
    steps = np.diff(place, prepend=np.uint32(0))
    steps[first] = place[first]
    planes = np.diff(words, prepend=np.uint64(0)).view(np.uint16).reshape(len(words), 4)
    own = [keys[k].astype(d) for k, d in KEYS.items()]
    return zstandard.compress(b"".join(x.tobytes() for x in (head, *own, *(planes[:, i] for i in range(4)), (steps & np.uint32(0xFFFF)).astype(np.uint16), (steps >> np.uint32(16)).astype(np.uint16))), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(words sorted, places of all lines' words, offsets of lines, keys) of a slice."""
    data, at = zstandard.decompress(raw), 24
    d, n, w = np.frombuffer(data, np.int64, 3).tolist()

    def take(kind, count):
        nonlocal at
        at += count * np.dtype(kind).itemsize
        return np.frombuffer(data, kind, count, at - count * np.dtype(kind).itemsize)

    keys = {k: take(kind, n) for k, kind in KEYS.items()}
    words = np.empty(d, np.uint64)
    for i in range(4):
        words.view(np.uint16).reshape(d, 4)[:, i] = take(np.uint16, d)
    low, high = take(np.uint16, w), take(np.uint16, w)
    steps, o = low | high.astype(np.uint32) << np.uint32(16), np.concatenate(([0], np.cumsum(keys["size"], dtype=np.int64)))
    total = np.cumsum(steps, dtype=np.uint32)
    place = total - np.repeat(total[o[:-1]] - steps[o[:-1]], keys["size"])
    return np.cumsum(words, dtype=np.uint64), place, o, keys


def slices(docs: DataFrame) -> DataFrame:
    """slice (a number), data (classes of lines) and gone (lines that have an equal one before them
    in the task), from rows of doc_id, text and row."""

    def rows(batches):
        seen: dict[int, tuple[int, int, int]] = {}
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            all_ids, all_rows = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            text, bounds = V.text_bytes(b.column(1))
            for i, j in V.spans(bounds):
                ids, row, buf, off = all_ids[i:j], all_rows[i:j], text[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                lines, doc, nth = lines_of(buf, off)
                s, e, of = V.words(buf, lines)
                words, place = np.unique(V.hashes(buf, s, e), return_inverse=True)
                place, o = V.distinct(place.astype(np.uint32), of, len(doc))
                with np.errstate(over="ignore"):
                    f = fingerprints(V.mix(words)[place], o)
                some = np.flatnonzero(np.diff(o))
                some = some[np.lexsort((row[doc[some]], nth[some], ids[doc[some]], f[some]))]
                at = {"f": f[some], "doc_id": ids[doc[some]], "line": nth[some], "row": row[doc[some]]}
                new = np.diff(at["f"], prepend=0) != 0
                new[:1] = True
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                gone = (at["doc_id"] != at["doc_id"][lead]) | (at["line"] != at["line"][lead]) | (at["row"] != at["row"][lead])
                keep = np.flatnonzero(new)
                stay = np.ones(len(keep), bool)
                for n, (key, *mine) in enumerate(zip(*(at[k][keep].tolist() for k in ("f", "doc_id", "line", "row")))):
                    mine, was = tuple(mine), seen.get(key)
                    if was is None or mine < was:
                        seen[key] = mine
                    else:
                        stay[n], gone[keep[n]] = False, mine > was
                if len(seen) > 100_000:
                    seen = {}
                keep = keep[stay]
                size = np.diff(o)[some[keep]]
                own = place[flat(o[some[keep]], size)]
                data = _pack(words, own, np.concatenate(([0], np.cumsum(size))), {"size": size} | {k: v[keep] for k, v in at.items()})
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary()), pa.array([zstandard.compress(b"".join(at[k][gone].astype(KEYS[k]).tobytes() for k in ("doc_id", "row", "line")), 1)], pa.binary())], ["slice", "data", "gone"])
                number += 1

    return settle(docs.select("doc_id", "text", "row").mapInArrow(trimmed(rows), "slice long, data binary, gone binary"), "lines")


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def rarity(parsed: DataFrame) -> tuple[np.ndarray, int]:
    """(scaled logarithm of each of SLOTS counters, count of all words): 4 MB, whatever the size of the table."""
    width = SLOTS // SLOT_PARTS

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                words, place, _, _ = _unpack(raw)
                np.add.at(n, _slot(words), np.bincount(place, minlength=len(words)))
        salt = TaskContext.get().partitionId() % SLOT_PARTS
        parts = [zstandard.compress(n[k * width : (k + 1) * width].tobytes(), 1) for k in range(SLOT_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int32()), pa.array([salt] * SLOT_PARTS, pa.int32()), pa.array(parts, pa.binary())], ["k", "salt", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = np.zeros(width, np.int64)
        for raw in t.column("n").to_pylist():
            n += np.frombuffer(zstandard.decompress(raw), np.int64)
        return pa.table({"k": t.column("k").slice(0, 1), "salt": t.column("salt").slice(0, 1), "n": pa.array([zstandard.compress(n.tobytes(), 1)], pa.binary())})

    kind = "k int, salt int, n binary"
    added = parsed.select("data").mapInArrow(trimmed(count), kind).groupBy("k", "salt").applyInArrow(add, kind).groupBy("k").applyInArrow(add, kind).collect()  # SLOT_PARTS rows of counters
    n = np.zeros(SLOTS, np.int64)
    for r in added:
        n[r.k * width : (r.k + 1) * width] = np.frombuffer(zstandard.decompress(r.n), np.int64)
    return np.round(STEPS * np.log2(np.maximum(n, 1))).astype(np.uint16), int(n.sum())


def fingerprints(mixed: np.ndarray, o: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    return V.mix(total[o[1:]] - total[o[:-1]] + np.diff(o).astype(np.uint64)).view(np.int64)


def by_rarity(words: np.ndarray, place: np.ndarray, o: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words in order of rarity, each line's words as places in them, in that order)."""
    number = scale[_slot(words)].astype(np.uint64) << HASH_BITS | V.mix(words) >> (np.uint64(64) - HASH_BITS)
    order = np.argsort(number)
    back = np.empty(len(order), np.uint32)
    back[order] = np.arange(len(order), dtype=np.uint32)
    return number[order], V.distinct(back[place], np.repeat(np.arange(len(o) - 1), np.diff(o)), len(o) - 1)[0]


def wide(n: np.ndarray) -> np.ndarray:
    """Columns of parity bits that a line of n words has: 1, 2 or 4."""
    return 1 + (n > LONG) + 2 * (n > 2 * LONG)


def parity(number: np.ndarray, place: np.ndarray, o: np.ndarray) -> dict[str, np.ndarray]:
    """64, 128 or 256 bits for each line, of which every word flips one, in up to four columns; columns that
    a line does not have are 0 and pack to nothing. No line is empty."""
    h = V.mix(number ^ np.uint64(0x632BE59BD9B4E019))
    word, bit, size = (h >> np.uint64(62)).astype(np.int64), np.uint64(1) << (h >> np.uint64(56) & np.uint64(63)), np.diff(o)
    out, columns = {f"b{k}": np.zeros(len(size), np.uint64) for k in range(4)}, wide(size)
    for many in (1, 2, 4):
        some = np.flatnonzero(columns == many)
        if len(some):
            mine, starts = place[flat(o[some], size[some])], np.cumsum(size[some]) - size[some]
            for k in range(many):
                out[f"b{k}"][some] = np.bitwise_xor.reduceat(np.where(word % many == k, bit, np.uint64(0))[mine], starts)
    return out


#: Columns of a posting, and how many are held before they are dealt out.
POSTING = {"token": np.uint64, "place": np.uint64, "doc_id": np.int64, "row": np.int64, "line": np.int32, "slice": np.int64, "nth": np.int32, "n": np.int32, "pos": np.int32, "f": np.int64, "b0": np.uint64, "b1": np.uint64, "b2": np.uint64, "b3": np.uint64}
HELD = 1 << 17
#: Columns whose bytes are as good as random.
RANDOM = ("f", "b0")


def packed(t: dict) -> bytes:
    """Postings as bytes: column by column, and of most columns all low parts, then all higher ones,
    so that those which hardly differ lie together; tokens, which are nearly sorted, as steps."""
    steps = np.diff(t["token"], prepend=np.uint64(0))
    parts = []
    for k, kind in POSTING.items():
        column = np.ascontiguousarray(steps if k == "token" else t[k], kind)
        planes = column.view(np.uint16).reshape(len(column), -1)
        parts += [column.tobytes()] if k in RANDOM else [planes[:, i].tobytes() for i in range(planes.shape[1])]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(blobs: list[bytes]) -> dict:
    """Postings of all blobs, column by column; one blob at a time is held beside them."""
    wide = sum(np.dtype(d).itemsize for d in POSTING.values())
    sizes = [zstandard.frame_content_size(raw) // wide for raw in blobs]
    out, first = {k: np.empty(sum(sizes), d) for k, d in POSTING.items()}, 0
    for raw, rows in zip(blobs, sizes):
        data, at = np.frombuffer(zstandard.decompress(raw), np.uint16), 0
        for k, d in POSTING.items():
            some, wide16 = out[k][first : first + rows], np.dtype(d).itemsize // 2
            planes = some.view(np.uint16).reshape(rows, wide16)
            for i in range(1 if k in RANDOM else wide16):
                if k in RANDOM:
                    some[:] = data[at : at + rows * wide16].view(d)
                else:
                    planes[:, i] = data[at + i * rows : at + (i + 1) * rows]
            if k == "token":
                np.cumsum(some, out=some)
            at += rows * wide16
        first += rows
    return out


def _take(t: dict, at: np.ndarray) -> None:
    """Keep the rows at, in place, so that only one column is held twice."""
    for k in t:
        t[k] = t[k][at]


class Marks:
    """A set of 64-bit values as 2 ** 24 bits: it may hold more than was put in, never less."""

    def __init__(self, values: DataFrame) -> None:
        """values: rows of c and token; tokens, and pairs of both, are put in."""

        def slots(batches):
            for b in batches:
                c, token = (b.column(k).to_numpy().view(np.uint64) for k in range(2))
                at = np.unique(np.concatenate((self.slot(token), self.slot(self.pair(c, token)))))
                yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["w", "b"])

        found = values.select("c", "token").mapInArrow(slots, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2 ** 18 rows at most
        self.bits = np.zeros(1 << 18, np.uint64)
        self.bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)

    @staticmethod
    def slot(x: np.ndarray) -> np.ndarray:
        return (V.mix(x) >> np.uint64(40)).astype(np.int64)

    @staticmethod
    def pair(c: np.ndarray, token: np.ndarray) -> np.ndarray:
        return c ^ V.mix(token + np.uint64(1))

    def has(self, x: np.ndarray) -> np.ndarray:
        at = self.slot(x)
        return (self.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def postings(parsed: DataFrame, scale: np.ndarray, percent: int, parts: int, only: Marks | None = None) -> DataFrame:
    """part and rows: bytes of the postings that meet there, the rarest words of each class. A word's
    postings, or those of one pair of its blocks, are in the same part. With only, just the postings of its tokens."""

    def deal(held: list[dict]):
        t = {k: np.concatenate([x.pop(k) for x in held]) for k in POSTING}
        held.clear()
        with np.errstate(over="ignore"):
            part = V.mix(t["token"] + V.mix(t["place"] & PAIR_BITS)) % np.uint64(parts)
        order = np.argsort(part << np.uint64(40) | t["token"] >> np.uint64(24))
        part = part[order].astype(np.int32)
        _take(t, order)
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))[: len(part) + 1]
        blobs = [packed({k: v[a:b] for k, v in t.items()}) for a, b in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(blobs, pa.binary())], ["part", "rows"])

    def rows(batches):
        held, size = [], 0
        for b in batches:
            for number, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, place, o, keys = _unpack(raw)
                with np.errstate(over="ignore"):
                    x, place = by_rarity(words, place, o, scale)
                    n, bits = np.diff(o), parity(x, place, o)
                    take = n - -(-percent * n // 100) + 1
                    line = np.repeat(np.arange(len(n)), take)
                    pos = np.arange(len(line)) - np.repeat(np.cumsum(take) - take, take)
                    token = x[place[o[line] + pos]]
                    if only is not None:
                        keep = only.has(token)
                        line, pos, token = line[keep], pos[keep], token[keep]
                    mine, other = np.zeros(len(line), np.int64), np.zeros(len(line), np.int64)
                    blocks = np.clip(np.exp2((token >> HASH_BITS).astype(np.float64) / STEPS) / BLOCK, 1, MOST_BLOCKS).astype(np.int64)
                    if (blocks > 1).any():
                        own = (V.mix(keys["f"][line].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                        rep = np.repeat(np.arange(len(line)), blocks)
                        other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                        mine, line, pos, token = own[rep], line[rep], pos[rep], token[rep]
                    where = np.minimum(mine, other) | np.maximum(mine, other) << 20 | mine << 40
                    held.append({"token": token, "place": where.astype(np.uint64), "slice": np.full(len(line), number), "nth": line.astype(np.int32), "n": n[line].astype(np.int32), "pos": pos.astype(np.int32), **{k: keys[k][line] for k in ("doc_id", "row", "line", "f")}, **{c: v[line] for c, v in bits.items()}})
                size += len(token)
                if size >= HELD:
                    yield deal(held)
                    size = 0
        if size:
            yield deal(held)

    return parsed.select("slice", "data").mapInArrow(trimmed(rows), "part int, rows binary")


#: A pair of classes, c with a later line than d, where each is written, d's line, and the word they share.
PAIR = "c long, c_slice long, c_nth int, d long, d_slice long, d_nth int, d_doc long, d_row long, d_line int, more boolean, token long"
#: Pairs that are held before those beyond the limit are let go.
PAIRS_HELD = 1 << 21


def in_order(t: dict) -> np.ndarray:
    """A number for each posting's line: the order of (doc_id, line, row), equal for the same line."""
    doc, line = t["doc_id"], t["line"].astype(np.int64)
    low, lines = doc.min(initial=0), int(line.max(initial=0)) + 1
    if (int(doc.max(initial=0)) - int(low)) * lines + lines < 1 << 62:
        order = np.argsort((doc - low) * lines + line)
    else:
        order = np.lexsort((line, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (line[order][1:] != line[order][:-1])
    row = t["row"][order]
    if (~new[1:] & (row[1:] != row[:-1])).any():  # lines of one number in texts of one id
        order = np.lexsort((t["row"], line, doc))
        row = t["row"][order]
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (line[order][1:] != line[order][:-1]) | (row[1:] != row[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def grouped(t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the postings that meet others, by word and length, the earliest line of each class; their groups; their lines in order)."""
    with np.errstate(over="ignore"):
        key = V.mix(t["token"] + V.mix(t["place"] & PAIR_BITS))
    at = np.argsort(key)
    same = key[at][1:] == key[at][:-1]
    met = np.append(same, False) | np.append(False, same)  # most words are posted once
    at, g = at[met], np.cumsum(np.append(False, ~same))[met]
    n, f = t["n"][at].astype(np.int64), t["f"][at]
    if len(g) and int(n.max()) < 1 << 20 and int(g[-1]) < 1 << 28:
        order = np.argsort(g << 35 | n << 15 | f & 0x7FFF)
    else:
        order = np.lexsort((f, n, g))
    at, g, n, f = at[order], g[order], n[order], f[order]
    when = in_order({k: t[k][at] for k in ("doc_id", "line", "row")})
    start = np.ones(len(g), bool)
    start[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1]) | (f[1:] != f[:-1])
    start = np.flatnonzero(start)
    least = np.minimum.reduceat(when, start) if len(start) else when
    first = when == np.repeat(least, np.diff(np.append(start, len(g))))
    return at[first], g[first], when[first]


def find(t: dict, percent: int, limit: int, only: Marks | None) -> pa.RecordBatch:
    """Pairs of a later line c and an earlier d that pass the bounds, among all postings of a part:
    the limit earliest of each c and word, with only just for the c and words it has."""
    at, g, when = grouped(t)
    _take(t, at)
    n, own, a, k = t["n"].astype(np.int64), t["place"] >> np.uint64(40), np.arange(len(g)), 0
    apart = (t["place"] & np.uint64(0xFFFFF)) != (t["place"] >> np.uint64(20) & np.uint64(0xFFFFF))
    fold, half, columns = t["b0"] ^ t["b1"] ^ t["b2"] ^ t["b3"], [t["b0"] ^ t["b2"], t["b1"] ^ t["b3"]], wide(n)
    many, held, size = np.zeros(len(g), np.int64), [], 0

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(fold[a] ^ fold[b]).astype(np.int64)
        both = np.minimum(columns[a], columns[b])
        for many, bits in ((2, half), (4, [t[f"b{k}"] for k in range(4)])):
            some = np.flatnonzero(both == many)
            if len(some):
                out[some] = sum(np.bitwise_count(x[a[some]] ^ x[b[some]]).astype(np.int64) for x in bits)
        return out

    def earliest():
        c, d = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(2))
        order = np.lexsort((when[d], c))
        c, d = c[order], d[order]
        keep = np.arange(len(c)) - np.searchsorted(c, c) < limit
        return c[keep], d[keep]

    rest = n - t["pos"]
    while len(a):
        k += 1
        a = a[: np.searchsorted(a, len(g) - k)]
        b = a + k
        na, nb = n[a], n[b]
        near = (g[b] == g[a]) & (100 * na >= percent * nb)
        a, b, na, nb = a[near], b[near], na[near], nb[near]
        need = (percent * (na + nb) + 99 + percent) // (100 + percent)
        fits = np.flatnonzero(np.minimum(rest[a], rest[b]) >= need)
        x, y, most = a[fits], b[fits], na[fits] + nb[fits] - 2 * need[fits]
        ok = (differ(x, y) <= most) & (when[x] != when[y]) & (~apart[x] | (own[x] != own[y]))
        x, y = x[ok], y[ok]
        later = when[y] > when[x]
        c, d = np.where(later, y, x), np.where(later, x, y)
        if only is not None:
            with np.errstate(over="ignore"):
                asked = only.has(only.pair(t["f"][c].view(np.uint64), t["token"][c]))
            c, d = c[asked], d[asked]
        np.add.at(many, c, 1)
        held.append((c, d))
        size += len(c)
        if size > PAIRS_HELD:
            held = [earliest()]
            size = len(held[0][0]) // 2
    c, d = earliest()
    own = lambda at: [t["f"][at], t["slice"][at], t["nth"][at]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (*own(c), *own(d), t["doc_id"][d], t["row"][d], t["line"][d], many[c] > limit, t["token"][c].view(np.int64))], [x.split()[0] for x in PAIR.split(", ")])


def candidates(posted: DataFrame, percent: int, limit: int, only: Marks | None = None) -> DataFrame:
    """Rows of PAIR."""

    def meet(t: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([find(unpacked(t.column("rows").to_pylist()), percent, limit, only)])
        release()
        return out

    return posted.groupBy("part").applyInArrow(meet, PAIR)


def class_lines(parsed: DataFrame) -> DataFrame:
    """f, doc_id, line and row of the written line of each class."""

    def rows(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                keys = _unpack(raw)[3]
                yield pa.RecordBatch.from_arrays([pa.array(keys[k]) for k in ("f", "doc_id", "line", "row")], ["f", "doc_id", "line", "row"])

    return parsed.select("data").mapInArrow(trimmed(rows), "f long, doc_id long, line int, row long")


def _gone(parsed: DataFrame) -> DataFrame:
    def rows(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                data = zstandard.decompress(raw)
                n = len(data) // 20
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, np.int64, n)), pa.array(np.frombuffer(data, np.int64, n, 8 * n)), pa.array(np.frombuffer(data, np.int32, n, 16 * n))], ["doc_id", "row", "line"])

    return parsed.select("gone").mapInArrow(rows, "doc_id long, row long, line int")


def class_sets(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """f and the set (bytes) of each class whose place (slice, nth) is wanted."""
    wanted = settle(wanted, "places")
    need = wanted.groupBy("slice").agg(F.collect_set("nth").alias("need"))  # no more than lines of a slice
    need = F.broadcast(need) if wanted.count() <= BROADCAST_PLACES else need

    def rows(batches):
        for b in batches:
            for raw, pick in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, place, o, keys = _unpack(raw)
                x, pick = words[place], np.sort(pick)
                yield pa.RecordBatch.from_arrays([pa.array(keys["f"][pick]), pa.array([x[a:z].tobytes() for a, z in zip(o[pick], o[pick + 1])], pa.binary())], ["f", "words"])

    return parsed.select("slice", "data").join(need, "slice").select("data", "need").mapInArrow(trimmed(rows), "f long, words binary")


def _verified(pairs: DataFrame, parsed: DataFrame, percent: int) -> DataFrame:
    """c, d_doc, d_line and d_row of the pairs whose sets reach the similarity."""
    # d's line is the same wherever the pair was met; of equal rows any place serves.
    unique = settle(pairs.groupBy("c", "d").agg(*[F.min(x).alias(x) for x in ("c_slice", "d_slice", "d_doc", "d_line", "d_row")], F.min_by("c_nth", "c_slice").alias("c_nth"), F.min_by("d_nth", "d_slice").alias("d_nth")), "pairs")
    wanted = unique.groupBy("c").agg(F.min(F.struct("c_slice", "c_nth")).alias("w")).union(unique.groupBy("d").agg(F.min(F.struct("d_slice", "d_nth")))).select("w.*").toDF("slice", "nth").distinct()
    sets = settle(class_sets(parsed, wanted), "line-sets").dropDuplicates(["f"])

    def rows(batches):
        for b in batches:
            good = []
            for p, q in zip(b.column(4), b.column(5)):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = V.overlap(x, y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["c", "d_doc", "d_line", "d_row"]).filter(pa.array(good, pa.bool_()))

    named = lambda k: sets.select(F.col("f").alias(k), F.col("words").alias(f"w{k}"))
    both = unique.select("c", "d", "d_doc", "d_line", "d_row").join(named("c"), "c").join(named("d"), "d")
    return both.select("c", "d_doc", "d_line", "d_row", "wc", "wd").mapInArrow(trimmed(rows), "c long, d_doc long, d_line int, d_row long")


def _removed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id (NO_ID for none), row and line of each line that has an earlier match, from rows of doc_id, text and row."""
    parsed = slices(docs)
    scale, total = rarity(parsed)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART)
    limit, only, open_classes = AT_ONCE, None, None
    found = []
    while True:
        pairs = candidates(postings(parsed, scale, percent, parts, only), percent, limit, only)
        if only is not None:
            pairs = pairs.join(open_classes, "c", "left_semi")
        pairs = settle(pairs, "met")
        let_go(pairs)  # of postings, which have met
        found.append(settle(_verified(pairs, parsed, percent), "matches"))
        again = settle(pairs.filter("more").select("c", "token").distinct().join(found[-1].select("c").distinct(), "c", "left_anti"), "again")
        if again.isEmpty():
            break
        limit, only, open_classes = limit * MORE, Marks(again), again.select("c").distinct()
    lines = settle(class_lines(parsed), "class-lines")
    at = F.struct("doc_id", "line", "row")
    every = lines.select("f", at.alias("at"))
    for x in found:
        every = every.unionByName(x.select(F.col("c").alias("f"), F.struct(F.col("d_doc").alias("doc_id"), F.col("d_line").alias("line"), F.col("d_row").alias("row")).alias("at")))
    least = every.groupBy("f").agg(F.min("at").alias("least"))
    return lines.join(least, "f").filter(at > F.col("least")).select("doc_id", "row", "line").unionByName(_gone(parsed))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id (NO_ID for none), row (as by keyed()) and line of each line that has an earlier match."""
    return _removed(keyed(docs.select("doc_id", "text"), "row"), percent).distinct()


def _marked(docs: DataFrame, percent: int) -> tuple[DataFrame, Column]:
    """(docs with the removed lines of each row, the expression for them, null for none)."""
    row, gone, of_id, of_row = fresh(docs, "row", "gone", "of_id", "of_row")
    docs = keyed(docs, row)
    found = settle(settle(_removed(docs.select("doc_id", "text", F.col(row).alias("row")), percent), "removed").groupBy(F.col("doc_id").alias(of_id), F.col("row").alias(of_row)).agg(F.collect_set("line").alias(gone)), "removed-of")
    here = lambda df: (F.coalesce(df["doc_id"], F.lit(NO_ID)) == F.col(of_id)) & (df[row] == F.col(of_row))
    if (found.agg(F.sum(F.size(gone) + 8)).first()[0] or 0) <= BROADCAST_PLACES:
        return docs.join(F.broadcast(found), here(docs), "left"), F.col(gone)
    # Rows that lose nothing, but for a few, stay where they are.
    (mark,) = fresh(docs.join(found), "mark")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID)), row)
    marked = bloom(docs, key, found, F.xxhash64(of_id, of_row), mark=mark)
    some = marked.filter(mark).drop(mark)
    joined = some.join(found, here(some), "left")
    rest = marked.filter(~F.col(mark)).drop(mark)
    return joined.unionByName(rest, allowMissingColumns=True), F.col(gone)


def _kept(gone: Column) -> Column:
    return F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with their text less the removed lines, and n_lines and n_removed, which get underscores after
    their names where docs has columns of these names."""
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    out, gone = _marked(docs, percent)
    count = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    made = {n_lines: F.coalesce(count, F.lit(0)).cast("long"), n_removed: F.when(gone.isNull() | F.col("text").isNull(), 0).otherwise(F.size(gone)).cast("long")}
    return out.select(*[_kept(gone).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in made.items()])


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with their columns, less removed lines; a document that loses its last line with words goes too.

    n_chars, if there is one, follows the text.
    """
    out, gone = _marked(docs, percent)
    text, lost = fresh(out, "kept_text", "lost")
    out = out.withColumns({text: _kept(gone), lost: gone.isNotNull()}).filter(~F.col(lost) | F.col(text).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    n_chars = F.when(F.col(lost), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    made = {"text": F.col(text), "n_chars": n_chars}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])
