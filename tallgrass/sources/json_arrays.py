"""Elements of large JSON files, each an array of objects (or one object), read by many tasks.

A file is cut at closing braces by Spark's text source, so each of its splits is read by a task of its own, on any file
system. What a brace means depends on all that is before it, so a split is first summed up for both cases, that it starts
inside a string or outside: how many quotes and open brackets it leaves, and how low its depth gets. A few numbers for
each split are enough to know in what state each one starts. Then each task gives the elements that lie in its split;
what is left at the borders, less than an element on either side, is put together by the split that it began in.

Elements that are no objects are left out. Files that are compressed, which Spark cannot split, are one split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, ESCAPE = 0x22, 0x5C
STEP = np.zeros(256, np.int64)
STEP[[0x7B, 0x5B]], STEP[[0x7D, 0x5D]] = 1, -1
#: What may stand before an element.
BEFORE = " \t\r\n,[﻿"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(path, start of the split, pieces) for rows of the same split."""
    path, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    code = path.indices.to_numpy()
    edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(start) != 0)) + 1 if len(code) else []
    for i, j in zip([0, *edges], [*edges, len(code)]):
        if j > i:
            yield path.dictionary[int(code[i])].as_py(), int(start[i]), batch.column(0).slice(i, j - i)


def _braced(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces, each with the brace that ended it; places of these braces)."""
    data = [p.encode() for p in pieces.to_pylist()]
    return np.frombuffer(b"}".join(data) + b"}", np.uint8), np.cumsum([len(d) + 1 for d in data]) - 1


def _quotes(buf: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes. Pieces end with a brace, so no run of backslashes goes on in the next."""
    at = np.flatnonzero(buf == QUOTE)
    plain = np.where(buf != ESCAPE, np.arange(len(buf)), -1)
    run = at - 1 - np.maximum.accumulate(plain)[at - 1]
    out = np.zeros(len(buf), bool)
    out[at[(at == 0) | (run % 2 == 0)]] = True
    return out


def _depths(buf: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """(change of depth up to each byte, whether it is in a string) where the first byte is (inside) or is not in one."""
    string = (np.cumsum(quotes) - quotes + inside) & 1
    return np.cumsum(STEP[buf] * (1 - string)), string


SUMS = "path string, start long, quotes long, depth0 long, depth1 long, low0 long, low1 long, first string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for path, start, pieces in _runs(batch):
            s = sums.setdefault((path, start), [0, 0, 0, 1 << 40, 1 << 40, ""])
            buf, ends = _braced(pieces)
            quotes = _quotes(buf)
            for k in (0, 1):  # the case that the split starts inside a string or not
                depth, string = _depths(buf, quotes, (s[0] + k) & 1)
                closed = depth[ends[string[ends] == 0]]
                s[3 + k] = min(s[3 + k], s[1 + k] + int(closed.min()) if len(closed) else 1 << 40)
                s[1 + k] += int(depth[-1])
            s[0] += int(quotes.sum())
            s[5] = s[5] or next((c for c in bytes(buf[:4096]).decode(errors="replace") if c not in " \t\r\n﻿"), "")
    if sums:
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = (pa.string(), *[pa.int64()] * 6, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split(" ")[0] for c in SUMS.split(", ")])


def states(rows: list) -> dict[tuple[str, int], tuple[int, int, int, int]]:
    """For each split, from rows of SUMS: whether it starts in a string, at what depth, the depth of elements, and the
    split that the element which is open there began in (-1: none is)."""
    out, path = {}, None
    for r in sorted(rows, key=lambda r: (r.path, r.start)):
        if r.path != path:
            path, inside, depth, base, began = r.path, 0, 0, int(r.first == "["), -1
        out[r.path, r.start] = inside, depth, base, began
        low, step = (r.low1, r.depth1) if inside else (r.low0, r.depth0)
        ended = depth + low <= base
        inside, depth = (inside + r.quotes) & 1, depth + step
        began = (r.start if ended or began < 0 else began) if inside or depth > base else -1
    return out


PARTS = "path string, began long, start long, value string"


def _cut(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, inside, depth, base, began = None, [], 0, 0, 0, -1

        def rest() -> list[tuple]:
            """What is left of a split: the start of an element, or a part of one that began before."""
            inner = bool(open_) and (inside or depth > base)
            return [(at[0], began if began >= 0 else at[1], at[1], "}".join(open_) + "}")] if at and inner else []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "began", "start", "value"])

        for batch in batches:
            found = []
            for path, start, pieces in _runs(batch):
                if (path, start) != at:
                    found += rest()
                    at, open_ = (path, start), []
                    inside, depth, base, began = shared.value[at]
                buf, ends = _braced(pieces)
                quotes = _quotes(buf)
                depths, string = _depths(buf, quotes, inside)
                last = np.flatnonzero((string[ends] == 0) & (depths[ends] + depth == base))
                texts, i = pieces.to_pylist(), 0
                for j in last.tolist():
                    value = "}".join([*open_, *texts[i : j + 1]]) + "}"
                    if began >= 0:  # the end of an element of an earlier split
                        found.append((path, began, start, value))
                        began = -1
                    else:
                        found.append((path, None, start, value.lstrip(BEFORE)))
                    open_, i = [], j + 1
                open_ += texts[i:]
                inside, depth = (inside + int(quotes.sum())) & 1, depth + int(depths[-1])
            if found:
                yield batch_of(found)
        if rest():
            yield batch_of(rest())

    return rows


def elements(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path and value, the text of each object of the arrays in the files of a folder that fit pattern."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "}")
    pieces = read.text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    known = states(pieces.mapInArrow(_summed, SUMS).collect())  # a few numbers for each split
    parts = pieces.mapInArrow(_cut(spark.sparkContext.broadcast(known)), PARTS)
    whole = parts.filter("began is null").select("path", "value")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x.value)
    border = parts.filter("began is not null").groupBy("path", "began").agg(F.ltrim(F.array_join(texts, ""), F.lit(BEFORE)).alias("value"))
    return whole.unionByName(border.select("path", "value"))
