"""Best-fit packing: a grouping genetic algorithm on islands.

Texts are encoded and cut into pieces of ``CAPACITY`` ids at most. A full piece is a
sequence of its own. The others are dealt at random into batches of about ``BATCH``
pieces; each batch is solved on several islands:

- A solution is a list of bins. One of a new island is best fit from large to small, so no
  result has more bins than that; the others put the pieces one after the other, in orders
  from large to small that are disturbed more and more, until a bin is full (next fit).
- In each generation two solutions of the better half are crossed: whole well-filled bins
  of one are taken into the other, bins that held the same pieces are emptied, and so are
  the emptiest others. One displaced piece or two take the place of one piece or two that
  fill an open bin less well; what is displaced then is put back by best fit. A child takes
  the place of the worst solution if it is better and no copy.
- After an epoch each island sends its best solutions to the next island of its batch. An
  epoch ends when a crossover has reached the least number of bins that the sum of sizes
  allows, when ``STALE`` generations have made nothing better, or after ``GENERATIONS``.

The best solution of a batch stands, except that the pieces of its emptiest bin go on to a
last round, in which those of all batches are packed together. Fitness is the number of
bins, then, for what a crossover made, the mean square of how full they are. ``generation`` says when the solution
that a sequence is from was made (0: a start), ``crossovers`` how many its island had made
by then, and ``migrants`` how many of its batch's solutions came from another island.

Defined results. A null or empty text is its end id alone. Repeated rows and rows without
an id are packed one for one. An empty table gives no pieces. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import settle, trimmed

CAPACITY, BATCH, ISLANDS, EPOCHS, POPULATION, GENERATIONS, STALE, ELITE = 4096, 4000, 3, 2, 6, 150, 40, 2
#: Displaced pieces of which an exchange looks at pairs.
PAIRED = 256


def best_fit(size: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[tuple[int, int]], next_bin: int, capacity: int) -> int:
    """Put the pieces of order into the fullest bin that holds them, or a new one; bins is filled in place."""
    free.sort()
    for p in order.tolist():
        n = int(size[p])
        k = bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b, next_bin = capacity, next_bin, next_bin + 1
        bins[p] = b
        if room > n:
            insort(free, (room - n, b))
    return next_bin


def tidy(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(size: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(number of bins, -mean square of fill): less is better."""
    fill = np.bincount(bins, size) / capacity
    return len(fill), -float((fill**2).mean())


def next_fit(size: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """The pieces in order, each in the bin of the one before while it fits there."""
    ends = np.concatenate(([0], np.cumsum(size[order])))
    bins, at, k = np.zeros(len(size), np.int32), 0, 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1)
        bins[order[at:to]], at, k = k, to, k + 1
    return bins


def exchange(size: np.ndarray, bins: np.ndarray, out: np.ndarray, load: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Put one or two pieces of out for one or two neighbours of an open bin where they fill it better, no bin
    twice; bins and load are changed in place. Returns the pieces that are out then."""
    d = out[np.argsort(size[out], kind="stable")]
    some = d if len(d) <= PAIRED else d[np.sort(rng.choice(len(d), PAIRED, replace=False))]
    i, j = np.triu_indices(len(some), 1)
    one, two = np.concatenate((d, some[i])), np.concatenate((np.full(len(d), -1), some[j]))
    offered = np.concatenate((size[d], size[some[i]] + size[some[j]]))
    order = np.argsort(offered, kind="stable")
    one, two, offered = one[order], two[order], offered[order]
    held = np.flatnonzero(bins >= 0)
    held = held[load[bins[held]] < capacity]
    held = held[np.argsort(bins[held], kind="stable")]
    pairs = [(held[:-k], held[k:], bins[held[:-k]] == bins[held[k:]]) for k in (1, 2)]
    a = np.concatenate([held, *(x[same] for x, _, same in pairs)])
    b = np.concatenate([np.full(len(held), -1), *(y[same] for _, y, same in pairs)])
    if not len(offered) or not len(a):
        return out
    home, given = bins[a], size[a] + np.where(b >= 0, size[b], 0)
    most = given + capacity - load[home]
    at = np.searchsorted(offered, most, "right") - 1
    gain = np.where(at >= 0, offered[at] - given, 0)
    better = np.flatnonzero(gain > 0)
    gone, touched, back = set(), set(), []
    for k in better[np.argsort((most - given - gain)[better], kind="stable")].tolist():
        to, x, y = int(home[k]), int(one[at[k]]), int(two[at[k]])
        if to in touched or x in gone or y in gone:
            continue
        touched.add(to)
        load[to] += gain[k]
        for p in (x, y):
            if p >= 0:
                gone.add(p)
                bins[p] = to
        for p in (int(a[k]), int(b[k])):
            if p >= 0:
                back.append(p)
                bins[p] = -1
    return np.concatenate((out[~np.isin(out, list(gone))], np.array(back, np.int64)))


def cross(size: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of a, with well-filled whole bins of b: from a quarter of them to few."""
    share = 0.5 ** rng.integers(2, 8)
    fill = np.bincount(b, size)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = np.zeros(len(fill), bool)
    taken[rng.choice(good, max(1, int(len(good) * share)), replace=False)] = True
    moved = taken[b]
    hurt = np.zeros(a.max() + 1, bool)
    hurt[a[moved]] = True
    left = np.bincount(a, size)
    rest = np.flatnonzero(~hurt)
    hurt[rest[np.argsort(left[rest] * rng.normal(1, 0.05, len(rest)))[: 1 + int(len(rest) * share / 2)]]] = True
    child = np.full(len(size), -1, np.int64)
    stay = ~hurt[a]
    child[stay] = a[stay]
    child[moved] = b[moved] + a.max() + 1
    top = int(a.max() + b.max() + 2)
    load = np.bincount(child[child >= 0], size[child >= 0], minlength=top).astype(np.int64)
    out = np.flatnonzero(child < 0)
    for _ in range(3):
        out = exchange(size, child, out, load, capacity, rng)
    used = np.flatnonzero((load > 0) & (load < capacity))
    best_fit(size, out[np.argsort(-size[out], kind="stable")], child, list(zip((capacity - load[used]).tolist(), used.tolist())), top, capacity)
    return tidy(child)


#: A solution: its fitness, its bins, the generation that made it and the crossovers of its island by then, and if it came from another one.
Solution = tuple[tuple[int, float], np.ndarray, int, int, bool]


def evolve(size: np.ndarray, came: list[Solution], epoch: int, seed: int, capacity: int = CAPACITY) -> list[Solution]:
    """The solutions of one island after an epoch, the best first; came holds those it had and those sent to it."""
    rng, herd = np.random.default_rng(seed), list(came)
    least = -(-int(size.sum()) // capacity)
    for k in range(len(herd), POPULATION):
        if k == 0:
            bins = np.zeros(len(size), np.int32)
            best_fit(size, np.argsort(-size, kind="stable"), bins, [], 0, capacity)
        else:
            bins = next_fit(size, np.argsort(-size * rng.lognormal(0, 0.3 * k, len(size)), kind="stable"), capacity)
        herd.append(((int(bins.max()) + 1, 0.0), bins, 0, 0, False))
    herd.sort(key=lambda s: s[0])
    del herd[POPULATION:]
    made, stale = max(s[3] for s in herd), 0
    for g in range(epoch * GENERATIONS + 1, (epoch + 1) * GENERATIONS + 1):
        if stale == STALE or (herd[0][0][0] == least and herd[0][3] > 0):
            break
        i, j = rng.choice(max(2, POPULATION // 2), 2, replace=False)
        child = cross(size, herd[i][1], herd[j][1], capacity, rng)
        fit = fitness(size, child, capacity)
        made, stale = made + 1, stale + 1 if fit >= herd[0][0] else 0
        if fit < herd[-1][0] and all(fit != s[0] for s in herd):
            herd[-1] = (fit, child, g, made, herd[i][4] or herd[j][4])
            herd.sort(key=lambda s: s[0])
    return herd


HERD = "array<struct<bins:binary,generation:int,crossovers:int,migrant:boolean>>"
SOLVED = f"batch long, island int, ids binary, size binary, bins int, score double, herd {HERD}"
_SOLUTION = pa.struct([("bins", pa.binary()), ("generation", pa.int32()), ("crossovers", pa.int32()), ("migrant", pa.bool_())])


def _epoch(capacity: int, epoch: int):
    """One row for each island of a batch to the same after an epoch, its best solution first in herd."""

    def rows(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                size, came = np.frombuffer(r["size"], np.int32).astype(np.int64), []
                for s in r["herd"]:
                    bins = np.frombuffer(s["bins"], np.int32)
                    came.append(((int(bins.max()) + 1, fitness(size, bins, capacity)[1] if s["generation"] else 0.0), bins, s["generation"], s["crossovers"], s["migrant"]))
                herd = evolve(size, came, epoch, r["batch"] * 1009 + r["island"] * 31 + epoch, capacity)
                kept = [{"bins": s[1].astype(np.int32).tobytes(), "generation": s[2], "crossovers": s[3], "migrant": s[4]} for s in herd]
                out.append({"batch": r["batch"], "island": r["island"], "ids": r["ids"], "size": r["size"], "bins": herd[0][0][0], "score": herd[0][0][1], "herd": kept})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("batch", pa.int64()), ("island", pa.int32()), ("ids", pa.binary()), ("size", pa.binary()), ("bins", pa.int32()), ("score", pa.float64()), ("herd", pa.list_(_SOLUTION))]))

    return rows


def _gather(items: DataFrame, batch: int, name: str) -> DataFrame:
    """One row for each batch: its pieces' numbers and sizes as bytes."""
    n = items.count()
    batches = max(1, -(-n // batch))

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({"batch": t.column("batch").slice(0, 1), "ids": pa.array([t.column("u").to_numpy().astype(np.int64).tobytes()], pa.binary()), "size": pa.array([t.column("length").to_numpy().astype(np.int32).tobytes()], pa.binary())})

    dealt = items.select(F.pmod(F.xxhash64("u"), F.lit(batches)).alias("batch"), "u", "length")
    return settle(dealt.groupBy("batch").applyInArrow(pack, "batch long, ids binary, size binary"), name)


def solve(items: DataFrame, capacity: int, name: str) -> DataFrame:
    """batch, ids, size, best (a solution) and migrants: the best solution of any island for each batch of items (u, length)."""
    islands = F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = _gather(items, BATCH, name).select("batch", "ids", "size", islands).withColumn("herd", F.array().cast(HERD))
    for epoch in range(EPOCHS):
        dealt = now.select("batch", "island", "ids", "size", "herd").repartition(parts, "batch", "island")
        done = settle(dealt.mapInArrow(trimmed(_epoch(capacity, epoch)), SOLVED), f"{name}-epoch")
        guests = F.transform(F.slice("herd", 1, ELITE), lambda s: s.withField("migrant", F.lit(True)))
        sent = done.select("batch", ((F.col("island") + 1) % ISLANDS).alias("island"), guests.alias("guests"))
        now = done.join(sent, ["batch", "island"]).select("batch", "island", "ids", "size", F.concat(F.slice("herd", 1, POPULATION - ELITE), "guests").alias("herd"))
    moved = F.sum(F.size(F.filter("herd", lambda s: s.migrant))).cast("int").alias("migrants")
    best = F.min_by(F.struct("ids", "size", F.get("herd", F.lit(0)).alias("best")), F.struct("bins", "score", "island")).alias("x")
    return done.groupBy("batch").agg(best, moved).select("batch", "x.*", "migrants")


def _places(capacity: int, keep_open: bool, base: int):
    """u, length, sequence_id and offset of each piece; a null sequence_id sends it to the last round."""

    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                u, size, bins = (np.frombuffer(x, t) for x, t in ((r["ids"], np.int64), (r["size"], np.int32), (r["best"]["bins"], np.int32)))
                order = np.argsort(bins, kind="stable")
                s, g = size[order].astype(np.int64), bins[order]
                first = np.concatenate(([0], np.cumsum(s)[:-1]))
                at = first - np.repeat(first[np.flatnonzero(np.diff(g, prepend=-1))], np.bincount(g))
                load = np.bincount(bins, size)
                seq = g.astype(np.int64) + base + r["batch"] * (2 * BATCH)
                open_bin = (g == load.argmin()) & (load.min() < capacity) & (not keep_open)
                yield pa.RecordBatch.from_arrays([pa.array(u[order]), pa.array(s), pa.array(seq, mask=open_bin), pa.array(at), *(pa.array(np.full(len(u), x, np.int32)) for x in (r["best"]["generation"], r["best"]["crossovers"], r["migrants"]))], ["u", "length", "sequence_id", "offset", "generation", "crossovers", "migrants"])

    return rows


MADE = ["generation", "crossovers", "migrants"]
PLACED = "u long, length long, sequence_id long, offset long, generation int, crossovers int, migrants int"


def pieces(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """u (a number), doc_id, piece, start, length, ids_crc32 of each piece of each text."""

    def rows(batches):
        for b in batches:
            ids_of, out = b.column(0).to_pylist(), []
            for k, ids in tokens.encoded(b, 1, path, True, end_id):
                out += [(ids_of[k], i, s, len(p := ids[s : s + capacity]), zlib.crc32(p.tobytes())) for i, s in enumerate(range(0, len(ids), capacity))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = docs.select("doc_id", "text").mapInArrow(trimmed(rows), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return settle(cut.withColumn("u", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = tokens.WORD_BPE, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each text, and generation,
    crossovers and migrants of the search that placed it (null for a full piece)."""
    every = pieces(docs, capacity, path, end_id)
    full = every.filter(F.col("length") == capacity).withColumns({"sequence_id": -F.col("u") - 1, "offset": F.lit(0).cast("long"), **{c: F.lit(None).cast("int") for c in MADE}})
    rest = every.filter(F.col("length") < capacity)
    placed = settle(solve(rest.select("u", "length"), capacity, "batches").mapInArrow(_places(capacity, False, 0), PLACED), "placed")
    last = solve(placed.filter("sequence_id is null").select("u", "length"), capacity, "last").mapInArrow(_places(capacity, True, 1 << 60), PLACED)
    spots = placed.filter("sequence_id is not null").unionByName(last).select("u", "sequence_id", "offset", *MADE)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *MADE]
    return rest.join(spots, "u").select(*columns).unionByName(full.select(*columns))
