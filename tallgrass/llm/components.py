"""Connected components of an edge table by union-find inside partitions and star steps across them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


class Forest:
    """Union-find; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def contract(edges: DataFrame) -> DataFrame:
    """The same components with one edge for each node of a partition, to its root there."""

    def rows(batches):
        f, nodes = Forest(), set()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f.join(u, v)
                nodes.add(u)
                nodes.add(v)
        pairs = [(x, r) for x in nodes if (r := f.root(x)) != x]
        for i in range(0, len(pairs), 50_000):
            u, v = zip(*pairs[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(rows, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge; a component is named by its smallest node.

    edges has the columns u and v (long). Each partition first joins its own edges.
    Rounds of large and small stars then link every node to the smallest neighbour's
    until nothing changes; what is held in one place is a node and its minimum, never
    its neighbours. A round is written to the shared folder, so a lost executor costs
    no earlier round. Edges with a null end, and loops, link nothing.
    """
    plain = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, before = settle(contract(plain), "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = settle(small, "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
