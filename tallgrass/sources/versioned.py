"""Tables kept by key in a folder: changes are added beside what is stored, buckets split as they grow, and one manifest counts.

A row is in the bucket that the last ``depth`` bits of its key's hash name. A commit adds, for each bucket that has changed
keys, a delta: all rows that these keys have from now on, or a mark that they have none. A bucket with ``MOST_DELTAS``
deltas, or with more than ``BUCKET_ROWS`` rows, is written anew from what counts, in two or more buckets where it is
large, so no task ever writes much more than that, however large the table is.

The manifest, one row for each bucket and write, is written aside and then renamed: a reader sees the commit whole or not
at all, and a commit whose number is taken by then fails. The last two manifests and what they name are kept; older files go.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.scratch import scratch

BUCKET_ROWS, MOST_DELTAS, KEPT = 200_000, 8, 2
MANIFEST = "table string, depth int, prefix long, seq long, base boolean, path string, rows long"
#: Columns of stored rows: the commit, and whether a key has no rows from then on.
OWN = ("_seq", "_gone")


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key))


def _prefix(h: Column, depth: Column) -> Column:
    one = F.lit(1).cast("long")
    return h.bitwiseAND(F.call_function("shiftleft", one, depth) - one)


class Store:
    """The tables of a folder; rows of all of them have the column key."""

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.seq, self.rows = self._newest()

    def _versions(self) -> list[int]:
        at = self.path(f"{self.folder}/manifest")
        found = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[1:]) for n in found if n[0] == "v")

    def _manifest(self, version: int) -> list:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v{version}").collect()  # a row for each bucket and delta

    def _newest(self) -> tuple[int, list]:
        versions = self._versions()
        return (versions[-1], self._manifest(versions[-1])) if versions else (0, [])

    def tables(self) -> set[str]:
        return {r.table for r in self.rows}

    def _leaves(self, table: str) -> dict[tuple[int, int], list]:
        out: dict[tuple[int, int], list] = {}
        for r in self.rows:
            if r.table == table:
                out.setdefault((r.depth, r.prefix), []).append(r)
        return out

    def _placed(self, df: DataFrame, leaves) -> DataFrame:
        """df with the bucket (_depth, _prefix) of each row."""
        known = self.spark.createDataFrame(list(leaves), "_depth int, _prefix long")
        depths = F.array(*[F.lit(d) for d in sorted({d for d, _ in leaves})])
        at = df.withColumn("_depth", F.explode(depths)).withColumn("_prefix", _prefix(_hash(self.key), F.col("_depth")))
        return at.join(known, ["_depth", "_prefix"], "left_semi")

    def _counted(self, files: list) -> DataFrame | None:
        """The rows that count of some buckets' files."""
        files = [r for r in files if r.path]
        if not files:
            return None
        # Writes of one table may differ in columns: a later one has more.
        df = self.spark.read.option("mergeSchema", True).parquet(*[r.path for r in files])
        deltas = [r.path for r in files if not r.base]
        if deltas:
            new = self.spark.read.schema(df.select(self.key, "_seq").schema).parquet(*deltas).groupBy(F.col(self.key).alias("_key")).agg(F.max("_seq").alias("_last"))
            df = df.join(new, F.col(self.key).eqNullSafe(F.col("_key")), "left").filter(F.col("_seq") == F.coalesce("_last", "_seq")).drop("_key", "_last")
        return df.filter(~F.col("_gone")).drop(*OWN)

    def read(self, table: str, near: DataFrame | None = None) -> DataFrame | None:
        """The rows of a table; with near, those of all buckets that its keys are in. None where there are none."""
        leaves = self._leaves(table)
        if near is not None and leaves:
            at = {tuple(r) for r in self._placed(near.select(self.key), leaves).select("_depth", "_prefix").distinct().collect()}
            leaves = {k: v for k, v in leaves.items() if k in at}
        return self._counted([r for v in leaves.values() for r in v])

    def _write(self, df: DataFrame, table: str, base: bool, seq: int) -> list[tuple]:
        """Write rows with _depth and _prefix, a folder for each bucket, and say what was written."""
        target = f"{self.folder}/data/{uuid.uuid4().hex}"
        dealt = df.withColumn("_bucket", F.concat_ws("-", "_depth", "_prefix")).drop("_depth", "_prefix")
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(target)
        found = self.spark.read.schema("_seq long, _bucket string").parquet(target).groupBy("_bucket").count().collect()
        return [(table, int(b.split("-")[0]), int(b.split("-")[1]), seq, base, f"{target}/_bucket={b}", n) for b, n in found]

    def _change(self, table: str, rows: DataFrame, touched: DataFrame, seq: int) -> tuple[set, list[tuple]]:
        """(buckets that are written anew, new rows of the manifest) for rows, all that touched keys have from now on."""
        path, own = scratch(self.spark, "delta"), {"_seq": F.lit(seq).cast("long")}
        rows.withColumns({"_gone": F.lit(False)} | own).write.parquet(path)
        written = self.spark.read.parquet(path)  # rows are not made again for their keys
        gone = touched.select(self.key).distinct().join(written.select(self.key), self.key, "left_anti").withColumns({"_gone": F.lit(True)} | own)
        marks = scratch(self.spark, "gone")
        gone.write.parquet(marks)
        delta = written.unionByName(self.spark.read.parquet(marks), allowMissingColumns=True)
        leaves = self._leaves(table) or {(0, 0): []}
        counts = {(r._depth, r._prefix): r["count"] for r in self._placed(delta.select(self.key), leaves).groupBy("_depth", "_prefix").count().collect()}
        anew, deeper = {}, {}
        for k, n in counts.items():
            total = n + sum(r.rows for r in leaves[k])
            if total > BUCKET_ROWS or len(leaves[k]) > MOST_DELTAS or not leaves[k]:
                anew[k] = leaves[k]
                deeper[k] = k[0] + max(0, math.ceil(math.log2(total / BUCKET_ROWS))) if total else k[0]
        out: list[tuple] = []
        added = [k for k in counts if k not in anew]
        if added:
            out += self._write(self._placed(delta, added), table, False, seq)
        if anew:
            keys = delta.select(self.key).distinct()
            held = self._counted([r for v in anew.values() for r in v])
            fresh = self._placed(delta.filter(~F.col("_gone")), list(anew))
            if held is not None:
                kept = held.join(keys, self.key, "left_anti").withColumns({"_gone": F.lit(False), "_seq": F.lit(seq).cast("long")})
                fresh = fresh.unionByName(self._placed(kept, list(anew)), allowMissingColumns=True)
            split = self.spark.createDataFrame([(*k, d) for k, d in deeper.items()], "_depth int, _prefix long, _to int")
            fresh = fresh.join(split, ["_depth", "_prefix"]).withColumn("_prefix", _prefix(_hash(self.key), F.col("_to"))).drop("_depth").withColumnRenamed("_to", "_depth")
            written = self._write(fresh, table, True, seq)
            full = {(r[1], r[2]) for r in written}
            for (depth, prefix), to in deeper.items():
                for k in range(1 << (to - depth)):
                    if (to, prefix | k << depth) not in full:
                        written.append((table, to, prefix | k << depth, seq, True, None, 0))
            out += written
        return set(anew), out

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame]], whole: tuple[str, ...] = ()) -> None:
        """For each table (rows, touched): the rows that touched keys have from now on. Tables of whole have no others."""
        seq, kept, new = self.seq + 1, list(self.rows), []
        for table, (rows, touched) in changes.items():
            if table in whole:
                kept = self.rows = [r for r in kept if r.table != table]
            anew, out = self._change(table, rows, touched, seq)
            kept = [r for r in kept if r.table != table or (r.depth, r.prefix) not in anew]
            new += out
        aside, at = f"{self.folder}/manifest/aside-{uuid.uuid4().hex}", f"{self.folder}/manifest/v{seq}"
        self.spark.createDataFrame([*map(tuple, kept), *new], MANIFEST).coalesce(1).write.parquet(aside)
        if self.fs.exists(self.path(at)) or not self.fs.rename(self.path(aside), self.path(at)):
            raise RuntimeError(f"another run has committed version {seq} of {self.folder}")
        self.seq, self.rows = seq, self._manifest(seq)
        self._clear()

    def _clear(self) -> None:
        versions = self._versions()
        alive = {r.path for v in versions[-KEPT:] for r in self._manifest(v)}
        for v in versions[:-KEPT]:
            for path in {r.path for r in self._manifest(v)} - alive - {None}:
                self.fs.delete(self.path(path), True)
            self.fs.delete(self.path(f"{self.folder}/manifest/v{v}"), True)
