"""A table in order of its key, of which a merge writes only the files anew that may hold a changed key.

Files hold ranges of keys that do not overlap, some ``FILE_ROWS`` rows each; a manifest has the least and largest key
and the rows of each. A changed or new key belongs to one file, so changes of one per cent of the keys in one range cost
about one per cent of the table. Of several rows of a key the one with the largest order holds, a new one before a stored
one of the same order, and of new ones of the same order the one whose columns are largest, from the left.

The manifest is written aside and then renamed, so a reader sees a merge whole or not at all; a merge whose number is
taken by then fails. The files of the last two manifests are kept. The driver holds the manifest, a row a file: some
400,000 for 100 TB in files of 256 MB; their first keys are sent to tasks that look for the file of a key.

Defined results. Rows without a key are left out; a null order is the smallest. Without changes nothing is written.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.scratch import scratch

FILE_ROWS = 1_000_000


class Ranged:
    def __init__(self, spark: SparkSession, folder: str, key: str, order: str, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.folder, self.key, self.order, self.file_rows = spark, folder.rstrip("/"), key, order, file_rows
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        at = self.path(f"{self.folder}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        self.version = max((int(n[1:]) for n in names if n[0] == "v"), default=0)
        self.files = self._files(self.version)

    def _files(self, version: int) -> list:
        """A row (path, least, largest, rows) for each file, in order."""
        return self.spark.read.parquet(f"{self.folder}/manifest/v{version}").orderBy("least").collect() if version else []

    def read(self) -> DataFrame | None:
        return self._rows(self.files)

    def _rows(self, files: list) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*[f.path for f in files]) if files else None

    def _slot(self) -> Column:
        """The number of the file that a key belongs to."""
        fences = [f.least for f in self.files[1:]]

        @F.arrow_udf("int")
        def of(keys: pa.Array) -> pa.Array:
            return pa.array([bisect_right(fences, k) for k in keys.to_pylist()], pa.int32())

        return of(self.key) if fences else F.lit(0)

    def _newest(self, rows: DataFrame, *first: str) -> DataFrame:
        """One row for each key, found before rows are shuffled as far as a task sees them."""
        rest = [c for c in rows.columns if c not in (self.key, self.order, *first)]
        rank = F.struct(self.order, *first, *rest)
        return rows.groupBy(self.key).agg(F.max(rank).alias("_r")).select(self.key, *[F.col(f"_r.{c}").alias(c) for c in rows.columns if c != self.key])

    def merge(self, changes: DataFrame) -> dict[str, int]:
        """Put changes in. Returns how many files there were, and were written anew, and rows of those."""
        path = scratch(self.spark, "changes")
        self._newest(changes.filter(F.col(self.key).isNotNull())).withColumn("_slot", self._slot()).write.parquet(path)
        new = self.spark.read.parquet(path)
        counts = {r._slot: r["count"] for r in new.groupBy("_slot").count().collect()}
        touched = [self.files[k] for k in sorted(counts)] if self.files else []
        said = {"files": len(self.files), "rewritten": len(touched), "rows": sum(f.rows for f in touched) + sum(counts.values())}
        if not counts:
            return said
        every = new.withColumn("_new", F.lit(1))
        held = self._rows(touched)
        if held is not None:
            every = self._newest(every.unionByName(held.withColumns({"_slot": self._slot(), "_new": F.lit(0)}), allowMissingColumns=True), "_new")
        target = f"{self.folder}/data/{uuid.uuid4().hex}"
        parts = -(-said["rows"] // self.file_rows)
        dealt = every.drop("_new").repartitionByRange(parts, "_slot", self.key).sortWithinPartitions("_slot", self.key)
        dealt.write.partitionBy("_slot").parquet(target)
        self._publish(target, touched)
        return said

    def _publish(self, target: str, replaced: list) -> None:
        k, gone = F.col(self.key), {f.path for f in replaced}
        made = self.spark.read.parquet(target).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(k).alias("least"), F.max(k).alias("largest"), F.count("*").alias("rows"))
        kept = [f for f in self.files if f.path not in gone]
        whole = made.unionByName(self.spark.createDataFrame(kept, made.schema)) if kept else made
        aside, to = f"{self.folder}/aside-{uuid.uuid4().hex}", f"{self.folder}/manifest/v{self.version + 1}"
        whole.coalesce(1).write.parquet(aside)
        self.fs.mkdirs(self.path(f"{self.folder}/manifest"))
        if self.fs.exists(self.path(to)) or not self.fs.rename(self.path(aside), self.path(to)):
            for left in (aside, target):
                self.fs.delete(self.path(left), True)
            raise RuntimeError(f"another merge has written {to}")
        before = {f.path for f in self.files}
        self.version, self.files = self.version + 1, self._files(self.version + 1)
        if self.version > 2:  # what only the manifest before the last two names
            for f in {f.path for f in self._files(self.version - 2)} - before - {f.path for f in self.files}:
                self.fs.delete(self.path(f), False)
            self.fs.delete(self.path(f"{self.folder}/manifest/v{self.version - 2}"), True)
