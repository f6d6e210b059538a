"""What the operators of this package share: scratch tables, bounded filters, row keys.

Scratch tables are written to the folder that the session names in
``spark.checkpoint.dir`` (which every executor shares), so that lineage is cut and a
lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.scratch import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch: texts may be long, and both sides hold a batch whole.
BATCH_ROWS, BATCH_KEY = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again. A session that leaves the size of Arrow batches to Spark
    has small ones from here on."""
    if df.sparkSession.conf.get(BATCH_KEY) == "10000":
        df.sparkSession.conf.set(BATCH_KEY, BATCH_ROWS)
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has: those given, with underscores after them where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trimmed(work: Callable) -> Callable:
    """work for mapInArrow, after which a worker gives free memory back to the system, for it may wait long for its next task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return rows


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def let_go(df: DataFrame) -> None:
    """Let Spark delete shuffle files of tables that nothing refers to, which it does when the driver collects garbage."""
    for _ in range(2):  # first what Python refers to, then what the driver does
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def crc_of_id(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def bloom(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = 1 << 22, mark: str = "") -> DataFrame:
    """Rows of df whose key may be among those of keys: all that are, and few others; with mark, all rows and which these are.

    The filter is one bit per hash value, so what is broadcast has bits / 64 rows at
    most, however large keys is; with very many keys it only lets more rows through.
    """
    h = F.pmod(F.xxhash64(keys_key), F.lit(bits))
    words = keys.select(h.alias("_h")).groupBy((F.col("_h") / 64).cast("int").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(_h % 64))")).alias("_b"))
    g = F.pmod(F.xxhash64(key), F.lit(bits))
    out = df.withColumns({"_w": (g / 64).cast("int"), "_s": (g % 64).cast("int")}).join(F.broadcast(words), "_w", "left" if mark else "inner")
    some = F.expr("shiftright(_b, _s) & 1L") == 1
    if mark:
        return out.select(*[out[c] for c in df.columns], F.coalesce(some, F.lit(False)).alias(mark))
    return out.filter(some).select(*[out[c] for c in df.columns])
