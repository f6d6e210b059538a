"""Places and running sums within keys, across tasks: no key's rows go through one task, however many it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallgrass.sources.scratch import scratch

#: Rows in all that one task may as well put in order.
FEW = 1 << 19
#: Keys of parts that every task may be sent; with more of them rows move to theirs.
SENT_PARTS = 100_000
#: Rows of a part are numbered from here on in the lower bits.
PART_BITS = 33


def numbered(df: DataFrame, keys: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """df with _place, from 1 in each key by order, and with value its running sum _total up to the row.

    Rows are dealt to tasks by ranges of (keys, order), and sorted there; equal ones come in an order that their other
    columns decide. What each part has of each key is added up over the parts before it, one row for a key and part.
    Rows are written twice: ranges are chosen from a first look at them. Of ``FEW`` rows or less in all none is a key
    too large for a task, and windows do.
    """
    spark, path, sorted_path = df.sparkSession, scratch(df.sparkSession, "rows"), scratch(df.sparkSession, "ranges")
    by = [*keys, *order, "_tie"]
    df.withColumn("_tie", F.xxhash64(*df.columns)).write.parquet(path)
    held = spark.read.parquet(path)
    if held.count() <= FEW:
        w = W.partitionBy(*keys).orderBy(*order, "_tie")
        sums = {"_total": F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))} if value else {}
        return held.withColumns({"_place": F.row_number().over(w).cast("long")} | sums).select(*df.columns, "_place", *sums)
    # The number of a row in its part, and in the upper bits that of the part.
    held.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(sorted_path)
    rows = spark.read.parquet(sorted_path).withColumn("_part", F.shiftright("_at", PART_BITS))
    sums = [F.sum(value).alias("_sum")] if value else []
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *sums)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = {"_before": "_n"} | ({"_sum_before": "_sum"} if value else {})
    parts = parts.withColumns({new: F.coalesce(F.sum(old).over(earlier), F.lit(0)) for new, old in before.items()})
    parts = parts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), "_first", *before)
    parts_path = scratch(spark, "parts")
    parts.write.parquet(parts_path)
    parts = spark.read.schema(parts.schema).parquet(parts_path)
    if parts.count() <= SENT_PARTS:
        parts = F.broadcast(parts)
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = rows.join(parts, same).withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    if value:
        inner = W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("_total", F.col("_sum_before") + F.sum(value).over(inner))
    return out.select(*df.columns, "_place", *(["_total"] if value else []))
