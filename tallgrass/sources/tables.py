"""Tables: snapshots kept up by key, logs that are added to, and text output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import MapType, VariantType


def upserted(stored: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: the one with the largest order, or else new before stored, of which only keys that
    new lacks are kept, so no more than new is put in order. Of several new rows of a key, with the same order or without
    any, the one whose columns are largest, from the left, holds: the result does not depend on how rows are dealt."""
    rest = [F.desc_nulls_last(F.to_json(F.struct(c)) if isinstance(new.schema[c].dataType, (MapType, VariantType)) else c) for c in new.columns if c not in (key, order)]
    if not order:
        first = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*rest or [key]))).filter("_n = 1").drop("_n")
        return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(first, allowMissingColumns=True)
    both = stored.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(F.desc(order), F.desc("_rank"), *rest)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_rank")


def log_event(df: DataFrame, path: str) -> None:
    """Add rows (kind, title, body, metadata) to a log; earlier rows are never touched."""
    df.withColumn("metadata", F.to_json("metadata") if dict(df.dtypes)["metadata"] != "string" else F.col("metadata")).write.mode("append").parquet(path)


#: Rows of a key that go into one file of a dossier.
FILE_ROWS = 10_000


def write_dossiers(rows: DataFrame, path: str, keys: list[str], order: str, body: str) -> None:
    """A folder for each key with the texts of its rows in order, in files of FILE_ROWS at most that are named in
    order. Keys are dealt by ranges of keys and order, so a large one goes to several tasks."""
    ranged = rows.select(*keys, order, body).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    ranged.select(*keys, body).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*keys).text(path)


def metrics_row(import_id: str, metrics: DataFrame) -> DataFrame:
    """One row with the metrics (one row) of a run as JSON."""
    return metrics.select(F.lit(import_id).alias("import_id"), F.to_json(F.struct(*metrics.columns)).alias("metrics_json"))
