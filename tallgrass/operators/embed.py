"""An embedding index that is kept up by content hash."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallgrass.sources.batches import release, small
from tallgrass.sources.scratch import scratch

#: Signs of a text that are embedded, codes of answers after which a call is made again, and the longest wait.
INPUT, TRANSIENT, LONGEST = 8_000, frozenset((429, 500, 502, 503, 504)), 8


def _joined(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def chat_hash(conversation: Column, first: Column, last: Column, text: Column) -> Column:
    return _joined(conversation, first, last, text)


def asset_hash(asset: Column, text: Column) -> Column:
    return _joined(asset, text)


def note_hash(path: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat(path, index.cast("string"), text), 256)


Embedder = Callable[[pd.Series], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A stand-in for a model: words hashed to places, at unit length; equal texts, equal vectors."""

    def embed(texts: pd.Series) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.maximum(norm, 1e-9)).tolist()

    return embed


def embedded(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding", tries: int = 4, pause: float = 1.0) -> DataFrame:
    """df with a vector for the first INPUT signs of text. A call that fails in passing (without a code, or with one
    of TRANSIENT) is made again after 1, 2, 4 and at most LONGEST times pause seconds."""

    def called(texts: pd.Series) -> pd.Series:
        for k in range(tries):
            try:
                return pd.Series(embedder(texts.fillna("")))
            except OSError as e:
                code = getattr(e, "code", None)
                if k == tries - 1 or (code is not None and code not in TRANSIENT):
                    raise
                time.sleep(pause * min(2**k, LONGEST))
        raise AssertionError

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(called, batches)
        release()

    return small(df).withColumn(name, run(F.substring(text, 1, INPUT)))


def embed_missing(chunks: DataFrame, text: str, embedder: Embedder, model: str) -> DataFrame:
    """chunks with vectors where they have none, but for chunks whose content_kind is metadata alone."""
    wanted = F.col("embedding").isNull()
    if "content_kind" in chunks.columns:
        wanted = wanted & (F.coalesce("content_kind", F.lit("")) != "metadata")
    made = embedded(chunks.filter(wanted).drop("embedding", "embedding_model"), text, embedder).withColumn("embedding_model", F.lit(model))
    return chunks.filter(~wanted).unionByName(made, allowMissingColumns=True)


def last_of_hash(chunks: DataFrame, source: str = "source_id") -> DataFrame:
    """Of chunks of one source with the same hash, the one with the last index."""
    w = W.partitionBy(source, "chunk_hash").orderBy(F.desc("chunk_index"))
    return chunks.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reuse(new: DataFrame, old: DataFrame, model: str, embedding_on: bool = True) -> DataFrame:
    """new with the stored vector of its hash where the model is the same or embedding is off, and whether it was reused."""
    known = old.filter("embedding is not null").groupBy("chunk_hash").agg(F.max_by(F.struct("embedding", "embedding_model"), F.struct((F.col("embedding_model") == model).alias("same"), "chunk_index")).alias("_old"))
    fits = F.col("_old").isNotNull() & ((F.col("_old.embedding_model") == model) | F.lit(not embedding_on))
    joined = new.join(known, "chunk_hash", "left")
    return joined.select(*new.columns, F.when(fits, F.col("_old.embedding")).alias("embedding"), F.when(fits, F.col("_old.embedding_model")).otherwise(F.lit(model)).alias("embedding_model"), fits.alias("reused"))


#: Pointers of 16 bytes and a file's name that every task may be sent; with more of them, rows move to their pointers.
SENT_POINTERS = 250_000


def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a Parquet folder, with the place of each row in its files as at (file, row)."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    return spark.read.parquet(folder).select("*", at)


def located(new: DataFrame, stored: DataFrame, model: str, embedding_on: bool = True) -> DataFrame:
    """What reuse() says of new, with the place (at) of the stored vector instead of the vector, so that only hashes and
    places are shuffled. Of several stored chunks of a hash the one with the largest index counts, then the last place;
    null hashes have no vector."""
    same = F.col("embedding_model") == model
    known = stored.filter("embedding is not null").select("chunk_hash", F.struct(same.alias("same"), "chunk_index", "at", F.col("embedding_model").alias("model")).alias("_old"))
    last = known.groupBy("chunk_hash").agg(F.max("_old").alias("_old"))
    fits = F.col("_old").isNotNull() & (F.coalesce(F.col("_old.same"), F.lit(False)) | F.lit(not embedding_on))
    joined = new.join(last, "chunk_hash", "left")
    return joined.select(*new.columns, F.when(fits, F.col("_old.at")).alias("at"), F.when(fits, F.col("_old.model")).otherwise(F.lit(model)).alias("embedding_model"), fits.alias("reused"))


def fetched(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found (of located()) with the vectors at its places. Few places are sent to the scan, which then gives no other
    vector to a shuffle; with more than SENT_POINTERS of them places and vectors meet by a shuffle."""
    spark, path = found.sparkSession, scratch(found.sparkSession, "places")
    found.filter("at is not null").select("at.file", "at.row").distinct().write.parquet(path)
    places = spark.read.parquet(path)
    few = places.count() <= SENT_POINTERS
    vectors = stored.select(F.col("at.file").alias("file"), F.col("at.row").alias("row"), "embedding")
    wanted = vectors.join(F.broadcast(places) if few else places, ["file", "row"], "left_semi").select(F.struct("file", "row").alias("at"), "embedding")
    return found.join(wanted, "at", "left").select(*found.columns, "embedding").drop("at")


def replace_sources(new: DataFrame, stored: DataFrame, source: str = "source_id", touched: DataFrame | None = None) -> DataFrame:
    """The chunk table after an import: all chunks of touched sources (those of new if none are named) are the new
    ones, so a touched source without chunks loses those it had."""
    keys = (new if touched is None else touched).select(source).distinct()
    return stored.join(keys, source, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_vector(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """new with the stored vector where it has none."""
    old = stored.select(F.col(key).alias("_key"), F.col("embedding").alias("_old"))
    joined = new.join(old, new[key] == F.col("_key"), "left")
    return joined.select(*[new[c] for c in new.columns if c != "embedding"], F.coalesce(new["embedding"], F.col("_old")).alias("embedding"))


def metrics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("source_id").alias("conversations"), F.count("*").alias("chunks"), F.count_if(~F.col("reused") & F.col("embedding").isNotNull()).alias("embedded"), F.count_if("reused").alias("reused"), F.count("embedding").alias("vectors"))
