"""Token-ID output: one zstandard frame for each document, with a dictionary that all share.

A store is a folder with two Parquet tables, written by Spark's own committers:

- ``dictionary``: one row, the bytes of the zstandard dictionary and their SHA-256. It is
  trained on the serialized id arrays of at most ``SAMPLE`` documents, those with the
  smallest hash of id and text.
- ``shards``: rows of about ``SHARD`` bytes in ascending doc_id order, in parts of about ``PART``
  bytes that follow each other. Each has the dictionary's hash, how many ids its part holds before it, a payload of frames, and an index of 32 bytes for each document: doc_id, offset
  and length in the payload, number of ids (all little-endian), so one document is read
  by decompressing its frame alone.

Ids are serialized as 16-bit integers if the vocabulary allows it, else as 32-bit ones.

Defined results. A null text is an empty one: just the end id. A row without an id comes
first and is read back as null (``NO_ID`` in the index). Rows that share an id are kept
one for one, in the order of their frames' hashes. An empty table gives a store without
shards. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import scratch, trimmed

SAMPLE, DICTIONARY, SHARD, PART, LEVEL = 512, 112_640, 4 << 20, 64 << 20, 3
NO_ID = -(1 << 63)
SHARDS = "part int, shard int, first_id long, last_id long, docs long, ids long, before long, width string, dictionary string, index binary, payload binary"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("ids", "<i8")])


def _dictionary(docs: DataFrame, path: str, end_id: int, width: str) -> DataFrame:
    sample = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(SAMPLE)

    def train(batches):
        arrays = [ids.astype(width).tobytes() for b in batches for _, ids in tokens.encoded(b, 1, path, False, end_id)]
        try:
            raw = zstandard.train_dictionary(DICTIONARY, arrays).as_bytes()
        except zstandard.ZstdError:  # too little to train on
            raw = b""
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([hashlib.sha256(raw).hexdigest()])], ["bytes", "sha256"])

    return sample.repartition(1).mapInArrow(train, "bytes binary, sha256 string")


def _stored_dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str]:
    """The dictionary and its hash; an empty one for a store without documents."""
    row = spark.read.schema("bytes binary, sha256 string").parquet(f"{folder}/dictionary").first()
    return (bytes(row.bytes), row.sha256) if row else (b"", hashlib.sha256(b"").hexdigest())


def _zdict(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, folder: str, path: str = tokens.BYTE_BPE, end_id: int = 2, vocabulary: int = 50_257) -> None:
    """Encode each text, append end_id, and write the store to folder."""
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    _dictionary(docs, path, end_id, width).write.parquet(f"{folder}/dictionary")
    raw, digest = _stored_dictionary(spark, folder)

    def frames(batches):
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(raw))
        for b in batches:
            sizes, out = [], []
            for _, ids in tokens.encoded(b, 1, path, False, end_id):
                sizes.append(len(ids))
                out.append(z.compress(ids.astype(width).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids", "frame"])

    def shards(batches):
        part, k, before, rows, payload, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush():
            index = np.array(rows, INDEX)
            values = {"part": part, "shard": k, "first_id": None if rows[0][0] == NO_ID else rows[0][0], "last_id": None if rows[-1][0] == NO_ID else rows[-1][0], "docs": len(rows), "ids": int(index["ids"].sum()), "before": before, "width": width, "dictionary": digest, "index": index.tobytes(), "payload": b"".join(payload)}
            return pa.RecordBatch.from_pylist([values], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("before", pa.int64()), ("width", pa.string()), ("dictionary", pa.string()), ("index", pa.binary()), ("payload", pa.binary())]))

        for b in batches:
            for doc, ids, frame in zip(*(c.to_pylist() for c in b.columns[:3])):
                rows.append((NO_ID if doc is None else doc, size, len(frame), ids))
                payload.append(frame)
                size += len(frame)
                if size >= SHARD:
                    yield flush()
                    before += sum(r[3] for r in rows)
                    k, rows, payload, size = k + 1, [], [], 0
        if rows:
            yield flush()

    encoded = docs.select("doc_id", "text").mapInArrow(trimmed(frames), "doc_id long, ids long, frame binary")
    encoded.write.parquet(f"{folder}/_frames")
    made = spark.read.schema("doc_id long, ids long, frame binary").parquet(f"{folder}/_frames")
    size = made.agg(F.sum(F.length("frame") + 40)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    ranged = made.repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id"), F.xxhash64("frame"))
    ranged.mapInArrow(shards, SHARDS).write.parquet(f"{folder}/shards")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_frames")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def _decode(dictionary: bytes, digest: str, base: dict[int, int], wanted: set | None = None):
    def rows(batches):
        z = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary"] != digest:
                    raise ValueError("a shard names another dictionary")
                at, out = base[r["part"]] + r["before"], []
                for doc, offset, length, n in np.frombuffer(r["index"], INDEX).tolist():
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(z.decompress(r["payload"][offset : offset + length]), r["width"])
                        out.append((None if doc == NO_ID else doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if wanted is not None else None))
                    at += n
                if out:
                    doc, start, n, crc, ids = zip(*out)
                    cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return rows


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and ids if doc_ids names the documents wanted.

    Only shards whose range of ids holds a wanted one are read, and of them only its frames.
    """
    raw, digest = _stored_dictionary(spark, folder)
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("ids").alias("n")).collect()}  # as many as write() had partitions
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    if doc_ids is not None:
        near = [(F.col("first_id") <= i) & (F.col("last_id") >= i) for i in doc_ids]
        some = near[0] if near else F.lit(False)
        for c in near[1:]:
            some |= c
        shards = shards.filter(some)
    return shards.select("part", "before", "width", "dictionary", "index", "payload").mapInArrow(_decode(raw, digest, base, None if doc_ids is None else set(doc_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read from a store of docs in the shared folder."""
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, folder)
    return read(docs.sparkSession, folder).drop("ids")
