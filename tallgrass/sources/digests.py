"""Content hashes of files of any size.

A file of up to ``LARGEST`` bytes is read and hashed by the scan. A larger one, which no value
of Spark could hold beyond 2 GiB, is listed by the scan (each in a task of its own, since it
is longer than a part) and read ``STEP`` bytes at a time by its task, which folds the digest
and keeps the first ``HEAD`` bytes, so a task's memory does not depend on the file.

Defined results. Empty files are left out, as Spark's readers leave them out. A file that is gone, or that may
not be read, ends the job, as it does for Spark's own readers.
"""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST, STEP, HEAD = 1 << 28, 1 << 23, 1 << 23


def opened(path: str) -> pa.NativeFile:
    """A stream of the bytes of a file that Spark names."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(inner)


def folded(path: str, head: int) -> tuple[bytes, str]:
    """(first bytes, sha256) of a file."""
    digest, first = hashlib.sha256(), b""
    with opened(path) as source:
        while step := source.read(STEP):
            digest.update(step)
            if len(first) < head:
                first += step[: head - len(first)]
    return first, digest.hexdigest()


def contents(spark: SparkSession, folder: str, pattern: str = "*", largest: int | None = None, head: int | None = None) -> DataFrame:
    """path, size, content, whole and sha of each file below folder; content is the first head bytes of a file larger than
    largest, which is not whole. If content is not used, it does not leave the scan."""
    largest, head = LARGEST if largest is None else largest, HEAD if head is None else head
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    small = files.filter(F.col("length") <= largest).select("path", F.col("length").alias("size"), "content", F.lit(True).alias("whole"), F.sha2("content", 256).alias("sha"))

    def rows(batches):
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, sha = folded(path, head)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([first], pa.binary()), pa.array([False]), pa.array([sha])], ["path", "size", "content", "whole", "sha"])

    large = files.filter(F.col("length") > largest).select("path", "length")
    return small.unionByName(large.mapInArrow(rows, "path string, size long, content binary, whole boolean, sha string"))
