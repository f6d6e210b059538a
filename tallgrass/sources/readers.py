"""Readers of chat exports, notes, attachments, inventories and compose files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions.text import iso
from tallgrass.operators.archive import text_of_parts
from tallgrass.operators.assets import CONTROL, EXTENSION, MORE_SUFFIXES
from tallgrass.operators.compose import COMPOSE_FILES
from tallgrass.operators.files import category, sensitive, skipped
from tallgrass.sources.digests import contents
from tallgrass.sources.json_arrays import elements

#: An export's schema is given, never inferred: node ids are keys of mapping.
EXPORT = "id string, conversation_id string, title string, create_time double, update_time double, current_node string, mapping map<string, variant>"


def chat_exports(spark: SparkSession, folder: str, pattern: str = "conversations*.json") -> DataFrame:
    """One row for each conversation of each export file, which is an array of them. A large file is read by many tasks."""
    found = elements(spark, folder, pattern).select("path", F.from_json("value", EXPORT).alias("x"))
    return exports(found.select("x.*", F.col("path").alias("source_file")))


def exports(df: DataFrame) -> DataFrame:
    """Rows of EXPORT and source_file as conversations: id, title, dates as text, nodes as an array."""
    get = lambda v, path, kind="string": F.try_variant_get(v, F.lit(path), kind)
    node = lambda k, v: F.struct(
        k.alias("node_id"), get(v, "$.parent").alias("parent"), F.coalesce(get(v, "$.message.author.role"), F.lit("unknown")).alias("role"),
        text_of_parts(get(v, "$.message.content.parts", "array<variant>")).alias("text"), get(v, "$.message.create_time").alias("created_at"), get(v, "$.message").alias("message"),
    )
    nodes = F.transform(F.map_entries("mapping"), lambda e: node(e.key, e.value))
    named = df.select(F.coalesce("id", "conversation_id").alias("conversation_id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), "create_time", "update_time", "current_node", nodes.alias("nodes"), "source_file")
    return named.filter("conversation_id is not null").select("conversation_id", "title", iso("create_time").alias("created_at"), iso("update_time").alias("updated_at"), "current_node", "nodes", "source_file")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and sha of each file of any size; contents do not leave the scan."""
    return contents(spark, folder, pattern, head=0).select("path", "sha")


#: Tasks for each core that list folders; Spark's own bound, 10,000, makes one of nearly every folder.
LISTERS, LISTER_KEY = 4, "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """What load gives, whose files are listed by a few tasks for each core."""
    before = spark.conf.get(LISTER_KEY)
    spark.conf.set(LISTER_KEY, min(int(before), LISTERS * spark.sparkContext.defaultParallelism))
    try:
        return load()
    finally:
        spark.conf.set(LISTER_KEY, before)


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and text of each file. Files are read as bytes: Spark's text source looks for codecs anew for every whole
    file, one task at a time in an executor."""
    df = _listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("text"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of notes."""
    df = whole_texts(spark, folder)
    return df.filter(~skipped(F.col("path")))


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and sha of what may be an attachment, its size, and if content is whole: of a file beyond
    digests.LARGEST it is the beginning, which gives its type and its text if it is plain, but no list of an archive."""
    df = contents(spark, folder)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    wanted = ending.isin(".dat", *EXTENSION.values(), *MORE_SUFFIXES) | F.startswith(name, F.lit("file_")) | F.startswith(name, F.lit("file-"))
    control = F.lower(name).isin(*CONTROL) | F.lower(name).rlike(r"^conversations-.*\.json$")
    return df.filter(wanted & ~control)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, time, category and sensitive of each file; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), category(name).alias("category"), sensitive(F.col("path")).alias("sensitive"))


#: Folders without compose files.
SKIP_FOLDERS = (".git", ".cache", "node_modules", "venv", ".venv", "__pycache__", "pgdata", "postgres", "postgres-data", "db_data", "database", "redis-data", "cache", "logs", "backups", "backup", "Photos", "photos", "library", "upload")


def compose_files(spark: SparkSession, folder: str, pattern: str = "*compose.y*ml", names: tuple[str, ...] = COMPOSE_FILES) -> DataFrame:
    """path and text of compose files; with no names, of all files that fit the pattern."""
    df = whole_texts(spark, folder, pattern)
    parts = F.split(F.col("path"), "/")
    named = F.element_at(parts, -1).isin(*names) if names else F.lit(True)
    return df.filter(named & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIP_FOLDERS])))
