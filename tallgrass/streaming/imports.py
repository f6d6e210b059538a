"""An incremental import: new conversations arrive, each run merges them and keeps what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators import archive, chunking, classify, embed
from tallgrass.sources.scratch import scratch
from tallgrass.sources.versioned import Store

KEY = "conversation_id"
STATE = "state string, attempts int, last_error string"
#: Columns by which the last of several versions of a conversation is known, where they are given.
ORDER = ("source_file", "position", "updated_at", "created_at")


def united(new: Column, old: Column) -> Column:
    """The messages of both in order of position; where both have one, the new one."""
    kept = F.filter(F.coalesce(old, F.array()), lambda m: ~F.exists(new, lambda n: n.pos == m.pos))
    return F.when(old.isNull(), new).otherwise(F.array_sort(F.concat(new, kept)))


def _settled(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def import_batch(new: DataFrame, folder: str, model: str = "hash", derived: tuple[str, ...] = (), unite: bool = False) -> None:
    """Merge conversations (conversation_id, title, created_at, messages) into the tables in folder: conversations with
    their state, and chunks with their vectors. Rows of tables named in derived (with a conversation_id) go where a
    conversation has changed.

    Of several versions of a conversation the last one holds, by the columns of ORDER that new has, then by its digest.
    A version is the whole conversation, or, with unite, some of its messages: others that are stored stay. A run that
    is repeated after a loss finds equal digests and changes nothing.
    """
    spark, store = new.sparkSession, Store(new.sparkSession, folder, KEY)
    of = F.col("messages")
    order = F.struct(*[F.col(c) for c in ORDER if c in new.columns], archive.digest(F.col("title"), of))
    last = archive.last_wins(new, KEY, order)
    last = _settled(last, "batch")  # it is looked at twice
    old = store.read("conversations", near=last)
    if unite and old is not None:
        held = old.select(KEY, F.col("messages").alias("_old"))
        last = last.join(held, KEY, "left").withColumn("messages", united(of, F.col("_old"))).drop("_old")
    now = last.withColumn("digest", archive.digest(F.col("title"), of)).withColumn("hash_version", F.lit(archive.HASH_VERSION)).withColumn("priority", classify.priority(F.col("title"), archive.user_text(of)))
    now = _settled(now, "import")
    if old is None:
        old = spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema) + ", " + STATE)
    changes = archive.diff(now, old, again=archive.digest(F.col("title"), of))
    changed = changes.filter("change <> 'unchanged'").select(KEY)
    chunks = chunking.chunk_conversations(now.join(changed, KEY, "left_semi")).withColumn("source_id", F.col(KEY)).withColumn("chunk_hash", embed.chat_hash(F.col(KEY), F.col("first_message"), F.col("last_message"), F.col("text")))
    key = now.schema[KEY].dataType.simpleString()
    old_chunks = store.read("chunks", near=now)
    if old_chunks is None:
        old_chunks = spark.createDataFrame([], f"{KEY} {key}, chunk_index int, first_message int, last_message int, text string, source_id {key}, chunk_hash string, embedding array<float>, embedding_model string")
    reused = embed.reuse(embed.last_of_hash(chunks), old_chunks, model).drop("reused")
    # Chunks with and without a vector go different ways from here on.
    made = embed.embed_missing(_settled(reused, "chunks"), "text", embed.hashing_embedder(), model)
    merged = archive.merge(now, old, again=archive.digest(F.col("title"), of), rest=False)
    tables = {"conversations": (merged, now), "chunks": (made, changed)}
    updated = changes.filter("change = 'updated'").select(KEY)
    for name in derived:
        if name in store.tables():
            tables[name] = (updated.limit(0), updated)
    store.commit(tables)


def put(df: DataFrame, folder: str, table: str) -> None:
    """df as the whole of a table."""
    Store(df.sparkSession, folder, KEY).commit({table: (df, df)}, whole=(table,))


def run(turns_folder: str, folder: str, spark: SparkSession, schema, files_at_once: int = 100, derived: tuple[str, ...] = ()) -> None:
    """Take all turns files (conv_id, turn, role, text) that have come since the last run. The turns of a conversation
    may be in any files and runs; of a turn that comes again the last one holds, by run, then file, then row."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(turns_folder)
    placed = stream.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))

    def merge(batch: DataFrame, _: int) -> None:
        turns = batch.groupBy("conv_id", "turn").agg(F.max_by(F.struct("role", "text"), "_place").alias("m")).select("conv_id", "turn", "m.*")
        c = archive.as_messages(turns, "conv_id").withColumns({"title": F.concat(F.lit("conversation "), F.col(KEY).cast("string")), "created_at": F.lit("")})
        import_batch(c, folder, derived=derived, unite=True)

    q = placed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return Store(spark, folder, KEY).read(table)
