"""Conversations: messages, transcripts, digests, and merging an import with what is stored."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X
from pyspark.sql import Window as W

from tallgrass.functions.text import trim

MESSAGES = X.ArrayType(X.StructType([X.StructField("pos", X.IntegerType()), X.StructField("role", X.StringType()), X.StructField("text", X.StringType()), X.StructField("created_at", X.StringType())]))


def as_messages(turns: DataFrame, key: str) -> DataFrame:
    """conversation_id and messages (pos, role, text) in order, from rows of turns."""
    m = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("pos"), "role", "text")))
    return turns.groupBy(F.col(key).alias("conversation_id")).agg(m.alias("messages"))


def transcript(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m.role, F.lit("] "), m.text)), "\n\n")


def user_text(messages: Column) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m.role == "user"), lambda m: m.text), "\n")


def digest(title: Column, messages: Column) -> Column:
    """Of what was said alone: volatile metadata has no part in it."""
    return F.sha2(F.to_json(F.struct(title.alias("title"), messages.alias("messages"))), 256)


def text_of_parts(parts: Column) -> Column:
    """Text of an ARRAY<VARIANT>: strings, and the text of objects, that are not empty, joined and trimmed."""
    one = F.transform(parts, lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.try_variant_get(p, "$.text", "string")))
    return trim(F.array_join(F.filter(one, lambda x: F.coalesce(x, F.lit("")) != ""), "\n"))


def branch(current: str | None, nodes: dict[str, tuple[str | None, dict | None]]) -> list[dict]:
    """Messages from the root to current; a node met again ends the walk."""
    out, seen = [], set()
    while current and current in nodes and current not in seen:
        seen.add(current)
        current, message = nodes[current]
        if message and (message.get("text") or "").strip():
            out.append({"role": message.get("role") or "unknown", "text": message["text"].strip(), "created_at": message.get("created_at") or ""})
    return [{"pos": k, **m} for k, m in enumerate(reversed(out))]


def flatten(conversations: DataFrame) -> DataFrame:
    """conversation_id and the messages of its active branch; a row never leaves its task.

    conversations has conversation_id, current_node and nodes: an array of (node_id, parent,
    role, text, created_at).
    """

    def rows(batches):
        for b in batches:
            out = []
            for current, nodes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree = {n["node_id"]: (n["parent"], n) for n in nodes or []}
                out.append(branch(current, tree))
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("created_at", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["conversation_id", "messages"])

    kind = conversations.schema["conversation_id"].dataType
    return conversations.select("conversation_id", "current_node", "nodes").mapInArrow(rows, X.StructType([X.StructField("conversation_id", kind), X.StructField("messages", MESSAGES)]))


def last_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = W.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


#: Fixed value: the version of digest().
HASH_VERSION = "analysis-v1"


def diff(incoming: DataFrame, stored: DataFrame, key: str = "conversation_id", digest: str = "digest", again: Column | None = None) -> DataFrame:
    """incoming with change: added, updated or unchanged. Only keys and digests of stored are shuffled. A stored
    digest that is missing, or whose hash_version is another, is made anew by again, an expression of stored."""
    was = F.col(digest)
    if again is not None:
        was = F.when((F.col("hash_version") == HASH_VERSION) & (F.coalesce(was, F.lit("")) != ""), was).otherwise(again)
    old = stored.select(F.col(key).alias("_key"), was.alias("_digest"))
    change = F.when(F.col("_key").isNull(), "added").when(F.col("_digest") == F.col(digest), "unchanged").otherwise("updated")
    return incoming.join(old, incoming[key] == F.col("_key"), "left").withColumn("change", change).drop("_key", "_digest")


#: Columns that say how far a conversation is, and what they start with.
STATE = {"state": "pending", "attempts": 0, "last_error": None, "claimed_at": None, "processed_at": None}


def merge(incoming: DataFrame, stored: DataFrame, key: str = "conversation_id", again: Column | None = None, rest: bool = True) -> DataFrame:
    """The new snapshot, with all columns of stored. What the import says of titles, dates, files, texts and priority
    holds; unchanged rows keep their state, updated ones start again; rows that the import lacks stay, or, without rest, are
    left out, and then only what the import does not say is read and shuffled of stored."""
    new, old = diff(incoming, stored, key, again=again).alias("n"), stored.alias("s")
    same = F.col("n.change") == "unchanged"
    joined = new.join(old, F.col(f"n.{key}") == F.col(f"s.{key}"), "full_outer" if rest else "left")
    kinds = dict(stored.dtypes)

    def column(c: str) -> Column:
        if c in STATE:
            return F.when(F.col(f"n.{key}").isNull() | same, F.col(f"s.{c}")).otherwise(F.lit(STATE[c]).cast(kinds[c])).alias(c)
        if c in incoming.columns and not rest:
            return F.col(f"n.{c}").alias(c)
        if c in incoming.columns:
            return F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
        return F.col(f"s.{c}")

    return joined.select(*[column(c) for c in stored.columns])


def invalidate(derived: DataFrame, changed: DataFrame, key: str = "conversation_id") -> DataFrame:
    """derived without the rows of updated conversations."""
    return derived.join(changed.filter("change = 'updated'").select(key).distinct(), key, "left_anti")


def insert_or_ignore(incoming: DataFrame, stored: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows of incoming with a key that stored lacks; the first of each."""
    return first_wins(incoming, key, *order).join(stored.select(key), key, "left_anti")


def with_new_priority(stored: DataFrame, incoming: DataFrame, key: str = "conversation_id") -> DataFrame:
    """stored with the priority that incoming gives to conversations that are still pending."""
    new = incoming.groupBy(F.col(key).alias("_key")).agg(F.max("priority").alias("_new"))
    priority = F.when(F.col("state") == "pending", F.coalesce("_new", "priority")).otherwise(F.col("priority"))
    return stored.join(new, stored[key] == F.col("_key"), "left").select(*[priority.cast(stored.schema[c].dataType).alias(c) if c == "priority" else stored[c] for c in stored.columns])


def without_done(candidates: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return candidates.join(done.select(*keys), list(keys), "left_anti")


def next_batch(conversations: DataFrame, n: int) -> DataFrame:
    return conversations.filter("state = 'pending'").orderBy(F.desc("priority"), "created_at", "conversation_id").limit(n)


#: Fixed value: attempts after which a conversation is set aside.
MOST_ATTEMPTS = 3


def after_outcome(state: DataFrame, outcome: DataFrame, key: str = "conversation_id") -> DataFrame:
    """States after a run: done, tried again, or quarantined; what was left in processing is pending again."""
    o = outcome.select(F.col(key).alias("_key"), "ok", "error")
    tries = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
    new = F.when(F.col("ok"), "done").when(~F.col("ok"), F.when(tries >= MOST_ATTEMPTS, "quarantined").otherwise("pending")).when(F.col("state") == "processing", "pending").otherwise(F.col("state"))
    joined = state.join(o, state[key] == F.col("_key"), "left")
    return joined.select(state[key], new.alias("state"), tries.alias("attempts"), F.when(F.col("ok"), None).otherwise(F.col("error")).alias("last_error"))
