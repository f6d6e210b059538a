"""Keyword, vector, hybrid and full-text search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallgrass.functions.text import keyword_score, lits, occurrences
from tallgrass.sources.scratch import scratch

#: Weight of the cosine, results of a search, and the constants of BM25.
WEIGHT, LIMIT, K1, B, LEAST_IDF = 10.0, 8, 1.2, 0.75, 1e-6
#: Queries that a task compares with a batch of chunks at once.
AT_ONCE = 256


def cosine(a: Column, b: Column) -> Column:
    """-1 if either is missing, they differ in length, or one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    good = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(good, dot(a, b) / norms).otherwise(-1.0)


def vector(values: list[float]) -> Column:
    """A query vector as a constant."""
    return lits(float(v) for v in values)


def hybrid_score(keywords: Column, similarity: Column) -> Column:
    return keywords + F.when(similarity >= 0, WEIGHT * similarity).otherwise(0.0)


def search(chunks: DataFrame, query: str, query_vector: list[float] | None = None, limit: int = LIMIT) -> DataFrame:
    """The best chunks (source, source_rank, chunk_id, text, embedding): only the first limit of each
    partition are sent on. Ties keep the order of sources, then of chunks."""
    similarity = cosine(F.col("embedding"), vector(query_vector)) if query_vector else F.lit(-1.0)
    scored = chunks.withColumn("score", hybrid_score(keyword_score(F.col("text"), query), similarity)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "source_rank", "chunk_id").limit(limit)


def search_many(chunks: DataFrame, queries: DataFrame, limit: int = LIMIT, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """query_id, chunk_id, score and place of the best chunks for each of queries (query_id, vector).

    A task keeps the limit best of each query as it goes through its chunks, so what is shuffled
    is limit rows for each query and task. Queries come to every task, and to the driver, in blocks whose
    numbers fill about broadcast_bytes, however long their vectors are.
    """
    known = queries.select("query_id", "vector").orderBy("query_id")
    out = None
    rows, width = known.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-rows * 8 * max(width or 0, 1) // broadcast_bytes))
    for k in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        held = part.toPandas()
        ids, q = held["query_id"].to_numpy(), np.array(held["vector"].tolist(), np.float64).reshape(len(held), -1 if len(held) else 1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        best = chunks.select("chunk_id", "embedding").mapInArrow(_best(chunks.sparkSession.sparkContext.broadcast((ids, q)), limit), "query_id long, chunk_id long, score double")
        out = best if out is None else out.unionByName(best)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return out.withColumn("place", place).filter(F.col("place") <= limit)


def _best(shared, limit: int):
    def rows(batches):
        ids, q = shared.value
        top: list = [None] * len(ids)
        for b in batches:
            sizes = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            good = sizes == q.shape[1]
            x = np.array([v for v, g in zip(b.column(1).to_pylist(), good) if g], np.float64).reshape(-1, q.shape[1])
            chunk = b.column(0).to_numpy()[good]
            norm = np.linalg.norm(x, axis=1)
            x, chunk = x[norm > 0] / norm[norm > 0, None], chunk[norm > 0]
            for i in range(0, len(ids) if len(x) else 0, AT_ONCE):
                near = np.round(q[i : i + AT_ONCE] @ x.T, 9)
                # All that reach the limit-th best of a row, so that ties are settled by chunk.
                least = np.partition(near, -limit, axis=1)[:, -limit] if near.shape[1] > limit else np.full(len(near), -2.0)
                for k, (s, low) in enumerate(zip(near, least), i):
                    good = np.flatnonzero(s >= low)
                    c, v = (chunk[good], s[good]) if top[k] is None else (np.append(top[k][0], chunk[good]), np.append(top[k][1], s[good]))
                    order = np.lexsort((c, -v))[:limit]
                    top[k] = (c[order], v[order])
        found = [(i, c, s) for i, t in zip(ids, top) if t is not None for c, s in zip(*t)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "chunk_id", "score"])

    return rows


def regex_terms(query: str) -> list[str]:
    """Words of two signs or more, in lower case."""
    import re

    return [t.lower() for t in re.findall(r"[A-Za-z0-9_-]{2,}", query)]


def layered(facts: DataFrame, fallback: DataFrame, query: str) -> DataFrame:
    """Facts by how often they have the query's terms; if there are none at all, the fallback so.

    Both have id, text and date. The layer with results is found by one aggregate, not collected.
    """
    def scored(df: DataFrame, layer: int) -> DataFrame:
        low, total = F.lower("text"), F.lit(0)
        for t in regex_terms(query):
            total = total + occurrences(low, F.lit(t))
        return df.select("id", "text", "date", F.lit(layer).alias("layer"), total.alias("score")).filter("score > 0")

    both = scored(facts, 1).unionByName(scored(fallback, 2))
    first = both.agg(F.min("layer").alias("_first"))
    return both.join(F.broadcast(first), F.col("layer") == F.col("_first")).drop("_first")


def query_words(query: str, mode: str = "and") -> list[str]:
    """The different words of a query, each of ASCII letters and digits; where any of them will do, 'or' is none."""
    return sorted({w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in query.lower()).split() if mode == "and" or w != "or"})


def word_weight(items: int, having: int) -> float:
    """The weight of a word that so many of the items have."""
    return max(LEAST_IDF, math.log((items - having + 0.5) / (having + 0.5)))


def full_text(items: DataFrame, query: str, columns: list[str], mode: str = "and", limit: int = 20, keep: Column | None = None, conversations: DataFrame | None = None) -> DataFrame:
    """id and rank (negative, best first) of the items that have all or any of the query's words, by BM25.

    An item's words are those of all columns. Only their counts are gathered, in one row, over all items;
    keep then says which are wanted. With conversations (conversation_id, title, created_at), items have
    conversation_title and created_at, and those of no conversation are left out.

    This reads the texts of all items, once; postings.full_text() does the same from an index.
    """
    words = query_words(query, mode)
    carried = ["source_conversation_id"] if conversations is not None else []
    # An array of one, taken apart, is a value that later steps cannot put in their places and work out again.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    low = items.select("id", *carried, (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("_keep"), once(F.lower(F.concat_ws(" ", *[F.col(c) for c in columns])), "_low"))
    # Words are counted where they stand: no text is cut into an array.
    times = [F.when(F.contains("_low", F.lit(w)), F.regexp_count("_low", F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))).otherwise(0) for w in words]
    counts = low.select("id", *carried, "_keep", F.regexp_count("_low", F.lit("[a-z0-9]+")).alias("_len"), F.array(*times).cast("array<int>").alias("_tf"))
    path = scratch(items.sparkSession, "counts")
    counts.write.parquet(path)
    base = items.sparkSession.read.schema(counts.schema).parquet(path)
    n = base.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.get("_tf", F.lit(k)) > 0).alias(f"_d{k}") for k in range(len(words))]).first()
    has, rank = F.lit(mode == "and" and bool(words)), F.lit(0.0)
    for k in range(len(words)):
        tf = F.get("_tf", F.lit(k))
        has = has & (tf > 0) if mode == "and" else has | (tf > 0)
        rank = rank - word_weight(n["_n"], n[f"_d{k}"]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(n["_avg"] or 1.0)))
    found = base.filter(has & F.col("_keep")).select("id", *carried, F.round(rank, 12).alias("rank"))
    if conversations is not None:
        c = conversations.select(F.col("conversation_id").alias("source_conversation_id"), F.col("title").alias("conversation_title"), "created_at")
        found = found.join(c, "source_conversation_id")
    return found.orderBy("rank", "id").limit(limit)


#: Columns of knowledge items that full-text search looks at.
ITEM_COLUMNS = ["project_slug", "category", "title", "statement", "evidence"]


def search_items(items: DataFrame, conversations: DataFrame, query: str, project: str | None = None, category: str | None = None, limit: int = 20, mode: str = "and") -> DataFrame:
    """full_text() over knowledge items and their conversations, for a project (a slug) and a category where they are named."""
    keep = F.lit(True)
    for name, value in (("project_slug", project), ("category", category)):
        if value is not None:
            keep = keep & (F.col(name) == value)
    return full_text(items, query, ITEM_COLUMNS, mode, limit, keep, conversations)


def like(items: DataFrame, needle: str, project: str | None = None, category: str | None = None, limit: int = 20) -> DataFrame:
    """Items whose statement or evidence has needle, whatever the case, newest first."""
    pattern = f"%{needle}%"
    keep = F.col("statement").ilike(pattern) | F.col("evidence").ilike(pattern)
    for name, value in (("project", project), ("category", category)):
        if value is not None:
            keep = keep & (F.col(name) == value)
    return items.filter(keep).orderBy(F.desc("created_at"), "id").limit(limit)


#: Words of an error search.
ERROR_WORDS = "error OR failure OR failed OR bug OR broken OR issue"


def errors(items: DataFrame, conversations: DataFrame, words: str = ERROR_WORDS, project: str | None = None, category: str = "error", limit: int = 50) -> DataFrame:
    """Items of the error category with any of words; none where it has none of them."""
    return search_items(items, conversations, words, project, category, limit, "or")


def resolve(names: DataFrame, projects: DataFrame) -> DataFrame:
    """names (name) with slug: that of the project with this slug or name, whatever the case, or the name itself."""
    p = projects.select(F.explode(F.array_distinct(F.array(F.lower("name"), F.col("slug")))).alias("_k"), F.col("slug").alias("_slug")).groupBy("_k").agg(F.min("_slug").alias("_slug"))
    return names.join(p, (F.lower(names["name"]) == F.col("_k")), "left").select(*names.columns, F.coalesce("_slug", "name").alias("slug"))


def chat_chunks(chunks: DataFrame, conversations: DataFrame, scheme: str = "chatgpt") -> DataFrame:
    """Chunks (conversation_id, first_message, last_message, text, embedding) of known conversations as search takes
    them: with the address of their messages, a title (the id where there is none), date, file and range."""
    c = conversations.select("conversation_id", F.col("title").alias("_title"), F.col("created_at").alias("date"), "source_file")
    span = F.concat(F.col("first_message").cast("string"), F.lit("-"), F.col("last_message").cast("string"))
    cid = F.col("conversation_id").cast("string")
    return chunks.join(c, "conversation_id").select(
        F.lit("chat").alias("source_type"), F.concat(F.lit(f"{scheme}://conversation/"), cid, F.lit("#messages="), span).alias("source"),
        F.coalesce(F.nullif("_title", F.lit("")), cid).alias("title"), "text", "embedding", "conversation_id", "date", "source_file", span.alias("message_range"),
    )


def titled_assets(chunks: DataFrame, assets: DataFrame, references: DataFrame) -> DataFrame:
    """Asset chunks with a title: the first original name of the asset, or else its file name."""
    first = references.filter("original_name is not null").groupBy("asset_id").agg(F.min_by("original_name", "seq").alias("_name"))
    out = chunks.join(assets.select("asset_id", "mime", "ext"), "asset_id").join(first, "asset_id", "left")
    return out.withColumn("title", F.coalesce("_name", F.concat(F.lit("file_"), "asset_id", "ext"))).drop("_name")
