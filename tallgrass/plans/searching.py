"""Queries for search, imports and the embedding index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import archive, embed, postings, search
from tallgrass.sources import ranged, tables
from tallgrass.sources.scratch import scratch

from .knowledge import FACTS, SLUG, facts
from .registry import query

QUERY = "The onth hein tionre of THE"
_TERMS = T.query_terms(QUERY)
_SCORE = "CAST(" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}" for w in _TERMS) + " AS INT)"


@query("SEA1_keyword_score", f"SELECT doc_id, {_SCORE} AS score FROM documents")
def keyword(t):
    return t.documents.select("doc_id", T.keyword_score(F.col("text"), QUERY).alias("score"))


_VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(64)]
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_Q = "[" + ", ".join(map(str, _VECTOR)) + "]::DOUBLE[]"
_COS = f"{_DOT.format('embedding', _Q)} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format(_Q, _Q)}))"


@query("SEA2_cosine", f"SELECT vec_id, round(CASE WHEN vec_id % 10 = 0 THEN -1 ELSE {_COS} END, 6) AS cosine FROM embeddings")
def cosine(t):
    v = F.when(F.col("vec_id") % 10 != 0, F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(search.cosine(v, search.vector(_VECTOR)), 6).alias("cosine"))


_CHUNKS = """chunks AS (SELECT 'notes' AS source, 0 AS source_rank, doc_id AS chunk_id, text, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id
    UNION ALL SELECT 'chats', 1, conv_id * 100 + turn, text, NULL FROM conversations UNION ALL SELECT 'assets', 2, item_id, text, NULL FROM benchmark)"""


def _chunks(t):
    notes = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(F.lit("notes").alias("source"), F.lit(0).alias("source_rank"), F.col("doc_id").alias("chunk_id"), "text", "embedding")
    chats = t.conversations.select(F.lit("chats").alias("source"), F.lit(1).alias("source_rank"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "text")
    assets = t.benchmark.select(F.lit("assets").alias("source"), F.lit(2).alias("source_rank"), F.col("item_id").alias("chunk_id"), "text")
    return notes.unionByName(chats, allowMissingColumns=True).unionByName(assets, allowMissingColumns=True)


@query("SEA3_hybrid_search", f"WITH {_CHUNKS} SELECT source, chunk_id, round(score, 6) AS score, substring(replace(text, chr(10), ' '), 1, 900) AS excerpt FROM (SELECT *, {_SCORE} + CASE WHEN embedding IS NULL THEN 0 ELSE greatest(0, 10 * ({_COS})) END AS score FROM chunks) WHERE score > 0 ORDER BY score DESC, source_rank, chunk_id LIMIT 8")
def hybrid(t):
    return search.search(_chunks(t), QUERY, _VECTOR).select("source", "chunk_id", F.round("score", 6).alias("score"), T.excerpt(F.col("text")).alias("excerpt"))


@query("SEA4_asset_titles", "SELECT c.chunk_id, c.asset_id, a.mime, coalesce((SELECT arg_min(r.name, r.seq) FROM (SELECT 'a' || event_id % (SELECT count(*) FROM part) AS asset_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'n' || event_id END AS name FROM events WHERE event_type = 'view') r WHERE r.asset_id = c.asset_id AND r.name IS NOT NULL), 'file_' || c.asset_id || '.png') AS title FROM (SELECT doc_id AS chunk_id, 'a' || doc_id % (SELECT count(*) FROM part) AS asset_id FROM documents) c JOIN (SELECT 'a' || p_partkey AS asset_id, p_type AS mime FROM part) a ON a.asset_id = c.asset_id")
def asset_titles(t):
    a = lambda c: F.concat(F.lit("a"), c.cast("string")).alias("asset_id")
    n = F.lit(t.part.count())
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), a(F.col("doc_id") % n))
    refs = t.events.filter("event_type = 'view'").select(a(F.col("event_id") % n), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("original_name"))
    return search.titled_assets(chunks, t.part.select(a(F.col("p_partkey")), F.col("p_type").alias("mime"), F.lit(".png").alias("ext")), refs).select("chunk_id", "asset_id", "mime", "title")


@query("SEA4_chat_chunks", "SELECT 'chat' AS source_type, 'chatgpt://conversation/' || conv_id || '#messages=' || turn || '-' || (turn + 1) AS source, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR ELSE 't' || conv_id END AS title, text, conv_id AS conversation_id, 'd' || conv_id % 9 AS date, 'f' || conv_id % 5 AS source_file, turn || '-' || (turn + 1) AS message_range FROM conversations WHERE conv_id % 4 > 0")
def chat_chunks(t):
    k = F.col("conv_id")
    chunks = t.conversations.select(k.alias("conversation_id"), F.col("turn").alias("first_message"), (F.col("turn") + 1).alias("last_message"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    title = F.when(k % 3 == 0, F.when(k % 2 == 0, "").otherwise(F.lit(None))).otherwise(F.concat(F.lit("t"), k))
    known = t.conversations.filter("conv_id % 4 > 0").select("conv_id").distinct().select(k.alias("conversation_id"), title.alias("title"), F.concat(F.lit("d"), k % 9).alias("created_at"), F.concat(F.lit("f"), k % 5).alias("source_file"))
    return search.chat_chunks(chunks, known).drop("embedding")


@query("SEA5_batch_search", f"""SELECT query_id, chunk_id, place FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id,
    {_DOT.format('e.embedding', 'q.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE place <= 8""")
def batch(t):
    q = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.search_many(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), q).select("query_id", "chunk_id", "place")


_TEXTS = "CAST(" + " + ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{w}', ''))) / {len(w)}" for w in search.regex_terms("Thatth onhe zz")) + " AS INT)"


@query("SEA6_layered_search", f"WITH {FACTS}, s AS (SELECT id, statement AS text, source_date AS date, 1 AS layer, {_TEXTS.format('statement')} AS score FROM facts UNION ALL SELECT conv_id * 100 + turn, text, role, 2, {_TEXTS.format('text')} FROM conversations) SELECT * FROM s WHERE score > 0 AND layer = (SELECT min(layer) FROM s WHERE score > 0)")
def layered(t):
    f = facts(t).select("id", F.col("statement").alias("text"), F.col("source_date").alias("date"))
    c = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.col("role").alias("date"))
    return search.layered(f, c, "Thatth onhe zz")


def _bm25(words, join, keep, limit):
    w = ", ".join(f"('{x}')" for x in words)
    return f"""WITH {FACTS}, base AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', {SLUG('project')}, category, '', statement, evidence)), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM facts), q(w) AS (VALUES {w}),
        tf AS (SELECT id, len(t) AS n, w, len(list_filter(t, lambda x: x = w)) AS tf FROM base, q), s AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM base), df AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY w)
        SELECT id, round(-sum(greatest(1e-6, ln((total - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 12) AS rank FROM tf JOIN df USING (w), s WHERE id IN (SELECT id FROM facts WHERE {keep}) GROUP BY id HAVING {join} ORDER BY rank, id LIMIT {limit}"""


#: Conversations that facts are from: some are missing.
_CONVERSATIONS = "SELECT DISTINCT 'c' || conv_id AS conversation_id, 't' || conv_id AS conversation_title, conv_id AS created_at FROM conversations WHERE conv_id % 3 > 0"


def _conversations(t):
    c = t.conversations.filter("conv_id % 3 > 0").select("conv_id").distinct()
    return c.select(F.concat(F.lit("c"), "conv_id").alias("conversation_id"), F.concat(F.lit("t"), "conv_id").alias("title"), F.col("conv_id").alias("created_at"))


def _found(words, join, keep, limit):
    """_bm25() with the conversation of each item."""
    return f"SELECT id, round(rank, 6) AS rank, conversation_title, created_at FROM ({_bm25(words, join, keep + f' AND source_conversation_id IN (SELECT conversation_id FROM ({_CONVERSATIONS}))', limit)}) r JOIN (SELECT id, source_conversation_id AS conversation_id FROM {'(WITH ' + FACTS + ' SELECT * FROM facts)'}) USING (id) JOIN ({_CONVERSATIONS}) USING (conversation_id)"


def _searchable(t):
    return facts(t).withColumns({"project_slug": T.slugify(F.col("project")), "title": F.lit("")})


@query("SEA7_full_text", f'SELECT id, round(rank, 6) AS rank FROM ({_bm25(("of", "the"), "count(*) FILTER (tf > 0) = 2", "true", 20)})')
def full_text(t):
    return search.full_text(_searchable(t), "The of", search.ITEM_COLUMNS).select("id", F.round("rank", 6).alias("rank"))


@query("SEA7_filtered", _found(("of", "the"), "count(*) FILTER (tf > 0) = 2", f"category = 'workflow' AND {SLUG('project')} = 'src11'", 20))
def filtered(t):
    return search.search_items(_searchable(t), _conversations(t), "The of", "src11", "workflow").select("id", F.round("rank", 6).alias("rank"), "conversation_title", "created_at")


def _index(t):
    """An index of all facts that came in two batches."""
    folder = scratch(t.spark, "postings")
    for half in (0, 1):
        postings.add_segment(_searchable(t).filter(F.pmod(F.xxhash64("source_conversation_id"), F.lit(2)) == half), folder)
    return postings.read(t.spark, folder)


@query("SEA7_indexed", f'SELECT id, round(rank, 6) AS rank FROM ({_bm25(("of", "the"), "count(*) FILTER (tf > 0) = 2", "true", 20)})')
def indexed(t):
    return postings.full_text(_index(t), "The of").select("id", F.round("rank", 6).alias("rank"))


@query("SEA8_like", f"WITH {FACTS} SELECT id, statement FROM facts WHERE (statement ILIKE '%E_a%' OR evidence ILIKE '%E_a%') AND category = 'workflow' ORDER BY CAST(source_date AS BIGINT) DESC, id LIMIT 20")
def like(t):
    return search.like(facts(t).withColumn("created_at", F.col("source_date").cast("long")), "E_a", category="workflow").select("id", "statement")


@query("SEA9_errors", _found(("en", "of", "the"), "count(*) FILTER (tf > 0) > 0", "category = 'error'", 50))
def errors(t):
    return search.errors(_searchable(t), _conversations(t), "the OR of OR en").select("id", F.round("rank", 6).alias("rank"), "conversation_title", "created_at")


@query("SEA9_indexed", _found(("en", "of", "the"), "count(*) FILTER (tf > 0) > 0", "category = 'error'", 50))
def indexed_errors(t):
    found = postings.search_items(_index(t), _searchable(t), _conversations(t), "the OR of OR en", category="error", limit=50, mode="or")
    return found.select("id", F.round("rank", 6).alias("rank"), "conversation_title", "created_at")


@query("SEA10_resolve", f"WITH p AS (SELECT DISTINCT source AS name, {SLUG('source')} || '-x' AS slug FROM documents), n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SRC' || p_partkey % 30 WHEN 1 THEN 'src' || p_partkey % 30 || '-x' ELSE p_name END AS name FROM part) SELECT p_partkey, n.name, coalesce(p.slug, n.name) AS slug FROM n LEFT JOIN p ON lower(n.name) = lower(p.name) OR lower(n.name) = p.slug")
def resolve(t):
    p = t.documents.select(F.col("source").alias("name"), F.concat(T.slugify(F.col("source")), F.lit("-x")).alias("slug")).distinct()
    k = F.col("p_partkey")
    n = t.part.select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit("SRC"), k % 30)).when(k % 3 == 1, F.concat(F.lit("src"), k % 30, F.lit("-x"))).otherwise(F.col("p_name")).alias("name"))
    return search.resolve(n, p)


@query("SEA11_excerpt", "SELECT doc_id, substring(replace(text, chr(10), ' '), 1, 900) AS excerpt FROM documents")
def excerpt(t):
    return t.documents.select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


# Imports: the stored side is made from the same table, with other ids and other texts.
_RAW = "CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE text END"
STORED = f"""stored AS (SELECT doc_id AS conversation_id, 't' || doc_id % 5 AS title, n_chars AS created_at, n_chars + 1 AS updated_at, 'old.json' AS source_file, {_RAW} AS raw_json, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE md5({_RAW}) END AS digest, CASE WHEN doc_id % 6 = 0 THEN 'v0' ELSE 'analysis-v1' END AS hash_version,
    CAST(doc_id % 120 AS INT) AS priority, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' ELSE 'pending' END AS state, CAST(doc_id % 4 AS INT) AS attempts, CASE WHEN doc_id % 9 = 0 THEN 'e' END AS last_error, CASE WHEN doc_id % 4 < 2 THEN 'then' END AS claimed_at, CASE WHEN doc_id % 4 = 0 THEN 'later' END AS processed_at FROM documents WHERE doc_id % 10 <> 3)"""
INCOMING = "incoming AS (SELECT doc_id AS conversation_id, source AS title, n_chars + 2 AS created_at, n_chars + 3 AS updated_at, 'new.json' AS source_file, text AS raw_json, md5(text) AS digest, 'analysis-v1' AS hash_version, CAST(doc_id % 77 AS INT) AS priority FROM documents WHERE doc_id % 10 <> 5)"
CHANGES = "changes AS (SELECT i.*, CASE WHEN s.conversation_id IS NULL THEN 'added' WHEN CASE WHEN s.hash_version = 'analysis-v1' THEN s.digest ELSE md5(s.raw_json) END = i.digest THEN 'unchanged' ELSE 'updated' END AS change FROM incoming i LEFT JOIN stored s USING (conversation_id))"


def _again():
    """The digest of stored rows made anew."""
    return F.md5("raw_json")


def _stored(t):
    k = F.col("doc_id")
    raw = F.when(k % 7 == 0, "edited").otherwise(F.col("text"))
    state = F.when(k % 4 == 0, "done").when(k % 4 == 1, "processing").otherwise("pending")
    return t.documents.filter("doc_id % 10 <> 3").select(
        k.alias("conversation_id"), F.concat(F.lit("t"), k % 5).alias("title"), F.col("n_chars").alias("created_at"), (F.col("n_chars") + 1).alias("updated_at"), F.lit("old.json").alias("source_file"), raw.alias("raw_json"),
        F.when(k % 6 == 0, "x").otherwise(F.md5(raw)).alias("digest"), F.when(k % 6 == 0, "v0").otherwise(archive.HASH_VERSION).alias("hash_version"), (k % 120).cast("int").alias("priority"), state.alias("state"), (k % 4).cast("int").alias("attempts"),
        F.when(k % 9 == 0, "e").alias("last_error"), F.when(k % 4 < 2, "then").alias("claimed_at"), F.when(k % 4 == 0, "later").alias("processed_at"),
    )


def _incoming(t):
    return t.documents.filter("doc_id % 10 <> 5").select(
        F.col("doc_id").alias("conversation_id"), F.col("source").alias("title"), (F.col("n_chars") + 2).alias("created_at"), (F.col("n_chars") + 3).alias("updated_at"), F.lit("new.json").alias("source_file"), F.col("text").alias("raw_json"),
        F.md5("text").alias("digest"), F.lit(archive.HASH_VERSION).alias("hash_version"), (F.col("doc_id") % 77).cast("int").alias("priority"),
    )


@query("ARC5_digest", """SELECT conv_id, sha256('{"title":"t' || conv_id || '","messages":[' || string_agg('{"pos":' || turn || ',"role":"' || role || '","text":' || to_json(text) || '}', ',' ORDER BY turn) || ']}') AS digest FROM conversations GROUP BY conv_id""")
def digest(t):
    m = archive.as_messages(t.conversations, "conv_id")
    return m.select(F.col("conversation_id").alias("conv_id"), archive.digest(F.concat(F.lit("t"), "conversation_id"), F.col("messages")).alias("digest"))


@query("ARC6_import_diff", f"WITH {STORED}, {INCOMING}, {CHANGES} SELECT change, count(*) AS n FROM changes GROUP BY change")
def import_diff(t):
    return archive.diff(_incoming(t), _stored(t), again=_again()).groupBy("change").agg(F.count("*").alias("n"))


_SAME = "c.change IS NULL OR c.change = 'unchanged'"
_TAKEN = ", ".join(f"coalesce(c.{x}, s.{x}) AS {x}" for x in ("conversation_id", "title", "created_at", "updated_at", "source_file", "raw_json", "digest", "hash_version", "priority"))
_KEPT = ", ".join(f"CASE WHEN {_SAME} THEN s.{x} ELSE {start} END AS {x}" for x, start in (("state", "'pending'"), ("attempts", "0"), ("last_error", "NULL"), ("claimed_at", "NULL"), ("processed_at", "NULL")))


@query("ARC7_merge", f"WITH {STORED}, {INCOMING}, {CHANGES} SELECT {_TAKEN}, {_KEPT} FROM changes c FULL JOIN stored s ON c.conversation_id = s.conversation_id")
def merge(t):
    return archive.merge(_incoming(t), _stored(t), again=_again())


@query("ARC8_invalidate", f"WITH {STORED}, {INCOMING}, {CHANGES} SELECT doc_id AS conversation_id, quality FROM labels WHERE doc_id NOT IN (SELECT conversation_id FROM changes WHERE change = 'updated')")
def invalidate(t):
    return archive.invalidate(t.labels.select(F.col("doc_id").alias("conversation_id"), "quality"), archive.diff(_incoming(t), _stored(t), again=_again()))


@query("ARC9_insert_or_ignore", f"WITH {STORED} SELECT c AS conversation_id, min(turn) AS turn FROM (SELECT conv_id + 900 AS c, turn FROM conversations) WHERE c NOT IN (SELECT conversation_id FROM stored) GROUP BY c")
def ignore(t):
    new = t.conversations.select((F.col("conv_id") + 900).alias("conversation_id"), "turn")
    return archive.insert_or_ignore(new, _stored(t), "conversation_id", F.col("turn"))


@query("ARC9_priority", f"WITH {STORED} SELECT conversation_id, CASE WHEN state = 'pending' AND p IS NOT NULL THEN p ELSE priority END AS priority FROM stored LEFT JOIN (SELECT conv_id, CAST(max(turn) + 500 AS INT) AS p FROM conversations GROUP BY conv_id) ON conv_id = conversation_id")
def priority(t):
    new = t.conversations.select(F.col("conv_id").alias("conversation_id"), (F.col("turn") + 500).alias("priority"))
    return archive.with_new_priority(_stored(t), new).select("conversation_id", "priority")


@query("ARC10_candidates", "SELECT d.doc_id, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND d.doc_id % 6 <> 0 ORDER BY n_chars, d.doc_id LIMIT 25")
def candidates(t):
    labelled = t.documents.join(t.labels.filter("quality = 1"), "doc_id")
    done = t.labels.filter("doc_id % 6 = 0")
    return archive.without_done(labelled, done, "doc_id").orderBy("n_chars", "doc_id").limit(25).select("doc_id", "n_chars")


@query("ARC11_resume", "SELECT conv_id, turn FROM conversations EXCEPT SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 3 = 0")
def resume(t):
    done = t.conversations.filter("(conv_id + turn) % 3 = 0")
    return archive.without_done(t.conversations, done, "conv_id", "turn").select("conv_id", "turn").distinct()


@query("ARC12_with_label", "SELECT d.doc_id, coalesce('q' || quality, 'UNCLASSIFIED') AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def with_label(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("q"), "quality"), F.lit("UNCLASSIFIED")).alias("label"))


@query("ARC13_next_batch", f"WITH {STORED} SELECT conversation_id, priority FROM stored WHERE state = 'pending' ORDER BY priority DESC, created_at, conversation_id LIMIT 100")
def next_batch(t):
    return archive.next_batch(_stored(t), 100).select("conversation_id", "priority")


@query("ARC14_retry", f"""WITH {STORED}, outcome AS (SELECT doc_id AS conversation_id, quality = 1 AS ok, 'bad ' || toxic AS error FROM labels WHERE doc_id % 4 = 1)
    SELECT s.conversation_id, CASE WHEN ok THEN 'done' WHEN NOT ok THEN CASE WHEN attempts + 1 >= 3 THEN 'quarantined' ELSE 'pending' END WHEN state = 'processing' THEN 'pending' ELSE state END AS state, attempts + CASE WHEN ok IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN ok THEN NULL ELSE error END AS last_error FROM stored s LEFT JOIN outcome o ON s.conversation_id = o.conversation_id""")
def retry(t):
    outcome = t.labels.filter("doc_id % 4 = 1").select(F.col("doc_id").alias("conversation_id"), (F.col("quality") == 1).alias("ok"), F.concat(F.lit("bad "), "toxic").alias("error"))
    return archive.after_outcome(_stored(t), outcome)


@query("SNK1_upsert", f"WITH {STORED}, {INCOMING} SELECT conversation_id, title, digest FROM incoming UNION ALL SELECT conversation_id, title, digest FROM stored WHERE conversation_id NOT IN (SELECT conversation_id FROM incoming)")
def upsert(t):
    return tables.upserted(_stored(t).select("conversation_id", "title", "digest"), _incoming(t).select("conversation_id", "title", "digest"), "conversation_id")


_NEAR = "o_orderkey BETWEEN (SELECT max(o_orderkey) FROM orders) // 5 * 2 AND (SELECT max(o_orderkey) FROM orders) // 5 * 2 + (SELECT max(o_orderkey) FROM orders) // 100"


@query("SNK1_merged_files", f"SELECT o_orderkey, CASE WHEN {_NEAR} THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN {_NEAR} THEN 2 ELSE 0 END AS seq FROM orders WHERE o_orderkey IS NOT NULL")
def merged_files(t):
    """One per cent of the orders, those of a range of keys, change twice in a table of fifty files or more."""
    rows = t.orders.select("o_orderkey", "o_totalprice", F.lit(0).alias("seq"))
    n, top = rows.agg(F.count("*"), F.max("o_orderkey")).first()
    store = ranged.Ranged(t.spark, scratch(t.spark, "ranged"), "o_orderkey", "seq", min(ranged.FILE_ROWS, n // 50 + 1))
    store.merge(rows)
    near = rows.filter(F.col("o_orderkey").between(top // 5 * 2, top // 5 * 2 + top // 100)) if top is not None else rows.limit(0)
    again = F.explode(F.array(F.lit(2), F.lit(1)))
    store.merge(near.withColumn("seq", again).withColumn("o_totalprice", F.col("o_totalprice") + F.col("seq")))
    held = store.read()
    return rows if held is None else held.select(*rows.columns)


@query("FIL3_inventory_upsert", "SELECT p_brand AS path, max_by(p_name, p_partkey) AS name, max(p_partkey) AS seen FROM part GROUP BY p_brand")
def inventory(t):
    rows = t.part.select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seen"))
    return tables.upserted(rows.filter("seen % 2 = 0"), rows.filter("seen % 2 = 1"), "path", "seen")


@query("WEB4_pages_upsert", "SELECT url, max(page_id) AS page_id FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id FROM pages) GROUP BY url")
def pages(t):
    rows = t.pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id")
    return tables.upserted(rows.filter("page_id % 2 = 0"), rows.filter("page_id % 2 = 1"), "url", "page_id")


_NEW = "new AS (SELECT conv_id AS source_id, turn AS chunk_index, CASE WHEN turn > 3 THEN 'again' ELSE text END AS text, sha256(conv_id || chr(0) || CASE WHEN turn > 3 THEN 'again' ELSE text END) AS chunk_hash FROM conversations)"
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_hash ORDER BY chunk_index DESC) AS n FROM new) WHERE n = 1)"
_OLD = "old AS (SELECT source_id, chunk_index + 90 AS chunk_index, chunk_hash, CASE WHEN chunk_index % 3 < 2 THEN 'm1' ELSE 'm2' END AS embedding_model, CASE WHEN source_id % 5 > 0 THEN chunk_index * 1.0 END AS v FROM last WHERE source_id % 2 = 0)"


def _new(t):
    text = F.when(F.col("turn") > 3, "again").otherwise(F.col("text"))
    c = t.conversations.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk_index"), text.alias("text"))
    return embed.last_of_hash(c.withColumn("chunk_hash", embed.asset_hash(F.col("source_id"), F.col("text"))))


def _old(t):
    n = _new(t).filter("source_id % 2 = 0")
    model = F.when(F.col("chunk_index") % 3 < 2, "m1").otherwise("m2")
    return n.select("source_id", (F.col("chunk_index") + 90).alias("chunk_index"), "chunk_hash", model.alias("embedding_model"), F.when(F.col("source_id") % 5 > 0, F.array(F.col("chunk_index").cast("float"))).alias("embedding"))


@query("EMB2_reuse", f"WITH {_NEW}, {_LAST}, {_OLD} SELECT l.source_id, l.chunk_index, coalesce(o.v IS NOT NULL AND o.embedding_model = 'm1', false) AS reused, CASE WHEN o.embedding_model = 'm1' THEN o.v END AS v FROM last l LEFT JOIN old o ON l.chunk_hash = o.chunk_hash AND o.v IS NOT NULL")
def reuse(t):
    return embed.reuse(_new(t), _old(t), "m1").select("source_id", "chunk_index", F.coalesce("reused", F.lit(False)).alias("reused"), F.get("embedding", F.lit(0)).cast("double").alias("v"))


@query("EMB2_reuse_stored", f"WITH {_NEW}, {_LAST}, {_OLD} SELECT l.source_id, l.chunk_index, coalesce(o.v IS NOT NULL AND o.embedding_model = 'm1', false) AS reused, CASE WHEN o.embedding_model = 'm1' THEN o.v END AS v FROM last l LEFT JOIN old o ON l.chunk_hash = o.chunk_hash AND o.v IS NOT NULL")
def reuse_stored(t):
    """As EMB2_reuse, from an index that lies in files: vectors are fetched by their places."""
    folder = scratch(t.spark, "index")
    _old(t).write.parquet(folder)
    stored = embed.stored_vectors(t.spark, folder)
    return embed.fetched(embed.located(_new(t), stored, "m1"), stored).select("source_id", "chunk_index", "reused", F.get("embedding", F.lit(0)).cast("double").alias("v"))


@query("EMB2_reuse_without_model", f"WITH {_NEW}, {_LAST}, {_OLD} SELECT l.source_id, l.chunk_index, o.v IS NOT NULL AS reused FROM last l LEFT JOIN old o ON l.chunk_hash = o.chunk_hash")
def reuse_off(t):
    return embed.reuse(_new(t), _old(t), "m1", embedding_on=False).select("source_id", "chunk_index", F.coalesce("reused", F.lit(False)).alias("reused"))


@query("EMB3_last_of_hash", f"WITH {_NEW}, {_LAST} SELECT source_id, chunk_index FROM last")
def last_of_hash(t):
    return _new(t).select("source_id", "chunk_index")


@query("EMB4_replace_sources", f"WITH {_NEW}, {_LAST}, {_OLD} SELECT source_id, chunk_index, chunk_hash FROM last WHERE source_id % 8 = 0 UNION ALL SELECT source_id, chunk_index, chunk_hash FROM old WHERE source_id % 4 <> 0")
def replace(t):
    return embed.replace_sources(_new(t).filter("source_id % 8 = 0"), _old(t), touched=_new(t).filter("source_id % 4 = 0")).select("source_id", "chunk_index", "chunk_hash")


@query("EMB5_embed")
def embedded(t):
    return embed.embedded(t.documents.select("doc_id", "text"), "text", embed.hashing_embedder()).select("doc_id", "embedding")


@query("EMB6_keep_vector", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN embedding END ELSE [0.5::FLOAT] END AS embedding FROM embeddings")
def keep_vector(t):
    new = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.array(F.lit(0.5).cast("float"))).alias("embedding"))
    old = t.embeddings.filter("vec_id % 2 = 0").select("vec_id", "embedding")
    return embed.keep_vector(new, old, "vec_id")


@query("EMB7_metrics", f"WITH {_NEW}, {_LAST}, {_OLD}, j AS (SELECT l.*, o.v, o.embedding_model = 'm1' AS same FROM last l LEFT JOIN old o ON l.chunk_hash = o.chunk_hash AND o.v IS NOT NULL) SELECT count(DISTINCT source_id) AS conversations, count(*) AS chunks, 0 AS embedded, count(*) FILTER (same) AS reused, count(*) FILTER (same) AS vectors FROM j")
def metrics(t):
    return embed.metrics(embed.reuse(_new(t), _old(t), "m1").withColumn("reused", F.coalesce("reused", F.lit(False))))


def _tree(t):
    """Conversations as trees: each turn is the child of the one before, and one branch was given up."""
    node = lambda n: F.concat(F.lit("n"), n.cast("string"))
    main = t.conversations.select("conv_id", F.struct(node(F.col("turn")).alias("node_id"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent"), "role", "text", F.lit("").alias("created_at")).alias("n"))
    lost = t.conversations.filter("turn = 1").select("conv_id", F.struct(F.lit("x").alias("node_id"), F.lit("n0").alias("parent"), "role", F.lit("given up").alias("text"), F.lit("").alias("created_at")).alias("n"))
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    nodes = main.unionByName(lost).groupBy("conv_id").agg(F.collect_list("n").alias("nodes")).join(last, "conv_id")
    return nodes.select(F.col("conv_id").alias("conversation_id"), node(F.col("last")).alias("current_node"), "nodes")


@query("ARC1_active_branch", "SELECT conv_id, string_agg('[' || role || '] ' || trim(text), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def active_branch(t):
    return archive.flatten(_tree(t)).select(F.col("conversation_id").alias("conv_id"), archive.transcript(F.col("messages")).alias("transcript"))


@query("ARC2_parts", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || chr(10) || text ELSE role END AS text FROM conversations")
def parts(t):
    as_text, obj = lambda c: F.to_json(F.array(c)), lambda c: F.to_json(F.array(F.struct(c.alias("text"))))
    j = F.when(F.col("turn") % 3 == 0, as_text(F.col("text"))).when(F.col("turn") % 3 == 1, F.to_json(F.array("role", F.lit(""), "text"))).otherwise(obj(F.col("role")))
    return t.conversations.select("conv_id", "turn", archive.text_of_parts(F.parse_json(j).cast("array<variant>")).alias("text"))
