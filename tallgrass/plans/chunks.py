"""Queries for transcripts, chunks, scalar functions and note text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import archive, chunking, embed

from .registry import query

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("CHK1_fixed_windows", "SELECT doc_id, k AS chunk_index, substring(text, CAST(k * 1000 + 1 AS BIGINT), 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS k FROM documents)")
def fixed(t):
    return t.documents.select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"), 1000)).alias("chunk_index", "chunk"))


_OVERLAP = """
    WITH d AS (SELECT doc_id, {text} AS t FROM documents),
    w AS (SELECT doc_id, unnest(CASE WHEN length(t) <= 2400 THEN [{whole}] ELSE list_transform(range(0, length(t), 2100), lambda s: {part}) END) AS chunk, unnest(range(CASE WHEN length(t) <= 2400 THEN 1 ELSE CAST(ceil(length(t) / 2100.0) AS BIGINT) END)) AS k FROM d)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, chunk FROM w WHERE chunk <> ''"""


@query("CHK2_overlap_chunks", _OVERLAP.format(text=TRIM.format("text"), whole=TRIM.format("t"), part=TRIM.format("substring(t, s + 1, 2400)")))
def overlap(t):
    return t.documents.select("doc_id", F.posexplode(chunking.overlapping(F.col("text"))).alias("chunk_index", "chunk"))


@query("CHK3_note_chunks", _OVERLAP.format(text="substring(text, 1, 60000)", whole=TRIM.format("t"), part=TRIM.format("substring(t, s + 1, 2400)")))
def notes(t):
    return t.documents.select("doc_id", F.posexplode(chunking.note_chunks(F.col("text"))).alias("chunk_index", "chunk"))


_PIECES = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS ps FROM documents),
    c AS (SELECT doc_id, list_transform(ps, lambda x: list_transform(range(0, length(x), 3200), lambda s: substring(x, s + 1, 3200))) AS cs FROM p WHERE len(ps) > 0),
    r AS (SELECT doc_id, list_reduce(cs, lambda a, x: CASE WHEN len(x) = 1 AND length(a[-1]) + length(x[1]) + 2 <= 3200 THEN list_append(a[1:len(a) - 1], a[-1] || chr(10) || chr(10) || x[1]) ELSE list_concat(a, x) END) AS pieces FROM c)
    SELECT doc_id, CAST(unnest(range(len(pieces))) AS INT) AS piece, unnest(pieces) AS text FROM r"""


@query("CHK4_split_message", _PIECES)
def split(t):
    return chunking.split_messages(t.documents.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")), "doc_id", "text")


@query("CHK5_chat_chunks")
def chat(t):
    return chunking.chunk_conversations(archive.as_messages(t.conversations, "conv_id"))


@query("CHK6_titles", f"SELECT page_id, substring(CASE WHEN h <> '' THEN h ELSE 'page-' || page_id END, 1, 160) AS title FROM (SELECT page_id, coalesce({TRIM.format('''regexp_replace(list_filter(string_split(replace(html, '<h1>', chr(10) || '# '), chr(10)), lambda x: starts_with(x, '#'))[1], '^[#]+', '')''')}, '') AS h FROM pages)")
def titles(t):
    text = F.replace(F.col("html"), F.lit("<h1>"), F.lit("\n# "))
    return t.pages.select("page_id", chunking.title_for(text, F.concat(F.lit("page-"), F.col("page_id").cast("string"))).alias("title"))


_MESSAGES = "SELECT conv_id, {} AS {} FROM conversations {} GROUP BY conv_id"


@query("ARC3_transcript", _MESSAGES.format("string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn)", "transcript", ""))
def transcript(t):
    return archive.as_messages(t.conversations, "conv_id").select(F.col("conversation_id").alias("conv_id"), archive.transcript(F.col("messages")).alias("transcript"))


@query("ARC4_user_text", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user_text FROM conversations GROUP BY conv_id")
def user_text(t):
    return archive.as_messages(t.conversations, "conv_id").select(F.col("conversation_id").alias("conv_id"), archive.user_text(F.col("messages")).alias("user_text"))


@query("EMB1_chunk_hashes", "SELECT conv_id, turn, sha256('c' || conv_id || chr(0) || turn || chr(0) || turn || chr(0) || text) AS chat_hash, sha256('c' || conv_id || chr(0) || text) AS asset_hash, sha256('c' || conv_id || turn || text) AS note_hash FROM conversations")
def hashes(t):
    cid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return t.conversations.select("conv_id", "turn", embed.chat_hash(cid, F.col("turn"), F.col("turn"), F.col("text")).alias("chat_hash"), embed.asset_hash(cid, F.col("text")).alias("asset_hash"), embed.note_hash(cid, F.col("turn"), F.col("text")).alias("note_hash"))


@query("FUN1_iso", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(make_timestamp(CAST(round(o_totalprice * 1000 * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN CAST(round(o_totalprice * 1000 * 1000000) AS BIGINT) % 1000000 = 0 THEN '' ELSE strftime(make_timestamp(CAST(round(o_totalprice * 1000 * 1000000) AS BIGINT)), '.%f') END || '+00:00' END AS at FROM orders")
def iso(t):
    seconds = F.when(F.col("o_orderkey") % 7 == 0, F.lit("soon")).otherwise((F.col("o_totalprice") * 1000).cast("string"))
    return t.orders.select("o_orderkey", seconds.alias("seconds")).select("o_orderkey", T.iso("seconds").alias("at"))


@query("FUN2_json_list", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_name, p_brand] ELSE [] END AS items FROM part""")
def json_list(t):
    made = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_name", "p_brand"))).when(F.col("p_partkey") % 3 == 1, F.lit("[not json")).otherwise(F.lit('{"a": 1}'))
    return t.part.select("p_partkey", T.json_list(made).alias("items"))


@query("FUN3_safe_list", f"SELECT conv_id, turn, list_transform(list_filter(list_transform(string_split(text, '.'), lambda x: {TRIM.format('x')}), lambda x: x <> '')[1:12], lambda x: substring(x, 1, 30)) AS items FROM conversations")
def safe(t):
    return t.conversations.select("conv_id", "turn", T.safe_list(F.split("text", "[.]"), size=30).alias("items"))


@query("FUN4_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || chr(10) || chr(10) || '... truncated ' || (length(text) - 200) || ' chars ...' ELSE text END AS t FROM documents")
def truncate(t):
    return t.documents.select("doc_id", T.truncate(F.col("text"), 200).alias("t"))


@query("FUN5_file_slugs", f"SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE substring(s, 1, 80) END AS slug, CASE WHEN l = '' THEN 'Lesson' ELSE replace(substring(l, 1, 80), '  ', ' ') END AS lesson FROM (SELECT doc_id, replace({TRIM.format('''regexp_replace(text, '[^a-zA-Z0-9._ -]+', '', 'g')''')}, ' ', '_') AS s, {TRIM.format('''regexp_replace(text, '[^\\p{L}\\p{N} _-]', '', 'g')''')} AS l FROM documents)")
def slugs(t):
    return t.documents.select("doc_id", T.file_slug(F.col("text")).alias("slug"), T.lesson_slug(F.col("text")).alias("lesson"))


@query("FUN6_markdown", f"SELECT doc_id, replace(replace(text, chr(10), '<br>'), '|', '\\|') AS cell, replace({TRIM.format('replace(text, chr(10), chr(32))')}, '|', '\\|') AS line FROM documents")
def markdown(t):
    return t.documents.select("doc_id", T.markdown_cell(F.col("text")).alias("cell"), T.markdown_line(F.col("text")).alias("line"))


@query("FUN7_front_matter", """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN concat_ws(chr(10), '---', 'title: "' || p_name || '"', 'audience: ' || ['AI-LEARN', 'READ-ME'][p_partkey % 3 + 1], 'tags:', '  - ' || p_brand || chr(10) || '  - ' || p_type, CASE WHEN p_size > 20 THEN 'purpose: "' || p_type || '"' END, '---') END AS block FROM part""")
def front_matter(t):
    who = F.element_at(T.lits(["AI-LEARN", "READ-ME", "NOBODY"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", T.front_matter(F.col("p_name"), who, F.array("p_brand", "p_type"), F.when(F.col("p_size") > 20, F.col("p_type"))).alias("block"))
