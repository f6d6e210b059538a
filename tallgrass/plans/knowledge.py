"""Queries for projects, knowledge items and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions.text import slugify
from tallgrass.operators import knowledge, reports

from .registry import query, spread

_CATS = [*knowledge.CATEGORY, "custom", ""]
_CAT_LIST = "[" + ", ".join(f"'{c}'" for c in _CATS) + "]"
#: Facts and analyses that the test tables stand for, in both languages.
FACTS = f"""facts AS (SELECT doc_id * 100000 + pos AS id, 'c' || (doc_id % 97) AS source_conversation_id, CASE doc_id % 5 WHEN 0 THEN upper(source) WHEN 1 THEN source || ' !' ELSE source END AS project, {_CAT_LIST}[(doc_id + pos) % 16 + 1] AS category,
    statement, evidence, CASE WHEN doc_id % 3 > 0 THEN 'current' END AS temporal_status, CASE WHEN doc_id % 7 > 0 THEN 'HIGH' END AS confidence, CAST(n_chars AS VARCHAR) AS source_date, doc_id % 2 AS rank FROM (SELECT *, unnest(range(len(l))) AS pos, unnest(l) AS statement, unnest(list_concat(l[2:], [''])) AS evidence FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)))"""
_SLUG = "CASE WHEN {0} = '' THEN 'uncategorized' ELSE substring({0}, 1, 80) END"
SLUG = lambda c: _SLUG.format(f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
ANALYSES = """analyses AS (SELECT DISTINCT 'c' || conv_id AS conversation_id, conv_id, CASE conv_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS label, CAST((conv_id % 13) / 10.0 AS DOUBLE) AS confidence, ['r1', 'r2', 'r3', 'r4'] AS reasons,
    ['src' || (conv_id % 20), 'SRC' || (conv_id % 7), 'other ' || (conv_id % 3)] AS projects FROM conversations)"""


def facts(t):
    """A fact for each line of each document, with the line after it as evidence."""
    id_, lines = F.col("doc_id"), F.split("text", "\n", -1)
    after = F.concat(F.slice(lines, 2, 1 << 30), F.array(F.lit("")))
    rows = spread(t.documents, "doc_id").select("doc_id", "source", "n_chars", F.posexplode(F.arrays_zip(lines.alias("s"), after.alias("e"))).alias("pos", "x"))
    project = F.when(id_ % 5 == 0, F.upper("source")).when(id_ % 5 == 1, F.concat("source", F.lit(" !"))).otherwise(F.col("source"))
    return rows.select(
        (id_ * 100_000 + F.col("pos")).alias("id"), F.concat(F.lit("c"), id_ % 97).alias("source_conversation_id"), project.alias("project"), F.element_at(F.array(*[F.lit(c) for c in _CATS]), ((id_ + F.col("pos")) % 16 + 1).cast("int")).alias("category"),
        F.col("x.s").alias("statement"), F.col("x.e").alias("evidence"), F.when(id_ % 3 > 0, "current").alias("temporal_status"), F.when(id_ % 7 > 0, "HIGH").alias("confidence"), F.col("n_chars").cast("string").alias("source_date"), (id_ % 2).alias("rank"),
    )


def analyses(t):
    c = F.col("conv_id")
    name = lambda p, n: F.concat(F.lit(p), (c % n).cast("string"))
    label = F.when(c % 3 == 0, "A").when(c % 3 == 1, "B").otherwise("C")
    return t.conversations.select("conv_id").distinct().select(F.concat(F.lit("c"), c.cast("string")).alias("conversation_id"), "conv_id", label.alias("label"), ((c % 13) / 10.0).alias("confidence"), F.array(*[F.lit(f"r{k}") for k in range(1, 5)]).alias("reasons"), F.array(name("src", 20), name("SRC", 7), name("other ", 3)).alias("projects"))


def _split_facts(t):
    f = facts(t)
    return f.filter("rank = 0").drop("rank"), f.filter("rank = 1").drop("rank", "temporal_status")


def _names(t):
    a = analyses(t).select(F.col("conv_id").alias("seq"), F.posexplode("projects").alias("p", "name")).select((F.col("seq") * 10 + F.col("p")).alias("seq"), "name")
    one, two = _split_facts(t)
    return knowledge.project_names(a, *[x.select(F.col("id").alias("seq"), F.col("project").alias("name")) for x in (one, two)])


@query("KNW1_slugs", f"SELECT doc_id, {SLUG('text')} AS slug FROM documents")
def slugs(t):
    return t.documents.select("doc_id", slugify(F.col("text")).alias("slug"))


_NAMES = f"""names AS (SELECT slug, arg_min(name, k) AS name FROM (SELECT {SLUG('name')} AS slug, name, (rank, seq, name) AS k FROM (
    SELECT 0 AS rank, conv_id * 10 + p AS seq, name FROM (SELECT conv_id, unnest(range(3)) AS p, unnest(projects) AS name FROM analyses) UNION ALL SELECT 1 + rank, id, project FROM facts)) GROUP BY slug)"""


@query("KNW2_project_names", f"WITH {FACTS}, {ANALYSES}, {_NAMES} SELECT slug, name FROM names")
def names(t):
    return _names(t)


_LINKS = f"links AS (SELECT DISTINCT conversation_id, {SLUG('name')} AS slug, greatest(0.05, least(1.0, confidence)) AS relevance, 'r1; r2; r3' AS rationale, 'analysis:' || lower(label) AS source FROM (SELECT *, unnest(projects) AS name FROM analyses))"


@query("KNW3_links", f"WITH {FACTS}, {ANALYSES}, {_LINKS} SELECT conversation_id, slug, CAST(relevance AS DOUBLE) AS relevance, rationale, source FROM links")
def links(t):
    return knowledge.links(analyses(t), _names(t))


_MAPPED = "CASE WHEN category = '' THEN 'fact' " + " ".join(f"WHEN category = '{a}' THEN '{b}'" for a, b in knowledge.CATEGORY.items()) + " ELSE category END"
_ITEMS = f"""items AS (SELECT id, source_conversation_id, project, cat AS category, statement, evidence, CASE WHEN rank = 0 THEN coalesce(temporal_status, 'unknown') ELSE 'unknown' END AS status, coalesce(confidence, 'UNKNOWN') AS confidence, source_date, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY source_conversation_id, project, cat, statement ORDER BY rank, id) AS n FROM (SELECT *, {_MAPPED} AS cat FROM facts)) WHERE n = 1)"""


@query("KNW4_items", f"WITH {FACTS}, {_ITEMS} SELECT id, source_conversation_id, project, category, statement, evidence, status, confidence, source_date, CAST(rank AS INT) AS rank, '' AS title, {SLUG('project')} AS project_slug FROM items")
def items(t):
    return knowledge.items(*_split_facts(t))


_STORED = "stored AS (SELECT fingerprint, source_conversation_id, slug, category, 'kept' AS title, statement, 'old' AS evidence, 'old' AS status, 'LOW' AS confidence, '0' AS source_date FROM made WHERE ord(fingerprint) % 2 = 0)"
_MADE = f"""made AS (SELECT sha256(concat_ws(chr(31), source_conversation_id, slug, category, statement)) AS fingerprint, * FROM (SELECT source_conversation_id, slug, category, '' AS title, statement, arg_max(evidence, (rank, id)) AS evidence, arg_max(status, (rank, id)) AS status, arg_max(confidence, (rank, id)) AS confidence, arg_max(source_date, (rank, id)) AS source_date
    FROM (SELECT *, {SLUG('project')} AS slug FROM items) GROUP BY source_conversation_id, slug, category, statement))"""


def _upserted(t):
    normal = knowledge.fingerprinted(*_split_facts(t))
    empty = normal.limit(0).select(F.lit("").alias("fingerprint"), "source_conversation_id", F.lit("").alias("slug"), "category", "title", "statement", "evidence", "status", "confidence", "source_date")
    made = knowledge.upsert(normal, empty)
    stored = made.filter("ascii(fingerprint) % 2 = 0").withColumns({"title": F.lit("kept"), "evidence": F.lit("old"), "status": F.lit("old"), "confidence": F.lit("LOW"), "source_date": F.lit("0")})
    gone = stored.withColumn("fingerprint", F.reverse("fingerprint"))
    return knowledge.upsert(normal, stored.unionByName(gone))


@query("KNW5_upsert", f"WITH {FACTS}, {_ITEMS}, {_MADE}, {_STORED} SELECT * REPLACE (CASE WHEN ord(fingerprint) % 2 = 0 THEN 'kept' ELSE '' END AS title) FROM made UNION ALL SELECT reverse(fingerprint), source_conversation_id, slug, category, title, statement, 'old', 'old', 'LOW', '0' FROM stored")
def upsert(t):
    return _upserted(t)


@query("KNW5_populated", f"WITH {FACTS}, {_ITEMS} SELECT count(*) AS items FROM items")
def populated(t):
    return knowledge.populated(knowledge.items(*_split_facts(t)))


@query("KNW6_project_counts", f"WITH {FACTS}, {ANALYSES}, {_NAMES}, {_LINKS}, {_ITEMS}, {_MADE} SELECT n.slug, n.name, (SELECT count(DISTINCT conversation_id) FROM links l WHERE l.slug = n.slug) AS conversations, (SELECT count(DISTINCT fingerprint) FROM made m WHERE m.slug = n.slug) AS items FROM names n")
def counts(t):
    normal = knowledge.items(*_split_facts(t))
    made = normal.withColumnRenamed("project_slug", "slug").withColumn("fingerprint", knowledge.fingerprint(F.col("source_conversation_id"), F.col("slug"), F.col("category"), F.col("statement")))
    return knowledge.project_counts(_names(t), knowledge.links(analyses(t), _names(t)), made)


@query("KNW7_array_counts", f"WITH {ANALYSES} SELECT project, count(*) AS count FROM (SELECT unnest(projects) AS project FROM analyses WHERE label = 'A') GROUP BY project")
def array_counts(t):
    return knowledge.array_counts(analyses(t), "A")


@query("KNW8_project_sources", f"WITH {ANALYSES} SELECT conversation_id, label, n FROM analyses JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id) WHERE list_contains(projects, 'src3') OR list_contains(projects, 'SRC3') AND label = 'B'")
def sources(t):
    c = t.conversations.groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id")).agg(F.count("*").alias("n"), F.min("turn").alias("created_at"))
    a = analyses(t).drop("conv_id")
    one, two = knowledge.of_project(a, c, "src3"), knowledge.of_project(a.filter("label = 'B'"), c, "SRC3")
    return one.unionByName(two).select("conversation_id", "label", "n").distinct()


@query("KNW9_wanted_sources", f"WITH {ANALYSES} SELECT conversation_id, list_sort(list_intersect(projects, ['src1', 'SRC2', 'other 0'])) AS assigned FROM analyses WHERE len(list_intersect(projects, ['src1', 'SRC2', 'other 0'])) > 0")
def wanted(t):
    return knowledge.wanted_sources(analyses(t), ["src1", "SRC2", "other 0"])


@query("RPT1_status", f"WITH {ANALYSES} SELECT 'label' AS what, label AS value, count(*) AS n FROM analyses GROUP BY label UNION ALL SELECT 'sure', CASE WHEN confidence >= 0.8 THEN 'true' ELSE 'false' END, count(*) FROM analyses GROUP BY 2 UNION ALL SELECT 'projects', '', count(DISTINCT p) FROM (SELECT unnest(projects) AS p FROM analyses WHERE label = 'A') UNION ALL SELECT 'last done', conversation_id || ' — t' || conv_id, 1 FROM (SELECT * FROM analyses WHERE conv_id % 4 = 0 ORDER BY conv_id % 50 DESC, conversation_id LIMIT 1)")
def status(t):
    a = analyses(t)
    c = a.select("conversation_id", F.concat(F.lit("t"), "conv_id").alias("title"), F.when(F.col("conv_id") % 4 == 0, "done").otherwise("pending").alias("state"), (F.col("conv_id") % 50).alias("processed_at"))
    return reports.status(a.withColumn("sure", F.col("confidence") >= 0.8), "label", "sure").unionByName(reports.overview(c, a, "A"))


@query("RPT2_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("documents", "conversations", "pages", "labels", "events")) + " UNION ALL SELECT 'sensitive', count(*) FROM labels WHERE toxic = 1")
def row_counts(t):
    return reports.row_counts({n: getattr(t, n) for n in ("documents", "conversations", "pages", "labels", "events")} | {"sensitive": t.labels.filter("toxic = 1")})


@query("RPT3_by_category", "SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type")
def by_category(t):
    return t.part.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("RPT4_latest", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3")
def latest(t):
    return reports.latest(t.documents, "source", 3, F.desc("n_chars"), F.col("doc_id")).select("source", "doc_id", "place")


_PAIRS = "SELECT source, max(substring(text, 1, 12000)) FILTER (place = 1) AS newer, max(substring(text, 1, 12000)) FILTER (place = 2) AS older FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents) GROUP BY source"


@query("RPT5_changed_lines", f"SELECT source, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS added, list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS removed FROM (SELECT source, string_split(newer, chr(10)) AS a, string_split(older, chr(10)) AS b FROM ({_PAIRS}))")
def changed(t):
    return reports.changed_lines(reports.pairs_of_newest(t.documents, "source", "text", "doc_id"), "source")


@query("RPT5_line_diff")
def diff(t):
    return reports.line_diff(reports.pairs_of_newest(t.documents, "source", "text", "doc_id"), "source")


@query("RPT6_dossiers", f"WITH {FACTS}, {_ITEMS} SELECT slug, category, CAST(page AS INT) AS page, count(*) AS items, string_agg('- ' || statement, chr(10) ORDER BY n) AS body FROM (SELECT *, (n - 1) // 1000 AS page FROM (SELECT *, row_number() OVER (PARTITION BY slug, category ORDER BY source_date, id) AS n FROM (SELECT *, {SLUG('project')} AS slug FROM items))) GROUP BY slug, category, page")
def dossiers(t):
    normal = knowledge.items(*_split_facts(t)).withColumnRenamed("project_slug", "slug")
    return reports.dossier(normal, ["slug", "category"], F.concat(F.lit("- "), "statement"), "source_date", "id")


DOCS = {"PROJECT": ("fact", "decision", "configuration", "workflow", "status"), "ISSUES": ("error",), "HISTORY": ("fact", "status", "error", "solution"), "NONE": ("missing",)}


@query("RPT7_routed_documents", f"""WITH {FACTS}, {_ITEMS}, docs(document, category) AS (VALUES {', '.join(f"('{d}', '{c}')" for d, cs in DOCS.items() for c in cs)}), p AS (SELECT DISTINCT source AS project FROM documents)
    SELECT project, document, CAST((n - 1) // 1000 AS INT) AS page, coalesce(string_agg(statement, chr(10) ORDER BY n), 'Nothing recorded yet.') AS body FROM (SELECT p.project, d.document, i.statement, row_number() OVER (PARTITION BY p.project, d.document ORDER BY i.id) AS n
        FROM p CROSS JOIN docs d LEFT JOIN items i ON i.project = p.project AND i.category = d.category) GROUP BY project, document, page""")
def routed(t):
    return reports.routed(knowledge.items(*_split_facts(t)), DOCS, t.documents.select(F.col("source").alias("project")).distinct())


@query("RPT8_event_tail", "SELECT event_id, format('#{} {}: {}', event_id, event_type, props) AS line FROM events ORDER BY event_id DESC LIMIT 50")
def tail(t):
    return reports.tail(t.events, "event_id", 50, F.format_string("#%d %s: %s", "event_id", "event_type", "props"))


@query("RPT9_check_rollup", "SELECT user_id AS run, count(*) FILTER (event_type = 'view') AS passed, count(*) FILTER (event_type NOT IN ('view', 'error')) AS warned, count(*) FILTER (event_type = 'error') AS failed, coalesce(list_sort(list(DISTINCT 'e' || event_id % 50) FILTER (event_type = 'error')), []) AS failed_names, sum(CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END) AS exposed FROM events GROUP BY user_id")
def rollup(t):
    out = F.when(F.col("event_id") % 4 == 0, "0.0.0.0:80 and :443->443").when(F.col("event_id") % 4 == 1, "none")
    return reports.check_rollup(t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("status"), F.concat(F.lit("e"), (F.col("event_id") % 50).cast("string")).alias("name"), out.alias("output")), ok="view", failed="error")


_PACK = "SELECT source, doc_id, total FROM (SELECT source, doc_id, least(length(text), 2500) AS n, CAST(sum(least(length(text), 2500)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS total FROM documents) WHERE {}"


@query("RPT10_context_pack_after", _PACK.format("total - n <= 18000"))
def pack_after(t):
    return reports.context_pack(t.documents, "source", "doc_id", "text", 18_000, 2_500, True).drop("text")


@query("RPT10_context_pack_before", _PACK.format("total <= 18000"))
def pack_before(t):
    return reports.context_pack(t.documents, "source", "doc_id", "text", 18_000, 2_500, False).drop("text")
