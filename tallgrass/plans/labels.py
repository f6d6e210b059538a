"""Queries for labels, text scans and file inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions.terms import found_of
from tallgrass.operators import classify, files, scan

from .registry import query, spread

#: Terms that the test tables have.
A = ("thehe", "ingand", "ofthe", "tionre", "anding", "onth", "ndre", "hein")
B = ("ement", "euxtre", "ouai", "ution", "ungver", "lich", "ción", "mente")
NAMES = {"Alpha Works": ("onth", "hein"), "Beta/Lab": ("ouai",), "Gamma": ("lich", "ungver")}


def _list(terms):
    return "[" + ", ".join(f"'{t}'" for t in sorted(terms)) + "]"


_HITS = f"SELECT *, list_filter({_list(A)}, lambda t: contains(lower(text), t)) AS ha, list_filter({_list(B)}, lambda t: contains(lower(text), t)) AS hb FROM documents"
_LABEL = f"""SELECT *, CASE WHEN len(ha) >= 2 AND len(ha) >= 2 * len(hb) THEN 'TECHNICAL' WHEN len(hb) >= 2 AND len(hb) >= 2 * len(ha) THEN 'CREATIVE' WHEN len(ha) > 0 AND len(hb) > 0 THEN 'SHARED' ELSE 'UNKNOWN' END AS label,
    round(CASE WHEN len(ha) >= 2 AND len(ha) >= 2 * len(hb) THEN least(0.98, 0.70 + 0.08 * len(ha)) WHEN len(hb) >= 2 AND len(hb) >= 2 * len(ha) THEN least(0.98, 0.70 + 0.08 * len(hb)) WHEN len(ha) > 0 AND len(hb) > 0 THEN 0.55 ELSE 0.25 END, 2) AS confidence,
    CASE WHEN len(ha) >= 2 AND len(ha) >= 2 * len(hb) THEN list_sort(ha)[1:6] WHEN len(hb) >= 2 AND len(hb) >= 2 * len(ha) THEN list_sort(hb)[1:6] ELSE list_sort(list_concat(ha, hb))[1:6] END AS reasons FROM ({_HITS})"""


@query("CLS1_keyword_label", f"SELECT doc_id, label, CAST(confidence AS DOUBLE) AS confidence, reasons FROM ({_LABEL})")
def keywords(t):
    return t.documents.select("doc_id", classify.by_keywords(F.col("text"), A, B).alias("k")).select("doc_id", "k.*")


@query("CLS1_vocabulary", """WITH t AS (SELECT list(term ORDER BY term) AS every FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark) WHERE length(term) > 3)
    SELECT doc_id, len(f) AS n_terms, f[1] AS first_term, md5(array_to_string(f, ',')) AS terms_md5 FROM (SELECT doc_id, coalesce(list_filter(every, lambda w: contains(lower(text), w)), []) AS f FROM documents, t)""")
def vocabulary(t):
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).filter(F.length("term") > 3)
    hit = found_of(spread(t.documents.select("doc_id", "text"), "doc_id"), F.lower("text"), words)
    return hit.select("doc_id", F.size("terms").alias("n_terms"), F.get("terms", F.lit(0)).alias("first_term"), F.md5(F.array_join("terms", ",")).alias("terms_md5"))


@query("CLS2_priority", f"SELECT doc_id, CASE WHEN len(ha) >= 2 AND len(ha) > len(hb) THEN 100 + len(ha) WHEN len(hb) >= 2 AND len(hb) > len(ha) THEN 15 + len(hb) ELSE 0 END AS priority FROM (SELECT doc_id, list_filter({_list(A)}, lambda t: contains(lower(source || chr(10) || text), t)) AS ha, list_filter({_list(B)}, lambda t: contains(lower(source || chr(10) || text), t)) AS hb FROM documents)")
def priority(t):
    return t.documents.select("doc_id", classify.priority(F.col("source"), F.col("text"), A, B).alias("priority"))


_CASES = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower(text), '{x}')''' for x in p)} THEN '{n}' END" for n, p in NAMES.items())


@query("CLS3_projects", f"SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(list_concat([{_CASES}], [source]), lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '[^A-Za-z0-9_-]+', '-', 'g')))) AS projects FROM documents")
def projects(t):
    return t.documents.select("doc_id", classify.projects_for(F.array("source"), F.col("text"), NAMES).alias("projects"))


_MODEL = "CASE doc_id % 5 WHEN 0 THEN 'TECHNICAL' WHEN 1 THEN 'CREATIVE' WHEN 2 THEN 'shared' WHEN 3 THEN 'NONSENSE' ELSE 'UNKNOWN' END"


@query("CLS4_guarded_label", f"""SELECT doc_id, CASE WHEN (m = 'TECHNICAL' AND label = 'CREATIVE') OR (m = 'CREATIVE' AND label = 'TECHNICAL') THEN 'UNKNOWN' ELSE m END AS label,
    round(CASE WHEN (m = 'TECHNICAL' AND label = 'CREATIVE') OR (m = 'CREATIVE' AND label = 'TECHNICAL') THEN 0.30 WHEN label = 'UNKNOWN' AND m <> 'UNKNOWN' THEN least(c, 0.69) ELSE c END, 6) AS confidence
    FROM (SELECT doc_id, label, CASE WHEN doc_id % 5 = 3 THEN label ELSE upper({_MODEL}) END AS m, CAST(greatest(0, least(1, CASE WHEN doc_id % 7 = 0 OR doc_id % 15 = 0 THEN confidence ELSE (doc_id % 15) / 10.0 END)) AS DOUBLE) AS c FROM ({_LABEL}))""")
def guarded(t):
    model, sure = F.expr(_MODEL), F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 15) / 10.0)
    d = t.documents.select("doc_id", model.alias("m"), sure.alias("c"), classify.by_keywords(F.col("text"), A, B).alias("k"))
    return d.select("doc_id", classify.guarded(F.col("m"), F.col("c"), F.col("k")).alias("g")).select("doc_id", "g.label", F.round("g.confidence", 6).alias("confidence"))


@query("CLS5_promotion", f"""WITH a AS (SELECT doc_id AS conversation_id, source, string_split(text, '.')[1:10] AS m FROM ({_LABEL}) WHERE label = 'TECHNICAL' AND confidence >= 0.80),
    r AS (SELECT conversation_id, source, unnest(range(len(m))) AS pos, unnest(m) AS f FROM a),
    s AS (SELECT conversation_id, source, pos, substring(f, 1, 800) AS fact, CASE WHEN pos % 2 = 0 THEN 'setting' ELSE 'technical' END AS fact_type, CASE WHEN pos % 3 = 0 THEN 'current' ELSE 'dated' END AS temporal_status, CASE WHEN length(f) % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM r WHERE length(f) % 7 <> 0)
    SELECT conversation_id, 'technical' AS namespace, pos, fact, fact_type, temporal_status, confidence, '{{"conversation_id":' || conversation_id || ',"title":"t' || conversation_id || '","created_at":null,"source_file":"' || source || '"}}' AS provenance FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, fact ORDER BY pos) AS n FROM s) WHERE n = 1""")
def promotion(t):
    memories = F.transform(F.split("text", "[.]"), lambda x, i: F.struct(F.when(F.length(x) % 7 != 0, x).alias("fact"), F.when(i % 2 == 0, "setting").alias("fact_type"), F.when(i % 3 == 0, "current").alias("temporal_status"), F.when(F.length(x) % 3 == 0, "high").otherwise("sure").alias("confidence")))
    origin = [F.concat(F.lit("t"), "doc_id").alias("title"), F.lit(None).cast("string").alias("created_at"), F.col("source").alias("source_file")]
    a = t.documents.select(F.col("doc_id").alias("conversation_id"), *origin, classify.by_keywords(F.col("text"), A, B).alias("k"), memories.alias("memories")).select("conversation_id", "title", "created_at", "source_file", "k.label", "k.confidence", "memories")
    return classify.promoted(a)


_CATS = _list(classify.CATEGORIES).replace("[", "").replace("]", "")
_RAW = "[" + ", ".join(f"'{c}'" for c in (*classify.CATEGORIES, "other")) + "]"
_NORMAL = """WITH r AS (SELECT doc_id, source, unnest(range(len(s))) AS pos, unnest(s) AS x FROM (SELECT doc_id, source, string_split(text, '.')[1:{limit}] AS s FROM documents)),
    f AS (SELECT doc_id, source, pos, {project} AS project, {raw}[(pos + doc_id) % 13 + 1] AS category, substring(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 1, {size}) AS statement, substring(regexp_replace(substring(x, 10), '^\\s+|\\s+$', '', 'g'), 1, {size}) AS evidence, CASE pos % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM r)
    SELECT doc_id, pos, project, category, statement, evidence, confidence FROM f WHERE statement <> '' AND evidence <> '' AND category <> 'other' AND {allowed}"""


def _facts(t, project):
    cats = F.array(*[F.lit(c) for c in (*classify.CATEGORIES, "other")])
    fact = lambda x, i: F.struct(project(i).alias("project"), F.element_at(cats, ((i + F.col("doc_id")) % 13 + 1).cast("int")).alias("category"), x.alias("statement"), F.expr("''").alias("_e"), F.substring(x, 10, 1_000_000).alias("evidence"), F.when(i % 4 == 0, "high").when(i % 4 == 1, "LOW").when(i % 4 == 2, F.lit(None)).otherwise("maybe").alias("confidence"), F.when(i % 3 == 0, " current ").alias("temporal_status"))
    return t.documents.select("doc_id", "source", F.transform(F.split("text", "[.]"), fact).alias("facts"))


@query("CLS6_deep_facts", _NORMAL.format(limit=30, size=120, raw=_RAW, project="CASE pos % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE 'Other' END", allowed="project <> 'Other'"))
def deep(t):
    return classify.normal_facts(_facts(t, lambda i: F.when(i % 3 == 0, "Alpha").when(i % 3 == 1, "Beta").otherwise("Other")), "facts", ["Alpha", "Beta"], size=120).drop("source")


@query("CLS7_project_facts", _NORMAL.format(limit=10, size=160, raw=_RAW, project="CASE pos % 2 WHEN 0 THEN source ELSE 'src1' END", allowed="(project = source OR (doc_id % 2 = 0 AND project = 'src1'))").replace("confidence FROM f", "confidence, CASE WHEN pos % 3 = 0 THEN 'current' ELSE 'historical' END AS temporal_status FROM f") + " AND pos % 4 < 3")
def routed(t):
    d = _facts(t, lambda i: F.when(i % 2 == 0, F.col("source")).otherwise("src1"))
    d = d.withColumn("assigned", F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("src1"))).otherwise(F.array("source")))
    return classify.normal_facts(d, "facts", "assigned", limit=10, size=160, dated=True).drop("source", "assigned")


@query("CLS8_record_facts", """WITH stored AS (SELECT doc_id AS conversation_id, source AS project, lang AS statement, 'old' AS evidence FROM documents WHERE doc_id % 3 < 2),
    new AS (SELECT doc_id AS conversation_id, source AS project, CASE WHEN doc_id % 4 = 0 THEN lang ELSE text END AS statement, 'new' AS evidence FROM documents WHERE doc_id % 3 > 0)
    SELECT 'replace' AS how, * FROM (SELECT * FROM stored WHERE conversation_id NOT IN (SELECT conversation_id FROM new WHERE conversation_id % 5 > 0) UNION ALL SELECT * FROM new WHERE conversation_id % 5 > 0)
    UNION ALL SELECT 'add', * FROM (SELECT * FROM stored UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.conversation_id = n.conversation_id AND s.project = n.project AND s.statement = n.statement))""")
def record(t):
    cols = [F.col("doc_id").alias("conversation_id"), F.col("source").alias("project")]
    stored = t.documents.filter("doc_id % 3 < 2").select(*cols, F.col("lang").alias("statement"), F.lit("old").alias("evidence"))
    new = t.documents.filter("doc_id % 3 > 0").select(*cols, F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("text")).alias("statement"), F.lit("new").alias("evidence"))
    analyses = t.documents.select(F.col("doc_id").alias("conversation_id"), F.when(F.col("doc_id") % 5 > 0, "TECHNICAL").otherwise("SHARED").alias("label"))
    both = classify.replace_facts(stored, new, analyses=analyses).withColumn("how", F.lit("replace"))
    return both.unionByName(classify.add_facts(stored, new, ["conversation_id", "project", "statement"], "evidence").withColumn("how", F.lit("add")))


def _answers(prompts):
    import json

    return [json.dumps({"label": "TECHNICAL" if "th" in p else "CREATIVE", "confidence": 0.9}) if len(p) % 5 else "no answer" for p in prompts]


@query("CLS9_model_stage", "SELECT doc_id, CASE WHEN length(p) % 5 <> 0 THEN CASE WHEN contains(p, 'th') THEN 'TECHNICAL' ELSE 'CREATIVE' END END AS label, CASE WHEN length(p) % 5 = 0 THEN 'not JSON' END AS error FROM (SELECT doc_id, 'Text: ' || substring(text, 1, 14000) AS p FROM documents)")
def model(t):
    return classify.predicted(t.documents, "text", _answers, "Text: {text}").select("doc_id", "answer.label", "error")


_RISK = [p.replace("'", "''") for p in ("tion the", "onth", "hein", "xyzzy")]


@query("SCN1_risk_score", f"SELECT doc_id, CASE WHEN len(f) > 0 THEN 'warning' ELSE 'pass' END AS status, CASE WHEN len(f) > 0 THEN 70 ELSE 95 END AS score, array_to_string(list_transform(f, lambda x: 'Risky pattern found: `' || x || '`'), chr(10)) AS findings FROM (SELECT doc_id, list_filter({_list(_RISK)}, lambda p: contains(lower(text), p)) AS f FROM documents)")
def risk(t):
    return scan.evaluate(t.documents.select("doc_id", "text"), "doc_id", sorted(_RISK))


_LINES = "SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS line_no FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


@query("SCN2_line_hits", f"SELECT doc_id, line_no, p AS pattern, substring({'regexp_replace(line, ' + chr(39) + '^\\s+|\\s+$' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')'}, 1, 240) AS line FROM ({_LINES}), (SELECT unnest({_list(_RISK)}) AS p) WHERE contains(line, p)")
def line_hits(t):
    return scan.line_hits(t.documents, "doc_id", "text", sorted(_RISK))


@query("SCN3_keyword_lines", f"WITH m AS (SELECT doc_id, line_no, substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 240) AS l FROM ({_LINES}) WHERE contains(lower(line), 'xyzzy') OR contains(lower(line), 'hein') OR contains(lower(line), 'ungver')) SELECT doc_id, list(l ORDER BY line_no)[1:8] AS lines FROM m GROUP BY doc_id ORDER BY doc_id LIMIT 80")
def keyword_lines(t):
    return scan.keyword_lines(t.documents, "doc_id", "text", ["xyzzy", "Hein", "ungver"])


_PATH = "source || '/' || CASE doc_id % 9 WHEN 0 THEN 'Daily Briefings' WHEN 1 THEN 'raw' WHEN 2 THEN 'week summary' WHEN 3 THEN 'audit report' WHEN 4 THEN 'Logs' WHEN 5 THEN 'plan b' WHEN 6 THEN 'System Summaries' ELSE lang END || '/' || doc_id || '.md'"


@query("SCN4_audience", f"SELECT doc_id, CASE WHEN contains(p, 'system summaries') OR contains(p, 'daily briefings') THEN 'human' WHEN contains(p, 'raw') OR contains(p, 'logs') THEN 'ai' WHEN contains(p, 'summary') THEN 'human' WHEN contains(p, 'report') OR contains(p, 'plan') THEN 'ai' ELSE 'mixed' END AS audience FROM (SELECT doc_id, lower({_PATH}) AS p FROM documents)")
def audience(t):
    return t.documents.select("doc_id", scan.audience(F.expr(_PATH)).alias("audience"))


@query("SCN5_banner", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '<!-- audience -->' || chr(10) || text WHEN doc_id % 4 = 1 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || chr(10) || '<!-- audience -->' || chr(10) || text ELSE '<!-- audience -->' || chr(10) || text END AS text FROM documents""")
def banner(t):
    head = F.when(F.col("doc_id") % 4 == 0, F.lit("<!-- audience -->\n")).when(F.col("doc_id") % 4 == 1, F.lit("---\ntitle: x\n---\n")).otherwise(F.lit(""))
    return t.documents.select("doc_id", scan.with_banner(F.concat(head, F.col("text")), "<!-- audience -->\n", "<!-- audience").alias("text"))


@query("SCN6_report_counts", f"SELECT doc_id, count(*) FILTER (contains(line, 'hein')) AS exposed, count(*) FILTER (contains(line, 'hein') AND contains(line, 'onth')) AS private, count(*) FILTER (contains(lower(line), 'warning') OR contains(lower(line), 'failed')) AS warnings FROM ({_LINES}) GROUP BY doc_id")
def report_counts(t):
    return scan.report_counts(t.documents, "doc_id", "text", "hein", "onth", ends="\n")


_NAME = "p_name || ['.png', '.PY', '.mp4', '.md', '.zip', '.xyz', '', '.csv', '.deb', '.flac'][p_partkey % 10 + 1]"
_SUFFIX = "lower(regexp_extract(name, '(\\.[^./]*)$', 1))"
_CATEGORY = "CASE " + " ".join(f"WHEN {_SUFFIX} IN ({', '.join(repr(x) for x in s)}) THEN '{c}'" for c, s in files.SUFFIXES.items()) + " ELSE 'Other' END"
_SENSITIVE = "CAST(regexp_matches(lower(path), '" + "|".join(files.SENSITIVE) + "') AS INT)"
_FILES = f"SELECT *, {_CATEGORY} AS category, {_SENSITIVE} AS sensitive FROM (SELECT *, '/home/' || p_brand || '/' || name AS path FROM (SELECT p_partkey, p_brand, p_size, {_NAME} AS name FROM part))"


def _inventory(t):
    endings = F.array(*[F.lit(x) for x in (".png", ".PY", ".mp4", ".md", ".zip", ".xyz", "", ".csv", ".deb", ".flac")])
    name = F.concat("p_name", F.element_at(endings, (F.col("p_partkey") % 10 + 1).cast("int")))
    p = t.part.select("p_partkey", "p_size", "p_brand", name.alias("name")).withColumn("path", F.concat(F.lit("/home/"), "p_brand", F.lit("/"), "name"))
    return p.select("*", files.category(F.col("name")).alias("category"), files.sensitive(F.col("path")).alias("sensitive"))


@query("FIL1_category", f"SELECT p_partkey, category FROM ({_FILES})")
def category(t):
    return _inventory(t).select("p_partkey", "category")


@query("FIL2_sensitive", f"SELECT doc_id, {_SENSITIVE.replace('path', 'text')} AS sensitive FROM documents")
def sensitive(t):
    return t.documents.select("doc_id", files.sensitive(F.col("text")).alias("sensitive"))


@query("FIL4_sort_plan", f"SELECT category, name, path, k AS place, round(p_size * 100 / 1024.0, 1) AS kb FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY name, path, p_size) AS k FROM (SELECT * FROM ({_FILES}) ORDER BY category, name, path, p_size LIMIT 1000) WHERE sensitive = 0) WHERE k <= 75")
def sort_plan(t):
    return files.sort_plan(_inventory(t).withColumn("size", F.col("p_size") * 100))


@query("FIL4_sensitive_files", f"SELECT name, path, category FROM (SELECT * FROM ({_FILES}) ORDER BY category, name, path, p_size LIMIT 1000) WHERE sensitive = 1 ORDER BY category, name, path, p_size LIMIT 150")
def sensitive_files(t):
    return files.sensitive_files(_inventory(t).withColumn("size", F.col("p_size") * 100))


@query("FIL5_skip_rule", f"SELECT p_partkey, CAST(NOT (lower(regexp_extract(name, '(\\.[^./]*)$', 1)) IN ('.md', '.txt')) OR p_brand = 'Brand#7' OR regexp_matches(lower(path), 'red|wallet') AS INT) AS skipped FROM ({_FILES})")
def skip_rule(t):
    return _inventory(t).select("p_partkey", files.skipped(F.col("path"), parts=("Brand#7", ".git"), words=("red", "wallet")).cast("int").alias("skipped"))
