"""The operators of this package as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ctw, decontaminate, divergence, langid, lexical, licences, line_dedup, media, minhash, packing, quality, token_store
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("h", "first")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark, licences.TEXTS + licences.FURTHER, licences.DIGESTS))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_texts(table(spark, sf_dir, "documents")))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.rules(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_benchmark_decontamination, op3_language_id, op4_token_id_output, op5_lm_scoring, op6_minhash_near_dedup, op7_quality_classifier, op8_best_fit_packing, op9_license_scans, op10_media_columns, op11_ranked_lexical_search, op12_quality_rules, op13_cross_tokenizer_alignment)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    c = f"regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licences.NOTICE_LINE}', ' ', 'g')"
    c = f"concat('  ', trim(regexp_replace({c}, '{licences.NOT_WORD}', '  ', 'g')), '  ')"
    for was, now in licences.RULES:
        c = f"replace({c}, '{licences.spaced(was)}', '{licences.spaced(now)}')"
    return f"trim(replace({c}, '  ', ' '))"


def _licence_sql() -> str:
    texts = licences.TEXTS + licences.FURTHER
    texts = texts + [(n, f"{title}\n{t}") for n, t in texts for title in licences.TITLES.get(n, [])]
    rows = lambda pairs: ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in pairs)
    return f"""
        WITH texts AS (SELECT DISTINCT n AS license_id, sha256({_canonical_sql('t')}) AS d FROM (VALUES {rows(texts)}) v(n, t) UNION VALUES {rows(licences.DIGESTS)}),
        notices AS (SELECT DISTINCT n, sha256({_canonical_sql('t')}) AS d FROM (VALUES {rows(licences.NOTICES)}) v(n, t)),
        whole AS (SELECT doc_id, {_canonical_sql('text')} AS c, text FROM documents),
        lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE l ILIKE '%license%' OR l ILIKE '%licence%'),
        found AS (SELECT doc_id, string_agg(n, ',' ORDER BY n) AS ids FROM (SELECT DISTINCT doc_id, n FROM lines JOIN notices ON sha256({_canonical_sql('l')}) = d) GROUP BY doc_id)
        SELECT w.doc_id, CASE WHEN length(c) > 0 THEN sha256(c) END AS digest, license_id, coalesce(ids, '') AS notice_ids
        FROM whole w LEFT JOIN texts t ON sha256(c) = t.d LEFT JOIN found f ON w.doc_id = f.doc_id"""


def _decontaminate_sql() -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.WORD}')"
    return f"""
        WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
        i AS (SELECT item_id, {words('text')} AS w FROM benchmark),
        wins AS (SELECT DISTINCT item_id, n, w[s:s + n - 1] AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
        sizes AS (SELECT DISTINCT n FROM wins),
        places AS (SELECT doc_id, n, p, w[p:p + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, p, places.n AS n FROM places JOIN wins ON places.n = wins.n AND places.win = wins.win),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def _line_dedup_sql() -> str:
    return """
        WITH l AS (SELECT doc_id, unnest(range(len(s))) AS line, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
        w AS (SELECT doc_id, line, t, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'))) AS s FROM l),
        c AS (SELECT s, len(s) AS n, min((doc_id, line)) AS pl, row_number() OVER () AS id FROM w WHERE len(s) > 0 GROUP BY s),
        x AS (SELECT id, n, pl, unnest(s) AS word FROM c),
        p AS (SELECT a.id AS id, min(b.pl) AS pl FROM (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.word = b.word AND a.id <> b.id AND b.pl < a.pl AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))) q JOIN c a ON a.id = q.a JOIN c b ON b.id = q.b GROUP BY a.id),
        m AS (SELECT c.s, least(c.pl, coalesce(p.pl, c.pl)) AS pl FROM c LEFT JOIN p ON c.id = p.id),
        f AS (SELECT w.doc_id, w.line, w.t, m.pl IS NOT NULL AND (w.doc_id, w.line) > m.pl AS gone FROM w LEFT JOIN m ON w.s = m.s)
        SELECT d.doc_id, count(f.line) AS n_lines, count(*) FILTER (gone) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(f.t, chr(10) ORDER BY f.line) FILTER (NOT gone), '')) END AS text_sha256
        FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id, d.text"""


def _search_sql() -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
        s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
        q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({words('text')}) AS w FROM benchmark) GROUP BY ALL),
        tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(w) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
        weight AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY w, docs),
        part AS (SELECT tf.r, d.doc_id, tf.w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * docs) // terms))) AS part FROM tf JOIN weight USING (w) JOIN d ON tf.r = d.r, s),
        sums AS (SELECT item_id, r, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN part USING (w) GROUP BY ALL),
        best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sums WHERE score > 0)
        SELECT * FROM best WHERE rank <= 10"""


def sql() -> dict[str, str]:
    return {"op1_line_dedup": _line_dedup_sql(), "op2_benchmark_decontamination": _decontaminate_sql(), "op9_license_scans": _licence_sql(), "op11_ranked_lexical_search": _search_sql()}
