"""Projects, links of conversations to them, and normalized knowledge items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallgrass.functions.text import slugify

#: How fact categories are brought to a few.
CATEGORY = {
    "known_issue": "error", "failed_approach": "error", "bug": "error", "error": "error", "successful_command": "solution", "solution": "solution", "architecture_decision": "decision",
    "decision_reason": "decision", "lesson_learned": "lesson", "configuration": "configuration", "workflow": "workflow", "project_status": "status", "system_state": "status", "important_fact": "fact",
}


def category(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])
    return F.when(F.coalesce(c, F.lit("")) == "", "fact").otherwise(F.coalesce(F.try_element_at(named, c), c))


def project_names(*named: DataFrame) -> DataFrame:
    """slug and name of each project in any of the tables (name, seq), the first spelling by table and seq."""
    rows = None
    for rank, df in enumerate(named):
        one = df.filter("trim(name) <> ''").select(F.lit(rank).alias("rank"), "seq", "name")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(slugify(F.col("name")).alias("slug")).agg(F.min_by("name", F.struct("rank", "seq", "name")).alias("name"))


def links(analyses: DataFrame, projects: DataFrame) -> DataFrame:
    """conversation_id, slug, relevance, rationale and source, one for each pair."""
    each = analyses.select("conversation_id", "label", "confidence", "reasons", F.explode("projects").alias("name")).withColumn("slug", slugify(F.col("name")))
    known = each.join(projects.select("slug"), "slug", "left_semi")
    relevance = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    out = known.select("conversation_id", "slug", relevance.alias("relevance"), F.array_join(F.slice("reasons", 1, 3), "; ").alias("rationale"), F.concat(F.lit("analysis:"), F.lower("label")).alias("source"))
    return out.dropDuplicates(["conversation_id", "slug"])


def items(*facts: DataFrame) -> DataFrame:
    """Facts of all tables with one set of categories; of the same fact the first by table and id. Facts of a table
    without temporal_status have an unknown one."""
    return _items(facts, "_same", lambda *c: F.xxhash64(*c)).drop("_same")


def fingerprinted(*facts: DataFrame) -> DataFrame:
    """items() with their fingerprint, by which they are dealt to tasks: an upsert need not deal them again."""
    return _items(facts, "fingerprint", fingerprint)


def _items(facts: tuple[DataFrame, ...], name: str, same: Callable[..., Column]) -> DataFrame:
    """items() and, under name, what same() says of conversation, slug, category and statement. Rows are dealt and put in order by it
    before they are by their texts; what shares a project shares a slug."""
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    rows = None
    for rank, df in enumerate(facts):
        one = df.withColumn("rank", F.lit(rank))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    rows = rows.withColumns({"category": category(F.col("category")), "status": given("temporal_status", "unknown"), "confidence": given("confidence", "UNKNOWN"), "source_date": given("source_date", ""), "title": F.lit(""), "project_slug": slugify(F.col("project"))})
    rows = rows.withColumn(name, same(F.col("source_conversation_id"), F.col("project_slug"), F.col("category"), F.col("statement"))).repartition(name)
    w = W.partitionBy(name, "source_conversation_id", "project", "category", "statement").orderBy("rank", "id")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "temporal_status")


def fingerprint(conversation: Column, slug: Column, kind: Column, statement: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", conversation, slug, kind, statement), 256)


#: Columns of an item that stay as they were first, and those that the last fact gives.
FIRST, LAST = ("source_conversation_id", "slug", "category", "title", "statement"), ("evidence", "status", "confidence", "source_date")


def populated(normal: DataFrame) -> DataFrame:
    """One row, items: how many facts an upsert of normal takes in, whether or not they have been stored before."""
    return normal.agg(F.count("*").alias("items"))


def upsert(normal: DataFrame, stored: DataFrame) -> DataFrame:
    """The item table (fingerprint, FIRST, LAST) after normal: a fingerprint's first title, category and project stay;
    its last evidence, status, confidence and date win."""
    new = normal.withColumnRenamed("project_slug", "slug")
    if "fingerprint" not in new.columns:
        new = new.withColumn("fingerprint", fingerprint(F.col("source_conversation_id"), F.col("slug"), F.col("category"), F.col("statement")))
    seq = F.struct("rank", "id")
    last = new.groupBy("fingerprint").agg(F.min_by(F.struct(*FIRST), seq).alias("a"), F.max_by(F.struct(*LAST), seq).alias("b"))
    old = stored.select("fingerprint", F.struct(*FIRST).alias("_a"), F.struct(*LAST).alias("_b"))
    both = last.join(old, "fingerprint", "full_outer")
    return both.select("fingerprint", F.coalesce("_a", "a").alias("x"), F.coalesce("b", "_b").alias("y")).select("fingerprint", "x.*", "y.*")


def project_counts(projects: DataFrame, link: DataFrame, item: DataFrame) -> DataFrame:
    """Projects with their counts of conversations and items; each side is counted before the joins."""
    c = link.groupBy("slug").agg(F.countDistinct("conversation_id").alias("conversations"))
    i = item.groupBy("slug").agg(F.countDistinct("fingerprint").alias("items"))
    out = projects.join(c, "slug", "left").join(i, "slug", "left")
    return out.select("slug", "name", F.coalesce("conversations", F.lit(0)).alias("conversations"), F.coalesce("items", F.lit(0)).alias("items")).orderBy(F.lower("name"), "slug")


def array_counts(analyses: DataFrame, label: str) -> DataFrame:
    return analyses.filter(F.col("label") == label).select(F.explode("projects").alias("project")).groupBy("project").count()


def of_project(analyses: DataFrame, conversations: DataFrame, project: str) -> DataFrame:
    return analyses.filter(F.array_contains("projects", project)).join(conversations, "conversation_id").orderBy("created_at", "conversation_id")


def wanted_sources(analyses: DataFrame, wanted: list[str]) -> DataFrame:
    """conversation_id and which wanted projects it has, if any."""
    both = F.array_intersect("projects", F.array(*[F.lit(w) for w in wanted]))
    return analyses.select("conversation_id", F.array_sort(both).alias("assigned")).filter(F.size("assigned") > 0)
