"""Rollups, latest rows, differences of texts, and rendered reports."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallgrass.operators.ranks import SENT_PARTS, numbered
from tallgrass.sources.scratch import scratch

#: Signs of each text that a difference looks at, and its most lines.
DIFF_SIZE, DIFF_LINES = 12_000, 220


def status(state: DataFrame, *groups: str) -> DataFrame:
    """(what, value, n) for each value of the columns named."""
    rows = None
    for g in groups:
        one = state.groupBy(F.col(g).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(g).alias("what"), "value", "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def overview(conversations: DataFrame, analyses: DataFrame, label: str) -> DataFrame:
    """Rows of status(): how many projects the analyses of a label name, and which conversation was done last."""
    found = analyses.filter(F.col("label") == label).select(F.explode("projects").alias("p")).agg(F.countDistinct("p").alias("n")).select(F.lit("projects").alias("what"), F.lit("").alias("value"), "n")
    done = conversations.filter("state = 'done'").orderBy(F.desc("processed_at"), "conversation_id").limit(1)
    name = F.replace(F.replace(F.concat(F.col("conversation_id").cast("string"), F.lit(" — "), "title"), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return found.unionByName(done.select(F.lit("last done").alias("what"), name.alias("value"), F.lit(1).cast("long").alias("n")))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def latest(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def pairs_of_newest(df: DataFrame, group: str, text: str, newest: str) -> DataFrame:
    """group, newer and older text of the two rows of each group with the largest value of newest."""
    two = latest(df.select(group, newest, F.substring(text, 1, DIFF_SIZE).alias("_t")), group, 2, F.desc(newest))
    return two.groupBy(group).agg(F.max(F.when(F.col("place") == 1, F.col("_t"))).alias("newer"), F.max(F.when(F.col("place") == 2, F.col("_t"))).alias("older")).filter("older is not null")


def line_diff(pairs: DataFrame, group: str, most: int = DIFF_LINES) -> DataFrame:
    """A unified difference for each pair of texts."""

    def rows(batches):
        for b in batches:
            out = ["\n".join(list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), "older", "newer", lineterm=""))[:most]) for new, old in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [group, "diff"])

    return pairs.select(group, "newer", "older").mapInArrow(rows, f"`{group}` {pairs.schema[group].dataType.simpleString()}, diff string")


def changed_lines(pairs: DataFrame, group: str) -> DataFrame:
    """Lines that one of each pair of texts has alone."""
    a, b = F.split("newer", "\n"), F.split("older", "\n")
    return pairs.select(group, F.array_sort(F.array_except(a, b)).alias("added"), F.array_sort(F.array_except(b, a)).alias("removed"))


def dossier(items: DataFrame, keys: list[str], line: Column, *order: str) -> DataFrame:
    """Texts for each key, a line for each item in order, in pages of PAGE items at most, and how many there are."""
    return _paged(items.select(*keys, *order, line.alias("_line")), keys, order, "_line").withColumnRenamed("n", "items")


#: Items of a page of a report; longer reports have several, so no text grows with its key.
PAGE = 1000


def _paged(rows: DataFrame, keys: list[str], order: tuple[str, ...], line: str) -> DataFrame:
    """keys, page (from 0), n and body of rows."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_place", F.col(line).alias("_text")))), lambda x: x["_text"])
    placed = numbered(rows, keys, [*order, line]).withColumn("page", F.floor((F.col("_place") - 1) / PAGE).cast("int"))
    return placed.groupBy(*keys, "page").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("body"))


def routed(facts: DataFrame, documents: dict[str, tuple[str, ...]], projects: DataFrame, empty: str = "Nothing recorded yet.") -> DataFrame:
    """Bodies for each project and document, page by page, from the facts of the document's categories."""
    path = scratch(projects.sparkSession, "projects")
    projects.write.parquet(path)
    projects = projects.sparkSession.read.schema(projects.schema).parquet(path)
    few = projects.count() * len(documents) <= SENT_PARTS
    wanted = projects.select("project", F.explode(F.array(*[F.lit(d) for d in documents])).alias("document"))
    named = facts.join(F.broadcast(_documents(facts, documents)), "category").select("project", "document", "id", "statement")
    body = _paged(named, ["project", "document"], ("id",), "statement").drop("n")
    if few:  # bodies stay where they are; facts of other projects and documents make none
        none = wanted.join(body.select("project", "document").distinct(), ["project", "document"], "left_anti")
        found = body.join(F.broadcast(wanted), ["project", "document"]).select("project", "document", "page", "body")
        return found.unionByName(none.select("project", "document", F.lit(0).alias("page"), F.lit(empty).alias("body")))
    return wanted.join(body, ["project", "document"], "left").select("project", "document", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("body", F.lit(empty)).alias("body"))


def _documents(facts: DataFrame, documents: dict[str, tuple[str, ...]]) -> DataFrame:
    """(category, document) of a map in the code."""
    return facts.sparkSession.createDataFrame([(c, d) for d, cs in documents.items() for c in cs], "category string, document string")


def tail(df: DataFrame, key: str, n: int, line: Column) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n).select(key, line.alias("line"))


def check_rollup(results: DataFrame, ok: str = "PASS", failed: str = "FAIL") -> DataFrame:
    exposed = F.regexp_count(F.coalesce("output", F.lit("")), F.lit(r"0\.0\.0\.0:\d+|:\d+->"))
    return results.groupBy("run").agg(F.count_if(F.col("status") == ok).alias("passed"), F.count_if(~F.col("status").isin(ok, failed)).alias("warned"), F.count_if(F.col("status") == failed).alias("failed"), F.array_sort(F.collect_set(F.when(F.col("status") == failed, F.col("name")))).alias("failed_names"), F.sum(exposed).alias("exposed"))


def context_pack(df: DataFrame, pack: str, path: str, text: str, budget: int, per_file: int, stop_after: bool) -> DataFrame:
    """Files of each pack in order of path, up to a budget of signs: with stop_after the one that
    passes it is the last, else the one before."""
    cut = df.select(pack, path, F.substring(text, 1, per_file).alias("text")).withColumn("_size", F.length("text"))
    run = numbered(cut, [pack], [path], "_size").withColumnRenamed("_total", "total")
    wanted = F.col("total") - F.col("_size") <= budget if stop_after else F.col("total") <= budget
    return run.filter(wanted).drop("_size", "_place")
