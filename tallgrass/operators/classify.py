"""Deterministic labels of texts, and the guards around a model's answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallgrass.functions.terms import found
from tallgrass.functions.text import hits, lits, safe_list, trim

#: Words of the two vocabularies, without names of single users' projects, which users add.
TECHNICAL = ("linux", "linux mint", "xfce", "cinnamon", "cachyos", "kali", "server", "docker", "self-host", "ollama", "local llm", "ai agent", "coding", "programming", "github", "git", "qemu", "kvm", "virt-manager", "cybersecurity", "ethical hacking", "networking", "ssh", "tailscale", "homelab", "system administration", "macbook", "virtualization", "vm", "software development")
CREATIVE = ("image generation", "graphic design", "character design", "wireframe character", "angel", "fashion", "y2k", "emo", "scene aesthetic", "coloring book", "photo edit", "facial feature", "capcut", "firefly", "wallpaper", "glitter", "wings", "visual pose", "artwork", "make an image", "generate an image", "create an image", "emo girl", "fortnite image")
#: Fact categories and levels of confidence.
CATEGORIES = ("important_fact", "system_state", "project_status", "architecture_decision", "decision_reason", "successful_command", "failed_approach", "known_issue", "lesson_learned", "configuration", "workflow", "user_preference")
LEVELS = ("HIGH", "MEDIUM", "LOW")
#: Fixed value: signs of a promoted fact.
FACT = 800


def by_keywords(text: Column, a: Iterable[str] = TECHNICAL, b: Iterable[str] = CREATIVE, names: tuple[str, str] = ("TECHNICAL", "CREATIVE")) -> Column:
    """struct(label, confidence, reasons): a side wins with two hits or more and twice the other's."""
    answer = lambda label, confidence, reasons: F.struct(F.lit(label).alias("label"), F.round(confidence, 2).alias("confidence"), F.slice(F.array_sort(reasons), 1, 6).alias("reasons"))
    sure = lambda n: F.least(F.lit(0.98), F.lit(0.70) + 0.08 * n)

    def judged(found: Column) -> Column:
        ha, hb = found.a, found.b
        na, nb = F.size(ha), F.size(hb)
        return (
            F.when((na >= 2) & (na >= 2 * nb), answer(names[0], sure(na), ha))
            .when((nb >= 2) & (nb >= 2 * na), answer(names[1], sure(nb), hb))
            .when((na > 0) & (nb > 0), answer("SHARED", F.lit(0.55), F.concat(ha, hb)))
            .otherwise(answer("UNKNOWN", F.lit(0.25), F.concat(ha, hb)))
        )

    # In an array of one the hits are found once, whichever branch is taken.
    return F.get(F.transform(F.array(F.struct(hits(text, a).alias("a"), hits(text, b).alias("b"))), judged), F.lit(0))


def priority(title: Column, text: Column, a: Iterable[str] = TECHNICAL, b: Iterable[str] = CREATIVE) -> Column:
    low = F.concat(title, F.lit("\n"), text)
    na, nb = F.size(hits(low, a)), F.size(hits(low, b))
    return F.when((na >= 2) & (na > nb), 100 + na).when((nb >= 2) & (nb > na), 15 + nb).otherwise(0)


def projects_for(given: Column, text: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """Names whose patterns occur in text, and those given, made safe for file names."""
    here = found(F.lower(text), sorted({t for p in patterns.values() for t in p}))
    named = F.array(*[F.when(F.arrays_overlap(here, lits(p).cast("array<string>")), F.lit(name)) for name, p in patterns.items()])
    every = F.array_union(F.filter(named, lambda x: x.isNotNull()), F.coalesce(given, F.array().cast("array<string>")))
    safe = F.transform(every, lambda x: F.substring(F.regexp_replace(x, "[^A-Za-z0-9_-]+", "-"), 1, 80))
    return F.array_sort(F.array_distinct(F.filter(safe, lambda x: x != "")))


def guarded(label: Column, confidence: Column, fallback: Column, labels: tuple[str, str] = ("TECHNICAL", "CREATIVE")) -> Column:
    """struct(label, confidence) of a model's answer held against by_keywords(): the label in any case, a
    confidence of 0 as none, and no more than .69 where the fallback knew nothing and the answer does."""
    a, b = labels
    said = F.upper(label)
    named = F.when(said.isin(a, b, "SHARED", "UNKNOWN"), said).otherwise(fallback.label)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nullif(confidence, F.lit(0.0)), fallback.confidence)))
    against = ((named == a) & (fallback.label == b)) | ((named == b) & (fallback.label == a))
    weak = (fallback.label == "UNKNOWN") & (named != "UNKNOWN")
    return F.struct(F.when(against, "UNKNOWN").otherwise(named).alias("label"), F.when(against, 0.30).when(weak, F.least(sure, F.lit(0.69))).otherwise(sure).alias("confidence"))


def capped(c: Column, limit: int = 12) -> Column:
    return safe_list(c, limit)


def promoted(analyses: DataFrame, label: str = "TECHNICAL", least: float = 0.80, most: int = 10) -> DataFrame:
    """Memories (fact, fact_type, temporal_status, confidence) of sure analyses, which have title, created_at and
    source_file too: the first most of each conversation, without repeats, and where they are from."""
    origin = F.to_json(F.struct("conversation_id", "title", "created_at", "source_file"), {"ignoreNullFields": "false"})
    sure = analyses.filter((F.col("label") == label) & (F.col("confidence") >= least))
    rows = sure.select("conversation_id", F.lower("label").alias("namespace"), origin.alias("provenance"), F.posexplode(F.slice("memories", 1, most)).alias("pos", "m")).filter("m.fact is not null")
    level = F.upper(F.coalesce("m.confidence", F.lit("MEDIUM")))
    cut = lambda c, default: F.substring(F.coalesce(F.col(f"m.{c}"), F.lit(default)), 1, 80).alias(c)
    facts = rows.select("conversation_id", "namespace", "pos", F.substring("m.fact", 1, FACT).alias("fact"), cut("fact_type", "technical"), cut("temporal_status", "dated"), F.when(level.isin(*LEVELS), level).otherwise("MEDIUM").alias("confidence"), "provenance")
    return facts.withColumn("_n", F.row_number().over(W.partitionBy("conversation_id", "fact").orderBy("pos"))).filter("_n = 1").drop("_n")


def normal_facts(df: DataFrame, facts: str, projects: Iterable[str] | str, limit: int = 30, size: int = 1200, categories: Iterable[str] = CATEGORIES, dated: bool = False) -> DataFrame:
    """Rows of an array of (project, category, statement, evidence, confidence): at most limit of
    each, trimmed and cut, with a statement, evidence and an allowed project and category. projects
    is a list, or the name of an array column with the projects of the row. With dated, facts have
    a temporal_status ('historical' where none is given), and those whose confidence is no level go."""
    cut = lambda c, n: F.substring(trim(F.coalesce(F.col(f"f.{c}"), F.lit(""))), 1, n)
    level = F.upper(F.coalesce("f.confidence", F.lit("MEDIUM")))
    others = [c for c in df.columns if c != facts]
    rows = df.select(*others, F.posexplode(F.slice(facts, 1, limit)).alias("pos", "f"))
    out = rows.select(*others, "pos", cut("project", 80).alias("project"), trim(F.coalesce("f.category", F.lit(""))).alias("category"), cut("statement", size).alias("statement"), cut("evidence", size).alias("evidence"), F.when(level.isin(*LEVELS), level).otherwise("MEDIUM").alias("confidence"), *([F.substring(trim(F.coalesce("f.temporal_status", F.lit("historical"))), 1, 80).alias("temporal_status"), level.isin(*LEVELS).alias("_known")] if dated else []))
    if dated:
        out = out.filter("_known").drop("_known")
    allowed = F.array_contains(projects, F.col("project")) if isinstance(projects, str) else F.col("project").isin(*projects)
    return out.filter((F.col("statement") != "") & (F.col("evidence") != "") & allowed & F.col("category").isin(*categories))


def replace_facts(stored: DataFrame, new: DataFrame, key: str = "conversation_id", analyses: DataFrame | None = None, label: str = "TECHNICAL") -> DataFrame:
    """stored with all facts of the conversations in new replaced; with analyses (key, label), only of those that
    have the label, and what new says of others is left out."""
    if analyses is not None:
        new = new.join(analyses.filter(F.col("label") == label).select(key).distinct(), key, "left_semi")
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*stored.columns))


def add_facts(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored and those of new whose key it lacks, the first of each."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").select(*stored.columns)
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


Predictor = Callable[[pd.Series], list[str]]


def predicted(df: DataFrame, text: str, predictor: Predictor, template: str = "{text}", size: int = 14_000, schema: str = "struct<label:string,confidence:double>") -> DataFrame:
    """df with answer (parsed from a model's JSON) and error: what failed is a row, not an exception."""

    @F.pandas_udf("struct<reply:string,error:string>")
    def ask(texts: pd.Series) -> pd.DataFrame:
        prompts = texts.fillna("").map(lambda t: template.format(text=t[:size]))
        try:
            return pd.DataFrame({"reply": predictor(prompts), "error": None})
        except Exception as e:  # the user's model may fail in any way
            return pd.DataFrame({"reply": [None] * len(texts), "error": [f"{type(e).__name__}: {e}"] * len(texts)})

    out = df.withColumn("_a", ask(text)).withColumn("answer", F.from_json("_a.reply", schema))
    broken = F.col("_a.reply").isNotNull() & F.try_parse_json("_a.reply").isNull()
    return out.withColumn("error", F.coalesce("_a.error", F.when(broken, "not JSON"))).drop("_a")
