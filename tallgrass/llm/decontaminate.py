"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations alone.

A window is ``width`` consecutive words of an item; an item of fewer words is one window.
A shingle is one word, since an item may have no more. For a window to be contained whole
in a document its rarest word must be there: with a required containment of 1 the necessary
prefix of a set ordered by rarity is one shingle.

1. The texts are cut into words once, and the words written.
2. The words of the items are counted over all documents; each window takes its rarest
   word as its prefix. A window with a word that no document has is out.
3. Document words that are prefixes keep the ``width`` - 1 words on either side.
4. Each meets the item places of the same word. Lined up there, the equal words to the
   left and right are counted; a run as long as a window covers every window through
   that place, and is a hit. Bounds on position and length are part of that count.
5. A document's hits are united as intervals.

A table of item words is broadcast only while it has at most ``broadcast_rows`` rows and
``BROADCAST_BYTES`` bytes as text; beyond that the joins shuffle, one narrow row for each
document word, and only documents with prefix words are fetched again.

Defined results. Null and empty texts have no words. Items without an id, or without
words, have no windows; without items nothing is contaminated. Every row of docs gives one
row, repeated rows and rows without an id too; an empty table gives none. Columns other
than doc_id, item_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, lower_ascii, settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 13
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def equal_run(a: Column, b: Column) -> Column:
    """How many pairs from the start of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def small(df: DataFrame, rows: int) -> bool:
    """Whether df is within the bounds of what is broadcast."""
    n, size = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def checked(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if small(df, most) else df


def cut(docs: DataFrame) -> DataFrame:
    """u (a number), doc_id, h (a hash of the text) and dw (its words) of each row, written once."""
    return settle(docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("dw")).withColumn("u", F.monotonically_increasing_id()), "words")


def anchors(base: DataFrame, items: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """w, item_id, need, left (nearest word first) and right of each place of an item that is some window's rarest word."""
    own = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("iw")).filter("size(iw) > 0").distinct()
    own = settle(own.withColumn("k", F.monotonically_increasing_id()), "items")
    vocabulary = checked(settle(own.select(F.explode("iw").alias("w")).distinct(), "vocabulary"), broadcast_rows)
    counts = base.select(F.explode("dw").alias("w")).join(vocabulary, "w").groupBy("w").agg(F.count("*").alias("n"))
    need = F.least(F.lit(width), F.size("iw"))
    # Of windows of an item with the same words one is enough.
    every = own.select("item_id", "k", need.alias("need"), F.explode(F.sequence(F.lit(0), F.size("iw") - need)).alias("start"), "iw")
    windows = every.select("item_id", "k", "start", F.slice("iw", F.col("start") + 1, F.col("need")).alias("win"))
    windows = windows.groupBy("item_id", F.array_join("win", " ").alias("win")).agg(F.min(F.struct("k", "start")).alias("at")).select("at.k", "at.start", F.split("win", " ").alias("win"))
    places = windows.select("k", "start", F.size("win").alias("need"), F.posexplode("win").alias("j", "w")).join(counts, "w")
    per_window = places.groupBy("k", "start", "need").agg(F.min(F.struct("n", "w", (F.col("start") + F.col("j")).alias("q"))).alias("least"), F.count("*").alias("found"))
    best = per_window.filter(F.col("found") == F.col("need")).select("k", F.col("least.w").alias("w"), F.col("least.q").alias("q")).distinct().join(own, "k")
    left = F.reverse(F.slice("iw", F.greatest(F.lit(1), F.col("q") - width + 2), F.least(F.col("q"), F.lit(width - 1))))
    return best.select("w", "item_id", need.alias("need"), left.alias("left"), F.slice("iw", F.col("q") + 2, width - 1).alias("right"))


def hits(base: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """u, item_id, lo and hi: words lo..hi-1 of row u of base (as by cut()) are in windows of the item."""
    at = settle(anchors(base, items, width, broadcast_rows), "anchors")
    tokens = settle(at.select("w").distinct(), "prefixes")
    if small(tokens, broadcast_rows):
        found = base.select("u", "dw", F.posexplode("dw").alias("pos", "w")).join(F.broadcast(tokens), "w")
    else:
        places = base.select("u", F.posexplode("dw").alias("pos", "w")).join(tokens, "w").groupBy("u").agg(F.collect_list(F.struct("pos", "w")).alias("places"))
        found = base.select("u", "dw").join(places, "u").select("u", "dw", F.inline("places"))
    left = F.reverse(F.slice("dw", F.greatest(F.lit(1), F.col("pos") - width + 2), F.least(F.col("pos"), F.lit(width - 1))))
    near = found.select("u", "w", "pos", left.alias("dl"), F.slice("dw", F.col("pos") + 2, width - 1).alias("dr"))
    # zip_with pads the shorter side, and a padded pair is not equal, so runs end at either text's end.
    lined = near.join(checked(at, broadcast_rows), "w").withColumns({"l": equal_run(F.col("dl"), F.col("left")), "r": equal_run(F.col("dr"), F.col("right"))})
    good = lined.filter(F.col("l") + F.col("r") + 1 >= F.col("need"))
    return good.select("u", "item_id", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r") + 1).alias("hi"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    base = cut(docs)
    found = settle(hits(base, items, width, broadcast_rows), "hits")  # read twice below, and small against the texts
    before = F.max("hi").over(W.partitionBy("u").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(before, F.col("lo"))))
    spans = found.groupBy("u", "lo").agg(F.max("hi").alias("hi")).withColumn("new", new).groupBy("u").agg(F.sum("new").alias("n_hit"))
    ids = found.select("u", F.col("item_id").cast("string").alias("item")).distinct().groupBy("u").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = base.select("u", "doc_id", "h", F.size("dw").cast("long").alias("n_words")).join(spans.join(ids, "u"), "u", "left")
    n_hit, n_items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce(F.size("items"), F.lit(0))
    out = out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.greatest(n_items, F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    d, h = fresh(docs, "d", "h")
    bad = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
