"""An inverted index of items, kept as Parquet in order of terms, and BM25 search that opens only what it needs.

Items are taken in spans of ``SPAN``. The index has a row for each term and span: how many items of the span have the
term, its largest count, the fewest words of such an item, and the items themselves with counts and words. From the
largest count and the fewest words follows a bound of the score that holds for any statistics, so a batch of new items
is a further segment whose rows are added, and statistics are sums over all segments. A row without a term holds what
is known of the whole span: its items and their words.

Files hold ranges of terms in order with small row groups, so a search for some terms reads their rows alone (the
filter reaches the scan). It first adds up the bounds of each span, opens the most promising ones, and then only those
that may still hold one of the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.operators.search import B, ITEM_COLUMNS, K1, query_words, word_weight
from tallgrass.sources.scratch import scratch

#: Items of a span, spans that are opened first, and bytes of a row group.
SPAN, FIRST, GROUP = 4096, 4, 4 << 20
#: What each byte is to a text in lower case: itself in a word of [a-z0-9], else a space.
IN_WORD = np.full(256, 0x20, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B)):
    IN_WORD[_c] = _c


def _tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code and text of each word, the words that codes stand for) of texts without nulls."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    plain = IN_WORD[np.frombuffer(data, np.uint8)[off[0] : off[-1]]] if data is not None else np.zeros(0, np.uint8)
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(off - off[0]), pa.py_buffer(plain)))
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    flat = words.flatten()
    real = pc.not_equal(flat, "")  # at the ends of a text
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), text[real.to_numpy(zero_copy_only=False)], coded.dictionary.to_pylist()


def _span(number: int, ids: pa.Array, texts: pa.StringArray, names: list[str]) -> pa.RecordBatch:
    """The rows of a span: its terms in order of code, the items of each in their order."""
    code, text, terms = _tokens(texts)
    words = np.bincount(text, minlength=len(texts)).astype(np.int64)
    of, count = np.unique(code * len(texts) + text, return_counts=True)
    code, item = of // max(len(texts), 1), of % max(len(texts), 1)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    off = pa.array(np.append(first, [len(code), len(code)]), pa.int32())  # the last row is that without a term
    lists = [ids.take(pa.array(item)), pa.array(count, pa.int32()), pa.array(words[item], pa.int32())]
    most, least = (np.maximum.reduceat(count, first), np.minimum.reduceat(words[item], first)) if len(first) else (first, first)
    plain = [pa.array([*terms, ""], pa.string()), pa.array(np.full(len(first) + 1, number)), pa.array(np.append(np.diff(np.append(first, len(code))), len(texts)), pa.int32())]
    plain += [pa.array(np.append(most, words.sum())), pa.array(np.append(least, 0), pa.int32())]
    return pa.RecordBatch.from_arrays([*plain, *(pa.ListArray.from_arrays(off, x) for x in lists)], names)


def _inverted(segment: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = segment << 40 | TaskContext.get().partitionId() << 20, None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= SPAN:
                part, held, number = held.slice(0, SPAN), held.slice(SPAN), number + 1
                yield _span(number - 1, part.column(0).combine_chunks(), part.column(1).combine_chunks(), names)
        if held is not None and held.num_rows:
            yield _span(number, held.column(0).combine_chunks(), held.column(1).combine_chunks(), names)

    return rows


def add_segment(items: DataFrame, folder: str, columns: list[str] = ITEM_COLUMNS) -> None:
    """Add items (id and columns) to the index in folder, which may be new. Items that are there already are not looked for."""
    spark = items.sparkSession
    held = read(spark, folder)
    segment = 0 if held is None else (held.filter("term = ''").agg(F.max("span")).first()[0] >> 40) + 1
    kind = items.schema["id"].dataType.simpleString()
    schema = f"term string, span long, n int, most long, least int, ids array<{kind}>, counts array<int>, words array<int>"
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    inverted = items.select("id", text.alias("text")).mapInArrow(_inverted(segment, [c.split(" ")[0] for c in schema.split(", ")]), schema)
    # Ranges are chosen from a first look at the rows: they are written, so that texts are not taken apart twice.
    path = scratch(spark, "inverted")
    inverted.write.parquet(path)
    ordered = spark.read.schema(schema).parquet(path).repartitionByRange("term", "span").sortWithinPartitions("term", "span")
    ordered.write.mode("append").option("parquet.block.size", GROUP).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index in folder, or None where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return spark.read.parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def _part(idf: float, count: Column, words: Column, mean: float) -> Column:
    return F.lit(idf) * count * (K1 + 1) / (count + K1 * (1 - B + B * words / F.lit(mean)))


class Search:
    """The steps of a search: statistics of all segments, bounds of spans, and the scores of some spans."""

    def __init__(self, index: DataFrame, query: str, mode: str = "and") -> None:
        self.words, self.mode = query_words(query, mode), mode
        lists = index.filter(F.col("term").isin("", *self.words))
        known = {r.term: (r.n, r.most) for r in lists.groupBy("term").agg(F.sum("n").alias("n"), F.sum("most").alias("most")).collect()}  # a row for each word
        n, total = known.get("", (0, 0))
        self.mean = total / n if n and total else 1.0
        self.idf = {w: word_weight(n, known.get(w, (0,))[0]) for w in self.words}
        self.lists = lists.filter("term <> ''")

    def _each(self, count: Column, words: Column) -> list[Column]:
        """For each word what it adds to a score, of rows of that word."""
        return [F.max(F.when(F.col("term") == w, _part(self.idf[w], count, words, self.mean))) for w in self.words]

    def bounds(self) -> DataFrame:
        """span and the most that an item of it may score."""
        parts = self._each(F.col("most"), F.col("least"))
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        spans = self.lists.groupBy("span").agg(total.alias("bound"), F.count("*").alias("has"))
        return (spans.filter(F.col("has") == len(self.words)) if self.mode == "and" else spans).select("span", "bound")

    def scores(self, spans: DataFrame | None) -> DataFrame:
        """id and score of the items of some spans (of all, if none are given) that have the words."""
        lists = self.lists if spans is None else self.lists.join(spans.select("span"), "span", "left_semi")
        flat = lists.repartition("span").select("span", "term", F.explode(F.arrays_zip("ids", "counts", "words")).alias("x"))
        parts = self._each(F.col("x.counts"), F.col("x.words"))
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        found = flat.groupBy("span", F.col("x.ids").alias("id")).agg(total.alias("score"), F.count("*").alias("has"))
        return (found.filter(F.col("has") == len(self.words)) if self.mode == "and" else found).select("id", F.round("score", 12).alias("score"))


def full_text(index: DataFrame, query: str, mode: str = "and", limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """id and rank (negative, best first) of the items of the index that have all or any of the query's words, by BM25.

    Only items of allowed (id and columns to carry), if given, are wanted; statistics are of all items.
    """
    s = Search(index, query, mode)
    if not s.words:  # nothing is asked for
        s.lists = s.lists.limit(0)
    wanted = (lambda df: df) if allowed is None else lambda df: df.join(allowed, "id")
    bounds = s.bounds()
    first = wanted(s.scores(bounds.orderBy(F.desc("bound"), "span").limit(FIRST))).orderBy(F.desc("score"), "id").limit(limit).select("score").collect()  # limit numbers
    least = min(r.score for r in first) if len(first) == limit else 0.0
    # A bound and a score may differ in their last digits.
    found = wanted(s.scores(bounds.filter(F.col("bound") >= least - 1e-9))).withColumn("rank", -F.col("score")).drop("score")
    return found.orderBy("rank", "id").limit(limit)


def search_items(index: DataFrame, items: DataFrame, conversations: DataFrame, query: str, project: str | None = None, category: str | None = None, limit: int = 20, mode: str = "and") -> DataFrame:
    """full_text() over knowledge items and their conversations, for a project (a slug) and a category where they are named."""
    for name, value in (("project_slug", project), ("category", category)):
        if value is not None:
            items = items.filter(F.col(name) == value)
    c = conversations.select(F.col("conversation_id").alias("source_conversation_id"), F.col("title").alias("conversation_title"), "created_at")
    return full_text(index, query, mode, limit, items.select("id", "source_conversation_id").join(c, "source_conversation_id"))
