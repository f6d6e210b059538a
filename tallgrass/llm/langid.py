"""Language ID: nearest centroid over normalised TF-IDF vectors of byte n-grams.

A text's vector counts its runs of one to three bytes (A-Z lower-cased, other ASCII signs
taken as space), hashed to ``DIM`` places, as log(1 + count) times the place's IDF, at unit
length. IDF comes from all training rows. Each language's vectors, of at most ``SAMPLE``
training texts with the smallest hash of id and text (a repeated row once), are clustered into
``CLUSTERS`` centroids by spherical k-means. The prediction is the language of the centroid
nearest by cosine, which is the score. ``accepted`` is the distance-based rejection: false if
the cosine is below all but ``TAIL`` of what the centroid's own training rows reach.

Every language is learned. Centroids of ``LANGUAGES`` languages at a time are sent to the
tasks; where there are more, the texts are scored block after block and the best is kept.

Defined results. A null text, and one without a letter, is ``und`` with score 0 and not
accepted; so is every text if there is nothing to learn from. Ties go to the language first
in order. Repeated rows and rows without an id are kept one for one; a row without an id is
not learned from. An empty table gives an empty one. Columns other than doc_id, text and lang
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as V
from .common import bloom, crc_of_id, settle, trimmed

DIM, SAMPLE, CLUSTERS, ROUNDS, LANGUAGES, TAIL = 8192, 1500, 4, 8, 256, 0.01
#: Rows of a language that are ranked to find its sample, as a multiple of SAMPLE; which they are is a matter of hashes.
SPARE = 4
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x80] = 0x20
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
AT_ONCE = 256


def _place(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int32)


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of DIM n-gram counts."""
    b = FOLD[buf].astype(np.uint32)
    one = _place(b + np.uint32(1 << 24))
    two = _place((b[:-1] << np.uint32(8) | b[1:]) + np.uint32(1 << 25))
    three = _place(b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)
    out = np.zeros((len(off) - 1, DIM), np.float32)
    for k, (i, j) in enumerate(zip(off[:-1], off[1:])):
        if j > i:
            out[k] = np.bincount(np.concatenate((one[i:j], two[i : j - 1], three[i : max(i, j - 2)])), minlength=DIM)
    return out


def vectors(buf: np.ndarray, off: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts(buf, off)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-9)[:, None]


def _slices(col):
    buf, off = V.text_bytes(col)
    for i, j in V.spans(off):
        for k in range(i, j, AT_ONCE):
            m = min(j, k + AT_ONCE)
            yield k, m, buf[off[k] : off[m]], off[k : m + 1] - off[k]


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    def rows(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for i, j, buf, off in _slices(b.column(0)):
                df += (counts(buf, off) > 0).sum(axis=0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIM), -1).astype(np.int32)), pa.array(np.append(df, n))], ["place", "n"])

    found = docs.select("text").mapInArrow(trimmed(rows), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # DIM + 1 rows
    df = np.zeros(DIM + 1)
    df[found["place"].to_numpy()] = found["n"].to_numpy()
    return df[:DIM], int(df[DIM])


def cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cosine of each row with its own), started from rows far from each other."""
    centres = [x[int(np.argmax(x @ x.mean(axis=0)))]]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
    return c, x @ c.T


def sample(rows: DataFrame) -> DataFrame:
    """lang and text of at most SAMPLE rows (lang, text, h) of each language, those with the smallest hashes."""
    keys = settle(rows.select("lang", F.shiftrightunsigned("h", 1).alias("o"), "h").distinct(), "keys")
    sizes = keys.groupBy("lang").agg(F.count("*").alias("n"))
    # Of a large language only hashes below a bound are ranked, so that no window holds more than a few samples.
    few = keys.join(sizes, "lang").filter(F.col("o") / 2.0**63 * F.col("n") <= SPARE * SAMPLE)
    ranked = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("o", "h"))).filter(F.col("k") <= SAMPLE)
    taken = settle(ranked.select("lang", "h"), "sample")
    return bloom(rows, F.col("h"), taken, F.col("h")).join(taken, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def learn(docs: DataFrame) -> tuple[list[str], DataFrame, np.ndarray]:
    """(languages in order, lang, k, centre and floor of each centroid, idf) from rows with text and lang."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    df, n = document_frequency(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def fit(t: pa.Table) -> pa.Table:
        x = np.concatenate([vectors(buf, off, idf) for _, _, buf, off in _slices(t.column("text"))])
        c, cos = cluster(x, CLUSTERS, ROUNDS)
        own = np.argmax(cos, axis=1)
        floor = [float(np.quantile(cos[own == i, i], TAIL)) if (own == i).any() else 1.0 for i in range(len(c))]
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(c)), "k": pa.array(range(len(c)), pa.int32()), "centre": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary()), "floor": pa.array(floor, pa.float64())})

    made = settle(sample(rows).groupBy("lang").applyInArrow(fit, "lang string, k int, centre binary, floor double"), "centroids")
    return sorted(r.lang for r in made.select("lang").distinct().collect()), made, idf  # names alone


def _has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    letter = (FOLD[buf] != 0x20) & (buf < 0x80)
    high = buf >= 0x80
    run = np.concatenate(([0], np.cumsum(letter)))
    out = run[off[1:]] > run[off[:-1]]
    for k in np.flatnonzero(~out):
        if high[off[k] : off[k + 1]].any():
            out[k] = any(ch.isalpha() for ch in buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _nearer(docs: DataFrame, langs: list[str], centres: np.ndarray, floors: np.ndarray, idf: np.ndarray) -> DataFrame:
    """docs (doc_id, text, and what blocks before found) with the best of those and of these centroids."""
    schema = docs.select("doc_id", "text", "lang_pred", "score", "accepted").schema

    def rows(batches):
        for b in batches:
            for i, j, buf, off in _slices(b.column(1)):
                was, (pred, score, ok) = b.slice(i, j - i), (c.slice(i, j - i) for c in b.columns[2:])
                some = _has_letter(buf, off)
                if len(langs) and some.any():
                    cos = vectors(buf, off, idf) @ centres.T
                    best = np.argmax(cos, axis=1)
                    near = np.clip(cos[np.arange(j - i), best], 0, 1).astype(np.float64)
                    better = some & ((near > score.to_numpy()) | (pred.is_null().to_numpy(zero_copy_only=False)))
                    score = pa.array(np.where(better, near, score.to_numpy()))
                    ok = pa.array(np.where(better, near >= floors[best], ok.to_numpy(zero_copy_only=False)))
                    pred = pa.array([langs[k] if s else p for k, s, p in zip(best, better, pred.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([was.column(0), was.column(1), pred, score, ok], schema.names)

    return docs.mapInArrow(trimmed(rows), schema)


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row."""
    langs, made, idf = model
    out = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    for i in range(0, len(langs), LANGUAGES):
        block = sorted(made.filter(F.col("lang").between(langs[i], langs[min(i + LANGUAGES, len(langs)) - 1])).collect())  # LANGUAGES * CLUSTERS rows
        out = settle(out, "nearest") if i else out
        out = _nearer(out, [r.lang for r in block], np.array([np.frombuffer(r.centre, np.float32) for r in block]), np.array([r.floor for r in block]), idf)
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score", "accepted")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; rows with crc32(doc_id) mod 4 = 2 are held out."""
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = learn(docs.filter(~held))
    out = predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
