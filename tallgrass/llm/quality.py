"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by the shares
of pairs of neighbouring sign classes in it (letters by case, digits, space, each common
punctuation sign, all beyond ASCII), the share of its words that are distinct or repeat the
one before, and its mean word length. An encoder makes a vector of it; gated attention
(tanh times sigmoid, softmax over the bag) weighs the passages; a logistic layer scores the
weighted sum. All of it is learned together, by Adam, from document labels.

The model is fitted in one task on at most ``SAMPLE`` labelled texts, of the ids with the
smallest hashes, a repeated row once, and on ``BAG`` passages at even distances of a longer
one. Every document is scored on all its passages: a text of more than ``RUN`` bytes is cut
into runs of whole passages, whose attention is added up with a running maximum, so what a
task holds does not grow with the passages of a text.

Defined results. A null or empty text, and one without words, is one passage of zeros.
Without labels of both kinds every score is the share of label 1 (0.5 without labels). Of
several labels for one id the largest counts. Repeated rows and rows without an id are
scored one for one. Columns other than doc_id, text and quality are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import bloom, crc_of_id, fresh, release, settle, trimmed

PASSAGE, SAMPLE, HIDDEN, GATE, EPOCHS, BAGS, RATE, DECAY, SEED = 50, 3000, 32, 16, 30, 64, 0.004, 1e-4, 7
THRESHOLD = 0.3
BAG, RUN = 1000, 1 << 20
SIGNS = b" \n.,!?#$%&*|;:-'\"()/"
KINDS = len(SIGNS) + 5
CLASS = np.full(256, KINDS - 1, np.int16)
CLASS[0x80:] = KINDS - 2
CLASS[0x30:0x3A] = KINDS - 3
CLASS[0x41:0x5B] = KINDS - 4
CLASS[0x61:0x7B] = KINDS - 5
for _k, _c in enumerate(SIGNS):
    CLASS[_c] = _k
DIM = KINDS * KINDS + 3


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of DIM for each passage, offsets of documents); each document has one passage at least."""
    rows = len(off) - 1
    s, e, row = V.words(buf, off)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))
    held = np.maximum(1, -(-n // PASSAGE))
    at = np.concatenate(([0], np.cumsum(held)))
    x = np.zeros((at[-1], DIM), np.float32)
    if len(s):
        nth = np.arange(len(s)) - first[row]
        own = at[row] + nth // PASSAGE
        heads = np.flatnonzero(nth % PASSAGE == 0)
        ends = np.minimum(np.append(s[heads[1:]], len(buf)), off[row[heads] + 1])
        edges = np.column_stack((s[heads], ends)).ravel()  # a passage, what is between it and the next, ...
        slots = np.column_stack((own[heads], np.full(len(heads), -1))).ravel()
        width = KINDS * KINDS
        for lo in range(int(edges[0]), len(buf) - 1, RUN):  # pairs of neighbours within a passage, by their first byte
            hi = min(lo + RUN, len(buf) - 1)
            i, j = np.searchsorted(edges, (lo, hi), "right") - (1, 0)
            held = slots[i:j][slots[i:j] >= 0]
            if not len(held):
                continue
            of_byte = np.repeat(slots[i:j] - held[0], np.diff(np.clip(np.append(edges[i:j], hi + 1), lo, hi + 1)))
            pair = CLASS[buf[lo:hi]] * KINDS + CLASS[buf[lo + 1 : hi + 1]]
            same = (of_byte[:-1] == of_byte[1:]) & (of_byte[:-1] >= 0)
            n = int(held[-1] - held[0]) + 1
            x[held[0] : held[0] + n, :width] += np.bincount((of_byte[:-1] * width + pair)[same], minlength=n * width).reshape(-1, width)
        x[:, :width] = np.sqrt(x[:, :width] / np.maximum(x[:, :width].sum(axis=1), 1)[:, None])
        with np.errstate(over="ignore"):
            h = V.hashes(buf, s, e)
        size = np.maximum(np.bincount(own, minlength=at[-1]), 1)
        order = np.lexsort((h, own))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
        x[:, width] = np.bincount(own[order][new], minlength=at[-1]) / size
        again = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1])) + 1
        x[:, width + 1] = np.bincount(own[again], minlength=at[-1]) / size
        x[:, width + 2] = np.minimum(np.bincount(own, e - s, minlength=at[-1]) / size, 40) / 20
    return x, at


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(m: dict, x: np.ndarray, at: np.ndarray) -> dict:
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
    a = (t * g) @ m["w"]
    sizes = np.diff(at)
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at[:-1]), sizes))
    a /= np.repeat(np.add.reduceat(a, at[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ m["c"] + m["d"])}


def runs(buf: np.ndarray) -> Iterator[np.ndarray]:
    """The passages of one text, about RUN bytes at a time."""
    at, size = 0, RUN
    while at + size < len(buf):
        s, _, _ = V.words(buf[at : at + size], np.array([0, size]))
        k = (len(s) - 1) // PASSAGE * PASSAGE  # the last word may go on, or end a passage
        if k <= 0:
            size *= 2
            continue
        yield passages(buf[at : at + s[k]], np.array([0, s[k]]))[0]
        at, size = at + int(s[k]), RUN
    yield passages(buf[at:], np.array([0, len(buf) - at]))[0]


def folded(m: dict, parts: Iterable[np.ndarray]) -> float:
    """The score of one bag whose passages come in parts."""
    top, total, z = -np.inf, 0.0, 0.0
    for x in parts:
        h = np.tanh(x @ m["W"] + m["b"])
        a = ((np.tanh(h @ m["V"]) * sigmoid(h @ m["U"])) @ m["w"]).astype(np.float64)
        new = max(top, float(a.max()))
        e = np.exp(a - new)
        total, z = total * np.exp(top - new) + e.sum(), z * np.exp(top - new) + e @ h
        top = new
    return float(sigmoid(z / total @ m["c"] + m["d"]))


def scores(m: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The score of each text of a batch."""
    out = [np.zeros(0)]
    for i, j in V.spans(off, RUN):
        if "p" in m:
            out.append(np.full(j - i, m["p"]))
        elif off[j] - off[i] > RUN:  # one text
            out.append(np.array([folded(m, runs(buf[off[i] : off[j]]))]))
        else:
            out.append(forward(m, *passages(buf[off[i] : off[j]], off[i : j + 1] - off[i]))["p"].astype(np.float64))
    return np.concatenate(out)


def bags(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passages to learn from, and how many each text has: BAG at most, at even distances."""
    for i, j in V.spans(off, RUN):
        long = off[j] - off[i] > RUN
        x, at = (None, None) if long else passages(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        if long:
            every = sum(len(part) for part in runs(buf[off[i] : off[j]]))
            wanted, seen, found = np.unique(np.arange(min(BAG, every)) * every // min(BAG, every)), 0, []
            for part in runs(buf[off[i] : off[j]]):
                found.append(part[wanted[(wanted >= seen) & (wanted < seen + len(part))] - seen])
                seen += len(part)
            x, at = np.concatenate(found), np.array([0, len(wanted)])
        n = np.diff(at)
        if n.max() > BAG:
            pick = np.concatenate([at[k] + (np.arange(min(BAG, n[k])) * n[k] // min(BAG, n[k])) for k in range(len(n))])
            x, n = x[pick], np.minimum(n, BAG)
        yield x, n


def gradients(m: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    f, sizes = forward(m, x, at), np.diff(at)
    dp = (f["p"] - y) / len(y)
    dz = np.repeat(dp[:, None] * m["c"], sizes, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    da = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), sizes))
    dt, dg = da[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ dp, "d": dp.sum()}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    rng = np.random.default_rng(SEED)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / sd
    make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    m = {"W": make(DIM, HIDDEN), "b": np.zeros(HIDDEN), "V": make(HIDDEN, GATE), "U": make(HIDDEN, GATE), "w": make(GATE), "c": make(HIDDEN), "d": np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))}
    one, two, step = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BAGS):
            bags = np.sort(order[i : i + BAGS])
            pick = np.concatenate([np.arange(at[k], at[k + 1]) for k in bags])
            g = gradients(m, x[pick], np.concatenate(([0], np.cumsum(np.diff(at)[bags]))), y[bags])
            step += 1
            for k in m:
                d = g[k] + (DECAY * m[k] if k in "WVU" else 0)
                one[k], two[k] = 0.9 * one[k] + 0.1 * d, 0.999 * two[k] + 0.001 * d**2
                m[k] = m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    m["W"], m["b"] = m["W"] / sd[:, None], m["b"] - (mean / sd) @ m["W"]
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from rows of labels (doc_id, quality); {'p': share} if there is no model to fit."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    keys = settle(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "sample")
    known = bloom(docs.select("doc_id", "text"), F.col("doc_id"), keys, F.col("doc_id")).join(F.broadcast(keys), "doc_id")

    def train(batches):
        xs, sizes, ys = [], [], []
        for b in batches:
            buf, off = V.text_bytes(b.column(0))
            for x, n in bags(buf, off):
                xs.append(x)
                sizes.append(n)
            ys.append(b.column(1).to_numpy().astype(np.float32))
        y = np.concatenate(ys) if ys else np.zeros(0, np.float32)
        if len(set(y.tolist())) < 2:
            model = {"p": float(y.mean()) if len(y) else 0.5}
        else:
            model = fit(np.concatenate(xs), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = known.select("text", F.when(F.col("quality") > 0, 1).otherwise(0).alias("y"), F.xxhash64("doc_id", "text").alias("h"))
    made = rows.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).select("text", "y").mapInArrow(trimmed(train), "model binary").first()
    return pickle.loads(made.model) if made else {"p": 0.5}  # without rows there is no task


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, h (a hash of the text), score of each row."""

    def rows(batches):
        for b in batches:
            buf, off = V.text_bytes(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores(model, buf, off))], ["doc_id", "h", "score"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(trimmed(rows), "doc_id long, h long, score double")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of THRESHOLD or more, with all their columns."""
    model = learn(docs, labels.filter(~held_out()))
    if "p" in model:
        return docs if model["p"] >= THRESHOLD else docs.limit(0)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = scores(model, *V.text_bytes(texts))
        release()
        return pa.array(out)

    (mark,) = fresh(docs, "mark")  # only texts go to Python, and only scores come back
    return docs.withColumn(mark, scored("text")).filter(F.col(mark) >= THRESHOLD).drop(mark)


def held_out():
    return F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, held_out, score, predicted; labels of ids with crc32(doc_id) mod 5 = 0 are not learned from."""
    model = learn(docs, labels.filter(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", "h", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
