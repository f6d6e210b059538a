"""Quality rules: documents that are laid out or worded unlike their language.

A reference of a language holds the shares of ``CLASSES`` classes of signs in its documents, and those of its common
words: words (letters, digits and all beyond ASCII, A-Z lower-cased) that are at least one in ``RARE`` of its words. A
document is compared with the reference of each language and judged by the nearest, by the Jensen-Shannon distance (the
root of the divergence in bits) of its shares from those of the reference. It is rejected where the distance of its
classes of signs, or of its common words, is more than ``FAR_SIGNS`` or ``FAR_WORDS`` and what chance adds to it in a
text of that length; texts of less than ``LEAST_SIGNS`` signs or ``LEAST_WORDS`` words aren't judged.

References come from counts over all documents with a language: a task adds up those of a slice of texts (``SLICE``
bytes), Spark those of all slices, and only common words leave the cluster. A language has a reference if it has at least a hundredth of all words, so there are at most a hundred, each of at most
RARE words: what the driver and the tasks hold has a bound. Documents of other languages are only judged by the rules
below; those without a language by the nearest reference.

Before that, a document fails with less than 20 words, or where over 30 % of its words are in windows of eight words that
the text has twice or more.

Defined results: null and empty texts have no words and fail. Repeated rows and rows without an id are judged one by one.
Other columns do not matter, whatever their names; without a column ``lang`` no document has a language. Words, windows
and lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import settle, trimmed

#: Words that are one in so many of a language are common; a language needs one in so many of all words.
RARE, FEW = 500, 100
#: Bounds of the distances, and the least signs and words of a text that is judged.
FAR_SIGNS, FAR_WORDS, LEAST_SIGNS, LEAST_WORDS = 0.3, 0.3, 200, 50
#: Words of a window, least words, and the most of 100 words that are in repeated windows.
WINDOW, LEAST, REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
#: Bytes of texts whose counts a task adds up before it sends them, and rows of a batch of these.
SLICE, ROWS = 32 << 20, 1 << 16

#: The class of a sign by its first byte: small and capital letters, digits, spaces, line ends and tabs, stops, symbols,
#: controls, signs of two, three and four bytes; the rest of a sign has none.
CLASSES = 11
CLASS = np.full(256, 7, np.int64)
for _k, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), [0x20], range(0x09, 0x0E), b".,;:!?'\"-()", [])):
    CLASS[[*_bytes]] = _k
CLASS[[b for b in range(0x21, 0x7F) if CLASS[b] == 7]] = 6
CLASS[0x80:0xC0], CLASS[0xC0:0xE0], CLASS[0xE0:0xF0], CLASS[0xF0:] = CLASSES, 8, 9, 10
SYMBOL = np.zeros(256, bool)
SYMBOL[[*SYMBOLS]] = True


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of words as references have them."""
    s, e, row = V.words(buf, off, V.ALNUM)
    return V.hashes(buf, s, e), row


def classes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many signs of each class a row has."""
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    return np.bincount(row * (CLASSES + 1) + CLASS[buf], minlength=rows * (CLASSES + 1)).reshape(rows, -1)[:, :CLASSES]


def repeated(h: np.ndarray, row: np.ndarray, rows: int, k: int = WINDOW) -> np.ndarray:
    """How many words of a row are in windows of k words that it has twice or more."""
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
    full = np.flatnonzero(np.arange(len(h)) + k <= first[row + 1]) if len(h) else np.zeros(0, np.int64)
    x = np.zeros(len(full), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = V.mix(x * np.uint64(0xD6E8FEB86659FD93) + h[full + i])
    order = np.lexsort((x, row[full]))
    x, at = x[order], full[order]
    same = (x[1:] == x[:-1]) & (row[at[1:]] == row[at[:-1]])
    twice = np.zeros(len(x), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    return np.bincount(row, np.cumsum(cover)[:-1] > 0, minlength=rows).astype(np.int64)


def lines_again(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many lines with a word, of each row, are equal to an earlier one of it."""
    rows = len(off) - 1
    ends = np.zeros(256, bool)
    ends[0x0A] = True
    s, e, row = V.words(buf, off, ends)
    words = np.concatenate(([0], np.cumsum(~V.SPACE[buf])))
    some = words[e] > words[s]
    h, row = V.hashes(buf, s[some], e[some], False), row[some]
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=rows)


def plain_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(off) - 1
    s, e, row = V.words(buf, off)
    sum_ = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    return {
        "n_words": np.bincount(row, minlength=rows), "word_chars": sum_(~V.SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": sum_(SYMBOL[buf]),
        "n_dup_lines": lines_again(buf, off), "n_repeat_words": repeated(V.hashes(buf, s, e, False), row, rows),
    }


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = V.text_bytes(batch.column(0))
    for i, j in V.spans(off):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


COUNTS = "lang string, sign boolean, word long, n long"


@trimmed
def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for each language of a slice of a task: of words, of each class (sign) and of all words (sign, CLASSES)."""
    total: dict[str, list] = {}
    size = 0
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        code, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for i, j, buf, off in _texts(batch):
            h, row = word_hashes(buf, off)
            signs = classes(buf, off)
            for c in np.unique(code[i:j]):
                mine = code[i:j] == c
                got = total.setdefault(names[int(c)], [[], np.zeros(CLASSES, np.int64), 0])
                words = h[mine[row]]
                got[0].append(np.unique(words, return_counts=True))
                got[1], got[2] = got[1] + signs[mine].sum(0), got[2] + len(words)
            size += len(buf)
            if size >= SLICE:
                yield from _counted(total)
                total, size = {}, 0
    yield from _counted(total)


def _counted(total: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang, (words, signs, count) in total.items():
        u, back = np.unique(np.concatenate([w for w, _ in words]), return_inverse=True)
        n = np.bincount(back, np.concatenate([k for _, k in words]), minlength=len(u)).astype(np.int64)
        word = np.concatenate((u.view(np.int64), np.arange(CLASSES + 1)))
        cells = pa.array(np.arange(len(word)) >= len(u)), pa.array(word), pa.array(np.concatenate((n, signs, [count])))
        for k in range(0, len(word), ROWS):
            part = [c.slice(k, ROWS) for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], ["lang", "sign", "word", "n"])


class References:
    """Shares of classes (languages x CLASSES) and of common words (words x languages), with the hashes of these in order."""

    def __init__(self, rows: list[tuple[str, bool, int, int]]) -> None:
        special = {(lang, w): n for lang, sign, w, n in rows if sign}
        self.langs = sorted({lang for lang, _ in special})
        place = {lang: k for k, lang in enumerate(self.langs)}
        common = [(int(w) % (1 << 64), place[lang], n / special[lang, CLASSES]) for lang, sign, w, n in rows if not sign]
        self.words = np.array(sorted({w for w, _, _ in common}), np.uint64)
        self.shares = np.zeros((len(self.words), len(self.langs)))
        for w, k, share in common:
            self.shares[np.searchsorted(self.words, w), k] = share
        signs = np.array([[special.get((lang, k), 0) for k in range(CLASSES)] for lang in self.langs], float).reshape(-1, CLASSES)
        self.common = int((self.shares > 0).sum(0).max()) if self.shares.size else 0
        self.signs = signs / np.maximum(signs.sum(1, keepdims=True), 1)

    def distances(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distance of signs, of words, signs, words) of each row from the reference that is nearest by both together; 0 without references."""
        rows = len(off) - 1
        signs = classes(buf, off)
        h, row = word_hashes(buf, off)
        n = np.bincount(row, minlength=rows)
        if not self.langs:
            return np.zeros(rows), np.zeros(rows), signs.sum(1), n
        p = signs / np.maximum(signs.sum(1, keepdims=True), 1)
        by_signs = divergence(p[:, None, :], self.signs[None]).sum(2)
        # Of the words only those that a row has are gone through: any other adds half of its share.
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        hit = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        key, times = np.unique(row[hit] * max(len(self.words), 1) + at[hit], return_counts=True)
        r, w = key // max(len(self.words), 1), key % max(len(self.words), 1)
        by_words = np.zeros((rows, len(self.langs)))
        for k in range(len(self.langs)):
            q = self.shares[:, k]
            here = q[w] > 0  # words that are common in another language only are of the rest
            x = times[here] / n[r[here]]
            adds = np.bincount(r[here], divergence(x, q[w[here]]) - q[w[here]] / 2, minlength=rows)
            others = 1 - np.bincount(r[here], x, minlength=rows)
            by_words[:, k] = q.sum() / 2 + adds + divergence(np.maximum(others, 0), np.full(rows, max(1 - q.sum(), 0)))
        nearest = np.argmin(np.round(by_signs + by_words, 12), 1)
        pick = lambda x: np.sqrt(np.maximum(np.take_along_axis(x, nearest[:, None], 1)[:, 0], 0))
        return pick(by_signs), pick(by_words), signs.sum(1), n


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What each share adds to the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0)
        return (part(p) + part(q)) / 2


def by_chance(groups: np.ndarray, n: np.ndarray) -> np.ndarray:
    """About what a sample of n adds to the divergence, in bits, of a histogram of so many groups."""
    return (groups - 1) / (8 * np.log(2) * np.maximum(n, 1))


def references(docs: DataFrame) -> References:
    """Those of all documents (text, lang)."""
    texts = docs.select("text", "lang").filter("lang is not null and text is not null")
    counts = settle(texts.mapInArrow(_by_language, COUNTS).groupBy("lang", "sign", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.filter(F.col("sign") & (F.col("word") == CLASSES)).select("lang", F.col("n").alias("words"))
    every = totals.agg(F.sum("words")).first()[0] or 0
    large = totals.filter((F.col("words") > 0) & (F.col("words") * FEW >= every)).collect()  # FEW languages at most
    known = docs.sparkSession.createDataFrame([tuple(r) for r in large], "lang string, words long")
    rows = counts.join(F.broadcast(known), "lang").filter(F.col("sign") | (F.col("n") * RARE >= F.col("words")))
    return References([tuple(r) for r in rows.select("lang", "sign", "word", "n").collect()])  # RARE words of a language at most


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, sign_distance double, word_distance double"


def _judged(shared):
    @trimmed
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: References = shared.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, buf, off in _texts(batch):
                counts = plain_counts(buf, off)
                signs, words, n_signs, n = known.distances(buf, off)
                failed = (counts["n_words"] < LEAST) | (100 * counts["n_repeat_words"] > REPEATED * counts["n_words"])
                judged = np.array([x is None or x in known.langs for x in langs[i:j]], bool) & bool(known.langs)
                far_signs = (n_signs >= LEAST_SIGNS) & (signs**2 > FAR_SIGNS**2 + by_chance(CLASSES, n_signs))
                far_words = (n >= LEAST_WORDS) & (words**2 > FAR_WORDS**2 + by_chance(known.common + 1, n))
                kept = ~failed & ~(judged & (far_signs | far_words))
                out = [batch.column(2).slice(i, j - i), *(pa.array(counts[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(np.round(signs, 6)), pa.array(np.round(words, 6))]
                yield pa.RecordBatch.from_arrays(out, [c.split(" ")[0] for c in RULES.split(", ")])

    return rows


def rules(docs: DataFrame) -> DataFrame:
    """RULES of each document (doc_id, text and, where it has that, lang)."""
    named = docs.select("text", F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), F.col("doc_id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(references(named))
    return named.mapInArrow(_judged(shared), RULES)
