"""Cross-tokenizer alignment: which tokens of one public tokenizer stand where those of another do.

1. Texts are shuffled whole and each distinct one is kept once, with the number of its documents.
2. A task encodes its distinct texts with both tokenizers and cuts them into groups where both end a token.
   What it keeps of a block of texts (``BLOCK`` bytes) is one row: measures of each text, the linked id pairs of each
   text, and the distinct pairs of the block with the number of documents that hold them.
3. Counts of pairs are added up over blocks; each block then asks for the counts of its own distinct pairs, so that a
   pair that every text holds is asked for once a block, not once a text.
4. Measures of texts go to their documents by a digest of the text.

Only the highest count of each id of the first tokenizer is broadcast, at most one row for each entry of its vocabulary.

Defined results: null and empty texts, and those whose tokens' bytes differ from a space and the text, have no
tokens: zeros and an empty digest. Documents without an id and repeated rows have rows of their own. Other columns
do not matter, whatever their names.

A text is cut before single spaces and line ends, where neither tokenizer joins signs, and a worker keeps the ids of
the parts it has met. Parts are looked up by hash; the bytes of all tokens are compared with the text, and a text in
which they differ, or whose white space does not stand alone, is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import settle, trimmed
from .tokens import BYTE_BPE, Encoder

#: Fixed value: name of a tokenizer file.
PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of texts that share a row, parts that a worker keeps, and links of a group that are listed one by one.
BLOCK, CACHE, GROUP = 4 << 20, 400_000, 1 << 16


class Vocabulary:
    """The bytes of each id, one after the other, and the ids in decimal."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[ids] - before, size) + np.arange(size.sum())]


def byte_level(token: str, signs: dict[str, int]) -> bytes:
    return bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()


def byte_signs() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: printable Latin-1 signs stand for themselves, others follow U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the ids of parts that were met before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        if not os.path.exists(b_path):
            import public_tokenizers

            b_path = public_tokenizers.path(b_path)
        self.encoder = Encoder(a_path, False, 0)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs, vocabulary = byte_signs(), self.encoder.tokenizer.get_vocab()
        tokens = [""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            tokens[i] = t
        self.a = Vocabulary([byte_level(t, signs) for t in tokens])
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        # Where no piece goes over a space between two words, words are encoded one by one.
        self.apart = not any("▁" in p.lstrip("▁") for p in names)
        self.space = self.pieces.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.flat = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        return self.encoder.ids(" " + text), self.pieces.encode(text, num_threads=1)

    def learn(self, keys: np.ndarray, parts: list[str], line: np.ndarray) -> None:
        """Keep the ids of parts, which follow a line end (line) or a space."""
        a = [e.ids for e in self.encoder.tokenizer.encode_batch_fast([("\n" if n else " ") + p for p, n in zip(parts, line)], add_special_tokens=False)]
        b = self.pieces.encode([("\n" if n else "") + p for p, n in zip(parts, line)], num_threads=1)
        b = [x[1:] if n and x[0] == self.space else x for x, n in zip(b, line)]
        for k, ids in enumerate((a, b)):
            self.flat[k] = np.concatenate((self.flat[k], np.array([i for x in ids for i in x], np.int64)))
            self.size[k] = np.concatenate((self.size[k], np.array([len(x) for x in ids], np.int64)))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.numbers = np.insert(self.keys, at, keys), np.insert(self.numbers, at, np.arange(self.count, self.count + len(keys)))
        self.count += len(keys)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer (ids of all rows, one after the other; offsets of rows). Rows whose bytes differ have none."""
        rows = len(off) - 1
        alone = self.encoder.whole(buf, off) if self.apart else np.ones(rows, bool)
        s, e, row = V.words(buf, off)
        keep = ~alone[row]
        s, e, row = s[keep], e[keep], row[keep]
        line = (s > off[row]) & (buf[np.maximum(s - 1, 0)] == 0x0A)
        with np.errstate(over="ignore"):
            u, at, back = np.unique(V.mix(V.hashes(buf, s, e, False) + line), return_index=True, return_inverse=True)
        if self.count + len(u) > CACHE:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            w = at[new]
            self.learn(u[new], [buf[i:j].tobytes().decode() for i, j in zip(s[w].tolist(), e[w].tolist())], line[w])
        number = self.numbers[np.searchsorted(self.keys, u)][back] if len(u) else np.zeros(0, np.int64)
        n = np.bincount(row, minlength=rows)
        out = []
        for k in range(2):
            size, ends = self.size[k][number], np.concatenate(([0], np.cumsum(self.size[k])))
            before = np.concatenate(([0], np.cumsum(size)))
            ids = self.flat[k][np.repeat(ends[number] - before[:-1], size) + np.arange(before[-1])]
            out.append((ids, before[np.concatenate(([0], np.cumsum(n)))]))
        bad = alone | self.differs(buf, off, *out[0], self.a) | self.differs(buf, off, *out[1], self.b)
        if not bad.any():
            return out
        parts = [[ids[i:j] for i, j in zip(at[:-1], at[1:])] for ids, at in out]
        for r in np.flatnonzero(bad):
            text = buf[off[r] : off[r + 1]].tobytes()
            ids = [np.array(x, np.int64) for x in self.whole(text.decode())]
            same = all(v.joined(x).tobytes() == b" " + text for v, x in zip((self.a, self.b), ids)) and len(text) > 0
            for k in range(2):
                parts[k][r] = ids[k] if same else np.zeros(0, np.int64)
        return [(np.concatenate(p), np.concatenate(([0], np.cumsum([len(x) for x in p])))) for p in parts]

    @staticmethod
    def differs(buf: np.ndarray, off: np.ndarray, ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Rows whose tokens' bytes are not a space and the text."""
        total = np.concatenate(([0], np.cumsum(v.size[ids])))[at]
        bad = np.diff(total) != np.diff(off) + 1
        good = np.flatnonzero(~bad)
        if not len(good):
            return bad
        size = np.diff(off)[good] + 1
        starts = np.cumsum(size) - size
        inner = np.ones(size.sum(), bool)
        inner[starts] = False
        want = np.full(len(inner), 0x20, np.uint8)
        want[inner] = buf[np.repeat(~bad, np.diff(off))]
        unlike = np.flatnonzero(v.joined(ids[np.repeat(~bad, np.diff(at))]) != want)
        bad[good[np.searchsorted(starts, unlike, "right") - 1]] = True
        return bad


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One for each pair of files in a worker, kept from task to task."""
    return Pair(a_path, b_path)


def decimal(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each id in decimal and the sign after it, none where that is 0; offsets)."""
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
    ends = np.cumsum(digits + (after > 0))
    start, out = ends - digits - (after > 0), np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(7):  # from the last digit on
        some = digits > k
        out[(start + digits - 1 - k)[some]] = ids[some] // 10**k % 10 + 0x30
    out[(ends - 1)[after > 0]] = after[after > 0]
    return out, np.concatenate(([0], ends))


def groups(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> dict[str, np.ndarray]:
    """Groups of the tokens a and b, which have the same bytes: the group of each token and where each tokenizer's
    tokens of a group start, groups before each row, and which tokens end a group."""
    ea, eb = np.cumsum(a_size), np.cumsum(b_size)
    at = np.zeros((2, int(ea[-1]) + 1 if len(ea) else 1), bool)
    at[0, ea], at[1, eb] = True, True
    last_a, last_b = at[1, ea], at[0, eb]
    ga, gb = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    before = np.concatenate(([0], np.cumsum(last_a)))[a_at]
    return {"ga": ga, "gb": gb, "na": na, "nb": nb, "sa": np.cumsum(na) - na, "sb": np.cumsum(nb) - nb, "before": before, "last_a": last_a, "last_b": last_b}


def written(g: dict[str, np.ndarray], a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the groups of each row as text, offsets of rows)."""
    ids, after = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    pa_, pb = np.arange(len(a)) + g["sb"][g["ga"]], np.arange(len(b)) + (g["sa"] + g["na"])[g["gb"]]
    ids[pa_], ids[pb] = a, b
    after[pa_], after[pb] = np.where(g["last_a"], ord("|"), ord(",")), np.where(g["last_b"], ord(";"), ord(","))
    some = b_at[1:] > b_at[:-1]
    after[pb[b_at[1:][some] - 1]] = 0
    out, off = decimal(ids, after)
    return out, off[a_at + b_at]


def links(g: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, group, times) of linked tokens; large groups come with each pair once."""
    large = g["na"] * g["nb"] > GROUP
    i = np.flatnonzero(~large[g["ga"]])
    n = g["nb"][g["ga"][i]]
    j = np.repeat(g["sb"][g["ga"][i]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    found = [(np.repeat(a[i], n) << 32 | b[j], np.repeat(g["ga"][i], n), np.ones(len(j), np.int64))]
    for k in np.flatnonzero(large):
        x, p = np.unique(a[g["sa"][k] : g["sa"][k] + g["na"][k]], return_counts=True)
        y, q = np.unique(b[g["sb"][k] : g["sb"][k] + g["nb"][k]], return_counts=True)
        found.append(((x[:, None] << 32 | y).ravel(), np.full(len(x) * len(y), k), np.outer(p, q).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))


def aligned(p: Pair, buf: np.ndarray, off: np.ndarray) -> dict[str, list]:
    """Measures of each row, and its linked pairs with how often they are linked (offsets of rows in first)."""
    (a, a_at), (b, b_at) = p.encode(buf, off)
    rows = len(off) - 1
    g = groups(a, a_at, p.a.size[a], b, b_at, p.b.size[b])
    text, text_at = written(g, a, a_at, b, b_at)
    key, group, times = links(g, a, b)
    row = np.searchsorted(g["before"], group, "right") - 1
    order = np.lexsort((key, row))
    key, row, times = key[order], row[order], times[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    times = np.add.reduceat(times, start) if len(start) else times
    n_links = np.concatenate(([0], np.cumsum(g["na"] * g["nb"])))[g["before"]]
    digests = [hashlib.sha256(text[i:j]).hexdigest() if j > i else "" for i, j in zip(text_at[:-1].tolist(), text_at[1:].tolist())]
    return {
        "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(g["before"]), "n_links": np.diff(n_links), "groups_sha256": digests, "key": key[start], "times": times,
        "first": np.concatenate(([0], np.cumsum(np.bincount(row[start], minlength=rows)))),
    }


BLOCKS = "block long, digest array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, first array<long>, place array<int>, times array<int>, pairs array<long>, docs array<long>"


def _block(number: int, found: list[tuple[list[bytes], np.ndarray, dict]]) -> pa.RecordBatch:
    """One row of BLOCKS from some texts' (digests, documents, aligned())."""
    both = lambda name: np.concatenate([f[2][name] for f in found])
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f[2]["first"]) for f in found]))))
    pairs, place = np.unique(both("key"), return_inverse=True)
    weight = np.repeat(np.concatenate([f[1] for f in found]), np.diff(first))
    docs = np.zeros(len(pairs), np.int64)
    np.add.at(docs, place, weight)
    values = [[d for f in found for d in f[0]], *(both(c) for c in ("n_a", "n_b", "n_groups", "n_links")), [d for f in found for d in f[2]["groups_sha256"]], first, place, both("times"), pairs, docs]
    kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    cells = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in zip(values, kinds)]
    return pa.RecordBatch.from_arrays([pa.array([number]), *cells], ["block", *(c.split(" ")[0] for c in BLOCKS.split(", ")[1:])])


def _blocks(a_path: str, b_path: str):
    @trimmed
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, number, found, size = pair(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            buf, off = V.text_bytes(batch.column(0))
            docs = batch.column(1).to_numpy()
            for i, j in V.spans(off):
                digests = [hashlib.sha256(buf[x:y]).digest() for x, y in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist())]
                found.append((digests, docs[i:j], aligned(p, buf[off[i] : off[j]], off[i : j + 1] - off[i])))
                size += off[j] - off[i]
                if size >= BLOCK:
                    yield _block(number, found)
                    number, found, size = number + 1, [], 0
        if found:
            yield _block(number, found)

    return rows


MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _measured(left: pa.Table, right: pa.Table) -> pa.Table:
    """MEASURES of the texts of a block from the counts of its pairs (place, n, best)."""
    block = {c: left.column(c).combine_chunks() for c in left.column_names}
    flat = lambda c: block[c].flatten().to_numpy(zero_copy_only=False)
    n, best = np.zeros(len(flat("pairs")), np.int64), np.zeros(len(flat("pairs")), bool)
    at = right.column("place").to_numpy()
    n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    first, place, times = flat("first"), flat("place"), flat("times").astype(np.int64)
    run = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
    out = [block["digest"].flatten(), *(block[c].flatten() for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(run(times * best[place])), pa.array(run(times * n[place])), block["groups_sha256"].flatten()]
    return pa.table(out, [c.split(" ")[0] for c in MEASURES.split(", ")])


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    distinct = docs.filter("length(text) > 0").groupBy("text").agg(F.count("*").alias("docs"))
    blocks = settle(distinct.mapInArrow(_blocks(a_path, b_path), BLOCKS), "aligned")
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    counts = settle(counts, "pairs").withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of a vocabulary at most
    known = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    answered = asked.join(known, "pair").select("of_block", "place", "n", "best")
    measures = blocks.drop("docs").groupBy("block").cogroup(answered.groupBy("of_block")).applyInArrow(_measured, MEASURES)
    of_text = docs.select("doc_id", F.when(F.length("text") > 0, F.unhex(F.sha2(F.col("text"), 256))).alias("digest"))
    numbers = [F.coalesce(F.col(c.split(" ")[0]), F.lit(0).cast("long")).alias(c.split(" ")[0]) for c in MEASURES.split(", ")[1:-1]]
    return of_text.join(measures, "digest", "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
