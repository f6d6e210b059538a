"""Token ids of whole texts with public tokenizer files and the tokenizers library.

A text is cut where these tokenizers never join signs: before single spaces and line ends
that stand between two other signs, and before a full stop or comma that follows an ASCII
letter and ends a word. The ids of the parts, one after the other, are those of the whole.
A worker keeps the ids of the parts it has met (``CACHE`` of them at most; then it starts
anew), since most recur. A text in which white space does not stand alone, or that has
white space beyond ASCII, is encoded whole.

Parts are looked up by 64-bit hashes, and the bytes of each part are compared with those of
the part that was met; a text in which they differ is encoded whole, and so is one with a
part of more than ``vectors.LONG`` bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from . import vectors as V

#: Parts that are kept, and eighths of their bytes.
CACHE, TEXT = 1_000_000, 1 << 22
#: Names of tokenizer files.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes that only texts have that are encoded whole: controls that some take as white space.
ODD = np.zeros(256, bool)
ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
END, STOP, COMMA = (np.uint64(x) for x in (0x51ED270B0A1F3C4D, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))


class Encoder:
    def __init__(self, path: str, drops_space: bool, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space, self.end_id = drops_space, end_id
        vocabulary = self.tokenizer.get_vocab()
        # Where one of many words that were encoded together ends (a suffix) or begins (a marked space).
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if drops_space else t.startswith("Ġ"))]] = True
        self.clear()

    def clear(self) -> None:
        # Hashes in order and the numbers of their parts; the ids of all parts one after the other.
        self.keys, self.numbers, self.count, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0, []
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(CACHE + 16, np.int64), np.zeros(CACHE + 16, np.int32)
        # The bytes of each part, eight to a number, and their length with the sign before them (-1: no part).
        self.text, self.held, self.at, self.length = np.zeros(1 << 16, np.uint64), 0, np.zeros(CACHE + 16, np.int64), np.full(CACHE + 16, -1, np.int64)
        marks = [[self.end_id], self.ids("."), self.ids(",")]
        self.add([int(END), int(STOP), int(COMMA)], *self.joined(marks))
        self.enter()

    def enter(self) -> None:
        """Put what add() was given into the order of keys."""
        keys, numbers = (np.concatenate(x) for x in zip(*self.new))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.numbers, self.new = np.insert(self.keys, at, keys[order]), np.insert(self.numbers, at, numbers[order]), []

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the part of each key, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], -1)

    def remember(self, numbers: np.ndarray, parts: list[bytes], lead: np.ndarray) -> None:
        for k, part, sign in zip(numbers.tolist(), parts, lead.tolist()):
            n = -(-len(part) // 8)
            if self.held + n > len(self.text):
                self.text = np.concatenate((self.text, np.zeros_like(self.text)))
            self.text[self.held : self.held + n] = np.frombuffer(part.ljust(8 * n, b"\0"), "<u8")
            self.at[k], self.length[k], self.held = self.held, len(part) << 2 | sign, self.held + n

    def same(self, k: np.ndarray, buf: np.ndarray, s: np.ndarray, n: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Which of buf[s:s + n] are the parts k, byte for byte."""
        ok, step = self.length[k] == (n << 2 | lead), 0
        a, here = np.flatnonzero(ok), V.eights(buf) if len(buf) else np.zeros(0, np.uint64)
        while len(a):
            ok[a] = (here[s[a] + step] & V.KEEP[np.minimum(n[a] - step, 8)]) == self.text[self.at[k[a]] + step // 8]
            step += 8
            a = a[(n[a] > step) & ok[a]]
        return ok

    @staticmethod
    def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([i for x in lists for i in x], np.uint32), np.cumsum([0, *map(len, lists)])

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def add(self, keys: list[int], ids: np.ndarray, bounds: np.ndarray) -> None:
        """Keep ids[bounds[k]:bounds[k + 1]] as those of keys[k]."""
        n = self.count
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(keys)], self.size[n : n + len(keys)] = self.used + bounds[:-1], np.diff(bounds)
        self.new.append((np.array(keys, np.uint64), np.arange(n, n + len(keys), dtype=np.int32)))
        self.used, self.count = self.used + len(ids), n + len(keys)

    def learn(self, keys: list[int], parts: list[bytes], lead: list[int]) -> None:
        """Encode new parts: words of letters alone together, others one by one."""
        texts, together, alone = [p.decode() for p in parts], [], []
        for k, t in enumerate(texts):
            (together if t.isalpha() and (self.drops_space or lead[k] == 1) else alone).append(k)
        for i in range(0, len(together), 20_000):
            some = together[i : i + 20_000]
            ids = np.array(self.ids(" " + " ".join(texts[k] for k in some)), np.uint32)
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(some):
                bounds = np.concatenate(([0], at + 1)) if self.drops_space else np.append(at, len(ids))
                self.add([keys[k] for k in some], ids, bounds)
            else:  # a sign that the library takes otherwise than Python does
                alone += some
        before = ("", " ", "\n")
        for i in range(0, len(alone), 20_000):
            some = alone[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast([before[lead[k]] + texts[k] for k in some], add_special_tokens=False)
            self.add([keys[k] for k in some], *self.joined([e.ids for e in found]))

    def whole(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that must be encoded whole."""
        if not len(buf):
            return np.zeros(len(off) - 1, bool)
        space = (buf == 0x20) | (buf == 0x0A)
        odd = ODD[buf].copy()
        b, c = buf[:-1], buf[1:]
        odd[1:] |= ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((b == 0xE1) & (c == 0x9A)) | ((b == 0xE2) & ((c == 0x80) | (c == 0x81))) | ((b == 0xE3) & (c == 0x80))
        if not self.drops_space:
            odd[1:] |= space[:-1] & space[1:]
            some = off[1:] > off[:-1]
            ends = np.concatenate((off[:-1][some], off[1:][some] - 1))
            odd[ends] |= space[ends]
        run = np.concatenate(([0], np.cumsum(odd)))
        return run[off[1:]] > run[off[:-1]]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, one after the other, each with the end id; offsets of rows)."""
        rows, whole = len(off) - 1, self.whole(buf, off)
        s, e, row = V.words(buf, off)
        whole[row[e - s > V.LONG]] = True
        keep = ~whole[row]
        s, e, row = s[keep], e[keep], row[keep]
        last = buf[e - 1]
        tail = ((last == 0x2E) | (last == 0x2C)) & (e - s > 1) & LETTER[buf[e - 2]]
        e = e - tail
        with np.errstate(over="ignore"):
            text = V.LOWER[buf] if self.drops_space else buf
            key = V.hashes(text, s, e, False)
            lead = np.zeros(len(s), np.int8)
            if not self.drops_space:
                inner = s > off[row]
                lead[inner] = np.where(buf[s[inner] - 1] == 0x0A, 2, 1)
                key = V.mix(key + lead.astype(np.uint64))
        # Places of words, of stops and commas after them, and of the ends of rows.
        n = np.bincount(row, 1 + tail, minlength=rows).astype(np.int64) + 1
        first = np.concatenate(([0], np.cumsum(n)))
        before = np.cumsum(1 + tail) - (1 + tail)
        place = before + row
        every = np.full(first[-1], END, np.uint64)
        every[place] = key
        every[place[tail] + 1] = np.where(last[tail] == 0x2E, STOP, COMMA)
        u, at, back = np.unique(every, return_index=True, return_inverse=True)
        if self.count + len(u) > CACHE or self.held > TEXT:
            self.clear()
        number = self.find(u)
        missing = np.flatnonzero(number < 0)
        if len(missing) + self.count > CACHE:
            return self._halves(buf, off)
        if len(missing):
            w = np.searchsorted(place, at[missing])
            keys = u[missing].tolist()
            self.learn(keys, [buf[a:b].tobytes() for a, b in zip(s[w].tolist(), e[w].tolist())], lead[w].tolist())
            self.enter()
            number[missing] = self.find(u[missing])
            self.remember(number[missing], [text[a:b].tobytes() for a, b in zip(s[w].tolist(), e[w].tolist())], lead[w])
        w = number.astype(np.int64)[back]
        whole[row[~self.same(w[place], text, s, e - s, lead)]] = True
        size = self.size[w].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(self.start[w] - ends[:-1], size) + np.arange(ends[-1])]
        out = ends[first]
        if whole.any():
            parts = [ids[a:b] for a, b in zip(out[:-1], out[1:])]
            for k in np.flatnonzero(whole):
                parts[k] = np.array([*self.ids(buf[off[k] : off[k + 1]].tobytes().decode()), self.end_id], np.uint32)
            ids, out = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, out

    def _halves(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For more new words at once than are kept: a long text whole, several rows apart."""
        if len(off) == 2:
            ids = np.array([*self.ids(buf.tobytes().decode()), self.end_id], np.uint32)
            return ids, np.array([0, len(ids)])
        m = len(off) // 2
        (a, p), (b, q) = self.encode(buf[: off[m]], off[: m + 1]), self.encode(buf[off[m] :], off[m:] - off[m])
        return np.concatenate((a, b)), np.concatenate((p, q[1:] + p[-1]))


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool, end_id: int) -> Encoder:
    """One encoder for each file in a worker, kept from task to task."""
    return Encoder(path, drops_space, end_id)


def encoded(batch, column: int, path: str, drops_space: bool, end_id: int):
    """(row, ids with the end id as an array) for each row of a batch; a null text is empty."""
    enc = encoder(path, drops_space, end_id)
    buf, off = V.text_bytes(batch.column(column))
    for i, j in V.spans(off):
        ids, at = enc.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        for k in range(j - i):
            yield i + k, ids[at[k] : at[k + 1]]
