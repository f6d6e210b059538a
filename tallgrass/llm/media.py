"""Media columns: ISO base media files in binary columns, described from their tables.

A file is a tree of boxes. ``probe`` walks it and decodes the sample tables of each
track (sizes, chunks, chunk offsets, times, sync samples) and the runs of its movie
fragments to find the codec, the duration and the byte range of every keyframe; the
payload itself is not decoded. ``wrap`` is the inverse for raw 8-bit samples: one
access unit is a frame of 576.

Every track is an entry of the column tracks, in order of the file. The columns beside
it repeat the first video track that has samples, or where there is none the first
track that has. A duration is that of mdhd; in a file with fragments, whose header
can't know it, the sum of the durations of all samples.

Defined results. A null file gives nulls and error 'null'; a file that is cut short or
whose tables contradict each other gives nulls and says why in error, and never stops
the job. A null text counts as empty and is padded to one frame. Rows with equal bytes
have equal results; repeated rows and rows without an id are kept one for one. Columns
other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

FRAME = 576
RATE = 48_000
#: Frames to a chunk, and from one keyframe to the next, of files that wrap() makes.
CHUNK, SYNC = 8, 10
#: Boxes that hold boxes, and how deep files nest them at most.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
NUMBERED = {b"trak", b"moof", b"traf"}
DEEPEST = 32
#: Fixed values of the format: which fields a fragment's header and a run of samples have, and the sign of no sync sample.
BASE, DESCRIPTION, DURATION, SIZE, FLAGS, OWN_BASE = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_SYNC = 0x10000

RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
TRACKS = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", RANGES)]))
ABOUT = "codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,end:long>>"
PROBED = f"{ABOUT}, tracks array<struct<track_id long, handler string, {ABOUT}>>, media_bytes long, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def numbers(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def wrap(payload: bytes) -> bytes:
    """An audio file of raw unsigned 8-bit samples; the payload is a multiple of FRAME."""
    n = len(payload) // FRAME
    ticks = n * FRAME
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK, 1)] if n >= CHUNK else []
    if n % CHUNK:
        runs.append((chunks, n % CHUNK, 1))

    def moov(base: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", numbers(1), entry),
            full(b"stts", numbers(1, n, FRAME)),
            full(b"stss", numbers(-(-n // SYNC), *range(1, n + 1, SYNC))),
            full(b"stsc", numbers(len(runs), *(x for r in runs for x in r))),
            full(b"stsz", numbers(FRAME, n)),
            full(b"co64", numbers(chunks), struct.pack(f">{chunks}Q", *(base + k * CHUNK * FRAME for k in range(chunks)))),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1),
            full(b"hdlr", numbers(0), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", numbers(1), struct.pack(">I4sI", 12, b"url ", 1))), table),
        )
        track = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(16), matrix, bytes(8), version=1)
        head = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), matrix, bytes(24), numbers(2), version=1)
        return box(b"moov", head, box(b"trak", track, media))

    brand = box(b"ftyp", b"isom", numbers(512), b"isomiso2")
    start = len(brand) + len(moov(0)) + 16
    return b"".join((brand, moov(start), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)), payload))


def walk(data: bytes) -> Iterator[tuple[tuple, int, int, int]]:
    """(path of kinds, start, body start, body end) of each box, a box before what it holds; kinds in NUMBERED come
    with how many of them the file has had."""
    open_boxes, met = [(0, len(data), ())], dict.fromkeys(NUMBERED, 0)
    while open_boxes:
        at, end, path = open_boxes.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = at + size if size else end
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {at} overruns")
        if kind in NUMBERED:
            met[kind] += 1
        here = (*path, (kind, met[kind]) if kind in NUMBERED else kind)
        if len(here) > DEEPEST:
            raise ValueError(f"boxes nested more than {DEEPEST} deep")
        yield here, at, body, stop
        open_boxes.append((stop, end, path))
        if kind in NESTED:
            open_boxes.append((body, stop, here))


def series(data: bytes, at: int, end: int, per: int = 1, form: str = "I") -> list[tuple]:
    """The entries of a counted table."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    size = struct.calcsize(">" + form * per)
    if at + 8 + n * size > end:
        raise ValueError("table overruns its box")
    return list(struct.iter_unpack(">" + form * per, data[at + 8 : at + 8 + n * size]))


def sample_sizes(data: bytes, t: dict[bytes, tuple[int, int]]) -> list[int]:
    """The size of each sample of a track. No list outgrows the file: sizes that are all alike are counted against its
    length, others lie in it."""
    if b"stz2" in t:  # of 4, 8 or 16 bits
        at, end = t[b"stz2"]
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > end:
            raise ValueError("more samples than the file can hold")
        if bits == 4:
            return [x for k in range((n + 1) // 2) for x in (data[at + 12 + k] >> 4, data[at + 12 + k] & 15)][:n]
        return [x for (x,) in struct.iter_unpack(">B" if bits == 8 else ">H", data[at + 12 : at + 12 + n * bits // 8])]
    at, end = t[b"stsz"]
    even, n = struct.unpack_from(">II", data, at + 4)
    if n * even > len(data) or (not even and at + 12 + 4 * n > end):
        raise ValueError("more samples than the file can hold")
    return [even] * n if even else [x for (x,) in struct.iter_unpack(">I", data[at + 12 : at + 12 + 4 * n])]


def sample_ranges(data: bytes, t: dict[bytes, tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte range of each sample of a track, from its tables."""
    sizes = sample_sizes(data, t)
    if not sizes:
        return []
    offsets = [x for (x,) in (series(data, *t[b"co64"], form="Q") if b"co64" in t else series(data, *t[b"stco"]))]
    runs = series(data, *t[b"stsc"], per=3)
    out: list[tuple[int, int]] = []
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] if k + 1 < len(runs) else len(offsets) + 1
        if not 1 <= first <= last <= len(offsets) + 1:
            raise ValueError("a run of chunks that the file lacks")
        for place in offsets[first - 1 : last - 1]:
            for size in sizes[len(out) : len(out) + per]:
                out.append((place, place + size))
                place += size
    if len(out) != len(sizes) or any(e > len(data) for _, e in out):
        raise ValueError("sample tables contradict each other")
    return out


def key_ranges(data: bytes, t: dict[bytes, tuple[int, int]], ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of ranges those of sync samples; all where the track has no table of them."""
    if b"stss" not in t:
        return ranges
    found = [k for (k,) in series(data, *t[b"stss"])]
    if any(not 1 <= k <= len(ranges) for k in found):
        raise ValueError("a sync sample that the track lacks")
    return [ranges[k - 1] for k in found]


class Fragment:
    """Where a track fragment has got to, and what its samples have unless their run says otherwise."""

    def __init__(self, data: bytes, at: int, moof: int, end_before: int | None, usual: dict[int, tuple[int, int, int]]):
        """at: body of tfhd; moof: start of its fragment; end_before: end of the data of the track before it there."""
        flags = struct.unpack_from(">I", data, at)[0]
        self.track, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
        self.place = moof if flags & OWN_BASE or end_before is None else end_before
        if flags & BASE:
            self.place, at = struct.unpack_from(">Q", data, at)[0], at + 8
        at += 4 * bool(flags & DESCRIPTION)
        own = list(usual.get(self.track, (0, 0, 0)))
        for k, field in enumerate((DURATION, SIZE, FLAGS)):
            if flags & field:
                own[k], at = struct.unpack_from(">I", data, at)[0], at + 4
        self.usual, self.base = tuple(own), self.place

    def run(self, data: bytes, at: int, end: int, room: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
        """(ranges of samples, those of sync samples, durations together) of the trun whose body is from at to end; it
        may have room samples at most."""
        flags, n = struct.unpack_from(">II", data, at)
        at += 8
        if n > room:
            raise ValueError("more samples than the file can hold")
        if flags & RUN_OFFSET:
            self.place, at = self.base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & RUN_FIRST_FLAGS:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        fields = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
        if at + 4 * n * len(fields) > end:
            raise ValueError("table overruns its box")
        rows = struct.iter_unpack(f">{len(fields)}I", data[at : at + 4 * n * len(fields)]) if fields else [()] * n
        ranges, keys, ticks = [], [], 0
        for k, row in enumerate(rows):
            said = dict(zip(fields, row))
            size = said.get(RUN_SIZE, self.usual[1])
            here = (self.place, self.place + size)
            if here[0] < 0 or here[1] > len(data):
                raise ValueError("a fragment's samples overrun the file")
            ranges.append(here)
            ticks += said.get(RUN_DURATION, self.usual[0])
            mark = first if k == 0 and first is not None else said.get(RUN_FLAGS, self.usual[2])
            if not mark & NO_SYNC:
                keys.append(here)
            self.place = here[1]
        return ranges, keys, ticks


def fragment_samples(data: bytes, boxes: list[tuple[tuple, int, int, int]]) -> dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]], int]]:
    """For each track id (ranges of samples, those of sync samples, durations together) of all movie fragments, in order
    of the file. All together have no more samples than the file has bytes."""
    usual: dict[int, tuple[int, int, int]] = {}
    for path, _, at, _ in boxes:
        if path[:2] == (b"moov", b"mvex") and path[-1] == b"trex":
            track, _, *own = struct.unpack_from(">5I", data, at + 4)
            usual[track] = tuple(own)
    out: dict[int, tuple[list, list, int]] = {}
    moof, end_before, now, inside, room = 0, None, None, None, len(data)
    for path, start, at, end in boxes:
        if len(path) == 1 and path[0][0] == b"moof":
            moof, end_before, now, inside = start, None, None, None
        elif len(path) == 3 and path[0][0] == b"moof" and path[1][0] == b"traf":
            if path[1] != inside:
                inside, end_before, now = path[1], now.place if now else end_before, None
            if path[2] == b"tfhd":
                now = Fragment(data, at, moof, end_before, usual)
            elif path[2] == b"trun":
                if now is None:
                    raise ValueError("a run of samples without a track")
                ranges, keys, ticks = now.run(data, at, end, room)
                before = out.setdefault(now.track, ([], [], 0))
                before[0].extend(ranges)
                before[1].extend(keys)
                out[now.track] = (*before[:2], before[2] + ticks)
                room -= len(ranges)
    return out


def track(data: bytes, t: dict[bytes, tuple[int, int]], more: dict | None) -> dict | None:
    """An entry of the column tracks, from the tables of a track and, in a file with fragments, their samples of each
    track (which it is taken out of); None where it lacks tables that the format demands."""
    if b"stsd" not in t or b"mdhd" not in t or not (b"stsz" in t or b"stz2" in t):
        return None
    at = t[b"mdhd"][0]
    scale, ticks = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    ticks = None if ticks == (0xFFFFFFFFFFFFFFFF if data[at] == 1 else 0xFFFFFFFF) else ticks
    name = None
    if b"tkhd" in t:
        name = struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] == 1 else 12))[0]
    ranges = sample_ranges(data, t)
    keys = key_ranges(data, t, ranges)
    if more is not None:
        later = more.pop(name, ([], [], 0))
        ticks = sum(n * d for n, d in (series(data, *t[b"stts"], per=2) if b"stts" in t else [])) + later[2]
        ranges, keys = ranges + later[0], keys + later[1]
    latin = lambda box, at: data[t[box][0] + at : t[box][0] + at + 4].decode("latin-1") if box in t else None
    return {
        "track_id": name, "handler": latin(b"hdlr", 8), "codec": latin(b"stsd", 12), "timescale": scale,
        "duration": None if ticks is None or ticks >> 63 else ticks, "samples": len(ranges), "keyframes": [{"start": a, "end": b} for a, b in keys],
    }


def describe(data: bytes | None) -> dict:
    """What the columns of PROBED say of one file. A duration of all ones, which stands for an unknown one, or beyond 63
    bits is null. A file of which no track has samples has the columns of its first track, with 0 samples; samples in
    fragments of a track that the file doesn't describe are an error."""
    about = ("codec", "timescale", "duration", "samples", "keyframes")
    none = dict.fromkeys((*about, "tracks"))
    if data is None:
        return none | {"media_bytes": None, "error": "null"}
    try:
        tables: dict[int, dict[bytes, tuple[int, int]]] = {}
        boxes = [x for x in walk(data) if x[0][0] == b"moov" or x[0][0][0] == b"moof"]
        for path, _, at, end in boxes:
            if len(path) > 2 and path[0] == b"moov" and path[1][0] == b"trak" and isinstance(path[-1], bytes):
                tables.setdefault(path[1][1], {}).setdefault(path[-1], (at, end))
        more = fragment_samples(data, boxes) if any(path[0][0] == b"moof" for path, *_ in boxes) else None
        tracks = [x for _, t in sorted(tables.items()) if (x := track(data, t, more))]
        if more and any(ranges for ranges, *_ in more.values()):
            raise ValueError("samples of a track that the file lacks")
        if not tracks:
            return none | {"media_bytes": len(data), "error": "no track with samples"}
        best = min(tracks, key=lambda x: (x["samples"] == 0, x["handler"] != "vide"))
        return {c: best[c] for c in about} | {"tracks": tracks, "media_bytes": len(data), "error": None}
    except (ValueError, struct.error, IndexError, KeyError) as e:
        return none | {"media_bytes": len(data), "error": f"{type(e).__name__}: {e}"}


def probe(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The columns keep of df, then PROBED, one row for each file in column."""
    schema = df.select(*keep).schema.simpleString()[7:-1]

    def rows(batches):
        for b in batches:
            found = [describe(x.as_py()) for x in b.column(len(keep))]
            out = {c: b.column(k) for k, c in enumerate(keep)}
            kinds = {"codec": pa.string(), "keyframes": RANGES, "tracks": TRACKS, "error": pa.string()}
            out |= {c: pa.array([x[c] for x in found], kinds.get(c, pa.int64())) for c in found[0]} if found else {}
            if found:
                yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) or schema
    return df.select(*[F.col(c) for c in keep], F.col(column)).mapInArrow(rows, f"{fields}, {PROBED}")


def pad(text: bytes) -> bytes:
    size = max(1, -(-len(text) // FRAME)) * FRAME
    return text.ljust(size, b"\xff")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as the samples of a file, written and read again."""

    def rows(batches):
        for b in batches:
            texts = [(x.as_py() or "").encode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([wrap(pad(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return settle(docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary"), "media")


def read_payload(data: bytes) -> bytes:
    """The samples of the first track, joined; they are found by the tables alone."""
    t: dict[bytes, tuple[int, int]] = {}
    for path, _, at, end in walk(data):
        if len(path) > 2 and path[:2] == (b"moov", (b"trak", 1)):
            t.setdefault(path[-1], (at, end))
    return b"".join(data[a:b] for a, b in sample_ranges(data, t))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,end:long>>"


def digests(stored: DataFrame) -> DataFrame:
    """What the stored files hold, one row for each."""

    def rows(batches):
        for b in batches:
            out = []
            for doc, n, m in zip(*(b.column(k).to_pylist() for k in range(3))):
                d, p = describe(m), read_payload(m)
                ranges = hashlib.sha256(",".join(f"{k['start']}-{k['end']}" for k in d["keyframes"]).encode()).hexdigest()
                feature = f"codec={d['codec'].strip()};seconds={d['duration'] / d['timescale']:.6f};samples={d['samples']};keyframes={len(d['keyframes'])};ranges={ranges[:32]}"
                out.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, *(d[c] for c in ("codec", "timescale", "duration", "samples", "keyframes"))))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 3, RANGES]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(rows, DIGEST)
