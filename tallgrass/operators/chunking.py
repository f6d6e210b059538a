"""Text to chunks: fixed windows, overlapping windows, paragraphs, message groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.text import trim
from tallgrass.sources.batches import small, trimmed

#: Sizes in signs.
EXTRACT, CHUNK, OVERLAP, NOTE = 12_000, 2_400, 300, 60_000
MESSAGE, TARGET, MOST = 3_200, 2_600, 4_200


def fixed_windows(text: Column, size: int = EXTRACT) -> Column:
    """Windows that together are the text; one empty window for an empty text."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(_steps(text, size))


def _steps(text: Column, size: int) -> Column:
    """The text cut into pieces of size, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def overlapping(text: Column, size: int = CHUNK, overlap: int = OVERLAP, trim_first: bool = True) -> Column:
    """Windows of size that share overlap signs, to the end of the text, trimmed, blank ones left out."""
    t = trim(text) if trim_first else text
    # A window is a step of the text and what it shares with the steps after it, which are lined up beside it.
    step = size - overlap
    steps = _steps(t, step)
    after = [F.slice(steps, k + 1, 1 << 30) for k in range(1, -(-overlap // step) + 1)]
    zipped = F.arrays_zip(*[s.alias(f"s{k}") for k, s in enumerate([steps, *after])])
    many = F.transform(zipped, lambda z: trim(F.substring(F.concat_ws("", *[z[f"s{k}"] for k in range(len(after) + 1)]), 1, size)))
    return F.filter(F.when(F.length(t) <= size, F.array(trim(t))).otherwise(many), lambda c: c != "")


def note_chunks(text: Column) -> Column:
    return overlapping(F.substring(text, 1, NOTE), trim_first=False)


def title_for(text: Column, stem: Column) -> Column:
    """The first heading line, or else the file's name."""
    heads = F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit("#")))
    head = trim(F.regexp_replace(F.get(heads, F.lit(0)), "^[#]+", ""))
    return F.substring(F.when(F.coalesce(head, F.lit("")) != "", head).otherwise(stem), 1, 160)


def pack_blocks(blocks: list[str], most: int, joint: int = 2) -> list[list[str]]:
    """Greedy groups whose sizes, with joint signs for each block, stay within most."""
    out, size = [], most + 1
    for b in blocks:
        if not out or size + len(b) + joint > most:
            out.append([])
            size = 0
        out[-1].append(b)
        size += len(b) + joint
    return out


def split_message(text: str, most: int = MESSAGE) -> list[str]:
    """Paragraphs joined while they fit; a longer one is cut."""
    import re

    pieces: list[str] = []
    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        cuts = [p[i : i + most] for i in range(0, len(p), most)]
        if len(cuts) == 1 and pieces and len(pieces[-1]) + len(p) + 2 <= most:
            pieces[-1] += "\n\n" + p
        else:
            pieces += cuts
    return pieces


def split_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece number, piece) of each text of df."""

    def rows(batches):
        for b in batches:
            k, n, p = [], [], []
            for key_of, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, piece in enumerate(split_message(t or "")):
                    k.append(key_of)
                    n.append(i)
                    p.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field(0).type), pa.array(n, pa.int32()), pa.array(p, pa.string())], [key, "piece", "text"])

    return small(df.select(key, text)).mapInArrow(trimmed(rows), f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, text string")


#: Signs between two units of a chunk.
GAP = 2


def borders(sizes: np.ndarray, target: int) -> list[tuple[int, int]]:
    """Ranges of units that share a chunk: as many as fit into target, each with a gap after it, one at least."""
    ends, out, first = np.cumsum(sizes + GAP), [], 0
    while first < len(sizes):
        used = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, used + target, "right")))
        out.append((first, after))
        first = after
    return out


def chat_chunks(messages: list[dict], target: int = TARGET, most: int = MESSAGE, limit: int = MOST) -> list[tuple[int, int, int, str]]:
    """(index, first message, last message, text) of the chunks of a conversation. Pieces of messages, each with its
    role, fill chunks in order; the last piece of a chunk also leads the next one where both together stay within limit."""
    at, texts = [], []
    for m in messages:
        pieces = split_message(m["text"] or "", most)
        at += [m["pos"]] * len(pieces)
        texts += [f"[{m['role']}] {piece}" for piece in pieces]
    sizes = np.array([len(t) for t in texts], np.int64)
    out = []
    for index, (first, after) in enumerate(borders(sizes, target)):
        led = first - 1 if first and (sizes[first - 1 : after] + GAP).sum() <= limit else first
        out.append((index, min(at[led:after]), max(at[led:after]), "\n\n".join(texts[led:after])))
    return out


def chunk_conversations(conversations: DataFrame) -> DataFrame:
    """Chunks of conversations (conversation_id, messages array of pos, role, text), row by row."""
    kind = conversations.schema["conversation_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            out = [(c, *x) for c, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in chat_chunks(m or [])]
            cols = list(zip(*out)) if out else [[]] * 5
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, types)], ["conversation_id", "chunk_index", "first_message", "last_message", "text"])

    return small(conversations.select("conversation_id", "messages")).mapInArrow(trimmed(rows), f"conversation_id {kind}, chunk_index int, first_message int, last_message int, text string")
