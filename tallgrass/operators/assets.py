"""Attachments: identity, type, text, content dedupe, and links from messages."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: File ids in names, extensions by type, control files of an export, the most signs of a text.
FILE_ID = r"\bfile[-_]([A-Za-z0-9]{8,})\b"
EXTENSION = {
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/heif": ".heif", "application/pdf": ".pdf", "application/json": ".json", "application/zip": ".zip",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "audio/x-wav": ".wav", "audio/wav": ".wav", "audio/x-m4a": ".m4a", "video/mp4": ".mp4",
    "text/plain": ".txt", "text/csv": ".csv", "text/x-shellscript": ".sh", "text/x-script.python": ".py", "text/x-c": ".c",
}
CONTROL = ("chat.html", "conversations.json", "shared_conversations.json", "user.json", "message_feedback.json", "model_comparisons.json", "group_chats.json")
MORE_SUFFIXES = (".jpeg", ".heic", ".md", ".yaml", ".yml", ".js", ".ts", ".cpp", ".h", ".hpp", ".log", ".rtf")
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MOST_TEXT, MOST_NAMES, MOST_REFERENCES = 2_000_000, 500, 20


def asset_id(path: Column, content_sha: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    named = F.lower(F.regexp_extract(stem, f"(?i){FILE_ID}", 1))
    return F.when(named != "", named).otherwise(F.substring(content_sha, 1, 32))


def mime(path: Column, content: Column) -> Column:
    """By first bytes, or else by the name's ending; a DOCX is told from other ZIP files in extracted()."""
    head = F.hex(F.substring(content, 1, 64))
    starts = lambda *xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.startswith(head, x))
    at = lambda k, n: F.substring(head, 2 * k + 1, 2 * n)
    brands = F.lower(F.decode(F.unhex(at(8, 8)), "ISO-8859-1"))
    endings = {e: m for m, e in reversed(EXTENSION.items())} | {".jpeg": "image/jpeg", ".md": "text/markdown", ".html": "text/html"}
    known = F.create_map(*[F.lit(x) for pair in endings.items() for x in pair])
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return (
        F.when(starts("FFD8FF"), "image/jpeg").when(starts("89504E470D0A1A0A"), "image/png").when(starts("474946383761", "474946383961"), "image/gif").when(starts("25504446"), "application/pdf")
        .when(starts("52494646") & (at(8, 4) == "57454250"), "image/webp").when(starts("52494646") & (at(8, 4) == "57415645"), "audio/x-wav")
        .when(at(4, 4) == "66747970", F.when(brands.rlike("heic|heif|mif1"), "image/heif").otherwise("video/mp4"))
        .when(starts("504B0304"), "application/zip").otherwise(F.coalesce(F.try_element_at(known, ending), F.lit("application/octet-stream")))
    )


def extension(kind: Column, path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSION.items() for x in pair])
    own = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.coalesce(F.try_element_at(known, kind), F.when(own == ".dat", ".bin").when(own != "", own).otherwise(".bin"))


#: Tags of a word processor's file, and what stands before a list of an archive's files.
WORDS, PARAGRAPH, RUN = "word/document.xml", "http://schemas.openxmlformats.org/wordprocessingml/2006/main p", "http://schemas.openxmlformats.org/wordprocessingml/2006/main t"
LISTING = "Archive contents:"
#: Bytes that are inflated at once.
STEP = 1 << 16


def paragraphs(source, most: int = MOST_TEXT) -> str:
    """The first signs of the paragraphs of a word processor's XML, read step by step: what comes after them is not inflated."""
    out: list[str] = []
    state = {"size": 0, "runs": 0, "text": ""}
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def start(tag: str, _) -> None:
        state["runs"] += tag == RUN

    def end(tag: str) -> None:
        state["runs"] -= tag == RUN
        if tag == PARAGRAPH:
            if text := state["text"].strip():
                out.append(text)
                state["size"] += len(text) + 2
            state["text"] = ""

    def data(text: str) -> None:
        if state["runs"]:
            state["text"] = (state["text"] + text).lstrip() if not state["text"] else state["text"] + text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        while state["size"] + len(state["text"]) <= most + 2:
            step = source.read(STEP)
            parser.Parse(step, not step)
            if not step:
                break
    except expat.ExpatError as e:
        raise ElementTree.ParseError(str(e)) from e
    return "\n\n".join([*out, *([state["text"].strip()] if state["text"].strip() else [])])[:most]


def extract(content: bytes, kind: str) -> tuple[str, str, str]:
    """(type, text, status) of one file; what goes wrong is a status."""
    try:
        if kind.startswith("text/") or kind == "application/json":
            return kind, content[:MOST_TEXT].decode("utf-8", "replace"), "extracted"
        if kind in ("application/zip", DOCX):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                if kind == DOCX or WORDS in names:
                    with z.open(WORDS) as source:
                        return DOCX, paragraphs(source), "extracted"
                return kind, "\n".join([LISTING, *names[:MOST_NAMES]]), "extracted"
        if kind.split("/")[0] in ("image", "audio", "video"):
            return kind, "", "metadata-only"
        return kind, "", "unsupported"
    except Exception as e:  # a file from anywhere may be broken in any way
        return kind, "", f"error:{type(e).__name__}"


def extracted(files: DataFrame) -> DataFrame:
    """path, mime, text, status of files (path, content, mime)."""

    def rows(batches):
        for b in batches:
            found = [extract(c or b"", k) for c, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(x), pa.string()) for x in (zip(*found) if found else ((), (), ()))]], ["path", "mime", "text", "status"])

    return files.select("path", "content", "mime").mapInArrow(rows, "path string, mime string, text string, status string")


def deduplicated(files: DataFrame) -> DataFrame:
    """path, alias and asset_id of files (path, sha, alias): equal contents are one asset, named by the
    first path's alias; of different contents with one name all but the first take their hash."""
    first = files.groupBy("sha").agg(F.min_by("alias", "path").alias("named"), F.min("path").alias("path0"))
    rank = F.row_number().over(W.partitionBy("named").orderBy("path0"))
    assets = first.withColumn("asset_id", F.when(rank == 1, F.col("named")).otherwise(F.substring("sha", 1, 32))).select("sha", "asset_id")
    return files.join(assets, "sha").select("path", "alias", "asset_id", "sha")


def aliases(deduped: DataFrame) -> DataFrame:
    """alias and asset_id: the last path of an alias wins."""
    return deduped.groupBy("alias").agg(F.max_by("asset_id", "path").alias("asset_id"))


#: Keys that mark the description of a file, and keys of it that are kept.
HINTS = ("asset_pointer", "file_id", "name", "filename", "file_name", "mime_type", "size")
META = ("id", "file_id", "asset_pointer", "name", "filename", "file_name", "mime_type", "size")


def said(message: dict) -> str:
    """What a message says: its parts that are text, or have some, trimmed."""
    content = message.get("content")
    parts = content.get("parts") if isinstance(content, dict) else None
    texts = [p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in parts or []]
    return "\n".join(t for t in texts if isinstance(t, str) and t).strip()


def references(message: dict) -> list[tuple[str, dict]]:
    """(file id, metadata of the object it is in) of each attachment that a message names anywhere, in order."""
    out: list[tuple[str, dict]] = []
    todo = [(message, None, None)]
    while todo:
        value, parent, key = todo.pop()
        if isinstance(value, dict):
            todo += [(v, value, k) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(v, parent, key) for v in reversed(value)]
        elif isinstance(value, str):
            pointer = parent is not None and key in ("asset_pointer", "file_id", "id") and any(h in parent for h in HINTS)
            if pointer or "file-service://" in value.lower():
                meta = {k: parent[k] for k in META if parent and parent.get(k) not in (None, "")}
                out += [(m.lower(), meta) for m in re.findall(FILE_ID, value, re.I)]
    return out


def found_references(nodes: DataFrame) -> DataFrame:
    """A row for each file id in nodes (conversation_id, node_id, message as JSON): every node, not the active branch
    alone. meta has values as JSON, context what the message says."""
    kind = nodes.schema["conversation_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            out = []
            for c, n, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if not text or "file" not in text.lower():
                    continue
                try:
                    message = json.loads(text)
                except ValueError:
                    continue
                if isinstance(message, dict):
                    context = said(message)
                    out += [(c, n, str(message.get("id") or n), k, f, [(x, json.dumps(v, ensure_ascii=False)) for x, v in meta.items()], context) for k, (f, meta) in enumerate(references(message))]
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 7, types)], ["conversation_id", "node_id", "message_id", "seq", "alias", "meta", "context"])

    return nodes.select("conversation_id", "node_id", "message").mapInArrow(rows, f"conversation_id {kind}, node_id string, message_id string, seq int, alias string, meta map<string,string>, context string")


def linked(found: DataFrame, alias: DataFrame) -> DataFrame:
    """One reference for each asset, conversation, node and message, with the first value of each metadata key (also
    all of them as JSON, with sorted keys) and what the message says."""
    keys = ["asset_id", "conversation_id", "node_id", "message_id"]
    rows = found.join(alias, "alias")
    first = [F.min_by(F.col("meta")[k], F.when(F.col("meta")[k].isNotNull(), F.col("seq"))).alias(k) for k in META]
    out = rows.groupBy(*keys).agg(*first, F.min("context").alias("context"))
    text = lambda k: F.when(F.startswith(k, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), F.col(k), F.lit("}")), "$.v"))
    pairs = [F.concat(F.lit(f'"{k}": '), F.col(k)) for k in sorted(META)]
    every = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return out.select(*keys, F.coalesce(*map(text, ("name", "filename", "file_name"))).alias("original_name"), text("mime_type").alias("mime_type"), "context", every.alias("metadata_json"), F.sha2(F.concat_ws("\0", *keys), 256).alias("reference_hash"))


def of_conversations(linked: DataFrame, conversations: DataFrame) -> DataFrame:
    """References with the title and date of their conversation, as asset_texts() takes them."""
    return linked.join(conversations.select("conversation_id", "title", "created_at"), "conversation_id")


def asset_texts(assets: DataFrame, refs: DataFrame) -> DataFrame:
    """asset_id, content_kind and text: a heading, the file's own text, and its first references by date."""
    n = F.row_number().over(W.partitionBy("asset_id").orderBy("created_at", "conversation_id"))
    line = F.concat_ws("\n", F.when(F.col("original_name") != "", F.concat(F.lit("Original name: "), "original_name")), F.concat(F.lit("Conversation: "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("created_at", F.lit("")), F.lit(") id="), F.col("conversation_id").cast("string")), F.when(F.col("context") != "", F.col("context")))
    some = refs.withColumn("n", n).filter(F.col("n") <= MOST_REFERENCES).groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x.l), "\n").alias("refs"))
    own = F.coalesce("text", F.lit("")) != ""
    head = F.concat(F.lit("Asset file_"), "asset_id", "ext", F.lit("\nMIME type: "), "mime")
    text = F.concat(head, F.when(own, F.concat(F.lit("\n\nExtracted content:\n"), "text")).otherwise(""), F.when(F.col("refs").isNotNull(), F.concat(F.lit("\n\nConversation references:\n"), "refs")).otherwise(""))
    kind = F.when(own, "extracted_text").when(F.col("refs").isNotNull(), "conversation_context").otherwise("metadata")
    return assets.join(some, "asset_id", "left").select("asset_id", kind.alias("content_kind"), F.substring(text, 1, MOST_TEXT).alias("text"))
