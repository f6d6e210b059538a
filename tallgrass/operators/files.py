"""File inventories: categories, sensitive names, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallgrass.functions.text import lits

#: Endings by category, words of sensitive paths, and what notes are not.
SUFFIXES = {
    "Images": (".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg", ".avif", ".heic"),
    "Videos": (".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v"),
    "Audio": (".mp3", ".wav", ".flac", ".m4a", ".ogg"),
    "Documents": (".pdf", ".docx", ".odt", ".txt", ".md", ".rtf"),
    "Spreadsheets": (".csv", ".xlsx", ".ods"),
    "Archives": (".zip", ".tar", ".gz", ".7z", ".rar", ".xz", ".bz2"),
    "Code": (".py", ".js", ".ts", ".html", ".css", ".json", ".sh", ".rs", ".go", ".toml", ".yaml", ".yml"),
    "Apps": (".appimage", ".deb", ".rpm", ".flatpakref"),
}
SENSITIVE = ("seed", "private", "wallet", "keystore", "password", "recovery", "mnemonic", "ssh", "id_rsa", "secret", "passphrase", "2fa", "backup-code")
SKIP_PARTS = (".git", ".obsidian", ".trash", "node_modules", "__pycache__")
NOTE_SUFFIXES = (".md", ".txt")
NOTE_WORDS = ("seed", "mnemonic", "private key", "password", "wallet", "keystore", "recovery phrase", "id_rsa")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def category(name: Column) -> Column:
    out = F.lit("Other")
    for kind, endings in reversed(SUFFIXES.items()):
        out = F.when(suffix(name).isin(*endings), kind).otherwise(out)
    return out


def sensitive(path: Column) -> Column:
    return F.lower(path).rlike("|".join(SENSITIVE)).cast("int")


def skipped(path: Column, parts=SKIP_PARTS, suffixes=NOTE_SUFFIXES, words=NOTE_WORDS) -> Column:
    """Whether a path is none of a note's."""
    return F.arrays_overlap(F.split(path, "/"), lits(parts)) | ~suffix(path).isin(*suffixes) | F.lower(path).rlike("|".join(words))


def _head(inventory: DataFrame, first: int) -> DataFrame:
    return inventory.orderBy("category", "name", "path", "size").limit(first)


def sensitive_files(inventory: DataFrame, first: int = 1000, most: int = 150) -> DataFrame:
    """Of the same first files those that are sensitive, which no plan moves: the first most of them."""
    head = _head(inventory, first).filter("sensitive = 1")
    return head.orderBy("category", "name", "path", "size").limit(most).select("name", "path", "category")


def sort_plan(inventory: DataFrame, first: int = 1000, most: int = 75) -> DataFrame:
    """Of the first files by category and name, those that are not sensitive, most of each category."""
    head = _head(inventory, first).filter("sensitive = 0")
    k = F.row_number().over(W.partitionBy("category").orderBy("name", "path", "size"))
    return head.select("category", "name", "path", k.alias("place"), F.round(F.col("size") / 1024, 1).alias("kb")).filter(F.col("place") <= most)
