"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..sources.tables import checked, dealt, fresh, materialise, shared_dir, table_path

__all__ = ["alnum_words", "ascii_lower", "checked", "documents", "fold", "fresh", "materialise", "running", "shards", "shared_dir", "space_words", "table_path"]

#: Bytes that are not part of a benchmark word: all ASCII but digits and lower-case letters (after lower-casing).
_GAPS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; a small one of few files is dealt out to all cores."""
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fold(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def ascii_lower(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and every other character as it is."""
    return text.encode("utf-8", "surrogatepass").lower()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and any non-ASCII characters; none for null."""
    return ascii_lower(text).translate(_GAPS).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space (0x20, 0x09-0x0D); none for null."""
    return ascii_lower(text).split() if text else []


def shards(rows: int, per_shard: int) -> int:
    """Number of parts of about ``per_shard`` rows; one at least."""
    return max(1, math.ceil(rows / per_shard))
