"""Text functions as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Section headings of a reasoned answer, tokens of the repetition measure, characters stripped around a short answer.
THINKING = "## Thinking"
FINAL = "## Final Response"
TOKEN = r"[a-z0-9]+|[\p{L}\p{N}_]"
NOT_ASCII = r"[^\x00-\x7F]"
EDGE_CHARS = " \t\r\n:.-*`"

#: Ranges of which a text has a character if NFKC can change it. ASCII and the letters from U+00C0 to U+00FF are their own forms wherever they
#: stand. One pattern for each range: a class of several is many times slower in the JVM.
UNSTABLE = (r"[\x80-\xBF]", r"[\x{100}-\x{10FFFF}]")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode spaces and the ASCII separators too."""
    return F.regexp_replace(text, r"(?U)^[\x1c-\x1f\s]+|[\x1c-\x1f\s]+$", "")


def canonical(text: Column) -> Column:
    """Stripped text; a null becomes the word None, as string conversion of a missing value gives."""
    return F.coalesce(strip(text.cast("string")), F.lit("None"))


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode compatibility form; Spark has no built-in for it. One text at a time is a Python string."""
    if text.null_count == len(text):
        return text
    return pa.array((unicodedata.normalize("NFKC", t.as_py()) if t.is_valid else None for t in text), pa.string(), size=len(text))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    """Unicode compatibility form of each text of an array."""
    return texts.map(lambda a: [unicodedata.normalize("NFKC", t) if t is not None else None for t in a] if a is not None else None)


def normalize(text: Column, compatibility: bool = False) -> Column:
    """Lower-cased letters and digits of any script, nothing else.

    ``compatibility`` first takes the NFKC form, as the audit's and the deduplication's operators do. Only texts
    with a character of ``UNSTABLE`` go to Python. Without it the expression stays in the JVM.
    """
    text = F.coalesce(text, F.lit("None"))
    if compatibility:
        text = F.coalesce(nfkc(F.when(text.rlike(UNSTABLE[0]) | text.rlike(UNSTABLE[1]), text)), text)
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


#: For ``plain``: lower case of ASCII and of the letters from U+00C0, and what is neither a letter nor a digit.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_GONE = bytes(c for c in range(256) if not (chr(c).isalnum() if c < 0x80 else c >= 0xC0 and c not in (0xD7, 0xF7)))


def unsettled(text: Column) -> Column:
    """``normalize`` with ``compatibility`` of texts with a character of ``UNSTABLE``; null for the others, of which ``plain`` gives the same in Python."""
    text = F.coalesce(text, F.lit("None"))
    return F.regexp_replace(F.lower(nfkc(F.when(text.rlike(UNSTABLE[0]) | text.rlike(UNSTABLE[1]), text))), r"[^\p{L}\p{N}]", "")


def plain(text: str | None) -> str:
    """The normalized form of a text of ASCII and the letters from U+00C0 to U+00FF, for tasks that are in Python anyway: many times faster than a pattern."""
    return "none" if text is None else text.encode("latin-1").translate(_LOWER, _GONE).decode("latin-1")


def settled(norm: pa.Array, text: pa.Array) -> Iterator[str]:
    """The normalized texts, where ``norm`` has what ``unsettled`` gives."""
    return (n.as_py() if n.is_valid else plain(t.as_py()) for n, t in zip(norm, text))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own only one, an empty text has none.

    Characters come from one split: taking substrings by position walks a UTF-8 string from its start each time.
    """

    def grams(c: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.array_join(F.slice(c, i + 1, n), ""))
        return F.when(F.size(c) >= n, F.array_distinct(pieces)).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(text, ""), lambda x: x != ""), grams)


@F.pandas_udf(IntegerType())
def _count_ngrams(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_distinct(t, k) for t, k in zip(text, n)], dtype="int32")


def _distinct(text: str, n: int) -> int:
    """Characters are numbered; beginnings of n-grams are numbered anew where the next character doesn't fit into 63 bits, so nothing is hashed."""
    if len(text) <= n:
        return int(len(text) > 0)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = int(codes.max()) + 1
    size, most = len(codes) - n + 1, 1
    key = np.zeros(size, np.int64)
    for i in range(n):
        if most * kinds >= 1 << 63:
            known, key = np.unique(key, return_inverse=True)
            most = len(known)
        key = key * kinds + codes[i : i + size]
        most *= kinds
    key.sort()
    return int((key[1:] != key[:-1]).sum()) + 1


def ngram_count(text: Column, n: int = 5) -> Column:
    """The size of ``char_ngrams``, counted in Arrow batches; null has none."""
    return _count_ngrams(F.coalesce(text, F.lit("")), F.lit(n))


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    return let(F.size(F.array_union(left, right)), lambda u: F.when(u > 0, F.size(F.array_intersect(left, right)) / u).otherwise(F.lit(0.0)))


def shares_span(left: Column, right: Column, span: int = 64) -> Column:
    """Whether two texts have a substring of ``span`` characters in common."""
    long_enough = (F.length(left) >= span) & (F.length(right) >= span)
    return F.coalesce(F.when(long_enough, F.arrays_overlap(char_ngrams(left, span), char_ngrams(right, span))), F.lit(False))


def excerpt(text: Column, length: int = 300) -> Column:
    return F.left(strip(F.regexp_replace(text, r"(?U)[\x1c-\x1f\s]+", " ")), F.lit(length))


def short_answer(text: Column) -> Column:
    """Lower-cased, white space collapsed, edge punctuation stripped."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)[\x1c-\x1f\s]+", " "), F.lit(EDGE_CHARS))


def final_section(text: Column) -> Column:
    """What follows the last final heading; the whole text if there is none."""
    return F.substring_index(text, FINAL, -1)


def headings_in_order(text: Column) -> Column:
    """Whether the first thinking heading stands before the last final heading."""
    last = F.length(text) - F.length(final_section(text)) - len(FINAL)
    first = F.locate(THINKING, text) - 1
    return F.contains(text, F.lit(FINAL)) & (first >= 0) & (last > first)


def format_valid(text: Column) -> Column:
    """Whether the first final heading stands after the first thinking heading."""
    return (F.locate(THINKING, text) > 0) & (F.locate(FINAL, text) > F.locate(THINKING, text))


def final_response(text: Column) -> Column:
    """Stripped text after the first final heading; empty without one."""
    return F.when(F.contains(text, F.lit(FINAL)), strip(F.substring(text, F.locate(FINAL, text) + len(FINAL), F.length(text)))).otherwise(F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs, and other letters one by one."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def repetition_ratio(text: Column, n: int = 4) -> Column:
    """Share of token n-grams that repeat an earlier one; 0 below 2n tokens."""

    def ratio(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), "\x1f"))
        return F.when(F.size(t) >= 2 * n, let(grams, lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g))).otherwise(F.lit(0.0))

    return let(tokens(text), ratio)


def token_count(text: Column) -> Column:
    """Number of tokens by the pattern above; callers with a tokenizer pass a Column of their own."""
    return F.size(tokens(text)).cast("long")


def common_prefix(left: Column, right: Column) -> Column:
    """Length of the equal beginning of two arrays."""
    n = F.least(F.size(left), F.size(right))
    differs = F.transform(F.sequence(F.lit(1), n), lambda i: ~F.element_at(left, i).eqNullSafe(F.element_at(right, i)))
    return F.when(n > 0, let(F.array_position(differs, True), lambda p: F.when(p > 0, p - 1).otherwise(n.cast("long")))).otherwise(F.lit(0).cast("long"))


def trim_ids(ids: Column, eos: int, pad: int) -> Column:
    """Generated ids up to and with the first end id, then without trailing padding."""
    cut = let(F.array_position(ids, eos), lambda p: F.when(p > 0, F.slice(ids, F.lit(1), p.cast("int"))).otherwise(ids))
    last = lambda x: F.array_max(F.transform(x, lambda v, i: F.when(v != pad, i + 1).otherwise(F.lit(0))))
    return let(cut, lambda c: F.slice(c, F.lit(1), F.coalesce(last(c), F.lit(0))))
