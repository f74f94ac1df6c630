"""Benchmark decontamination by an FM-index for each training shard.

A shard is a slice of the documents as they are read. Its text is the sequence of the documents' words, written as numbers of the
test phrases' own alphabet: a word that no phrase has cannot be inside an occurrence, so a run of such words is one separator, and
so is a run of known words shorter than the shortest phrase. Over that sequence stand a suffix array (built, then sampled), its
Burrows-Wheeler transform in a wavelet matrix, and backward search of all phrases at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

WINDOW = 10
SAMPLE = 8
BLOCK_WINDOWS = 100_000
BLOCKS_PER_PASS = 4  # blocks of windows that go to the tasks at a time
SHARD_CHARS = 8 << 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative numbers by prefix doubling; the first round ranks as many symbols as fit in 62 bits."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    width = max(1, 62 // (bits + 1))
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << (bits + 1)) | padded[k : k + n]
    done = width
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if n else ranked
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1 or done >= n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] + 1
        key = rank * (n + 1) + after
        done *= 2


class WaveletMatrix:
    """Ranks of symbols over a sequence, a bit plane for each bit, with a count for each 64-bit word."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.planes = []
        for b in range(bits - 1, -1, -1):
            one = (seq >> b & 1).astype(bool)
            words = np.zeros(len(seq) // 64 + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.planes.append((b, words, counts, len(seq) - int(counts[-1])))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        a = np.zeros_like(i)
        for b, words, counts, zeros in self.planes:
            one = (symbol >> b & 1).astype(bool)
            out = []
            for x in (a, i):
                w = x >> 6
                ones = counts[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                out.append(np.where(one, zeros + ones, x - ones))
            a, i = out
        return i - a


class FMIndex:
    """Backward search and location over a sequence of numbers from 1 on; 0 ends it."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]]).astype(np.int64)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(self.bwt, max(1, (symbols - 1).bit_length()))
        self.sampled = sa % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.kept = sa[self.sampled]
        self.n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase (rows of ``phrases``, filled to the right)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for t in range(int(lengths.max()) if len(lengths) else 0):
            on = np.flatnonzero((lengths > t) & (hi > lo))
            c = phrases[on, lengths[on] - 1 - t]
            lo[on], hi[on] = self.before[c] + self.tree.rank(c, lo[on]), self.before[c] + self.tree.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: walk back to the next sampled one."""
        at, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at[left]]
            out[left[done]] = self.kept[self.slot[at[left[done]]]] + steps
            left = left[~done]
            c = self.bwt[at[left]]
            at[left] = self.before[c] + self.tree.rank(c, at[left])
            steps += 1
        return out


class Phrases:
    """Windows of benchmark items as rows of numbers: 1 is the separator, words follow from 2 on."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = {}
        for item, words in items:
            codes = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words]
            for k in range(max(1, len(codes) - window + 1) if codes else 0):
                found.setdefault(tuple(codes[k : k + window]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for k, x in enumerate(found):
            self.rows[k, : len(x)] = x
        self.shortest = int(self.lengths.min()) if found else 0

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, merged spans of words that occurrences cover, and the items that occur."""
        get = self.numbers.get
        parts = [np.array([get(w, 1) for w in common.alnum_words(t)], np.int64) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        out: list = [(int(n), [], set()) for n in sizes]
        if not len(self.rows) or not sizes.sum():
            return out
        glue = np.array([1], np.int64)
        joined = np.concatenate([x for p in parts for x in (p, glue)])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        del parts
        known = np.concatenate([[False], joined > 1, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        first, last = edges[::2], edges[1::2]
        long = last - first >= self.shortest
        first, last = first[long], last[long]
        if not len(first):
            return out
        each = last - first + 1  # and the separator after it
        ends = np.cumsum(each)
        place = np.repeat(first - (ends - each), each) + np.arange(ends[-1])
        text = joined[place]
        text[ends - 1] = 1
        index = FMIndex(text, len(self.numbers) + 2)
        lo, hi = index.search(self.rows, self.lengths)
        count = hi - lo
        phrase = np.repeat(np.arange(len(count)), count)
        if not len(phrase):
            return out
        at = index.locate(np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(phrase)))
        delta = np.zeros(len(text) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + self.lengths[phrase], -1)
        hit = np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]])
        turns = np.flatnonzero(hit[1:] != hit[:-1])
        for a, b in zip(place[turns[::2]], place[turns[1::2] - 1] + 1):
            doc = int(np.searchsorted(starts, a, "right")) - 1
            out[doc][1].append((int(a - starts[doc]), int(b - starts[doc])))
        docs = np.searchsorted(starts, place[at], "right") - 1
        for pair in np.unique(docs * len(self.rows) + phrase).tolist():
            out[pair // len(self.rows)][2].update(self.items[pair % len(self.rows)])
        return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int):
    """The benchmark in blocks of a bounded number of windows; only one block is in the driver's hands at a time."""
    items, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        words = common.alnum_words(row["text"])
        items.append((row["item"], words))
        size += len(words)
        if size >= most:
            yield Phrases(items, window)
            items, size = [], 0
    yield Phrases(items, window)


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, into: str = "contamination", keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS, blocks_per_pass: int = BLOCKS_PER_PASS) -> DataFrame:
    """Each document with a struct column ``into``: n_words, n_hit, item_ids (sorted as text) and merged spans of word positions.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Scanning needs no
    shuffle: each task indexes its own slices of at most about ``SHARD_CHARS`` characters (a longer text is a slice of its own).
    The benchmark goes to the tasks as a broadcast of at most ``blocks_per_pass`` blocks of about ``block_windows`` windows, which one
    Python stage takes in turn; a larger benchmark takes further passes, each over what the one before wrote. Null and empty texts have
    no words; null items' texts have no windows; a null item id is the empty text. Items with the same window all count as occurring,
    and repeated items as one. An empty benchmark or table gives no hits. Rows, repeated ones too, and other columns stay (those in
    ``keep``, default all; a column ``into`` is replaced).
    """
    columns = [c for c in (keep or docs.columns) if c != into]
    current = docs.select(*columns, *([] if text_col in columns else [text_col]))
    schema = T.StructType([*current.schema.fields, T.StructField(into, RESULT)])
    context, some = docs.sparkSession.sparkContext, []
    for phrases in _blocks(benchmark, item_col, item_text_col, window, block_windows):
        if len(some) == blocks_per_pass:
            current = common.materialise(current.mapInArrow(_scanner(context.broadcast(some), text_col, into), schema), "marked")
            some = []
        some.append(phrases)
    return current.mapInArrow(_scanner(context.broadcast(some), text_col, into), schema).select(*columns, into)


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _scanner(sent, text_col: str, into: str):
    """Marks texts with the hits of each block of phrases, and with those of an earlier pass."""

    def scan(batches):
        for batch in batches:
            at = {f.name: k for k, f in enumerate(batch.schema)}
            texts = batch.column(at[text_col]).to_pylist()
            old = batch.column(at[into]).to_pylist() if into in at else [None] * len(texts)
            rows = []
            for a, b in bpe.few(texts, SHARD_CHARS):
                found = [(0, [(s["start"], s["end"]) for s in was["spans"]], set(was["item_ids"])) if was else (0, [], set()) for was in old[a:b]]
                for phrases in sent.value:
                    found = [(n, spans + more, items | others) for (_, spans, items), (n, more, others) in zip(found, phrases.scan(texts[a:b]))]
                for n, spans, items in found:
                    spans = _merge(spans)
                    rows.append({"n_words": n, "n_hit": sum(b - a for a, b in spans), "item_ids": sorted(items), "spans": [{"start": a, "end": b} for a, b in spans]})
            kept = [f.name for f in batch.schema if f.name != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in kept), pa.array(rows, _ARROW)], names=[*kept, into])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """The documents without any occurrence of a window; columns as they are, of whatever names."""
    (into,) = common.fresh(docs, "contamination")
    return mark(docs, benchmark, text_col=text_col, window=window, into=into, **more).filter(F.col(into)["n_hit"] == 0).drop(into)


def cut(marked: DataFrame, *, text_col: str = "text", into: str = "contamination") -> DataFrame:
    """Marked documents with the removal spans cut out of their texts, for uses that keep the rest of a document."""

    def trim(batches):
        for batch in batches:
            names = batch.schema.names
            k, m = names.index(text_col), names.index(into)
            texts = [_trim(t, [(s["start"], s["end"]) for s in c["spans"]]) if t and c and c["spans"] else t for t, c in zip(batch.column(k).to_pylist(), batch.column(m).to_pylist())]
            yield batch.set_column(k, names[k], pa.array(texts, pa.string()))

    return marked.mapInArrow(trim, marked.schema)


def _trim(text: str, spans: list[tuple[int, int]]) -> str:
    import re

    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document against every benchmark item."""
    docs = common.documents(spark, sf_dir)
    found = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["item_ids"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, win FROM (SELECT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) ELSE [w] END) AS win FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM p),
dw AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, n, i, item FROM dw JOIN p USING (win)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
