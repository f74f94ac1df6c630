"""Language-model scores by context-tree weighting over bytes.

A text is the stream of its lower-cased words, a space after each, then a line feed as its end. A byte is eight binary decisions;
each has a tree of contexts, the last 0 to ``DEPTH`` bytes. A node's Krichevsky-Trofimov estimate and its children's product are
weighted by one half (a leaf has its estimate alone), so that the probability of a byte mixes the estimates of all depths of its
context. The counts are those of the training texts, then fixed: below the deepest context that was seen the mixture ends.

All that a text's score needs are the distinct n-grams of bytes (context and byte) and words of its batch, so texts never meet the
model. Keys travel in packed blocks, by steps that each split evenly:

1. ``gather``: a batch of texts gives, for each bucket of a hash of the context, a block of its distinct keys with their counts.
2. ``merge``: a bucket's blocks are summed, as they stream past, to the corpus's distinct keys.
3. ``climb``, ``descend``: distinct keys meet by their last bytes, so that the trees below depth two are whole in a task.
4. ``answer``: each batch's block gets the log-probabilities (or counts, for words) of its keys.
5. ``apply``: a batch's texts are scored by its answers.
"""

from __future__ import annotations

import collections
import math
import os
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 6  # a context and its byte are 56 bits of a key
SPLIT = 3  # nodes of this depth and below are whole in one task
FOLDS = 10
BATCH_BYTES = 32 << 20
BUCKET_BYTES = 4 << 20  # of text; buckets grow as the text to the power GROWTH, since distinct keys grow slower than the text
GROWTH = 0.75
CHUNK_ROWS = 120_000  # keys of one task whose nodes are in memory at a time
MERGE_ROWS = 500_000  # keys of blocks that are merged when there are so many
GRAM, WORD, TEXT = 0, 1, 2
_END = b"\n"
_STEP = 1 << 19
_ROWS = 256  # texts that are Python objects at a time
_TABLE = 4096


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else _END


def grams(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte of streams that follow each other: the DEPTH bytes before it, the latest first, and itself as one number.

    Before a stream's first byte are line feeds, whatever stream stands before it.
    """
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1) * DEPTH, sizes)
    padded = np.full(len(data) + DEPTH * len(sizes), 10, np.uint8)
    padded[place] = data
    key = np.zeros(len(padded) - DEPTH, np.int64)
    for k in [*range(1, DEPTH + 1), 0]:
        key <<= 8
        key |= padded[DEPTH - k : len(padded) - k]
    return key[place - DEPTH]


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte planes together; the first is sorted and kept as differences."""
    first = np.diff(columns[0], prepend=0)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    out[0] = np.cumsum(out[0])
    return out


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values))


class _Sums:
    """Distinct keys with summed counts of what is added, merged whenever ``MERGE_ROWS`` are new."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.new = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.append((keys, n))
        self.new += len(keys)
        if self.new >= max(MERGE_ROWS, len(self.held[0][0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held) > 1:
            key, n = (np.concatenate(c) for c in zip(*self.held))
            self.held, self.new = [], 0  # frees what was put together
            self.held = [_sum_by(key, n)]
        return self.held[0]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALVES, _WHOLES = _lgamma(np.arange(_TABLE) + 0.5), _lgamma(np.arange(_TABLE) + 1.0)


def _looked_up(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _TABLE)
    out[large] = _lgamma(n[large] + shift)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones (whole numbers)."""
    return _looked_up(_HALVES, a, 0.5) + _looked_up(_HALVES, b, 0.5) - math.log(math.pi) - _looked_up(_WHOLES, a + b, 1.0)


class Level:
    """Nodes of one depth: sorted keys (context << 8 | decision), counts, block probabilities and own weights."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray | None):
        self.keys, self.a, self.b = keys, a, b
        own = log_kt(a, b)
        if children is None:
            self.log_pw, self.weight = own, np.ones(len(own))
        else:
            self.log_pw = np.logaddexp(own, children) - math.log(2)
            self.weight = np.exp(own - math.log(2) - self.log_pw)

    def above(self, bits: int) -> Level:
        """The level one depth up, whose contexts lack the ``bits`` of the oldest byte."""
        names = (self.keys >> 8 + bits << 8) | self.keys & 255
        return Level(*_sum_by(names, self.a, self.b, self.log_pw))

    def mix(self, keys: np.ndarray, bit: np.ndarray, p: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The decision's probability given that of the level below, where that was seen."""
        if not len(self.keys):
            return p, seen
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        kt = (np.where(bit == 1, self.b[at], self.a[at]) + 0.5) / (self.a[at] + self.b[at] + 1.0)
        mixed = np.where(seen, self.weight[at] * kt + (1 - self.weight[at]) * p, kt)
        return np.where(here, mixed, p), here


class Forest:
    """The trees of depths ``SPLIT`` to ``DEPTH`` over sorted distinct keys that share no context of ``SPLIT`` bytes with others.

    At each depth a row is a (context, byte); rows are sorted, so the nodes of the k-th decision are runs of equal leading bits. A
    node without counts weighs nothing: its block probability is one.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.maps: list[np.ndarray] = []  # rows of the depth below to rows of this one
        self.nodes: list[list[tuple[np.ndarray, Level]]] = []  # for each depth and decision: node of each row, nodes
        self.key = key
        for d in range(DEPTH, SPLIT - 1, -1):
            if d < DEPTH:
                upper = (key >> 16 << 8) | key & 255
                key, at = np.unique(upper, return_inverse=True)
                n = np.bincount(at, n, len(key))
                self.maps.append(at)
            self.nodes.append([self._decision(key, n.astype(float), k) for k in range(8)])

    def _decision(self, key: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, Level]:
        lead = key >> 8 - k
        first = np.concatenate([[True], lead[1:] != lead[:-1]])
        starts = np.flatnonzero(first)
        node = np.cumsum(first, dtype=np.int32) - 1
        b = np.add.reduceat(n * (key >> 7 - k & 1), starts)
        a = np.add.reduceat(n, starts) - b
        children = None
        if self.nodes:
            below, level = self.nodes[-1][k]
            head = np.flatnonzero(np.concatenate([[True], below[1:] != below[:-1]]))
            children = np.bincount(node[self.maps[-1][head]], level.log_pw, len(starts))
        return node, Level((key[starts] >> 8 << 8) | (1 << k) | (key[starts] & 255) >> 8 - k, a, b, children)

    def sums(self) -> tuple[np.ndarray, ...]:
        """What the level above ``SPLIT`` needs: node, a, b, its children's log probability."""
        parts = [((x.keys >> 16 << 8) | x.keys & 255, x.a, x.b, x.log_pw) for _, x in self.nodes[-1]]
        names, a, b, below = (np.concatenate(c) for c in zip(*parts))
        some = a + b > 0
        return _sum_by(names[some], a[some], b[some], below[some])

    def log10(self, upper: list[Level]) -> np.ndarray:
        """log10 of each key's byte, given the levels above ``SPLIT`` from the deepest on."""
        rows = np.arange(len(self.key))
        places = [rows]
        for m in self.maps:
            places.append(m[places[-1]])
        short, at = np.unique((self.key >> 8 * (DEPTH - SPLIT + 2) << 8) | self.key & 255, return_inverse=True)
        product = np.ones(len(rows))
        for k in range(8):
            bit = self.key >> 7 - k & 1
            p, seen = np.full(len(rows), 0.5), np.zeros(len(rows), bool)
            for place, nodes in zip(places, self.nodes):
                node, level = nodes[k]
                i = node[place]
                a, b, w = level.a[i], level.b[i], level.weight[i]
                kt = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1.0)
                here = a + b > 0
                p = np.where(here, np.where(seen, w * kt + (1 - w) * p, kt), p)
                seen = here
            # The levels above map the probability so far by a line, and give a value of their own where nothing was seen below.
            low, high, alone = (self._up(short, k, upper, x, y) for x, y in ((0.0, True), (1.0, True), (0.5, False)))
            product *= np.where(seen, low[at] + (high - low)[at] * p, alone[at])
        return np.log10(product)

    @staticmethod
    def _up(key: np.ndarray, k: int, upper: list[Level], p: float, seen: bool) -> np.ndarray:
        bit, name = key >> 7 - k & 1, (1 << k) | (key & 255) >> 8 - k
        context = key >> 8
        value, known = np.full(len(key), p), np.full(len(key), seen)
        for level in upper:
            value, known = level.mix(context << 8 | name, bit, value, known)
            context = context >> 8
        return value


def _chunks(key: np.ndarray, n: np.ndarray):
    """Sorted keys by their contexts' last ``SPLIT`` bytes, about ``CHUNK_ROWS`` at a time; equal ones stay together."""
    short, a = key >> 8 * (DEPTH - SPLIT + 1), 0
    while a < len(key):
        b = int(np.searchsorted(short, short[min(a + CHUNK_ROWS, len(key)) - 1], "right"))
        yield a, b, Forest(key[a:b], n[a:b])
        a = b


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """The task of each key: by its last two bytes, and the third where there are tasks enough to split those."""
    fine = min(256, -(-parts // 64))
    name = (key >> 8 * DEPTH - 8 << 8 | (key >> 8 * DEPTH - 16 & 255) % fine).astype(np.uint64)
    with np.errstate(over="ignore"):
        return ((name * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _runs(batches, keys: list[str]):
    """The rows of a stream sorted by ``keys``, as (values of the keys, iterator of rows as dicts) for each run of equal ones."""

    def rows():
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                yield {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}

    it = rows()
    row = next(it, None)
    while row is not None:
        now = [row[k] for k in keys]

        def same():
            nonlocal row
            while row is not None and [row[k] for k in keys] == now:
                yield row
                row = next(it, None)

        yield now, (run := same())
        collections.deque(run, maxlen=0)


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_GATHERED = "batch long, kind int, bucket int, body binary"
_GATHERED_ARROW = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_MERGED = "kind int, bucket int, part int, total long, known long, body binary"
_MERGED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("total", pa.int64()), ("known", pa.int64()), ("body", pa.binary())])
_NODES = "node long, a double, b double, below double"
_NODES_ARROW = pa.schema([("node", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("below", pa.float64())])


def _buckets(key: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """A hash of a gram's context or of a word."""
    with np.errstate(over="ignore"):
        h = (key >> 8 if kind == GRAM else key).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


def _split(place: np.ndarray):
    """(value, positions) for each value of ``place``, positions in their order."""
    order = np.argsort(place, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1]])) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        yield int(place[order[a]]), order[a:b]


def gather(docs: DataFrame, buckets: int, *, id_col: str, text_col: str, folds: int) -> DataFrame:
    """Batches of texts: a row with the packed streams of each, and blocks of its distinct keys with their counts in training texts."""

    def make(batches):
        packer = zstandard.ZstdCompressor(level=3)

        class Held:
            def __init__(self):
                self.ids, self.outs, self.streams, self.size = [], [], [], 0
                self.part: tuple[list[bytes], list[bytes]] = ([], [])
                self.filled, self.sums, self.words = [0, 0], _Sums(), _Sums()

            def add(self, doc, out, text):
                made = stream(common.space_words(text))
                self.ids.append(doc)
                self.outs.append(out)
                self.streams.append(made)
                self.size += len(made)
                self.part[out].append(made)
                self.filled[out] += len(made)
                if self.filled[out] >= _STEP:
                    self.count(out)

            def count(self, out):
                part = self.part[out]
                if part:
                    u, c = np.unique(grams(np.frombuffer(b"".join(part), np.uint8), np.array([len(s) for s in part])), return_counts=True)
                    self.sums.add(u, np.zeros(len(u), np.int64) if out else c)
                    words = collections.Counter(b"".join(part).split())
                    words[_END] = len(part)
                    key, n = np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))
                    self.words.add(key, 0 * n if out else n)
                    part.clear()
                    self.filled[out] = 0

            def flush(self):
                batch = int.from_bytes(os.urandom(8), "little", signed=True)
                n = len(self.ids)
                flags = np.array([(i is not None) + 2 * o for i, o in zip(self.ids, self.outs)], np.uint8).tobytes()
                head = struct.pack("<q", n) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + flags + np.array([len(s) for s in self.streams], "<i8").tobytes()
                blob = packer.compress(b"".join((head, *self.streams)))
                self.streams.clear()
                yield _batch(_GATHERED_ARROW, batch=[batch], kind=[TEXT], bucket=[-1], body=[blob])
                self.count(0)
                self.count(1)
                for kind, sums in ((GRAM, self.sums), (WORD, self.words)):
                    key, count = sums.total()
                    sums.held = []
                    blocks = [(b, _packed(key[at], count[at])) for b, at in _split(_buckets(key, kind, buckets))]
                    for a in range(0, len(blocks), 64):
                        some = blocks[a : a + 64]
                        yield _batch(_GATHERED_ARROW, batch=[batch] * len(some), kind=[kind] * len(some), bucket=[b for b, _ in some], body=[x for _, x in some])

        held = Held()
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                for doc, out, text in zip(*(batch.column(k).slice(a, _ROWS).to_pylist() for k in range(3))):
                    held.add(doc, int(out), text)
                    if held.size >= BATCH_BYTES:
                        yield from held.flush()
                        held = Held()
        if held.ids:
            yield from held.flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (common.fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, _GATHERED)


def merge(gathered: DataFrame, parts: int) -> DataFrame:
    """The corpus's distinct keys with their counts, in blocks: those of a bucket of grams cut by the tasks that hold their trees."""

    def sum_up(batches):
        for (kind, bucket), rows in _runs(batches, ["kind", "bucket"]):
            sums = _Sums()
            for row in rows:
                sums.add(*_unpacked(row["body"], np.int64, np.int64))
            key, n = sums.total()
            for part, at in [(-1, slice(None))] if kind == WORD else _split(_part(key, parts)):
                yield _batch(_MERGED_ARROW, kind=[kind], bucket=[bucket], part=[part], total=[int(n[at].sum())], known=[int((n[at] > 0).sum())], body=[_packed(key[at], n[at])])

    blocks = gathered.filter(F.col("kind") != TEXT).select("kind", "bucket", "body")
    return blocks.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(sum_up, _MERGED)


def _of_part(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of a task's blocks, sorted, with their counts, buckets and order."""
    found = [(row["bucket"], *_unpacked(row["body"], np.int64, np.int64)) for row in rows]
    key, n = np.concatenate([k for _, k, _ in found]), np.concatenate([c for _, _, c in found])
    bucket = np.repeat(np.array([b for b, _, _ in found], np.int32), [len(k) for _, k, _ in found])
    order = np.argsort(key)
    return key[order], n[order], bucket[order]


def train(merged: DataFrame) -> DataFrame:
    """kind, bucket, body (keys and log10 probabilities of their bytes) for the grams of ``merged``, those never seen in training too.

    A task has all keys of some two-byte contexts (of three bytes, where there are many tasks), and works on chunks of them that share
    no node of depth ``SPLIT`` or more. The nodes above, at most 2**24 by their names, come to the driver as sums, and go out as a
    broadcast.
    """
    placed = merged.filter(F.col("kind") == GRAM).select("part", "bucket", "body").repartition("part").sortWithinPartitions("part")

    def climb(batches):
        for _, rows in _runs(batches, ["part"]):
            key, n, _ = _of_part(rows)
            parts = [forest.sums() for _, _, forest in _chunks(key, n)]
            node, a, b, below = _sum_by(*(np.concatenate(c) for c in zip(*parts)))
            yield _batch(_NODES_ARROW, node=node, a=a, b=b, below=below)

    sums = placed.mapInArrow(climb, _NODES).groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).orderBy("node").toArrow()
    upper = [Level(*(sums[c].to_numpy() for c in ("node", "a", "b", "below")))]
    for _ in range(SPLIT - 1):
        upper.append(upper[-1].above(8))
    sent = merged.sparkSession.sparkContext.broadcast(upper)

    def descend(batches):
        for _, rows in _runs(batches, ["part"]):
            key, n, bucket = _of_part(rows)
            values = np.empty(len(key), np.float32)
            for a, b, forest in _chunks(key, n):
                values[a:b] = forest.log10(sent.value)
            for b, at in _split(bucket):
                yield _batch(_GATHERED_ARROW, batch=[None], kind=[GRAM], bucket=[b], body=[_packed(key[at], values[at])])

    return placed.mapInArrow(descend, _GATHERED).drop("batch")


def answer(gathered: DataFrame, known: DataFrame) -> DataFrame:
    """batch, kind, body: the keys of each block with what ``known`` (kind, bucket, body) says of them."""

    def reply(batches):
        for (kind, _), rows in _runs(batches, ["kind", "bucket"]):
            of = np.float32 if kind == GRAM else np.int64
            table: list[tuple[np.ndarray, ...]] = []
            key = value = None
            for row in rows:
                if row["batch"] is None:  # what is known comes first
                    table.append(tuple(_unpacked(row["body"], np.int64, of)))
                    continue
                if key is None:
                    key, value = (np.concatenate(c) for c in zip(*table))
                    order = np.argsort(key)
                    key, value = key[order], value[order]
                asked, _ = _unpacked(row["body"], np.int64, np.int64)
                body = _packed(asked, value[np.searchsorted(key, asked)])
                yield _batch(_GATHERED_ARROW, batch=[row["batch"]], kind=[kind], bucket=[-1], body=[body])

    asked = gathered.filter(F.col("kind") != TEXT)
    both = known.select(F.lit(None).cast("long").alias("batch"), "kind", "bucket", "body").unionByName(asked)
    placed = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("batch").asc_nulls_first())
    return placed.mapInArrow(reply, _GATHERED).drop("bucket")


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """Scores of all texts by what the texts outside fold 0 teach.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word unigrams), score (log10 probability of the token
    stream under the context trees) and bits_per_byte (its code length for each byte of the stream). Texts are read once, into
    batches of about ``BATCH_BYTES``; a key in every batch is one entry of one block for each, whatever its count. Null and empty
    texts are the end token alone. A null id is the empty text as to folds. Repeated rows all count and all return. A very long text
    is a batch of its own. Other columns are not read. An empty table gives no rows.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    buckets = max(1, math.ceil((size / BUCKET_BYTES) ** GROWTH))
    gathered = common.materialise(gather(docs, buckets, id_col=id_col, text_col=text_col, folds=folds), "batches")
    merged = common.materialise(merge(gathered, buckets), "keys")
    words = merged.filter(F.col("kind") == WORD)
    totals = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    train_tokens, distinct = int(totals[0]), int(totals[1])
    model = common.materialise(train(merged), "model")
    answers = answer(gathered, model.unionByName(words.select("kind", "bucket", "body")))
    floor = math.log10(train_tokens + 0.1 * (distinct + 1))
    blobs = gathered.filter(F.col("kind") == TEXT).select(F.col("batch").alias("of"), F.col("body").alias("blob"))

    def apply(known, packed):
        tables = []
        for kind, of in ((GRAM, np.float32), (WORD, np.int64)):
            found = [_unpacked(b, np.int64, of) for k, b in zip(known["kind"].to_pylist(), known["body"].to_pylist()) if k == kind]
            key, value = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, of))
            order = np.argsort(key)
            tables.append((key[order], value[order]))
        (key, value), (word, count) = tables
        out: list[list] = [[] for _ in range(7)]
        terms: dict[bytes, int] = {}
        for blob in packed["blob"].to_pylist():
            data = zstandard.ZstdDecompressor().decompress(blob)
            (n,) = struct.unpack_from("<q", data)
            ids, flags = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, n, 8 + 8 * n)
            sizes = np.frombuffer(data, "<i8", n, 8 + 9 * n)
            at = 8 + 17 * n
            ends = at + np.cumsum(sizes)
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else at) + _STEP, "right")))
                lo, hi = int(ends[a] - sizes[a]), int(ends[b - 1])
                codes = _valued(key, value, grams(np.frombuffer(data, np.uint8, hi - lo, lo), sizes[a:b]))
                scores = np.add.reduceat(codes, ends[a:b] - sizes[a:b] - lo)
                split = [[*data[ends[k] - sizes[k] : ends[k]].split(), _END] for k in range(a, b)]
                fresh = [w for w in set().union(*split) if w not in terms]
                terms.update(zip(fresh, count[np.searchsorted(word, np.fromiter(map(word_key, fresh), np.int64, len(fresh)))].tolist()))
                for k, words in zip(range(a, b), split):
                    c = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
                    row = (int(ids[k]) if flags[k] & 1 else None, bool(flags[k] & 2), len(c), int((c > 0).sum()), float(np.log10(c + 0.1).sum() - len(c) * floor), float(scores[k - a]), float(-scores[k - a] / math.log10(2) / sizes[k]))
                    for column, x in zip(out, row):
                        column.append(x)
                a = b
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    scored = answers.groupBy("batch").cogroup(blobs.groupBy("of")).applyInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _valued(key: np.ndarray, value: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key; all of them are in ``key``. Sorted first, so that the search walks through ``key`` once."""
    order = np.argsort(asked)
    ranked = asked[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    found = value[np.searchsorted(key, ranked[starts])].astype(np.float64)
    out = np.empty(len(asked))
    out[order] = np.repeat(found, np.diff(np.append(starts, len(asked))))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document."""
    return score(common.documents(spark, sf_dir))
