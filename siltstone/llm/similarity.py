"""N-gram Jaccard self-join by MinHash banding, with exact verification, and its classes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MAX_HASHES = 160
BLOCK = 300  # members of a bucket that are compared with each other, or with another block, in one go
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (so the fewest chance candidates) with which a pair at ``similarity`` meets with probability ``recall``."""
    best = None
    for rows in range(1, most + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD[1])
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; all words as one if there are fewer; none without words."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in common.alnum_words(text)], np.uint64)
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = acc * np.uint64(_ODD[0]) + h[i : i + n]
        return np.unique(_mix(acc))


class Sketcher:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 2048):
                low = np.minimum(low, (s[i : i + 2048, None] * self.a + self.b).min(axis=0))
            grid = low.reshape(self.bands, self.rows)
            acc = np.arange(1, self.bands + 1, dtype=np.uint64)
            for j in range(self.rows):
                acc = _mix(acc * np.uint64(_ODD[0]) + grid[:, j])
        return acc.view(np.int64)


def _node(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def signatures(docs: DataFrame, *, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, node (hash of the n-gram set), n (its size) and band hashes of every row."""

    def sign(batches):
        sketch = Sketcher(bands, rows)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in bpe.few(texts, 1 << 22):
                nodes, sizes, hashes = [], [], []
                for t in texts[a:b]:
                    s = shingles(t, words)
                    nodes.append(_node(s))
                    sizes.append(len(s))
                    hashes.append(sketch(s).tolist() if len(s) else [])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "n", "bands"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return given.mapInArrow(sign, "doc_id long, text_key long, node long, n long, bands array<long>")


def _groups(batches, keys: int):
    """Rows of a stream that is sorted by its first ``keys`` columns, as one table for each of their values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *turns.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and a == 0 and any(held[-1].column(k)[0] != batch.column(k)[0] for k in range(keys)) or held and a > 0:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _grid(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _firsts(bands: np.ndarray, key: int, left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Which pairs of rows (left, right) meet in the band of ``key`` and in none before it, so that each pair counts once."""
    band = int(np.flatnonzero(bands[left[0]] == key)[0])
    first = np.triu(np.ones((len(left), len(right)), bool), 1) if same else np.ones((len(left), len(right)), bool)
    for k in range(band):
        first &= bands[left, k][:, None] != bands[right, k][None, :]
    return first


def _sides(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, bool]:
    """Key, and the rows of the two blocks that a group compares."""
    key, i, j = (table.column(k)[0].as_py() for k in range(3))
    block = table["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    return key, left, right, i == j


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, by products of 0/1 matrices in blocks of columns."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    on = often[at]
    owner, at = owner[on], number[at[on]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for a in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(at, [a, a + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], at[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _local_roots(nodes: np.ndarray, pairs: np.ndarray) -> dict[int, int]:
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(int(nodes[a])), root(int(nodes[b]))
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is connected with) for every node of ``edges`` (node, root).

    Each round takes the smallest label among neighbours and then the label of the label, so the rounds grow with the logarithm
    of a component's length; each round's labels are written.
    """
    both = common.materialise(edges.select("node", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = common.materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("label").alias("m"))
        stepped = labels.join(near, "node").select("node", F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = common.materialise(stepped.join(up, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        moved = new.join(labels.withColumnRenamed("label", "was"), "node").filter(F.col("label") != F.col("was")).limit(1).count()
        labels = new
        if not moved:
            return labels


def _linked(docs: DataFrame, signed: DataFrame, *, text_col: str, words: int, similarity: float, block: int) -> DataFrame:
    """node, links, root of each node in each compared group where it has a verified link."""
    nodes = common.materialise(signed.filter(F.col("n") > 0).groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("bands").alias("bands")), "nodes")
    met = nodes.select("node", F.explode("bands").alias("key"))
    shared = common.materialise(met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1), "buckets")
    blocks = F.ceil(F.col("m") / block).cast("int")
    members = met.join(shared, "key").select("key", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = members.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block").join(nodes.select("node", "bands"), "node").select("key", "i", "j", "node", "block", "bands")
    shape = "key long, i int, j int, node long, block int, bands array<long>"

    def candidates(batches):
        for table in _groups(batches, 3):
            key, left, right, same = _sides(table)
            if not len(left) or not len(right):
                continue
            first = _firsts(_grid(table["bands"]), key, left, right, same)
            need = np.union1d(left[first.any(axis=1)], right[first.any(axis=0)])
            if len(need):
                yield from table.take(pa.array(need)).combine_chunks().to_batches()

    parts = F.col("key"), F.col("i"), F.col("j")
    needed = common.materialise(placed.repartition(*parts).sortWithinPartitions("key", "i", "j", "node").mapInArrow(candidates, shape), "candidates")
    keys = common.materialise(needed.select("node").distinct().join(nodes.select("node", "text_key"), "node").select("text_key"), "texts")
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).join(common.checked(keys), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))

    def sets(batches):
        for batch in batches:
            found = batch.column(1).to_pylist()
            for a, b in bpe.few(found, 1 << 22):
                made = [shingles(t, words) for t in found[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "grams"])

    full = needed.join(texts.mapInArrow(sets, "node long, grams binary"), "node").select("key", "i", "j", "node", "block", "bands", "grams")

    def verify(batches):
        for table in _groups(batches, 3):
            key, left, right, same = _sides(table)
            if not len(left) or not len(right):
                continue
            first = _firsts(_grid(table["bands"]), key, left, right, same)
            if not first.any():
                continue
            grams = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
            sizes, ids = np.array([len(g) for g in grams]), table["node"].to_numpy()
            both = _common(grams, left, right)
            first &= both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6
            a, b = np.nonzero(first)
            if not len(a):
                continue
            pairs = np.stack([left[a], right[b]], axis=1)
            links = np.bincount(pairs.ravel(), minlength=len(ids))
            roots = _local_roots(ids, pairs)
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on].astype(np.int64)), pa.array([roots[int(x)] for x in ids[on]], pa.int64())], names=["node", "links", "root"])

    return full.repartition(*parts).sortWithinPartitions("key", "i", "j", "node").mapInArrow(verify, "node long, links long, root long")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, text_key, class_id, n_links, n_copies, class_key.

    Documents with equal n-gram sets are one node; ``n_copies`` is their number and ``n_links`` the number of other nodes with a
    Jaccard similarity of ``similarity`` or more. Linked nodes are a class, named by its smallest doc_id; ``class_key`` tells
    classes apart where ids repeat, and is null for a text that is alone.

    MinHash bands (``choose_bands``) are shuffled alone at first; only buckets of two or more nodes go on. A large bucket is cut
    into blocks, and pairs of blocks are compared, so that no task holds more than two blocks. A pair is verified on its full
    n-gram sets in the first bucket where it meets. Pairs are never rows: a group gives each node's links and its local root, so
    what leaves it is linear in its members. Nothing is capped.

    Null, empty and wordless texts have no n-grams: no links, a class of their own (their doc_id), n_copies 1. Rows of a null id
    take part; a class with only null ids has a null class_id. Repeated rows are copies. A very long text is one row, compared by its whole
    set of n-grams. An empty table gives no rows. Extra columns are not read.
    """
    bands, rows = choose_bands(similarity, recall)
    signed = common.materialise(signatures(docs, id_col=id_col, text_col=text_col, words=words, bands=bands, rows=rows), "signatures")
    linked = common.materialise(_linked(docs, signed, text_col=text_col, words=words, similarity=similarity, block=block), "links")
    labels = components(linked.filter(F.col("node") != F.col("root")).select("node", "root").distinct())
    links = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    copies = signed.filter(F.col("n") > 0).groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"))
    known = copies.join(links, "node", "left").join(labels, "node", "left").filter((F.col("n_copies") > 1) | F.col("n_links").isNotNull()).withColumn("label", F.coalesce("label", "node"))
    known = common.materialise(known, "known")
    classes = known.groupBy("label").agg(F.min("least").alias("class_id"))
    table = common.materialise(known.join(classes, "label").select("node", F.coalesce("n_links", F.lit(0)).alias("links"), "n_copies", "class_id", F.col("label").alias("class_key")), "classes")
    out = signed.select("doc_id", "text_key", "node", "n").join(common.checked(table.withColumnRenamed("node", "named")), (F.col("node") == F.col("named")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "text_key", F.when(F.col("named").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "class_key")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The documents with one of each class: the smallest doc_id (then text hash); other columns stay as they are.

    Of repeated rows (equal id and text) one stays too. Rows without n-grams all stay, and so do classes with null ids only.
    """
    found = common.materialise(join(docs, id_col=id_col, text_col=text_col, **more), "join")
    multi = found.filter((F.col("n_copies") > 1) | (F.col("n_links") > 0)).filter(F.col("class_id").isNotNull())
    best = common.materialise(multi.filter(F.col("doc_id") == F.col("class_id")).groupBy("class_key").agg(F.min("text_key").alias("best_key"), F.count(F.lit(1)).alias("rows")), "best")
    marked = multi.join(common.checked(best), "class_key")
    chosen = (F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("best_key"))
    row, key, rows = common.fresh(docs, "row_id", "row_key", "rows")
    acts = marked.groupBy("doc_id", "text_key").agg(F.max(F.when(chosen, F.col("rows")).otherwise(0)).alias(rows)).filter(F.col(rows) != 1)
    acts = common.materialise(acts.withColumnsRenamed({"doc_id": row, "text_key": key}), "acts")
    joined = docs.join(common.checked(acts), F.col(id_col).cast("long").eqNullSafe(F.col(row)) & (F.xxhash64(text_col) == F.col(key)), "left")
    kept = joined.filter(F.col(row).isNull() & F.col(key).isNull()).select(*docs.columns)
    if acts.filter(F.col(rows) > 1).limit(1).count():
        again = joined.filter(F.col(rows) > 1).dropDuplicates([row, key]).select(*docs.columns)
        kept = kept.unionByName(again)
    return kept


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document against every other."""
    return join(common.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")
