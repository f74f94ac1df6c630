"""Ranked lexical search: an inverted index in shards and blocks, searched by block-max MaxScore."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bpe, common

TOP = 10
BLOCK = 128  # postings
SHARD_DOCS = 65_536
SHARD_POSTINGS = 2_000_000  # a shard ends with the document that reaches one of these
WINDOW = 4096  # documents that are scored together
ITEMS_PER_PASS = 10_000

#: Each byte as itself, A-Z as a-z, and a space for ASCII that is no letter or digit.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_INDEX = "shard long, term string, n_docs long, n_terms long, last array<int>, bytes array<int>, points array<int>, tf array<int>, n array<int>, postings binary, ids array<long>, lengths array<int>"
_FOUND = "item long, doc_id long, score long"


def split(texts: pa.Array) -> pa.ListArray:
    """Terms of each text in turn: runs of ASCII letters and digits and of any other non-ASCII characters, only A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    _, offsets, data = texts.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[texts.offset, texts.offset + len(texts)]].tolist()
    folded = (data.to_pybytes() if data else b"")[:last].translate(_FOLD)
    same = pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset)
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(same)) if last > first else pa.array([[]] * len(texts), pa.list_(pa.string()))


# ---- postings


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned numbers, seven bits each, the lowest first and the last without the high bit; and how many each takes."""
    size = 1 + sum((values >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        on = size > k
        out[at[on] + k] = values[on] >> 7 * k & 127 | np.where(size[on] > k + 1, 128, 0)
    return out, size


def numbers(coded: np.ndarray) -> np.ndarray:
    """What ``varints`` has coded."""
    ends = np.flatnonzero(coded < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(coded)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((coded & 127).astype(np.int64) << 7 * place, starts) if len(coded) else np.zeros(0, np.int64)


class Shard:
    """Documents of a part of the corpus, inverted."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.cells, self.tfs, self.ids, self.lengths, self.postings = [], [], [], [], 0

    def add(self, ids: list, texts: pa.Array) -> None:
        terms = split(texts)
        coded = terms.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        to = np.fromiter((self.codes.setdefault(w, len(self.codes)) for w in words if w), np.int64)
        if "" in words:  # an empty text's only piece
            to = np.insert(to, words.index(""), -1)
        code = to[coded.indices.to_numpy(zero_copy_only=False)] if len(to) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
        owner, code = owner[code >= 0], code[code >= 0]
        cell, tf = np.unique(code << 32 | owner + len(self.ids), return_counts=True)
        self.cells.append(cell)
        self.tfs.append(tf)
        self.lengths.append(np.bincount(owner, minlength=len(ids)))
        self.ids += ids
        self.postings += len(cell)

    def rows(self, shard: int):
        """The index of the shard as record batches: a row of its documents, then one for each term.

        A term's postings, in the order of documents, are cut into blocks. For each block: its last document, its bytes (gaps and term
        frequencies) and its points: frequencies with the least length of a document that has them, without those that another point
        beats in both. A block's best score for any corpus statistics is that of one of its points.
        """
        cell, tf, lengths = np.concatenate(self.cells), np.concatenate(self.tfs), np.concatenate(self.lengths)
        order = np.argsort(cell, kind="stable")
        cell, tf = cell[order], tf[order]
        code, doc = cell >> 32, cell & 0xFFFFFFFF
        names = [x.split()[0] for x in _INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 5, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        own = [shard, None, int((lengths > 0).sum()), int(lengths.sum()), *[None] * 6, self.ids, lengths.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(own, kinds)], names=names)
        if not len(cell):
            return
        first = np.flatnonzero(np.diff(code, prepend=-1))  # of each term
        count = np.diff(np.append(first, len(cell)))
        opens = (np.arange(len(cell)) - np.repeat(first, count)) % BLOCK == 0
        block = np.flatnonzero(opens)
        of = np.cumsum(opens) - 1
        gaps = np.where(opens, doc, np.diff(doc, prepend=0))
        coded, size = varints(np.stack([gaps, tf], axis=1).reshape(-1))
        size = np.add.reduceat(size, 2 * block)
        n = lengths[doc]
        best = np.lexsort((n, -tf, of))  # in each block the largest frequency first
        least = n[best] - of[best] * (int(n.max()) + 1)  # lower in each later block, so the minimum so far is the block's own
        point = best[least < np.concatenate([[1 << 62], np.minimum.accumulate(least)[:-1]])]
        points = np.bincount(of[point], minlength=len(block))
        blocks, ends = np.searchsorted(block, np.append(first, len(cell))), np.append(block[1:], len(cell)) - 1  # of each term, of each block
        upto_point, upto_byte = np.append(0, np.cumsum(points)), np.append(0, np.cumsum(size))
        listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
        words = pa.array(list(self.codes), pa.string())
        raw = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(upto_byte[blocks].astype(np.int32).tobytes()), pa.py_buffer(coded.tobytes())])
        whole = pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first), shard), pa.int64()), words.take(pa.array(code[first])), pa.array(count, pa.int64()), pa.nulls(len(first), pa.int64()), listed(blocks, doc[ends]), listed(blocks, size), listed(blocks, points),
            listed(upto_point[blocks], tf[point]), listed(upto_point[blocks], n[point]), raw, pa.nulls(len(first), pa.list_(pa.int64())), pa.nulls(len(first), pa.list_(pa.int32())),
        ], names=names)
        for a in range(0, whole.num_rows, 20_000):
            yield whole.slice(a, 20_000)


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The inverted index of all terms of all texts, written in the shared folder: any number of searches can use it.

    Each task inverts the documents that it reads, ``shard_docs`` or ``shard_postings`` at a time; nothing is shuffled. The index holds
    no statistics of the corpus, so parts of one may be added to another.
    """

    def invert(batches):
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = [*map(int, pc.fill_null(pc.binary_length(texts), 0).to_pylist())]
            for a, b in bpe.few([range(s) for s in sizes]):
                shard.add(ids[a:b], texts.slice(a, b - a))
                if len(shard.ids) >= shard_docs or shard.postings >= shard_postings:
                    yield from shard.rows(number)
                    number, shard = number + 1, Shard()
        if shard.ids:
            yield from shard.rows(number)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.materialise(given.mapInArrow(invert, _INDEX), "index")


# ---- scores


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def measure(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these lengths, of ``n`` documents with ``total`` terms."""
    return 10 + 90 * lengths.astype(np.int64) * n // total


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class List:
    """A term's postings in a shard; blocks are decoded when they are asked for."""

    def __init__(self, row: dict, n: int, total: int):
        as_array = lambda c: np.array(row[c], np.int64)
        self.last, size, points = as_array("last"), as_array("bytes"), as_array("points")
        self.ends = np.append(0, np.cumsum(size))
        self.raw = np.frombuffer(row["postings"], np.uint8)
        self.best = np.maximum.reduceat(part(as_array("tf"), measure(as_array("n"), n, total)), np.cumsum(points) - points)
        self.count, self.decoded = row["n_docs"], 0

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some blocks, in order."""
        self.decoded += len(which)
        if len(which) == which[-1] - which[0] + 1:
            raw = self.raw[self.ends[which[0]] : self.ends[which[-1] + 1]]
        else:
            raw = np.concatenate([self.raw[self.ends[b] : self.ends[b + 1]] for b in which.tolist()])
        pairs = numbers(raw).reshape(-1, 2)
        sizes = np.where(which == len(self.last) - 1, self.count - BLOCK * (len(self.last) - 1), BLOCK)
        start = np.cumsum(sizes) - sizes
        upto = np.cumsum(pairs[:, 0])
        return upto - np.repeat(upto[start] - pairs[start, 0], sizes), pairs[:, 1]


class Heap:
    """The best scores of an item so far: score, then the smaller id, null ids last."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    @property
    def least(self) -> int:
        """What a further document has to reach."""
        return self.rows[-1][0] if len(self.rows) == self.size else 1

    def offer(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), ids))
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.size]


def search_shard(lists: dict[str, List], ids: np.ndarray, valid: np.ndarray, m: np.ndarray, item: list[tuple[str, int, int]], size: int, window: int = WINDOW) -> Heap:
    """The best documents of a shard for one item, given as terms with their weight and the best part of any document in the corpus.

    Windows of documents are scored in turn. Terms whose bounds together stay below what a document has to reach are non-essential:
    documents come from the other terms' lists only. From the non-essential term of the largest bound down, a document goes on only
    if what it has, the maximum of the block that it would be in and the bounds of the terms below together suffice; only blocks with
    such documents are decoded.
    """
    heap = Heap(size)
    terms = sorted((w * bound, w, term) for term, w, bound in item if term in lists and w > 0)
    upto = np.cumsum([0, *(b for b, _, _ in terms)]).tolist()  # bounds of the terms below each
    for a in range(0, len(ids), window):
        b = min(a + window, len(ids))
        essential = 0
        while essential < len(terms) and upto[essential + 1] < heap.least:
            essential += 1
        score = np.zeros(b - a, np.int64)
        for _, w, term in terms[essential:]:
            own = lists[term]
            first, end = np.searchsorted(own.last, [a, b - 1])
            which = np.arange(first, min(end + 1, len(own.last)))
            if len(which):
                doc, tf = own.blocks(which)
                on = (doc >= a) & (doc < b)
                doc, tf = doc[on], tf[on]
                score[doc - a] += w * part(tf, m[doc])
        doc = np.flatnonzero(score) + a
        have = score[doc - a]
        for k in range(essential - 1, -1, -1):
            on = have + upto[k + 1] >= heap.least
            doc, have = doc[on], have[on]
            if not len(doc):
                break
            _, w, term = terms[k]
            own = lists[term]
            block = np.searchsorted(own.last, doc)
            inside = block < len(own.last)
            on = have + np.where(inside, w * own.best[np.minimum(block, len(own.last) - 1)], 0) + upto[k] >= heap.least
            doc, have, block, inside = doc[on], have[on], block[on], inside[on]
            which = np.unique(block[inside])
            if len(which):
                listed, tf = own.blocks(which)
                at = np.minimum(np.searchsorted(listed, doc), len(listed) - 1)
                hit = listed[at] == doc
                have[hit] += w * part(tf[at[hit]], m[doc[hit]])
        on = have >= heap.least
        if on.any():
            doc, have = doc[on], have[on]
            if len(doc) > 4 * size:  # what is below the best scores of the window alone can't stay
                on = have >= np.partition(have, len(have) - size)[len(have) - size]
                doc, have = doc[on], have[on]
            heap.offer(have, [i if v else None for i, v in zip(ids[doc].tolist(), valid[doc].tolist())])
    return heap


def best_part(n: int, total: int) -> Column:
    """The best part of a row of the index: of its points."""
    return F.expr(f"array_max(zip_with(tf, n, (f, k) -> (1000000000L * f) div (1000L * f + 8L * (10L + (90L * k * {n}L) div {total}L))))")


def search(found: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", top: int = TOP, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents of a written ``index``.

    Items are numbered, and ``per_pass`` of them go to the tasks at a time as terms with weights and bounds. A pass reads the index, keeps the
    rows of its terms, takes document frequencies and bounds from them, and brings the rows of each shard together, where a heap for
    each item is filled; the heaps of all shards are merged by a ranking that keeps ``top`` rows of each task before it shuffles.
    """
    spark = found.sparkSession
    docs = found.filter("term is null")
    n, total = docs.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    given = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    numbered = common.materialise(common.running(given, ["item_id", "text"], into="item"), "items")
    kept = []
    for first in range(0, numbered.count() if n else 0, per_pass):
        kept.append(_pass(found, docs, numbered.filter(F.col("item").between(first, first + per_pass - 1)), n, total, top))
    rows = common.materialise(kept[0], "heaps") if kept else spark.createDataFrame([], _FOUND)
    for more in kept[1:]:
        rows = rows.unionByName(common.materialise(more, "heaps"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= top)
    return ranked.join(common.checked(numbered.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")


def _pass(found: DataFrame, docs: DataFrame, items: DataFrame, n: int, total: int, top: int) -> DataFrame:
    def terms(batches):
        for batch in batches:
            lists = [sorted({t for t in x if t}) for x in split(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=["item", "terms"])

    wanted = common.materialise(items.select("item", "text").mapInArrow(terms, "item long, terms array<string>"), "terms")
    distinct = common.materialise(wanted.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    postings = common.materialise(found.filter("term is not null").join(common.checked(distinct), "term", "left_semi").select(*found.columns), "postings")
    known = {r["term"]: (weight(n, r["df"]), r["bound"]) for r in postings.groupBy("term").agg(F.sum("n_docs").alias("df"), F.max(best_part(n, total)).alias("bound")).collect()}
    sent = found.sparkSession.sparkContext.broadcast([(r["item"], [(t, *known[t]) for t in r["terms"] if t in known]) for r in wanted.collect()])

    def rank(table: pa.Table) -> pa.Table:
        lists, ids, lengths = {}, None, None
        for batch in table.to_batches():
            for row in batch.to_pylist():
                if row["term"] is None:
                    ids, lengths = pa.array(row["ids"], pa.int64()), np.array(row["lengths"], np.int64)
                else:
                    lists[row["term"]] = List(row, n, total)
        m, valid, out = measure(lengths, n, total), ids.is_valid().to_numpy(zero_copy_only=False), []
        plain = ids.fill_null(0).to_numpy()
        for number, item in sent.value:
            out += [(number, doc, score) for score, doc in search_shard(lists, plain, valid, m, item, top).rows]
        columns = list(zip(*out)) or [()] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return postings.unionByName(docs.select(*found.columns)).groupBy("shard").applyInArrow(rank, _FOUND)


def ranked(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """Each item's ``top`` best documents: item_id, rank, doc_id, score; scores above 0 only.

    Rows of documents and of items are taken one by one, repeated ones too: each repeated item row has its own ranks under the same
    item_id. Null and empty texts have no terms: such documents count nowhere, such items give no rows. Null doc_ids come last among equal scores. A very long text is
    one document, indexed whole. An empty table on either side gives no rows. Extra columns are not read.
    """
    return search(index(docs), items, **more)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every item of the benchmark over every document."""
    return ranked(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), counted AS (
  SELECT doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM counted
), each AS (
  SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM counted) GROUP BY doc_id, term
), df AS (
  SELECT term, count(*) AS df FROM each GROUP BY term
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * c.n_docs + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * c.n_docs) // c.n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN df USING (term) JOIN each USING (term), corpus c GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 10
"""
