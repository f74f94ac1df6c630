"""Best-fit packing of documents into training sequences."""

from __future__ import annotations

import collections
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

MAX_LEN = 2048
OPEN_BINS = 16384
DOCS_PER_PACK = 100_000

_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], size: int = MAX_LEN, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given.

    Bounded-space online best fit: at most ``open_bins`` bins are open; a bitset has a bit for each free space that some open
    bin has, so that the tightest bin that still fits is its lowest set bit from the length on. When all bins are open and none
    fits, the fullest closes. A length equal to ``size`` is a bin of its own. Lengths are 1 to ``size``.
    """
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask, n_open, made = 0, 0, 0
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i, n in enumerate(lengths):
        if n == size:
            bins[i], made = made, made + 1
            continue
        above = mask >> n
        if above:
            f = n + (above & -above).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                mask ^= 1 << f
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (mask & -mask).bit_length() - 1
                free[fullest].pop()
                if not free[fullest]:
                    mask ^= 1 << fullest
                n_open -= 1
            b, f, made = made, size, made + 1
        bins[i], offsets[i] = b, size - f
        if left := f - n:
            free[left].append(b)
            mask |= 1 << left
            n_open += 1
    return bins, offsets


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document's ids (the end id added): the first piece takes what is over a multiple of ``max_len``.

    ``copy`` tells equal rows of a batch apart: 0 for the first.
    """

    def cut(batches):
        encoder = bpe.encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            seen: collections.Counter = collections.Counter()
            for a, b in bpe.few(texts, bpe.CHUNK):
                for doc, code in zip(ids[a:b], encoder.encode(texts[a:b])):
                    code += end
                    n = len(code) // 4
                    at, step = 0, n % max_len or max_len
                    name = doc, n, zlib.crc32(code)
                    copy = seen[name]
                    seen[name] += 1
                    for k in range(-(-n // max_len)):
                        rows.append((doc, k, at, step, zlib.crc32(code[4 * at : 4 * (at + step)]), copy))
                        at, step = at + step, max_len
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*_COLUMNS, "copy"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"{_PIECES}, copy int")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, open_bins: int = OPEN_BINS, docs_per_pack: int = DOCS_PER_PACK, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``max_len`` ids; a row for each piece with its sequence and offset.

    The texts are encoded where they are read; only pieces' lengths are shuffled, to packs of about ``docs_per_pack`` documents
    each by a hash of the row and its number among equal ones of a batch, so that repeated rows spread as others do, the packs of other
    rows don't depend on how the input is split, and a lost task repeats alike.
    A pack feeds its pieces, longest first, to ``best_fit``. Null text: the end id alone. Null ids and repeated rows are packed as
    any other. A very long text is encoded as one row and cut into pieces, which spread over the packs. An empty table gives no rows.
    Columns besides id and text are not read.
    """
    packs = common.shards(docs.count(), docs_per_pack)

    def place(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(table["length"].to_pylist(), max_len, open_bins)
        first = key[0].as_py() << 40
        out = table.select(_COLUMNS)
        return out.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    rows = pieces(docs, id_col=id_col, text_col=text_col, max_len=max_len, vocabulary=vocabulary, end_id=end_id)
    key = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "copy"), F.lit(packs))
    return rows.withColumn("pack", key).groupBy("pack").applyInArrow(place, f"{_PIECES}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document of the table."""
    return pack(common.documents(spark, sf_dir))
