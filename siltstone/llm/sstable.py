"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard is one file::

    block*  index  bloom  footer

* A block holds some documents in key order. Its entries are compressed together (zlib). An entry: varint of the bytes that its
  key shares with the key before it in the block (0 for the first), varint of the bytes that follow, those bytes, varint of the
  number of ids, the ids as little-endian unsigned numbers of the footer's width.
* The index has, for each block: last key's length (u16), last key, offset (u64), length (u32), ids before the block (u64).
* The Bloom filter is a bit array; ``hashes`` positions for each key, from two halves of a 64-bit hash.
* The footer has a fixed size (``FOOTER``) and ends with ``MAGIC``; Spark's text writer puts a line feed after it.

A key is a tag byte (0: null, 1: number), then the number as 8 big-endian bytes with its sign bit flipped, so that bytes sort as
numbers do. The folder ``_catalog`` beside the shards has a row for each of them (first and last key, documents, ids, Bloom filter), so
that a lookup opens only the shards that may have a key. Shards are in the order of their first and last keys; their names mean nothing.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QIQIIIQBB8s")  # index at, index bytes, bloom at, bloom bytes, blocks, documents, ids, hashes, width, magic
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 4 << 20
PART_BYTES = 32 << 20  # ids that a task sorts and writes, as some shards
BITS_PER_KEY = 10
HASHES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _positions(key: bytes, hashes: int, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h >> 32, h & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(hashes)]


def _held(bloom: bytes, key: bytes, hashes: int) -> bool:
    return all(bloom[p >> 3] >> (p & 7) & 1 for p in _positions(key, hashes, len(bloom) * 8))


class ShardWriter:
    """Takes documents in key order; ``finish()`` gives the file's bytes."""

    def __init__(self, width: int = 4):
        self.width, self.blocks, self.index, self.keys = width, [], [], []
        self.at = self.n_ids = self.held = self.before = 0
        self.entries: list[bytes] = []
        self.last = b""

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian numbers of the writer's width."""
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        count = len(ids) // self.width
        self.entries.append(b"".join((_varint(shared), _varint(len(key) - shared), key[shared:], _varint(count), ids)))
        self.keys.append(key)
        self.last, self.n_ids, self.held = key, self.n_ids + count, self.held + len(ids)
        if self.held >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.entries:
            block = zlib.compress(b"".join(self.entries), 1)
            self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QIQ", self.at, len(block), self.before))
            self.blocks.append(block)
            self.at += len(block)
            self.entries, self.held, self.before = [], 0, self.n_ids

    def size(self) -> int:
        return self.at + self.held

    def finish(self) -> bytes:
        self._close()
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _positions(key, HASHES, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.index), len(self.keys), self.n_ids, HASHES, self.width, MAGIC)
        return b"".join((*self.blocks, index, bytes(bloom), footer))


class Shard:
    """Reads the bytes of a file: ``get`` by Bloom filter and binary search of the index, ``scan`` in key order."""

    def __init__(self, data: bytes):
        self.data = data
        end = len(data) - (data[-9:-1] == MAGIC and data[-8:] != MAGIC)
        at, n, self.bloom_at, self.bloom_bytes, blocks, self.documents, self.n_ids, self.hashes, self.width, magic = FOOTER.unpack_from(data, end - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.last_keys, self.places = [], []
        self.bloom = data[self.bloom_at : self.bloom_at + self.bloom_bytes]
        for _ in range(blocks):
            (k,) = struct.unpack_from("<H", data, at)
            self.last_keys.append(data[at + 2 : at + 2 + k])
            self.places.append(struct.unpack_from("<QIQ", data, at + 2 + k))
            at += 22 + k

    def may_have(self, key: bytes) -> bool:
        return _held(self.bloom, key, self.hashes)

    def first_key(self) -> bytes:
        return next(self._entries(0))[0]

    def _entries(self, block: int):
        """Key, ids before it in the shard, ids (32-bit bytes) of each document of a block."""
        at, n, before = self.places[block]
        data, at, key = zlib.decompress(self.data[at : at + n]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + more], at + more
            count, at = _read_varint(data, at)
            body = data[at : at + count * self.width]
            at += count * self.width
            yield key, before, np.frombuffer(body, "<u2").astype("<u4").tobytes() if self.width == 2 else body
            before += count

    def scan(self):
        for block in range(len(self.places)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document with the key (repeated keys are kept), none if it isn't there."""
        if not self.places or not self.may_have(key):
            return []
        found = []
        for block in range(bisect.bisect_left(self.last_keys, key), len(self.places)):
            for k, _, ids in self._entries(block):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def narrowed(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids in ``width`` bytes each; an id that doesn't fit raises."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if wide.max(initial=0) > 0xFFFF:
        raise ValueError(f"id {wide.max()} doesn't fit in 2 bytes; use width=4")
    return wide.astype("<u2").tobytes()


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, width: int = 2) -> DataFrame:
    """doc_id and ids (the end id last, ``width`` bytes each) of every row, encoded where the texts are read."""

    def encode(batches):
        encoder, end = bpe.encoder(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in bpe.few(texts, bpe.CHUNK):
                codes = [narrowed(code + end, width) for code in encoder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(codes, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES, width: int = 2) -> None:
    """Encode every text, the end id after it, and write shards in ascending order of the id under ``path``, with their catalog.

    Texts are encoded where they are read; what is shuffled are their ids. Those are range-partitioned by (id, hash of the ids, a number
    of the row), so that neither equal ids nor repeated rows meet in one task, and sorted within; each task cuts its rows into shards of
    about ``shard_bytes``. A shard is a file: Spark's own committer writes it, to any file system, so a lost or repeated task
    leaves no half file. ``width``: bytes of an id, 2 or 4; an id that doesn't fit raises. Null and empty texts: the end id alone; a
    null id sorts first. Repeated ids and rows all stay. A very long text is one entry of one block. Other columns are not read. An
    empty table gives no shards.
    """

    def build(batches):
        writer = ShardWriter(width)
        full = lambda: pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["shard"])
        for batch in batches:
            for doc, code in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(key_of(doc), code.as_py())
                if writer.size() >= shard_bytes:
                    yield full()
                    writer = ShardWriter(width)
        if writer.keys:
            yield full()

    rows = common.materialise(encoded(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, end_id=end_id, width=width), "ids")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    order = ["doc_id", "tie", "row"]
    keyed = rows.withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(common.shards(size, part_bytes), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    files = ordered.mapInArrow(build, "shard binary").select(F.col("shard").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    _cataloged(docs.sparkSession, path).write.parquet(f"{path}/_catalog")


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    """file (its name) and content of shards."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


_CATALOG = "file string, first binary, last binary, documents long, n_ids long, hashes int, bloom binary"


def _cataloged(spark: SparkSession, path: str) -> DataFrame:
    def look(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Shard(content.as_py())
                row = (file, s.first_key(), s.last_keys[-1], s.documents, s.n_ids, s.hashes, s.bloom)
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["file", "first", "last", "documents", "n_ids", "hashes", "bloom"])

    return _files(spark, path).mapInArrow(look, _CATALOG)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each shard under ``path``: file, first and last key, documents, n_ids, hashes, bloom."""
    return spark.read.schema(_CATALOG).parquet(f"{path}/_catalog")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the shards under ``path``: its id, ids before it in the shard, ids as 32-bit bytes, the shard's file."""

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for key, before, ids in Shard(content.as_py()).scan():
                    rows.append((id_of(key), before, ids, file))
                    size += len(ids)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "local_start", "ids", "file"])

    return _files(spark, path).mapInArrow(scan, "doc_id long, local_start long, ids binary, file string")


def lookup(spark: SparkSession, path: str, ids: list[int | None]) -> DataFrame:
    """doc_id and ids (32-bit bytes) of the documents asked for.

    The catalog's key ranges and Bloom filters name the shards that may have one of the keys; only those are opened, and searched by
    their block index. No ids, or none that is there: no rows.
    """
    keys = sorted({key_of(i) for i in ids})

    def may_have(batches):
        for batch in batches:
            c = {f.name: batch.column(k).to_pylist() for k, f in enumerate(batch.schema)}
            found = [
                file for file, first, last, hashes, bloom in zip(c["file"], c["first"], c["last"], c["hashes"], c["bloom"])
                if any(_held(bloom, k, hashes) for k in keys[bisect.bisect_left(keys, first) : bisect.bisect_right(keys, last)])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["file"])

    def find(batches):
        for batch in batches:
            for content in batch.column(1):
                shard = Shard(content.as_py())
                rows = [(id_of(k), found) for k in keys for found in shard.get(k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "ids"])

    opened = [r["file"] for r in catalog(spark, path).select("file", "first", "last", "hashes", "bloom").mapInArrow(may_have, "file string").collect()]  # the files to open
    shape = "doc_id long, ids binary"
    return _files(spark, *(f"{path}/{f}" for f in opened)).mapInArrow(find, shape) if opened else spark.createDataFrame([], shape)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids, all read from the shards."""

    def sums(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(id_of(key), before, len(ids) // 4, zlib.crc32(ids), file) for key, before, ids in Shard(content.as_py()).scan()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "local_start", "n_tokens", "ids_crc32", "file"])

    placed = common.running(catalog(spark, path).select("file", "first", "last", "n_ids"), ["first", "last", "file"], F.col("n_ids"))
    before = common.materialise(placed.select("file", "before"), "starts")
    rows = _files(spark, path).mapInArrow(sums, "doc_id long, local_start long, n_tokens long, ids_crc32 long, file string")
    return rows.join(common.checked(before), "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document of the table, written and read back."""
    path = common.table_path(spark, "sst")
    write(common.documents(spark, sf_dir), path)
    return digest(spark, path)
