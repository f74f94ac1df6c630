"""Order-preserving packing: documents in the order of their ids, cut into windows by dynamic programming."""

from __future__ import annotations

import collections
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

MAX_LEN = 2048
SENTENCE_PRICE = 8  # padding that a document's integrity is worth where a sentence ends
BROKEN_PRICE = 64  # within a sentence
TOKENS_PER_RANGE = 4_000_000
HORIZON = 1 << 20  # ids whose cuts are chosen together
TAIL = 16  # windows at its end that are chosen anew with what follows

_KEPT = 1_000_000  # words whose ids are kept
_CHUNK = 1 << 23  # characters encoded at a time
_SPACES = re.compile(r"[\t-\r ]+")
#: Words whose ids have as many bytes as they have, whatever the normalization: what ends a word tells where its ids end.
_PLAIN = "^[!-~ß-öø-ÿ]+$"
_STOP = "[.!?…。！？][\"')\\]}»”’]*$"
_DOC, _SENTENCE, _BROKEN = 0, 1, 2
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words:
    """Ids of whole texts by a vocabulary that drops white space, so that a text's ids are those of its words in turn.

    Every id comes from the tokenizers library, with ``add_special_tokens=False``; strings of added tokens are what the library makes of
    them. A bounded number of words is kept: each has a number, and arrays have where its ids start, how many they are and whether it
    ends a sentence. ``encode`` tells which ids end one: the last one of a word that ends in a full stop, question or exclamation mark,
    with closing quotes or brackets at most.
    """

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if vocabulary is None:
            import public_tokenizers

            vocabulary = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        if self.tokenizer.encode("a  b\n").tokens != ["a</w>", "b</w>"]:
            raise ValueError("a vocabulary with word ends that drops white space is needed")
        known = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(known.values()) + 1, np.int64)
        for token, i in known.items():
            self.lengths[i] = len(token.removesuffix("</w>"))
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(f"({'|'.join(added) or '(?!)'})")
        self.like_added = f"(?i:{'|'.join(added)})" if added else None
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size, self.stop = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, given: pa.Array) -> None:
        """Number new words. Plain ones are encoded as one text, whose ids are cut where words end; the others one by one."""
        plain = pc.match_substring_regex(given, _PLAIN)
        even, odd = given.filter(plain), given.filter(pc.invert(plain))
        words = pa.concat_arrays([even, odd])
        parts, sizes = [], np.zeros(0, np.int64)
        if len(even):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(even.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(pc.binary_length(even).to_numpy())
            sizes = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1, prepend=0)
            parts.append(ids)
        parts += [self._whole(w) for w in odd.to_pylist()]
        sizes = np.concatenate([sizes, [len(x) for x in parts[len(even) > 0 :]]]).astype(np.int32)
        first = len(self.ids) + np.cumsum(sizes) - sizes
        stops = pc.match_substring_regex(words, _STOP).to_numpy(zero_copy_only=False) & (sizes > 0)
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.start, self.size, self.stop = (np.concatenate(x) for x in ((self.ids, *parts), (self.start, first.astype(np.int32)), (self.size, sizes), (self.stop, stops)))

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of some distinct words, its place in ``words``. Known ones don't become Python strings."""
        if len(self.words) > _KEPT:
            self._forget()
        found = pc.index_in(words, value_set=self.words)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            known, missing = len(self.words), words.filter(pc.is_null(found))
            self._learn(missing)
            out[out < 0] = pc.index_in(missing, value_set=self.words.slice(known)).to_numpy(zero_copy_only=False) + known
        return out

    def _odd(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [x for part in self.added.split(text) for x in ([part] if self.added.fullmatch(part) else _SPACES.split(part)) if x]
        known = [self._whole(x) for x in parts]
        ends = np.cumsum([len(x) for x in known], dtype=np.int64)
        stops = [bool(re.search(_STOP, x)) and len(k) > 0 for x, k in zip(parts, known)]
        return np.concatenate([np.zeros(0, "<u4"), *known]), ends[np.array(stops, bool)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the ends of its sentences (numbers of ids before each); nothing for null and empty texts."""
        given = pc.fill_null(pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(given, self.like_added).to_pylist() if self.like_added else [False] * len(texts)
        even = given.filter(pa.array([not x for x in odd], pa.bool_()))
        lower = pc.replace_substring_regex(pc.ascii_lower(even), r"([a-z])([.,;:!?\"()]+)", r"\1 \2")  # the vocabulary splits between a letter and these too
        lists = pc.ascii_split_whitespace(lower)
        coded = lists.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary)
        codes = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, np.int64)
        each = self.size[codes]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        flat = self.ids[np.repeat(self.start[codes] - ends[:-1], each) + np.arange(ends[-1])]
        words = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        marks = np.flatnonzero(self.stop[codes])
        at = np.searchsorted(marks, words)
        found = ((flat[ends[a] : ends[b]], ends[marks[m:n] + 1] - ends[a]) for a, b, m, n in zip(words, words[1:], at, at[1:]))
        return [self._odd(texts[i]) if x else next(found) for i, x in enumerate(odd)]


@functools.lru_cache(2)
def encoder(vocabulary: str | None = None) -> Words:
    """The process's encoder: a worker that runs several tasks keeps its words."""
    return Words(vocabulary)


# ---- where a window may end


def candidates(n: int, sentences: np.ndarray, max_len: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a document of ``n`` ids (its end id the last) may be cut, ending with ``n``, and their kinds.

    These are its sentences' ends (an end right before the end id gives way to the document's) and, within a sentence longer than a
    window, all positions.
    """
    ends = np.concatenate([sentences[sentences < n - 1], [n]])
    gaps = np.diff(ends, prepend=0)
    kinds = np.full(len(ends), _SENTENCE)
    kinds[-1] = _DOC
    if (gaps > max_len).any():
        wide = [np.arange(b - g + 1, b) for g, b in zip(gaps[gaps > max_len].tolist(), ends[gaps > max_len].tolist())]
        ends, kinds = np.concatenate([ends, *wide]), np.concatenate([kinds, *(np.full(len(w), _BROKEN) for w in wide)])
        order = np.argsort(ends)
        ends, kinds = ends[order], kinds[order]
    return ends, kinds


def choose_cuts(ends: np.ndarray, prices: np.ndarray, max_len: int = MAX_LEN) -> np.ndarray:
    """Indices of the ``ends`` (ascending, from 0 on) at which windows of at most ``max_len`` end, the last one too, at the least cost.

    A window costs its padding up to ``max_len``, none if its length is a power of two, and the price of its end. The padding is linear
    in the window's start, so the best start is the minimum of cost plus position over a sliding range: a monotone queue has it. The few
    starts at the distance of a power of two are looked up. Each end must lie within ``max_len`` of the one before.
    """
    pos = np.concatenate([[0], ends])
    powers = [1 << k for k in range(max_len.bit_length()) if 1 << k < max_len]
    to, start = [], []
    for p in powers:
        at = np.minimum(np.searchsorted(pos, pos - p), len(pos) - 1)
        hit = np.flatnonzero(pos[at] == pos - p)
        to.append(hit)
        start.append(at[hit])
    to, start = np.concatenate(to) if to else np.zeros(0, int), np.concatenate(start) if start else np.zeros(0, int)
    order = np.argsort(to, kind="stable")
    first, exact = np.searchsorted(to[order], np.arange(len(pos) + 1)).tolist(), start[order].tolist()
    places, price = pos.tolist(), [0, *np.asarray(prices).tolist()]
    best, key, back = [0] * len(places), [0] * len(places), [0] * len(places)
    queue: collections.deque[int] = collections.deque([0])
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0]] < p - max_len:
            queue.popleft()
        i = queue[0]
        cost = key[i] + max_len - p
        for e in exact[first[j] : first[j + 1]]:
            if best[e] < cost:
                cost, i = best[e], e
        best[j] = cost = cost + price[j]
        back[j] = i
        cost += p
        while queue and key[queue[-1]] >= cost:
            queue.pop()
        key[j] = cost
        queue.append(j)
    cuts, j = [], len(places) - 1
    while j > 0:
        cuts.append(j - 1)
        j = back[j]
    return np.array(cuts[::-1], np.int64)


# ---- checksums of pieces from those of beginnings


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements modulo that of crc32, bits reversed."""
    out, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


@functools.lru_cache(2)
def _shifts(most: int) -> np.ndarray:
    """What 0 to ``most`` ids of four zero bytes each do to a checksum, as polynomials."""
    out = np.zeros(most + 1, np.uint32)
    x = 1 << 31
    for k in range(most + 1):
        out[k] = x
        for _ in range(32):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return out


def piece_crc(before: np.ndarray, upto: np.ndarray, n: np.ndarray, most: int = MAX_LEN) -> np.ndarray:
    """crc32 of the ``n`` ids between two beginnings of a text, from theirs."""
    return upto ^ _times(_shifts(most)[n], before)


# ---- the operator


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, n, crc, copy, ends, crcs: for each document the number of its ids, the places where it may be cut, with kinds, and the
    checksum of the ids before each. ``copy`` tells equal rows of a batch apart."""

    def measure(batches):
        words, end = encoder(vocabulary), np.array([end_id], "<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, seen = [], collections.Counter()
            for a, b in bpe.few(texts, _CHUNK):
                for doc, (code, sentences) in zip(ids[a:b], words.encode(texts[a:b])):
                    code = np.concatenate([code, end])
                    ends, kinds = candidates(len(code), sentences, max_len)
                    raw, crc, crcs, at = memoryview(code.tobytes()), 0, [], 0
                    for e in (4 * ends).tolist():
                        crc = zlib.crc32(raw[at:e], crc)
                        crcs.append(crc)
                        at = e
                    name = doc, len(code), crc
                    rows.append((*name, seen[name], (ends << 2 | kinds).astype("<u8").tobytes(), np.array(crcs, "<u4").tobytes()))
                    seen[name] += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["doc_id", "n", "crc", "copy", "ends", "crcs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, "doc_id long, n long, crc long, copy int, ends binary, crcs binary")


class _Stream:
    """The documents of a range as they come: places where the stream may be cut, planned and given out as pieces by and by."""

    def __init__(self, first: int, max_len: int, prices: tuple[int, int, int]):
        self.sequence, self.max_len, self.prices = first, max_len, np.array(prices, np.int64)
        self.doc: list = []  # id and length of each document of the buffer
        self.at = np.zeros(0, np.int64)  # of each place: position in its document, its number in ``doc``, position in the stream, kind, checksum
        self.of, self.pos, self.kind, self.crc = (np.zeros(0, np.int64) for _ in range(4))
        self.start = 0, -1, 0, 0  # the place before the first: position in a document, its number, position in the stream, checksum

    def add(self, table: pa.RecordBatch) -> None:
        lengths = table.column("n").to_numpy()
        codes, crcs = ([np.frombuffer(x.as_py(), kind) for x in table.column(c)] for c, kind in (("ends", "<u8"), ("crcs", "<u4")))
        size = [len(c) for c in codes]
        code = np.concatenate(codes).astype(np.int64)
        base = np.cumsum(lengths) - lengths + (self.pos[-1] if len(self.pos) else self.start[2])
        more = code >> 2, np.repeat(np.arange(len(size)) + len(self.doc), size), np.repeat(base, size) + (code >> 2), code & 3, np.concatenate(crcs).astype(np.int64)
        self.at, self.of, self.pos, self.kind, self.crc = (np.concatenate(x) for x in zip((self.at, self.of, self.pos, self.kind, self.crc), more))
        self.doc += zip(table.column("doc_id").to_pylist(), lengths.tolist())

    @property
    def waiting(self) -> int:
        return int(self.pos[-1] - self.start[2]) if len(self.pos) else 0

    def plan(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of the windows chosen; but for the last time without the last ``TAIL``."""
        if not len(self.pos):
            return None
        cuts = choose_cuts(self.pos - self.start[2], self.prices[self.kind], self.max_len)
        cuts = cuts if last else cuts[:-TAIL]
        if not len(cuts):
            return None
        c = int(cuts[-1])
        ends = np.union1d(np.flatnonzero(self.kind[: c + 1] == _DOC), cuts)
        before = np.concatenate([[-1], ends[:-1]])
        prior = lambda values, k: np.where(before < 0, self.start[k], values[before])
        same = prior(self.of, 1) == self.of[ends]
        start = np.where(same, prior(self.at, 0), 0)
        length = self.at[ends] - start
        crc = piece_crc(np.where(same, prior(self.crc, 3), 0).astype(np.uint32), self.crc[ends].astype(np.uint32), length, self.max_len)
        window = np.searchsorted(cuts, ends)
        opens = np.concatenate([[self.start[2]], self.pos[cuts]])
        docs = [self.doc[d] for d in self.of[ends].tolist()]
        out = [pa.array([d for d, _ in docs], pa.int64()), start, length, crc.astype(np.int64), pa.array([n for _, n in docs], pa.int64()), self.sequence + window, self.pos[ends] - length - opens[window]]
        self.sequence += len(cuts)
        gone = int(self.of[c]) + (self.kind[c] == _DOC)
        self.start = (int(self.at[c]), 0, int(self.pos[c]), int(self.crc[c])) if self.kind[c] != _DOC else (0, -1, int(self.pos[c]), 0)
        self.doc = self.doc[gone:]
        self.at, self.of, self.pos, self.kind, self.crc = self.at[c + 1 :], self.of[c + 1 :] - gone, self.pos[c + 1 :], self.kind[c + 1 :], self.crc[c + 1 :]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in _PIECES.split(", ")])


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, sentence_price: int = SENTENCE_PRICE, broken_price: int = BROKEN_PRICE, tokens_per_range: int = TOKENS_PER_RANGE,
    horizon: int = HORIZON, vocabulary: str | None = None, end_id: int = 1,
) -> DataFrame:
    """Cut the stream of all documents, in the order of their ids, into sequences of at most ``max_len`` ids; a row for each piece.

    Texts are encoded where they are read and their ids don't travel: what does is, for each place where a document may be cut, its
    position and the checksum of the ids before it, from which that of any piece follows. Ranges of ids of about ``tokens_per_range``
    ids go to a task each, which plans ``horizon`` ids at a time; the last windows of a plan are planned anew with what follows, so
    memory is bounded whatever a range holds. Sequences are numbered in the order of the stream within a range, ranges in their order.

    Null and empty texts are the end id alone. Null ids come first; rows of equal ids go by length and checksum, and equal rows, which
    spread over tasks by their number in a batch, in any order. A sentence longer than a sequence is cut anywhere. A very long text is encoded as one row
    and cut into pieces. An empty table gives no rows. Columns besides id and text are not read.
    """
    rows = common.materialise(encoded(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, end_id=end_id, max_len=max_len), "encoded")
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    prices = 0, sentence_price, broken_price

    def place(batches):
        stream = None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                stream = stream or _Stream(part.column("part")[0].as_py() << 40, max_len, prices)
                stream.add(part)
                if stream.waiting >= horizon and (out := stream.plan(False)):
                    yield out
        if stream and (out := stream.plan(True)):
            yield out

    order = ["doc_id", "n", "crc", "copy"]
    dealt = rows.repartitionByRange(common.shards(total, tokens_per_range), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "n", "ends", "crcs", F.spark_partition_id().alias("part")).mapInArrow(place, _PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document of the table."""
    return pack(common.documents(spark, sf_dir))
