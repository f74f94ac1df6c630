"""Byte-level BPE ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Two white-space characters together, or those that Python knows and the tokenizer doesn't: such a text is split in Python.
_ODD = "[\\s\\x0b\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}|[\\x1c-\\x1f]"
_ALIEN = re.compile("[\x1c-\x1f]")
#: A text splits at these into parts that the byte-level pre-tokenizer never joins: a run without white space with the one
#: space before it, or white space.
_PART = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Letters that the pre-tokenizer takes in one piece when no other non-ASCII character follows.
_STEM = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7f])")
_BARE = "\x1d"  # marks a part without a space before it
#: ASCII punctuation and digits at a word's end: the pre-tokenizer always splits between a letter and them.
_TAIL = "([A-Za-zÀ-ÖØ-öø-ÿ])([!-@\\[-`{-~]+)( |$)"
_MOST = 1_000_000  # words kept
CHUNK = 1 << 23  # characters encoded at a time


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian 32-bit bytes; null and empty texts have none.

    Every id comes from the tokenizers library. Texts repeat words, so the ids of words are kept (a bounded number of them), and
    new words are encoded together: the byte lengths of the ids tell where each ends. A text with an added token's string goes to the
    library as a whole.
    """

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or default_vocabulary())
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd, self.alien = (f"{_ODD}|{added}", re.compile(f"{_ALIEN.pattern}|{added}")) if added else (_ODD, _ALIEN)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(words.values()) + 1, np.int64)  # a byte-level vocabulary writes each byte as one character
        for word, i in words.items():
            self.lengths[i] = len(word)
        self.rests: dict[str, bytes] = {}
        self._forget()
        if "ByteLevel" not in str(self.tokenizer.pre_tokenizer) or "add_prefix_space=True" in str(self.tokenizer.pre_tokenizer):
            raise ValueError("a vocabulary with byte-level words is needed")

    def _forget(self) -> None:
        """No word is known. A known word has a number, its place in ``words``; arrays have where its ids start and how many they are."""
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _rest(self, text: str) -> bytes:
        ids = self.rests.get(text)
        if ids is None:
            if len(self.rests) > _MOST // 8:
                self.rests.clear()
            ids = self.rests[text] = self._whole(text)
        return ids

    def _stems(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of words, each with a space before it, encoded as one text."""
        if not keys:
            return {}
        text = " " + " ".join(keys)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([1 + len(k.encode()) for k in keys])
        cuts = ((np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * 4).tolist()
        whole = ids.tobytes()
        return {k: whole[a:b] for k, a, b in zip(keys, [0, *cuts], cuts)}

    def _new(self, keys: list[str]) -> list[bytes]:
        """Ids of keys that aren't known. Stems are encoded together; a stem with what follows it is put together."""
        out: list[bytes] = [b""] * len(keys)
        wanted, later = {}, []
        for i, key in enumerate(keys):
            if key.isalpha():  # one run of letters
                stem, rest = key, ""
            elif key[:-1].isalpha():
                stem, rest = key[:-1], key[-1]
            elif key[:1] == _BARE or not (m := _STEM.match(key)):
                out[i] = self._rest(key[1:] if key[:1] == _BARE else key if key == "\n" else " " + key)
                continue
            else:
                stem, rest = m[0], key[len(m[0]) :]
            wanted[stem] = None
            later.append((i, stem, rest))
        stems = self._stems(list(wanted))
        for i, stem, rest in later:
            out[i] = stems[stem] + self._rest(rest) if rest else stems[stem]
        return out

    def _numbered(self, keys: pa.Array) -> np.ndarray:
        """The number of each key; new ones are encoded and get theirs. Known keys don't become Python strings."""
        if len(self.words) > _MOST:
            self._forget()
        found = pc.index_in(keys, value_set=self.words)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            missing = keys.filter(pc.is_null(found))
            new = missing.unique()
            known = self._new(new.to_pylist())
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            out[out < 0] = pc.index_in(missing, value_set=new).to_numpy(zero_copy_only=False) + len(self.words)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, np.frombuffer(b"".join(known), "<u4")]), np.concatenate([self.size, size])
            self.words = pa.concat_arrays([self.words, new])
        return out

    def _flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words in turn, and the number of ids before each and in all."""
        each = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self.ids[np.repeat(self.start[numbers] - ends[:-1], each) + np.arange(ends[-1])], ends

    def _odd(self, text: str) -> bytes:
        if self.alien.search(text):
            return self._whole(text)
        keys = [w if w == "\n" else w[1:] if w[0] == " " and w != " \n" else _BARE + w for w in _PART.findall(text)]
        return self._flat(self._numbered(pa.array(keys, pa.string())))[0].tobytes()

    def _many(self, texts: pa.Array) -> list[bytes]:
        """Texts without odd white space: split, and each distinct part looked up once."""
        marked = pc.binary_join_element_wise(_BARE, pc.replace_substring(texts, "\n", " \n " + _BARE), "")
        marked = pc.replace_substring_regex(marked, _TAIL, f"\\1 {_BARE}\\2\\3")
        parts = pc.split_pattern(marked, " ")
        coded = parts.flatten().dictionary_encode()
        numbers = self._numbered(coded.dictionary)
        flat, ends = self._flat(numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(numbers) else numbers)
        flat, at = flat.tobytes(), (4 * ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]).tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in few(texts, CHUNK):
            some = pa.array(texts[a:b], pa.string())
            odd = pc.fill_null(pc.match_substring_regex(some, self.odd), True)
            even = iter(self._many(some.filter(pc.invert(odd))))
            out += [(self._odd(text) if text else b"") if special else next(even) for text, special in zip(texts[a:b], odd.to_pylist())]
        return out


@functools.lru_cache(2)
def encoder(vocabulary: str | None = None) -> Encoder:
    """The process's encoder: a worker that runs several tasks keeps its words."""
    return Encoder(vocabulary)


def few(texts: list, most: int = 1 << 20):
    """Index ranges of ``texts`` with about ``most`` characters each, so that memory holds for long texts."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)
