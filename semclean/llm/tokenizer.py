"""Batch encoding by the ``tokenizers`` library with a cache of the pieces its pre-tokenizer makes.

Both supported kinds of vocabulary encode every pre-token on its own, so a text's ids are its pieces'
ids joined. A batch's texts are cut here at the same places by numpy, equal pieces are found by Arrow, the
distinct ones are looked up by number, the library's model merges the bytes of new ones, and numpy joins
the ids. The model alone is asked since its normalizer and pre-tokenizer leave such pieces as they are, and
take longer than the merging. A text with a character outside the set for which the rules provably agree, or
with an added token's string, goes to the library whole. No vocabulary is copied or trained.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, repeat
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_L = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_P = "!-/:-@\\[-`{-~¡§«¶·»¿‐-‧"
_UNSAFE = re.compile(f"[^{_L}0-9 \\t\\n\\r{_P}]")
#: The letters that are still in that set when lowered: the small form of some capitals (Ə, Ɔ, Ⱥ) is beyond it.
_LOWERED = "".join(c for c in map(chr, range(0x250)) if re.match(f"[{_L}]", c) and re.match(f"[{_L}]", c.lower()))
_UNSAFE_LOWERED = re.compile(f"[^{_LOWERED}0-9 \\t\\n\\r{_P}]")
#: In a batch, what ends a text, and what stands for a text that goes to the library whole; no piece holds them.
_END, _WHOLE = "\0", "\1"
#: Neither is learnt.
_ENDING = {_END: -1, _WHOLE: -1}
_SPACE, _LETTER, _DIGIT, _SIGN, _MORE, _ENDS, _WHOLES = range(7)
#: The kind of a character by its first byte, which tells it in that set; ``_MORE``: a later byte.
_KINDS = bytearray([_SIGN]) * 256
for _kind_of, _bytes in ((_SPACE, b" \t\n\r"), (_DIGIT, b"0123456789"), (_LETTER, ascii_letters.encode()), (_LETTER, range(0xC3, 0xCA)), (_MORE, range(0x80, 0xC0)), (_ENDS, _END.encode()), (_WHOLES, _WHOLE.encode())):
    for _byte in _bytes:
        _KINDS[_byte] = _kind_of

_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: How a byte-level vocabulary writes bytes: these as Latin-1, the others from U+0100 on.
_WRITTEN = np.arange(256, dtype="<u2")
_WRITTEN[[x for x in range(256) if x not in _SHOWN]] = np.arange(0x100, 0x100 + 256 - len(_SHOWN))
#: Byte 0 stands between pieces.
_MARK = chr(_WRITTEN[0])

#: Pieces of a generation of a worker's cache; there are two. Longer pieces than ``CACHE_CHARS`` are forgotten after
#: their batch, so a generation holds some 20 MB at most. Neither changes results.
CACHE_ENTRIES, CACHE_CHARS = 90_000, 64
#: Pieces that the model is given at once, where it merges them as if alone. Doesn't change results.
MERGED_AT_ONCE = 64


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the package of vocabularies is looked up, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _written(pieces: list[str]) -> str:
    """``pieces`` as a byte-level vocabulary writes them, with marks between."""
    return _WRITTEN[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le")


def _joined(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The ids of the pieces ``numbers``, one after the other; piece i has ``sizes[i]`` of ``ids``, which are in order."""
    taken = sizes[numbers]
    at = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[numbers] - (np.cumsum(taken, dtype=np.int32) - taken), taken)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at]


def _pieces(data: bytes, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of ``data``, texts that end in ``_END``, begin, and their kinds; ``words``: by the word-level rules.

    Byte-level, as ``'(?:s|t|re|ve|m|ll|d)| ?[letters]+| ?[digits]+| ?[signs]+|[spaces]+(?!other)|[spaces]+``; word-level,
    as ``'(?:s|t|re|ve|m|ll|d)|[letters]+|[digits]|[signs]+``, where runs of spaces are pieces too, to be left out.
    """
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8).copy()
    more = np.flatnonzero(kinds == _MORE)
    for _ in range(2):
        kinds[more] = kinds[more - 1]
    chars = np.frombuffer(data, np.uint8)
    begin = np.ones(len(data), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
    begin |= kinds > _MORE
    if words:
        begin |= kinds == _DIGIT
    else:
        after = begin[1:] & (kinds[:-1] == _SPACE) & (kinds[1:] < _MORE)
        begin[:-1] |= after
        begin[1:] &= ~(after & (chars[:-1] == ord(" ")))
    at = np.flatnonzero(begin & (chars == ord("'")))
    first, second = chars[at + 1], chars[np.minimum(at + 2, len(chars) - 1)]
    one, two = np.isin(first, [*b"stmd"]), np.zeros(len(at), bool)
    for a, b in (b"re", b"ve", b"ll"):
        two |= (first == a) & (second == b)
    begin[at[one | two] + 1] = False
    begin[at[one] + 2] = begin[at[two] + 3] = True
    starts = np.flatnonzero(begin)
    return starts, kinds[starts]


def _distinct(data: bytes, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of ``data``, and which of them each piece is."""
    if not len(starts):
        return [], np.zeros(0, np.int32)
    ends = np.append(starts, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    held = found.dictionary
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), "\2")[0].as_py()
    return text.split("\2"), found.indices.to_numpy()


def _kind(spec: dict) -> tuple[bool, bool]:
    """Whether pieces are encoded here (else the library encodes all texts), and whether by the word-level rules, of lowered texts."""
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE":
        return False, False
    if pre.get("type") == "ByteLevel":
        return True, False
    words = [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and bool(spec.get("normalizer"))
    return words, words


def _mark_id(model: dict) -> int | None:
    """The id of the mark, if the model merges pieces with marks between them as if each were alone; else None."""
    if any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    if any(_MARK in (m.split(" ") if isinstance(m, str) else m) for m in model["merges"]):
        return None
    return model["vocab"].get(_MARK)


class PieceTokenizer:
    """``encode(text)`` gives the little-endian 32-bit ids of ``text``, without special tokens."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut, self.words = _kind(spec)
        self.mark = _mark_id(spec["model"]) if self.cut else None
        self.unsafe = _UNSAFE_LOWERED if self.words else _UNSAFE
        self.entries = CACHE_ENTRIES
        self.forget()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4")

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``pieces`` by the library's model, joined, and their number by piece."""
        merge = self.library.model.tokenize
        if self.mark is None:
            found = [[t.id for t in merge(w)] for w in _written(pieces).split(_MARK)] if pieces else []
            return np.fromiter(chain.from_iterable(found), "<i4"), np.array([len(x) for x in found], np.int32)
        found = []
        for at in range(0, len(pieces), MERGED_AT_ONCE):
            found += [t.id for t in merge(_written(pieces[at : at + MERGED_AT_ONCE]))]
            found.append(self.mark)
        ids = np.array(found, "<i4")
        marks = ids == self.mark
        return ids[~marks], (np.diff(np.flatnonzero(marks), prepend=-1) - 1).astype(np.int32)

    def _numbers(self, distinct: list[str], once: list[np.ndarray]) -> np.ndarray:
        """Where the ids of different pieces are, new ones learnt; those of long pieces go to ``once``, after all others."""
        numbers = np.fromiter(map(self.cache.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(numbers < 0)
        pieces = [distinct[i] for i in unknown.tolist()]
        old = np.fromiter(map(self.older.get, pieces, repeat(-2)), np.int64, len(pieces))
        long = np.fromiter(map(len, pieces), np.int64, len(pieces)) > CACHE_CHARS
        for i in np.flatnonzero(long).tolist():
            once.append(self.merged([pieces[i]])[0])
            numbers[unknown[i]] = -len(once)
        again, new = np.flatnonzero(old >= 0), np.flatnonzero((old == -2) & ~long)
        ids, sizes = self.merged([pieces[i] for i in new.tolist()])
        old = old[again] - self.least
        self.ids = np.concatenate([self.ids, _joined(self.ids, self.sizes, old), ids])
        self.sizes = np.concatenate([self.sizes, self.sizes[old], sizes])
        fresh, after = np.concatenate([again, new]), self.least + len(self.sizes)
        numbers[unknown[fresh]] = np.arange(after - len(fresh), after)
        self.cache.update(zip([pieces[i] for i in fresh.tolist()], range(after - len(fresh), after), strict=True))
        return np.where(numbers < 0, len(self.sizes) - 1 - numbers, numbers - self.least).astype(np.int32)

    def _data(self, texts: list[str], once: list[np.ndarray]) -> bytes:
        """The texts that are cut here, each with its end; the ids of others go to ``once``."""
        shown = []
        for t in texts:
            if not self.cut or self.unsafe.search(t) or any(s in t for s in self.specials):
                once.append(self.whole(t))
                t = _WHOLE
            shown += (t, _END)
        data = "".join(shown)
        return (data.lower() if self.words else data).encode()

    def encode_joined(self, texts: list[str], tail: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, each followed by ``tail``; their number by text."""
        if len(self.cache) > self.entries:
            self._turn()
        once = [np.array(tail, "<i4")]
        data = self._data(texts, once)
        wholes = np.arange(1, len(once))
        starts, kinds = _pieces(data, self.words)
        distinct, own = _distinct(data, starts)
        own = self._numbers(distinct, once)[own]
        own[kinds == _WHOLES] = len(self.sizes) + wholes
        if self.words:
            own, kinds = own[kinds != _SPACE], kinds[kinds != _SPACE]
        del data, starts, distinct
        sizes = np.concatenate([self.sizes, np.array([len(x) for x in once], np.int32)])
        upto = np.cumsum(sizes[own], dtype=np.int64)[kinds == _ENDS]
        return _joined(np.concatenate([self.ids, *once]), sizes, own), np.diff(upto, prepend=0)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        ids, lengths = self.encode_joined(texts)
        data, ends = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _turn(self) -> None:
        """The cache becomes the older generation, which is dropped."""
        gone = self.middle - self.least
        self.ids, self.sizes = self.ids[self.sizes[:gone].sum() :], self.sizes[gone:]
        self.least, self.middle = self.middle, self.middle + len(self.sizes)
        self.older, self.cache = self.cache, {}
        self.older.update(_ENDING)

    def forget(self) -> None:
        """Give the cache's memory back; for workers that go on to other work."""
        self.cache, self.older = {}, dict(_ENDING)
        #: ``ids`` and ``sizes`` hold the pieces numbered from ``least`` on; those before ``middle`` are the older generation's.
        self.ids, self.sizes, self.least, self.middle = np.zeros(0, "<i4"), np.zeros(0, np.int32), 0, 0

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One per worker process and file."""
    return PieceTokenizer(path)
