"""Exact, cached encoding with the ``tokenizers`` library.

Both tokenizer files cut a text at white space before anything else, so a text's ids are those of
its units (a run of white space and the run of other characters after it) one after the other.  A
word of Latin letters, the marks after it and a line feed before it are units of their own: both
files cut there.
Many texts are cut at once, as bytes, into the distinct units of all of them; where bytes alone do not
tell, a unit stays longer and is cut by the pattern when it is encoded.
Units repeat, so each worker encodes a unit once and keeps its ids, up to MAX_CACHED units;
beyond that units are encoded again when they return.  Results are the library's own, for the
whole text.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa

MAX_CACHED = 600_000
#: Longer units (in characters) are not kept.
MAX_KEPT = 256
#: Bytes of text that are cut at once, but one text at least; unknown words that are encoded at once.
GROUP_BYTES, PLAIN_AT_ONCE = 1 << 23, 128
#: Unicode white space, as both files' patterns have it.
SPACE = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks both files cut from a word before them, and keep together.
_MARKS = "[.,!?;:#$%&*]*"
_UNIT = re.compile(f" ?[{_LETTERS}]++(?={_MARKS}(?:[{SPACE}]|\\Z))|\n(?=[{_LETTERS}])|[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+")
_PLAIN = re.compile(f" ?[{_LETTERS}]+")
#: Kinds of bytes.
_OTHER, _WHITE, _LETTER, _MARK, _NOT_ASCII = range(5)
_KINDS = bytes(
    _NOT_ASCII if i > 127 else _WHITE if chr(i) in "\t\n\v\f\r " else _LETTER if chr(i).isalpha() else _MARK if chr(i) in ".,!?;:#$%&*" else _OTHER for i in range(256)
)


def _latin(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the two bytes from ``at`` on are a letter of _LETTERS that is not ASCII."""
    second = data[np.minimum(at + 1, len(data) - 1)]
    return (data[at] == 0xC3) & (second != 0x97) & (second != 0xB7)


def _unicode_space(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at ``end`` is a space of SPACE that is not ASCII."""
    c, b, a = data[end], data[np.maximum(end - 1, 0)], data[np.maximum(end - 2, 0)]
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return (c > 127) & (general | (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80))


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin in UTF-8 texts laid end to end, the texts beginning at ``starts``: at a text's start, at
    ASCII white space after anything else, at a mark after a Latin letter, and at a Latin letter after a
    single line feed.  Both files cut in all these places, whatever stands around them."""
    kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    white, is_start = kind == _WHITE, np.zeros(len(data) + 1, bool)
    is_start[starts] = True
    run = white.copy()
    run[1:] &= ~white[:-1] | is_start[1:-1]
    # After a character that is not ASCII, white space begins if that one was not white space itself.
    doubtful = np.flatnonzero(run[1:] & (kind[:-1] == _NOT_ASCII)) + 1
    run[doubtful] = ~_unicode_space(data, doubtful - 1)
    cut = run | is_start[:-1]
    mark = kind[1:] == _MARK
    cut[1:] |= mark & (kind[:-1] == _LETTER)
    at = np.flatnonzero(mark[1:] & (kind[1:-1] == _NOT_ASCII)) + 2
    cut[at] |= _latin(data, at - 2)
    feed = np.flatnonzero(run[:-1] & (data[:-1] == 10)) + 1
    cut[feed] |= (kind[feed] == _LETTER) | _latin(data, feed)
    return np.flatnonzero(cut)


@lru_cache(maxsize=4)
def encoder(path: str) -> "CachedEncoder":
    """One encoder for each file and worker process."""
    return CachedEncoder(path)


def _little_endian(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class CachedEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalizer, self.pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        #: How the pre-tokenizer names a space before a word; None if it drops white space.
        self.space = None if self.normalizer is not None else self.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        self.units: dict[str, bytes] = {}
        #: What the library makes of one Latin letter, and of a space before them.
        self.letters = {i: self._letter(chr(i)) for i in range(256) if chr(i) != " " and _PLAIN.fullmatch(chr(i))}
        self.letters[ord(" ")] = self.space
        #: ASCII words only need the space replaced.
        self.same = self.space is not None and all(self.letters[i] == chr(i) for i in self.letters if i < 128 and i != ord(" "))

    def _plain(self, units: list[str]) -> list[bytes]:
        """Words of Latin letters: one pre-token each, which needs no splitting."""
        bodies = [u.replace(" ", self.space) if self.same and u.isascii() else u.translate(self.letters) for u in units]
        found = list(map(self.model.tokenize, bodies))
        flat = _little_endian([t.id for own in found for t in own])
        ends = [2 * n for n in accumulate(map(len, found))]
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _letter(self, c: str) -> str:
        if self.normalizer is not None:
            c = self.normalizer.normalize_str(c)
        return self.pre_tokenizer.pre_tokenize_str(c)[0][0]

    def _other(self, unit: str) -> bytes:
        """A unit that is no plain word: what the pattern cuts from it, or the whole library's ids."""
        parts = _UNIT.findall(unit)
        if len(parts) > 1:
            return b"".join(self._ids(parts))
        return _little_endian(self.tokenizer.encode(unit, add_special_tokens=False).ids)

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, which are kept: plain words' from the model, any other's from the whole library."""
        out = list(map(self.units.get, units))
        new = dict.fromkeys(u for u, ids in zip(units, out) if ids is None)
        if new:
            plain = [u for u in new if _PLAIN.fullmatch(u)]
            for a in range(0, len(plain), PLAIN_AT_ONCE):
                some = plain[a : a + PLAIN_AT_ONCE]
                new.update(zip(some, self._plain(some)))
            new.update([(u, self._other(u)) for u, ids in new.items() if ids is None])
            out = [new[u] if ids is None else ids for u, ids in zip(units, out)]
            self.units.update((u, ids) for u, ids in new.items() if len(u) <= MAX_KEPT)
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text (None: of the empty one) as little-endian unsigned 16-bit integers."""
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each of many texts, in order."""
        texts = texts.fill_null("").cast(pa.large_string())
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP_BYTES, side="right")) - 1)
            begin, size = int(bounds[at]), int(bounds[to] - bounds[at])
            yield from self._group(data.slice(begin, size), bounds[at : to + 1] - begin) if size else [b""] * (to - at)
            at = to

    def _group(self, data: pa.Buffer, bounds: np.ndarray) -> Iterator[bytes]:
        starts = unit_starts(np.frombuffer(data, np.uint8), bounds[:-1])
        ends = np.append(starts, bounds[-1])
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), data).dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._ids(units), pa.large_binary()).take(coded.indices)
        if len(self.units) > MAX_CACHED:
            for key in list(self.units)[MAX_CACHED // 2 :]:
                del self.units[key]
        _, places, out = ids.buffers()
        places = np.frombuffer(places, np.int64, len(ids) + 1, 8 * ids.offset)[np.searchsorted(starts, bounds)].tolist()
        out = memoryview(out) if out is not None else memoryview(b"")
        for a, b in zip(places, places[1:]):
            yield out[a:b].tobytes()


def crc32_combine(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings joined, from theirs and the second one's length."""
    if length <= 0:
        return a
    return b ^ _shifted(a, length)


def _times(m: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


@lru_cache(maxsize=64)
def _zeros(k: int) -> tuple[int, ...]:
    """The matrix over GF(2) that appends 2**k zero bits to a crc32."""
    if k == 0:
        return (0xEDB88320, *(1 << i for i in range(31)))
    m = _zeros(k - 1)
    return tuple(_times(m, x) for x in m)


def _shifted(crc: int, length: int) -> int:
    bits, k = length * 8, 0
    while bits:
        if bits & 1:
            crc = _times(_zeros(k), crc)
        bits >>= 1
        k += 1
    return crc


@lru_cache(maxsize=64)
def _zeros_by_byte(k: int) -> np.ndarray:
    """What 2**k zero bits make of each value of each of a crc32's four bytes."""
    return np.array([[_times(_zeros(k), v << (8 * byte)) for v in range(256)] for byte in range(4)], np.uint32)


def crc32_joined(crcs: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of many byte strings, each given by its pieces' crc32 and lengths, laid end to end.

    ``first``: where each string's pieces begin, ascending; each string has a piece, each piece a byte.
    """
    ends = np.cumsum(lengths)
    last = np.repeat(ends[np.append(first[1:], len(crcs)) - 1], np.diff(np.append(first, len(crcs))))
    bits, out, k = (last - ends) * 8, crcs.astype(np.uint32), 0
    while (bits >> k).any():
        at = np.flatnonzero((bits >> k) & 1)
        if len(at):
            v, table = out[at], _zeros_by_byte(k)
            out[at] = table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]
        k += 1
    return np.bitwise_xor.reduceat(out, first)
