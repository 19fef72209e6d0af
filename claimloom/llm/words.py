"""Words and word n-grams as 64-bit hashes, computed over whole Arrow buffers.

A word is a maximal run of word bytes. Both word classes used here treat every byte from 0x80 up as
part of a word, so a UTF-8 text can be scanned byte by byte. Texts are worked through in pieces that end
between words; a text of any length costs about ten bytes a word, and no more for the rest.

A word's hash is a polynomial in random values of its bytes, modulo 2**64, mixed. Unequal words or
n-grams share a hash with a probability of about 2**-58 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that short_hash() takes by eights, and masks of a word's first bytes.
SHORT = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_rng = np.random.default_rng(20240601)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordClass:
    """Which bytes make up words, and whether A-Z count as a-z."""

    def __init__(self, is_word, fold: bool):
        self.word = np.array([is_word(b) for b in range(256)])
        self.folded = np.arange(256, dtype=np.uint8)
        if fold:
            self.folded[65:91] += 32
        self.value = _VALUE[self.folded]


def _not_space(b: int) -> bool:
    return b != 0x20 and not 9 <= b <= 13


#: [^\x20\x09-\x0D]+
SPACED = WordClass(_not_space, fold=False)
#: the same, A-Z as a-z
SPACED_LOWER = WordClass(_not_space, fold=True)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM_LOWER = WordClass(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, fold=True)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int):
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, PIECE + 1)
        inv = np.uint64(pow(int(_BASE), -1, 2**64))
        out = []
        for base in (_BASE, inv):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers, _inverse = out
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and the n + 1 offsets into them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def scan(data: np.ndarray, offsets: np.ndarray, kind: WordClass, places: bool = False):
    """Hashes of all words in order, and for each text the index of its first word (n + 1 of them); with places, the words' start and end bytes too."""
    begin, end = int(offsets[0]), int(offsets[-1])
    hashes, starts = [], []
    stops = []
    at = begin
    while at < end:
        to = min(end, at + PIECE)
        if to < end:
            cut = np.flatnonzero(~kind.word[data[at:to]])
            bound = offsets[np.searchsorted(offsets, to, "right") - 1]
            back = max(at + int(cut[-1]) + 1 if len(cut) else at, int(bound))
            if back > at:
                to = back
            else:  # one word longer than a piece
                while to < end and kind.word[data[to]] and not (offsets[np.searchsorted(offsets, to)] == to):
                    to += 1
        piece = data[at:to]
        word = kind.word[piece]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        first[inner] = word[inner]
        before = inner[inner > 0] - 1
        last[before] = word[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(kind.value[piece] * power[: len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        if places:
            stops.append(e + at)
        at = to
    none = np.zeros(0, np.int64)
    begins = np.concatenate(starts) if starts else none
    first = np.searchsorted(begins, offsets)
    out = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first)
    return (*out, begins, np.concatenate(stops) if stops else none) if places else out


def bytes_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each stretch of bytes, as scan() makes them."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        low = int(begin[at])
        to = max(at + 1, int(np.searchsorted(end, low + PIECE, "right")))
        piece = data[low : int(end[to - 1])]
        power, inverse = _tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * power[: len(piece)], out=total[1:])
        s, e = begin[at:to] - low, end[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def short_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each stretch of bytes, eight bytes at a time; of stretches over SHORT bytes, that of bytes_hash()."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))  # at each byte
    n = end - begin
    out = mix(n.astype(np.uint64) + _BASE)
    on, left = np.flatnonzero(n <= SHORT), np.minimum(n, SHORT)[n <= SHORT]
    at = begin[on]
    while len(on):
        part = eight[at] & _FIRST[np.minimum(left, 8)]
        out[on] = mix((out[on] ^ part) * _BASE)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    long = n > SHORT
    if long.any():
        out[long] = bytes_hash(data, begin[long], end[long])
    return out


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words in a row; those that run over a text's end are among them (see inside())."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n == 1:
        return mix(words + np.uint64(1))
    out = np.empty(len(words) - n + 1, np.uint64)
    for at in range(0, len(out), PIECE):
        part = words[at : at + PIECE + n - 1]
        if n <= 6:
            m = len(part) - n + 1
            h = part[:m].copy()
            for j in range(1, n):
                h *= _BASE
                h += part[j : j + m]
        else:
            power, inverse = _tables(PIECE + n + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=total[1:])
            h = (total[n:] - total[:-n]) * inverse[: len(part) - n + 1]
        out[at : at + PIECE] = mix(h + np.uint64(n))
    return out


def stretches(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash for each stretch of words, from start to before stop."""
    power, inverse = _tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For each text, how many n-grams lie in it."""
    return np.maximum(np.diff(first) - n + 1, 0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of fixed-width values as one binary a run."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
