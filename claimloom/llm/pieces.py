"""SentencePiece BPE with byte fallback: encoding by vectorised merge rounds, and decoding.

A text becomes a flat numpy array of symbols, one a character, with the space mark for each space and one before the text. It is cut
between two characters wherever no piece of the vocabulary has them side by side, since no merge can cross such a place; the parts are
called words here. Equal words (by a 64-bit hash) are merged once and kept in a cache of bounded size.

A round looks up the rank of every adjacent pair, takes each word's least one by a segmented minimum, merges all its
occurrences at once, the leftmost of those that overlap, and compacts the arrays; words in which no pair is left go. Merging all at once
equals merging one by one as long as what a merge makes possible ranks behind it. Pieces for which that isn't so (runs
of spaces, which all rank alike) are known from the vocabulary and are merged one a word and round. A word of more than LONG symbols takes
its merges from a heap, since rounds over it would cost the square of its length.

Defined results: null and empty texts have no pieces but the end id; decoding null gives null. A text of any length is worked through in stretches of
about STRETCH bytes that end where words do. Rows are independent, so repeated rows, rows without an id and ties don't matter;
encode() and decode() add one column, whose name the caller gives, and leave the others alone. Empty tables give empty ones.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.llm import words as W

MARK = 0x2581
STRETCH = 1 << 20
LONG = 4096
#: Words in a worker's cache; it is emptied when it has more.
CACHED = 1 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.int32(2**31 - 1)
UNKNOWN_SURFACE = " ⁇ "


def _fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message: number, and its integer or bytes."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            n = number() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """The pieces of a model file (text, score, kind) and what its settings say."""
    with open(path, "rb") as f:
        data = memoryview(f.read())
    pieces, settings = [], {"bpe": False, "bytes": False, "prefix": True, "trim": True, "escape": True, "suffix": False, "charsmap": False}
    for field, value in _fields(data):
        if field == 1:
            p = dict(_fields(value))
            pieces.append((bytes(p.get(1, b"")).decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif field == 2:
            t = dict(_fields(value))
            settings |= {"bpe": t.get(3, 1) == 2, "bytes": bool(t.get(35, 0)), "suffix": bool(t.get(24, 0))}
        elif field == 3:
            n = dict(_fields(value))
            settings |= {"charsmap": len(n.get(2, b"")) > 0, "prefix": bool(n.get(3, 1)), "trim": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
    return pieces, settings


class Known:
    """What units of text turn into: sorted hashes, and where in a pool a unit's ids are. It is emptied when it holds more than CACHED units."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.int32), 0

    def lacks(self, values: np.ndarray) -> np.ndarray:
        """Which of the sorted hashes aren't there. Call it before add() and ids()."""
        if len(self.keys) > CACHED:
            self.forget()
        if not len(self.keys):
            return np.ones(len(values), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)] != values

    def add(self, values: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Put in sorted hashes that aren't there, with all their ids and how many each has."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        to = np.searchsorted(self.keys, values)
        self.keys = np.insert(self.keys, to, values)
        self.at = np.insert(self.at, to, self.filled + np.cumsum(n) - n)
        self.n = np.insert(self.n, to, n)
        self.filled += len(ids)

    def ids(self, values: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units values[back], one unit after the other, and how many each has."""
        place = np.searchsorted(self.keys, values)[back]
        n = self.n[place]
        return self.pool[W.ragged(self.at[place], n)], n


class Pieces:
    def __init__(self, path: str):
        pieces, s = read_model(path)
        if not (s["bpe"] and s["bytes"] and s["prefix"] and s["escape"]) or s["trim"] or s["suffix"] or s["charsmap"] or {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: not a BPE model with byte fallback and a space before the text, without normalization and pieces of one's own")
        self.size = len(pieces)
        self.kind = np.array([k for _, _, k in pieces])
        symbol = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
        for c in sorted({c for t in symbol for c in t} - symbol.keys()):  # characters that are no pieces but parts of some
            symbol[c] = len(symbol) + self.size
        rank = np.full(max(symbol.values()) + 2, NONE)
        rank[: self.size] = np.unique([-x for _, x, _ in pieces], return_inverse=True)[1]
        self.rank = rank
        self.symbol = np.full(0x110000, len(rank) - 1, np.int32)  # the last symbol: a character of no piece
        joined, pairs = set(), {}
        self.alone = np.zeros(len(rank), bool)
        for t, i in symbol.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i
            joined.update(zip(t, t[1:]))
            for k in range(1, len(t)):
                a, b = symbol.get(t[:k]), symbol.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * len(rank) + b] = i
                    for part in (a, b):
                        if part < self.size and rank[i] <= rank[part]:
                            self.alone[part] = True
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        # which characters stand side by side in a piece, as a matrix over those that do at all
        self.left, self.right = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        sides = [sorted({p[k] for p in joined}) for k in (0, 1)]
        for table, side in ((self.left, sides[0]), (self.right, sides[1])):
            table[[ord(c) for c in side]] = np.arange(1, len(side) + 1)
        self.joined = np.zeros((len(sides[0]) + 1, len(sides[1]) + 1), bool)
        self.joined[self.left[[ord(a) for a, _ in joined]], self.right[[ord(b) for _, b in joined]]] = True
        #: Bytes before which a stretch may end at a space: ASCII that no piece has before a space mark.
        self.before_space = np.array([32 < b < 127 and not self.joined[self.left[b], self.right[MARK]] for b in range(256)])
        self.value = np.random.default_rng(7).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte_id = np.zeros(256, np.int32)
        surface = []
        for i, (t, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_id[int(t[3:5], 16)] = i
            surface.append({NORMAL: t.replace(chr(MARK), " ").encode(), UNKNOWN: UNKNOWN_SURFACE.encode(), CONTROL: b"", BYTE: bytes([int(t[3:5], 16)]) if k == BYTE else b""}[k])
        self.end = next((i for i, (t, _, k) in enumerate(pieces) if k == CONTROL and t == "</s>"), None)
        self.n_bytes = np.array([len(x) for x in surface], np.int64)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.known = Known()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that two symbols merge to, or the last one, which ranks behind all."""
        key = a.astype(np.int64) * len(self.rank) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], np.int32(len(self.rank) - 1))

    def rounds(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the words' symbols until no pair is left. Returns the symbols, the place each one begins at, and how many each word has."""
        word = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(symbols))
        done = []
        while len(symbols):
            pair = np.full(len(symbols), len(self.rank) - 1, np.int32)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair[inner] = self._pair(symbols[inner], symbols[inner + 1])
            rank = self.rank[pair]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            n = np.diff(np.r_[starts, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, starts), n)
            over = least == NONE
            if over.any():
                done.append((word[over], symbols[over], place[over]))
                live = ~over
                word, symbols, place, pair, rank, least = (x[live] for x in (word, symbols, place, pair, rank, least))
                if not len(word):
                    break
            hit = np.flatnonzero(rank == least)
            of = word[hit]
            one = self.alone[pair[hit]]
            if one.any():
                single = np.zeros(len(counts), bool)
                single[of[one]] = True
                hit = hit[~single[of] | np.r_[True, of[1:] != of[:-1]]]
                of = word[hit]
            # of hits in a row, which overlap, every second one goes
            begins = np.r_[True, (hit[1:] != hit[:-1] + 1) | (of[1:] != of[:-1])]
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = pair[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            word, symbols, place = word[stay], symbols[stay], place[stay]
        if not done:
            return symbols, place, np.zeros(len(counts), np.int64)
        word, symbols, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return symbols[order], place[order], np.bincount(word, minlength=len(counts))

    def heap(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long word's symbols merged one by one, least rank first, leftmost first. Returns symbols and places."""
        s = symbols.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self._pair(symbols[:-1], symbols[1:])
        rank, last = self.rank, len(self.rank) - 1
        queue = [(r, i, a, b, p) for i, (r, a, b, p) in enumerate(zip(rank[pair].tolist(), s, s[1:], pair.tolist())) if p != last]
        heapq.heapify(queue)
        known: dict[tuple[int, int], int] = {}
        while queue:
            _, i, a, b, p = heapq.heappop(queue)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = p, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n:
                    both = (s[left], s[right])
                    if both not in known:
                        known[both] = int(self._pair(np.array(both[:1]), np.array(both[1:]))[0])
                    if known[both] != last:
                        heapq.heappush(queue, (int(rank[known[both]]), left, *both, known[both]))
        out = np.array(s)
        place = np.flatnonzero(out >= 0)
        return out[place], place

    def _learn(self, values: np.ndarray, chars: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> None:
        """Put words in the cache; values are their sorted hashes."""
        long = counts > LONG
        at = W.ragged(begin[~long], counts[~long])
        code = chars[at]
        symbols, place, n = self.rounds(self.symbol[code], counts[~long])
        parts, numbers = [(symbols, code[place])], np.zeros(len(counts), np.int64)
        numbers[~long] = n
        which = [np.repeat(np.flatnonzero(~long), n)]
        for k in np.flatnonzero(long):
            code = chars[begin[k] : begin[k] + counts[k]]
            symbols, place = self.heap(self.symbol[code])
            parts.append((symbols, code[place]))
            which.append(np.full(len(symbols), k))
        symbols, code = (np.concatenate(x) for x in zip(*parts))
        which = np.concatenate(which)
        order = np.argsort(which, kind="stable")
        symbols, code, which = symbols[order], code[order], which[order]
        other = np.flatnonzero(symbols >= self.size)  # characters that are no pieces: as bytes
        raw = [chr(c).encode() for c in code[other].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[other] = [len(x) for x in raw]
        ids = np.repeat(symbols, width).astype(np.int32)
        ids[W.ragged((np.cumsum(width) - width)[other], width[other])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n = np.bincount(which, weights=width, minlength=len(counts)).astype(np.int64)
        self.known.add(values, ids, n)

    def _stretch(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of bytes, and how many come before each of the places starts, at which texts begin."""
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.cumsum((data & 0xC0) != 0x80)
        at = lead[starts] - 1
        chars = np.insert(np.where(chars == 32, np.uint32(MARK), chars), at, np.uint32(MARK))
        at += np.arange(len(at))
        begins = np.r_[True, ~self.joined[self.left[chars[:-1]], self.right[chars[1:]]]]
        begins[at] = True
        begin = np.flatnonzero(begins)
        counts = np.diff(np.r_[begin, len(chars)])
        power, inverse = W._tables(len(chars) + 1)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(self.value[chars] * power[: len(chars)], out=total[1:])
        keys = W.mix((total[begin + counts] - total[begin]) * inverse[begin] + counts.astype(np.uint64))
        values, first, back = np.unique(keys, return_index=True, return_inverse=True)
        new = self.known.lacks(values)
        if new.any():
            self._learn(values[new], chars, begin[first[new]], counts[first[new]])
        ids, n = self.known.ids(values, back)
        return ids, np.r_[0, np.cumsum(n)][np.searchsorted(begin, at)]

    def encode(self, texts: pa.Array, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and their numbers; with end, each text's end id too."""
        data, offsets = W.buffer_of(texts)
        starts = offsets[:-1][np.diff(offsets) > 0]  # empty texts have no space mark either
        ids, before, total = [], [], 0
        at, high = int(offsets[0]), int(offsets[-1])
        while at < high:
            to = min(high, at + STRETCH)
            if to < high:
                back = int(starts[np.searchsorted(starts, to, "right") - 1])
                space = np.flatnonzero((data[at + 1 : to] == 32) & self.before_space[data[at : to - 1]])
                back = max(back, at + 1 + int(space[-1]) if len(space) else 0)
                if back > at:
                    to = back
                else:  # one word as long as that: up to the next place where a text or a word ends
                    k = np.searchsorted(starts, to)
                    to = int(starts[k]) if k < len(starts) else high
            here = starts[np.searchsorted(starts, at) : np.searchsorted(starts, to)]
            found, upto = self._stretch(data[at:to], here - at) if len(here) and here[0] == at else self._continued(data[at:to], here - at)
            ids.append(found)
            before.append(upto + total)
            total += len(found)
            at = to
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        counts = np.zeros(len(texts), np.int64)
        if len(filled):
            counts[filled] = np.diff(np.r_[np.concatenate(before), total])
        if not end:
            return flat, counts
        out = np.full(total + len(counts), self.end, np.int32)
        body = np.ones(len(out), bool)
        body[np.cumsum(counts + 1) - 1] = False
        out[body] = flat
        return out, counts + 1

    def _continued(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A stretch that begins within a text, at a space: its first space is left out, since _stretch() puts one there."""
        found, upto = self._stretch(data[1:], np.r_[0, starts - 1])
        return found, upto[1:]

    def surfaces(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after the other."""
        return self.bytes[W.ragged(self.first_byte[ids], self.n_bytes[ids])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts that runs of ids stand for."""
        ends = np.cumsum(counts)
        shown = np.flatnonzero(self.kind[ids] != CONTROL)
        first = np.searchsorted(shown, ends - counts)
        first = shown[first[first < len(shown)]] if len(shown) else shown
        width = self.n_bytes[ids]
        begin = self.first_byte[ids]
        # the space that encoding put before the text: of each run's first piece that shows
        first = np.unique(first)
        first = first[(self.kind[ids[first]] == NORMAL) & (self.bytes[np.minimum(begin[first], len(self.bytes) - 1)] == 32)]
        begin[first] += 1
        width[first] -= 1
        raw = self.bytes[W.ragged(begin, width)].tobytes()
        upto = np.r_[0, np.cumsum(width)][np.r_[0, ends]].tolist()
        kind = self.kind[ids]
        split = np.zeros(len(counts), bool)  # something unseen ends a run of bytes
        split[np.searchsorted(ends, np.flatnonzero((kind[:-1] == BYTE) & (kind[1:] == CONTROL)), "right")] = True
        out = []
        for k, (a, b) in enumerate(zip(upto, upto[1:])):
            try:
                out.append(raw[a:b].decode() if not split[k] else self._by_runs(ids[ends[k] - counts[k] : ends[k]]))
            except UnicodeDecodeError:
                out.append(self._by_runs(ids[ends[k] - counts[k] : ends[k]]))
        return out

    def _by_runs(self, ids: np.ndarray) -> str:
        """The text of ids whose bytes may not be UTF-8: each run of byte pieces is read by itself."""
        out, run, first = [], b"", True
        for i in [*ids.tolist(), None]:
            surface = b"" if i is None else self.bytes[self.first_byte[i] : self.first_byte[i] + self.n_bytes[i]].tobytes()
            if i is not None and self.kind[i] == BYTE:
                run, first = run + surface, False
                continue
            out.append(_repaired(run))
            run = b""
            if i is not None and self.kind[i] != CONTROL:
                out.append((surface[1:] if first and self.kind[i] == NORMAL and surface[:1] == b" " else surface).decode())
                first = False
        return "".join(out)


def _repaired(raw: bytes) -> str:
    """Text of bytes: each one that begins no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if 0xC2 <= raw[at] < 0xE0 else 3 if 0xE0 <= raw[at] < 0xF0 else 4 if 0xF0 <= raw[at] < 0xF5 else 0
        try:
            out.append(raw[at : at + n].decode() or "\ufffd")
            at += max(n, 1)
        except UnicodeDecodeError:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values as one list a run."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def encode(text: str | Column, path: str, end: bool = True) -> Column:
    """A text's ids, array<int>; with end, the end id is the last."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield lists(*pieces(path).encode(batch, end))

    return ids(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str) -> Column:
    """The text that a list of ids stands for; null for null."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            batch = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
            counts = np.asarray(batch.value_lengths().fill_null(0)).astype(np.int64)
            out = pieces(path).decode(np.asarray(batch.flatten()).astype(np.int64), counts)
            yield pa.array([None if null else x for x, null in zip(out, batch.is_null().to_pylist())], pa.string())

    return text(F.col(ids) if isinstance(ids, str) else ids)
