"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

Each text, with a space before it, is tokenized by a byte-level BPE (A) and by SentencePiece pieces (B). The ends of tokens, as byte offsets,
are two sorted lists; their common members are found by galloping: the shorter list drives, and from where its last member was found the
longer one is searched by steps that double, then by halves between the last two. Texts are walked side by side, LANE members of a
list at a time, so a step is one numpy operation for all of them. Common ends cut both token lists into groups. In a group every A token is linked with every B
token; the difference of ranks between common ends gives the ranges, so links are counted without being listed.

Counts of linked ids over the corpus: each task works on blocks of about BLOCK bytes of text and states a block's id pairs once, with the number of its
documents that hold them. These are summed by pair, rated against the best of their A id (a table of the vocabulary's size is broadcast),
and sent back to their blocks, where the documents' own pairs meet them. A pair is one row a block at most, however common it is.

Defined results: texts that are null or empty, or whose tokens' bytes don't join to the text again, have no tokens: zeros, and no groups. Texts of any length
are worked through whole; a block is one text then. Rows are counted each for itself, also those that repeat an id or have none. Ties
for an A id's best count are all best. Only the id and the text are read, so other columns may have any names. An empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import keep, small_batches
from claimloom.llm.pieces import Known, lists, pieces

BLOCK = 2 << 20
LANE = 32
#: Links of one group that are listed at once; in larger groups equal ids are counted first.
LISTED = 1 << 12


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: those that can be seen for themselves, the others from U+0100 on in turn."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer, with a cache of what stretches of text turn into.

    The tokenizer's pattern never matches across a place where white space follows something else, nor where ASCII letters, digits and
    punctuation other than apostrophes meet, so texts are cut there and equal stretches are tokenized once.
    """

    KINDS = np.zeros(256, np.uint8)  # 1: letters, 2: digits, 3: punctuation, 4: an apostrophe, 5: white space
    KINDS[33:127] = 3
    KINDS[[*range(65, 91), *range(97, 123)]] = 1
    KINDS[48:58] = 2
    KINDS[39] = 4
    KINDS[[*range(9, 14), 32]] = 5

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level BPE without normalization")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        self.size = max([*vocabulary.values(), *added]) + 1
        surface = [b""] * self.size
        for token, i in vocabulary.items():
            surface[i] = added[i] if i in added else bytes(alphabet[c] for c in token)
        for i, raw in added.items():
            surface[i] = raw
        self.n_bytes = np.array([len(x) for x in surface], np.int64)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.known = Known()

    def surfaces(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[W.ragged(self.first_byte[ids], self.n_bytes[ids])]

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie in data one after the other, from the places starts on, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        kind = self.KINDS[data]
        # white space beyond ASCII ends in a byte from 0x80 up, but never in one after 0xC3 (Latin letters)
        solid = (kind[:-1] > 0) & (kind[:-1] < 5)
        solid[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)
        begins = np.r_[True, (kind[1:] == 5) & solid | (kind[:-1] != kind[1:]) & (np.minimum(kind[:-1], kind[1:]) > 0) & (np.maximum(kind[:-1], kind[1:]) < 4)]
        begins[starts] = True
        begin = np.flatnonzero(begins)
        end = np.r_[begin[1:], len(data)]
        values, first, back = np.unique(W.bytes_hash(data, begin, end), return_index=True, return_inverse=True)
        new = self.known.lacks(values)
        if new.any():
            at = first[new]
            strings = [data[b:e].tobytes().decode() for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            found = [e.ids for k in range(0, len(strings), 4096) for e in self.tokenizer.encode_batch_fast(strings[k : k + 4096], add_special_tokens=False)]
            self.known.add(values[new], np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64))
        ids, n = self.known.ids(values, back)
        upto = np.r_[0, np.cumsum(n)][np.searchsorted(begin, starts)]
        return ids, np.diff(np.r_[upto, len(ids)])


_byte_level: dict[str, ByteLevel] = {}


def byte_level(path: str) -> ByteLevel:
    """One tokenizer for each Python worker."""
    if path not in _byte_level:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _byte_level[path] = ByteLevel(path)
    return _byte_level[path]


def gallop(short: np.ndarray, long: np.ndarray, begin: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each lane, a run of members of the sorted list short: where they stand in long, or -1, as one array a member of short (-1 outside lanes).

    A lane's search begins at low in long and never passes high, at which a member at least as large as all of the lane's stands.
    """
    found = np.full(len(short), -1, np.int64)
    order = np.argsort(-count, kind="stable")  # lanes that are through are at the end
    begin, count, at, high = begin[order], count[order], low[order].copy(), high[order]
    sizes = -count
    for step in range(int(count[0]) if len(count) else 0):
        n = int(np.searchsorted(sizes, -step))  # lanes with more than step members
        target = short[begin[:n] + step]
        lower, bound = at[:n].copy(), at[:n].copy()  # below lower all are smaller; at bound one is at least as large, once found
        live = np.flatnonzero(long[bound] < target)
        jump = 1
        while len(live):  # steps that double
            lower[live] = bound[live] + 1
            bound[live] = np.minimum(bound[live] + jump, high[live])
            jump *= 2
            live = live[long[bound[live]] < target[live]]
        live = np.flatnonzero(lower < bound)
        while len(live):  # halves
            middle = (lower[live] + bound[live]) // 2
            less = long[middle] < target[live]
            lower[live[less]] = middle[less] + 1
            bound[live[~less]] = middle[~less]
            live = live[lower[live] < bound[live]]
        at[:n] = bound
        hit = long[bound] == target
        found[begin[:n][hit] + step] = bound[hit]
    return found


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into both lists of the ends that they share, for texts one after the other with n_a and n_b tokens each; a text's last ends are alike."""
    found = []
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    for driven, short, long, n_short, n_long, first_short, first_long in ((n_a <= n_b, ends_a, ends_b, n_a, n_b, first_a, first_b), (n_a > n_b, ends_b, ends_a, n_b, n_a, first_b, first_a)):
        text = np.flatnonzero(driven & (n_short > 0))
        lanes = -(-n_short[text] // LANE)
        text = np.repeat(text, lanes)
        step = W.ragged(np.zeros(len(lanes), np.int64), lanes) * LANE
        count = np.minimum(n_short[text] - step, LANE)
        place = gallop(short, long, first_short[text] + step, count, first_long[text], first_long[text] + n_long[text] - 1)
        at = np.flatnonzero(place >= 0)
        found.append((at, place[at]))
    (a, b), (b2, a2) = found
    return np.sort(np.r_[a, a2]), np.sort(np.r_[b, b2])  # both ascend together


class Aligned:
    """Texts' tokens and groups: ids, how many tokens and groups each text has, and the groups' numbers of tokens."""

    def __init__(self, texts: pa.Array, path_a: str, path_b: str):
        tokenizer_a, tokenizer_b = byte_level(path_a), pieces(path_b)
        data, offsets = W.buffer_of(texts)
        data, offsets = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        spaced = np.insert(data, offsets[filled], np.uint8(32))
        starts = offsets[filled] + np.arange(len(filled))
        width = np.diff(offsets)[filled] + 1
        a, n_a = tokenizer_a.encode(spaced, starts)
        b, n_b = tokenizer_b.encode(texts)
        n_b = n_b[filled]
        good = self._same(tokenizer_a, a, n_a, spaced, starts, width) & self._same(tokenizer_b, b, n_b, spaced, starts, width)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.size_a, self.size_b = tokenizer_a.size, tokenizer_b.size
        last_a, last_b = common_ends(np.cumsum(tokenizer_a.n_bytes[a]), np.cumsum(tokenizer_b.n_bytes[b]), n_a, n_b)
        self.in_a, self.in_b = np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b])  # tokens of each group
        upto = np.searchsorted(last_a, np.cumsum(n_a))  # groups before each text's end
        at_all = lambda x: np.bincount(filled, weights=x, minlength=len(texts)).astype(np.int64)
        self.n_a, self.n_b, self.n_groups = at_all(n_a), at_all(n_b), at_all(np.diff(np.r_[0, upto]))
        links = np.r_[0, np.cumsum(self.in_a * self.in_b)]
        group = np.r_[0, np.cumsum(self.n_groups)]
        self.n_links = links[group[1:]] - links[group[:-1]]

    @staticmethod
    def _same(tokenizer, ids: np.ndarray, n: np.ndarray, data: np.ndarray, starts: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Which texts the tokens' bytes join to again."""
        raw = tokenizer.surfaces(ids)
        upto = np.r_[0, np.cumsum(tokenizer.n_bytes[ids])][np.r_[0, np.cumsum(n)]]
        same = np.diff(upto) == width
        if same.all() and np.array_equal(raw, data):
            return same
        at = np.flatnonzero(same)
        differs = raw[W.ragged(upto[at], width[at])] != data[W.ragged(starts[at], width[at])]
        same[at[np.unique(np.searchsorted(np.cumsum(width[at]), np.flatnonzero(differs), "right"))]] = False
        return same

    def strings(self) -> pa.Array:
        """The groups as text: a1,a2|b1;a3|b2,b3."""
        before_b = np.r_[0, np.cumsum(self.in_b)]
        group_a, group_b = np.repeat(np.arange(len(self.in_a)), self.in_a), np.repeat(np.arange(len(self.in_b)), self.in_b)
        at_a = np.arange(len(self.a)) + before_b[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[group_b]
        ids, sign = np.empty(len(self.a) + len(self.b), np.int32), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[np.cumsum(self.in_a) - 1]] = ord("|")
        sign[at_b[np.cumsum(self.in_b) - 1]] = ord(";")
        digits, n = decimals(max(self.size_a, self.size_b))
        width = n[ids] + 1
        tokens = self.n_a + self.n_b
        last = np.cumsum(tokens)[tokens > 0] - 1
        width[last] -= 1
        ends = np.cumsum(width)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        start = ends - width
        for k in range(digits.shape[1]):
            has = np.flatnonzero(n[ids] > k)
            out[start[has] + k] = digits[ids[has], k]
        signed = np.ones(len(ids), bool)
        signed[last] = False
        out[ends[signed] - 1] = sign[signed]
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(tokens)]].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(tokens), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's different pairs of linked ids, as text and a * size_b + b in order, and how many links each has."""
        text = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        links = self.in_a * self.in_b
        group = np.flatnonzero(links <= LISTED)
        n = self.in_a[group]
        at = W.ragged(first_a[group], n)  # A tokens, each with all B tokens of its group
        m = np.repeat(self.in_b[group], n)
        keys = [np.repeat((np.repeat(text[group], n) * self.size_a + self.a[at]) * self.size_b, m) + self.b[W.ragged(np.repeat(first_b[group], n), m)]]
        times = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(links > LISTED):
            a, of_a = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            b, of_b = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            keys.append((((text[g] * self.size_a + a) * self.size_b)[:, None] + b).ravel())
            times.append((of_a[:, None] * of_b).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        if len(times) and times.max() == 1:
            keys, times = np.unique(keys, return_counts=True)
        else:
            order = np.argsort(keys, kind="stable")
            keys, starts = np.unique(keys[order], return_index=True)
            times = np.add.reduceat(times[order], starts) if len(starts) else times
        both = self.size_a * self.size_b
        return keys // both, keys % both, times


_decimals: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below size, from the left, and how many each has."""
    if size not in _decimals:
        n = np.array([len(str(i)) for i in range(size)])
        digits = np.zeros((size, int(n.max())), np.uint8)
        for i in range(size):
            digits[i, : n[i]] = np.frombuffer(str(i).encode(), np.uint8)
        _decimals[size] = digits, n
    return _decimals[size]


def packed(index: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and their counts, the bytes of each rank together, compressed."""
    both = np.concatenate([np.diff(index, prepend=0), times]).astype("<u8")
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, 16 * n, "zstd", asbytes=True), np.uint8).reshape(8, 2 * n)
    both = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
    return np.cumsum(both[:n]), both[n:]


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups string, block long, n_pairs long, pairs binary, pair_a array<int>, pair_b array<int>, pair_n array<int>"


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its tokens' and groups' numbers and the groups as text (empty without tokens), and what rate() needs: the block, the document's pairs, and on a block's first row its table of pairs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, BLOCK):
            found = Aligned(batch.column(1), path_a, path_b)
            of, pair, times = found.pairs()
            pairs, index, n = np.unique(pair, return_inverse=True, return_counts=True)
            upto = np.searchsorted(of, np.arange(len(batch) + 1))
            payload = [packed(index[s:e], times[s:e]) for s, e in zip(upto, upto[1:])]
            first = np.zeros(len(batch), np.int64)
            first[0] = len(pairs)
            table = [lists(x.astype(np.int32), first) for x in (pairs // found.size_b, pairs % found.size_b, n)]
            counts = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            columns = [batch.column(0), *counts, found.strings(), pa.array(np.full(len(batch), block)), pa.array(np.diff(upto)), pa.array(payload, pa.binary()), *table]
            yield pa.RecordBatch.from_arrays(columns, [key, *(x.split()[0] for x in FOUND.split(", "))])
            block += 1

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {FOUND}")


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, so that each has about size bytes, or one row."""
    held, n = [], 0
    for batch in batches:
        at = 0
        width = np.diff(W.buffer_of(batch.column(1))[1])
        while at < len(batch):
            upto = np.cumsum(width[at:])
            take = max(1, int(np.searchsorted(upto, size - n, "right"))) if n < size else 0
            if take:
                held.append(batch.slice(at, take))
                n += int(upto[take - 1])
                at += take
            if n >= size or at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def rate(found: DataFrame) -> DataFrame:
    """Give align()'s documents, which must have been written (see base.keep), n_best and count_sum: of a document's links, how many are of a pair that no other pair of the same A id is more common than, and the sum of their pairs' counts."""
    pairs = found.where(F.size("pair_a") > 0).select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("at", "p")).select("block", "at", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = totals.groupBy("a").agg(F.max("count").alias("most"))  # a row an id of the vocabulary, at most
    rated = totals.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.join(rated, ["a", "b"]).select(F.col("block").alias("of"), "at", "count", "best")
    others = [f for f in found.schema.fields if f.name not in ("block", "n_pairs", "pairs", "pair_a", "pair_b", "pair_n")]
    rows = found.select(*(f.name for f in others), "block", "n_pairs", "pairs")

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), bool)
        at = np.asarray(answers.column("at"))
        count[at], best[at] = np.asarray(answers.column("count")), np.asarray(answers.column("best"))
        n_best, count_sum = [], []
        for raw, n in zip(docs.column("pairs").to_pylist(), docs.column("n_pairs").to_pylist(), strict=True):
            index, times = unpacked(raw, n)
            n_best.append(int(times[best[index]].sum()))
            count_sum.append(int((times * count[index]).sum()))
        out = docs.select([f.name for f in others])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, f"{schema}, n_best long, count_sum long")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents with their groups as text, n_best and count_sum."""
    return rate(keep(align(docs, path_a, path_b), "aligned"))
