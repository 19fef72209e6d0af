"""Packing texts into token sequences, by lexical retrieval.

Texts are tokenized once. Their token ids are the terms of a BM25 index whose document frequencies and mean length are those
of all texts (a table of the vocabulary's size, so it goes to the executors as it is).

Texts are routed first: at most ROUTES texts are drawn as seeds, by a hash. The seeds' SEED_TERMS rarest terms that other texts
share are an index of bounded size that goes to the executors; every text of the table, in whatever file, is scored against all seeds by
BM25 over those terms. Texts are sorted by their best seed, then by their second best, and so on (PREFIX of them), so related texts
lie together however many there are; a text costs the same at any size of the table. Seeds are numbered in the order of their terms.

The index is sharded in that order: each task builds the inverted index of SHARD_DOCS texts at a time (fewer when they are
long), takes the first unused one as seed, ranks the unused others by BM25 with the seed as query, and fills the window with
the best, greedily. So beyond its routing a text meets the texts of its shard only.

A text that doesn't fit is cut at the window's end, and its rest is the next seed. What is left of a shard, less than a window, is
routed again with what the others left, and packed in a second pass. What is left then is cut into stretches whose lengths
are powers of two, which need no padding. So no sequence has any.

Defined results: a null or empty text has the end token only; texts of any length are cut over as many windows as they
need; ties go to the text first in its shard; repeated rows, and rows without an id, are packed each for itself; further
columns are not read, whatever their names; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import forget, keep, small_batches

SHARD_DOCS = 512
SHARD_TOKENS = 1 << 20
SEED_TERMS = 8
#: Seeds that texts are routed by, at most, and how many of a text's best ones it is sorted by.
ROUTES = 2048
PREFIX = 3
#: Cells (texts times seeds) that are scored at once.
CELLS = 1 << 20
K1, B = 1.2, 0.75

ROUTED = "doc_id long, start long, doc_tokens long, ids binary, " + ", ".join(f"seed{k} int" for k in range(PREFIX))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """A word-level tokenizer, with a cache of what words turn into.

    The tokenizer splits at white space first, so a text's ids are those of its words in turn. A word of Latin letters
    followed by punctuation is split once more, as the tokenizer itself would. Such plain units are folded to lower case here, so
    new ones are joined by spaces and go through the model alone, many at once; other words through the whole tokenizer.
    Units are cached by their 64-bit hash, in a table with open addressing.
    """

    LIMIT = 3 << 20
    #: Plain units in a string that the model gets.
    JOINED = 4096

    def __init__(self, path: str, end: int = 2):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.size = self.tokenizer.get_vocab_size()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.size, bool)  # the ids that end a word
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.forget()
        table = np.zeros(256, np.uint8)  # 0: white space, 1: letters, 2: punctuation, 3: anything else
        table[:] = 3
        for b in (*range(65, 91), *range(97, 123), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))):
            table[b] = 1
        for b in range(33, 127):
            if table[b] == 3 and not 48 <= b <= 57 and b != 39:
                table[b] = 2
        table[~W.SPACED.word] = 0
        self.kind = table
        self.folded = np.arange(256, dtype=np.uint8)  # of plain units: A to Z, and what follows 0xC3 in the letters from U+00C0 to U+00DE
        self.folded[[*range(65, 91), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 32

    def forget(self) -> None:
        """Empty the cache: hashes (0: a free slot), and where in the pool their ids are (place and number in one)."""
        self.keys, self.at, self.held = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), 0
        self.pool, self.filled = np.zeros(1 << 16, np.uint32 if self.size > 1 << 16 else np.uint16), 1
        self.pool[0] = self.end

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot that ends the search for it."""
        mask = len(self.keys) - 1
        slots = (keys & np.uint64(mask)).astype(np.int64)
        found = self.keys[slots]
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & mask
            found = self.keys[slots[left]]
            left = left[(found != keys[left]) & (found != 0)]
        return slots

    def _insert(self, keys: np.ndarray, at: np.ndarray) -> None:
        """Different keys that aren't in the table."""
        self.held += len(keys)
        if 2 * self.held > len(self.keys):
            on = self.keys != 0
            keys, at = np.concatenate([self.keys[on], keys]), np.concatenate([self.at[on], at])
            slots = 1 << (2 * self.held).bit_length()
            self.keys, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        while len(keys):
            slots, first = np.unique(self._slots(keys), return_index=True)  # one key a free slot, the others look on
            self.keys[slots], self.at[slots] = keys[first], at[first]
            keys, at = np.delete(keys, first), np.delete(at, first)

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, plain: np.ndarray) -> None:
        """Tokenize different units that aren't in the cache."""
        order = np.argsort(~plain, kind="stable")
        keys, begin, end, n_plain = keys[order], begin[order], end[order], int(plain.sum())
        found, counts = self._plain_ids(data, begin[:n_plain], end[:n_plain])
        other, other_counts = self._other_ids(data, begin[n_plain:], end[n_plain:])
        counts, ids = np.concatenate([counts, other_counts]), np.concatenate([found, other])
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(len(self.pool), len(ids)), self.pool.dtype)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self._insert(keys, (self.filled + np.cumsum(counts) - counts).astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
        self.filled += len(ids)

    def _plain_ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain units and their numbers."""
        if not self.closes.any():  # the model doesn't mark where a unit ends
            return self._other_ids(data, begin, end)
        found = [np.zeros(0, self.pool.dtype)]
        for a in range(0, len(begin), self.JOINED):
            b, n = begin[a : a + self.JOINED], (end - begin)[a : a + self.JOINED]
            joined = np.full(int(n.sum()) + len(n), 32, np.uint8)
            joined[W.ragged(np.cumsum(n + 1) - n - 1, n)] = data[W.ragged(b, n)]
            [encoding] = self.model.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)  # one at a time: they are large
            found.append(np.array(encoding.ids, self.pool.dtype))
            del encoding
        ids = np.concatenate(found)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _other_ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units of any kind and their numbers."""
        strings = [data[b:e].tobytes().decode() for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.array([i for x in found for i in x], self.pool.dtype), np.array([len(x) for x in found], np.int64)

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """The units of all texts: begins, ends, and whether they are plain. A word of letters and then punctuation is two."""
        kind = self.kind[data]
        edge = np.empty(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[offsets] = True  # the first and the last byte's among them
        runs = np.flatnonzero(edge)
        kinds = kind[runs[:-1]]
        starts = np.ones(len(kinds), bool)  # of words
        starts[1:] = kinds[:-1] == 0
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        starts[np.searchsorted(runs, inner)] = True
        on = np.flatnonzero(kinds)
        begin, end, kinds, starts = runs[on], runs[on + 1], kinds[on], starts[on]
        first = np.flatnonzero(starts)
        n = np.diff(first, append=len(on))
        last = first + n - 1
        plain = (n == 1) & (kinds[first] < 3) | (n == 2) & (kinds[first] == 1) & (kinds[last] == 2)
        end[first[~plain]] = end[last[~plain]]
        plain = np.repeat(plain, n)
        unit = plain | starts
        return begin[unit], end[unit], plain[unit]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each with the end token, and their numbers."""
        data, offsets = W.buffer_of(texts)
        low, high = int(offsets[0]), int(offsets[-1])
        data, offsets = data[low:high], offsets - low
        begin = np.zeros(0, np.int64)
        at = np.zeros(0, np.uint64)
        if len(data):
            begin, end, plain = self._units(data, offsets)
            folded = self.folded[data]
            as_is = W.ragged(begin[~plain], (end - begin)[~plain])
            folded[as_is] = data[as_is]
            keys = W.short_hash(folded, begin, end)
            keys[~plain] ^= np.uint64(1)
            keys[keys == 0] = 2
            if self.held > self.LIMIT:
                self.forget()
            slots = self._slots(keys)
            new = np.flatnonzero(self.keys[slots] == 0)
            if len(new):
                values, first = np.unique(keys[new], return_index=True)
                first = new[first]
                self._learn(values, folded, begin[first], end[first], plain[first])
                slots = self._slots(keys)
            at = self.at[slots]
        # an end token, the pool's first, goes in before the first unit of the next text
        closing = np.searchsorted(begin, offsets[1:])
        at = np.insert(at, closing, np.uint64(1))
        n = (at & np.uint64(0xFFFFFFFF)).astype(np.int64)
        upto = np.cumsum(n)
        return self.pool[W.ragged((at >> np.uint64(32)).astype(np.int64), n)], np.diff(upto[closing + np.arange(len(closing))], prepend=0)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One encoder for each Python worker."""
    if (path, end) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def _tokenize(path: str, end: int):
    def run(batches):
        enc = encoder(path, end)
        for batch in batches:
            ids, counts = enc.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), W.binaries(ids, counts)], ["doc_id", "n", "ids"])

    return run


def tokenize(docs: DataFrame, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ids (little-endian, two bytes each if the vocabulary allows it, else four)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_tokenize(path, end), "doc_id long, n long, ids binary")


def _ids(column, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = column.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    kind = np.dtype(np.uint32 if wide else np.uint16)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return values, np.diff(offsets) // kind.itemsize


def _terms(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with their numbers, by term."""
    text = np.repeat(np.arange(len(counts)), counts)
    keys, n = np.unique(values.astype(np.int64) * max(len(counts), 1) + text, return_counts=True)
    return keys % max(len(counts), 1), keys // max(len(counts), 1), n


def _document_frequencies(size: int, wide: bool):
    def run(batches):
        _encoders.clear()  # all texts are tokenized, and workers are used again
        df = np.zeros(size, np.int64)
        for batch in batches:
            values, counts = _ids(batch.column(0), wide)
            _, term, _ = _terms(values, counts, size)
            df += np.bincount(term, minlength=size)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(df[on])], ["term", "df"])

    return run


def _rarest(rank, shared: int, wide: bool):
    """The SEED_TERMS rarest terms of each text, of the `shared` first ones in rank."""

    def run(batches):
        places = rank.value
        term_of = np.argsort(places)
        for batch in batches:
            values, counts = _ids(batch.column(0), wide)
            keys = np.unique(np.repeat(np.arange(len(counts)), counts) * len(places) + places[values])
            keys = keys[keys % len(places) < shared]
            first = np.searchsorted(keys, np.arange(len(counts)) * len(places))
            keys = keys[np.arange(len(keys)) - first[keys // len(places)] < SEED_TERMS]
            offsets = np.searchsorted(keys, np.arange(len(counts) + 1) * len(places))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets.astype(np.int32), term_of[keys % len(places)].astype(np.int32))], ["terms"])

    return run


class Seeds:
    """The seeds' inverted index. terms: each seed's, rarest first; seeds are numbered in the order of those terms."""

    def __init__(self, terms: list[list[int]], rank: np.ndarray):
        ordered = sorted({tuple(int(rank[t]) for t in x) for x in terms if len(x)})
        lengths = np.array([len(x) for x in ordered], np.int64)
        ranks = np.array([r for x in ordered for r in x], np.int64)
        self.n, self.rank = len(ordered), rank
        self.heads = np.array([x[0] for x in ordered], np.int64)
        term = np.argsort(rank)[ranks]
        order = np.argsort(term, kind="stable")
        self.seed = np.repeat(np.arange(self.n), lengths)[order].astype(np.int32)
        self.first = np.searchsorted(term[order], np.arange(len(rank) + 1))

    def best(self, values: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
        """Each text's PREFIX best seeds of all, best first, the first of equal ones; in place of seeds it shares no term with, the one where its rarest term would lie."""
        text, term, tf = _terms(values, counts, len(idf))
        rarest = np.full(len(counts), len(idf))
        np.minimum.at(rarest, text, self.rank[term])
        best = np.repeat(np.minimum(np.searchsorted(self.heads, rarest), max(self.n - 1, 0))[:, None], PREFIX, axis=1)
        listed = self.first[term + 1] > self.first[term]  # the terms that some seed has
        text, term, tf = text[listed], term[listed], tf[listed]
        if not len(text):
            return best
        weight = (idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * counts / max(mean, 1.0)))[text])).astype(np.float32)
        order = np.argsort(text, kind="stable")
        text, term, weight = text[order], term[order], weight[order]
        step = max(1, CELLS // self.n)
        for at in range(0, len(counts), step):
            a, b = np.searchsorted(text, [at, at + step])
            n = self.first[term[a:b] + 1] - self.first[term[a:b]]
            cells = np.repeat((text[a:b] - at) * self.n, n) + self.seed[W.ragged(self.first[term[a:b]], n)]
            rows = min(step, len(counts) - at)
            found = np.bincount(cells, weights=np.repeat(weight[a:b], n), minlength=rows * self.n).reshape(rows, self.n)
            each = np.arange(rows)
            for k in range(min(PREFIX, self.n)):
                top = found.argmax(axis=1)
                on = found[each, top] > 0
                best[at : at + rows, k][on] = top[on]
                found[each, top] = 0
        return best


def _route(shared_seeds, idf, mean: float, wide: bool):
    def run(batches):
        seeds: Seeds = shared_seeds.value
        for batch in batches:
            best = seeds.best(*_ids(batch.column(3), wide), idf.value, mean).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(best[:, k])) for k in range(PREFIX))], ["doc_id", "start", "doc_tokens", "ids", *[f"seed{k}" for k in range(PREFIX)]])

    return run


class Shard:
    """The inverted index of some texts."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float):
        self.n = len(counts)
        text, term, tf = _terms(values, counts, len(idf))
        norm = K1 * (1 - B + B * counts / max(mean, 1.0))
        self.text = text
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[text])
        # postings of a term lie together; a text's terms are found by its own rows
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        order = np.argsort(text, kind="stable")
        self.terms = term[order]
        self.own = np.searchsorted(text[order], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        start = self.first[terms]
        rows = W.ragged(start, self.first[terms + 1] - start)
        return np.bincount(self.text[rows], weights=self.weight[rows], minlength=self.n)


def fill(values: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float, window: int, rest: list | None = None):
    """Sequences of one shard: lists of (text, start, length). The last, incomplete window is put into rest, if that is given, else cut."""
    shard = Shard(values, counts, idf, mean)
    unused = np.ones(shard.n, bool)
    sequence, room = [], window
    seed, ranked, at = -1, np.zeros(0, np.int64), 0
    while True:
        if seed < 0:
            left = np.flatnonzero(unused)
            if not len(left):
                break
            seed = int(left[0])
            unused[seed] = False
            taken = 0
        # the seed, then its neighbours until the window is full
        score = None
        current, start = seed, taken
        while True:
            length = min(room, int(counts[current]) - start)
            sequence.append((current, start, length))
            room -= length
            if room == 0:
                yield sequence
                sequence, room = [], window
                more = int(counts[current]) - start - length
                seed, taken = (current, start + length) if more else (-1, 0)
                break
            if score is None:
                score = shard.scores(seed)
                ranked = np.argsort(-score, kind="stable")
                ranked, at = ranked[unused[ranked]], 0
            if at == len(ranked):
                seed = -1
                break
            current, start, at = int(ranked[at]), 0, at + 1
            unused[current] = False
    # the last, incomplete window
    left = window - room
    if rest is not None:
        rest += sequence
        return
    while left:
        size = 1 << (left.bit_length() - 1)
        part, need = [], size
        while need:
            text, start, length = sequence[0]
            take = min(need, length)
            part.append((text, start, take))
            need -= take
            sequence[0] = (text, start + take, length - take)
            if take == length:
                sequence.pop(0)
        yield part
        left -= size


def _pack(idf, mean: float, window: int, wide: bool, with_ids: bool, last: bool):
    """Columns doc_id, start, doc_tokens, ids. Before the last pass, what doesn't fill a window has no sequence_id, and its ids."""

    def run(batches):
        from pyspark import TaskContext

        table = idf.value
        sequence_id = TaskContext.get().partitionId() << 40 | last << 39
        held: list[tuple[np.ndarray, ...]] = []
        held_ids: list[pa.Array] = []

        def shard():
            nonlocal sequence_id
            starts, totals, counts, values = (np.concatenate(x) for x in zip(*held, strict=True))
            docs = pa.concat_arrays(held_ids)  # some may be null
            held.clear()
            held_ids.clear()
            first = np.cumsum(counts) - counts
            rows: list[tuple] = []

            def add(sequence, number, ids_too):
                offset = 0
                for text, start, length in sequence:
                    ids = values[first[text] + start : first[text] + start + length].astype("<u4").tobytes()
                    rows.append((text, int(starts[text]) + start, length, zlib.crc32(ids), int(totals[text]), number, offset, ids if ids_too else None))
                    offset += length

            rest: list[tuple[int, int, int]] = []
            for sequence in fill(values, counts, table, mean, window, None if last else rest):
                add(sequence, sequence_id, with_ids)
                sequence_id += 1
            add(rest, None, True)
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([docs.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        waiting, tokens = 0, 0
        for batch in batches:
            values, counts = _ids(batch.column(3), wide)
            starts, totals = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):
                done = int(ends[at - 1]) if at else 0
                to = min(at + SHARD_DOCS - waiting, max(at + 1, int(np.searchsorted(ends, done + SHARD_TOKENS - tokens, "right"))))
                held_ids.append(batch.column(0).slice(at, to - at))
                held.append((starts[at:to], totals[at:to], counts[at:to], values[done : int(ends[to - 1])]))
                waiting, tokens, at = waiting + to - at, tokens + int(ends[to - 1]) - done, to
                if waiting >= SHARD_DOCS or tokens >= SHARD_TOKENS or at < len(counts):
                    yield shard()
                    waiting = tokens = 0
        if held:
            yield shard()

    return run


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves (little-endian, four bytes each)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    size = Tokenizer.from_file(path).get_vocab_size()
    wide = size > 1 << 16
    tokens = keep(tokenize(docs, path, end, doc_id, text), "tokens")
    df = np.zeros(max(size, end + 1), np.int64)
    rows = tokens.select("ids").mapInArrow(_document_frequencies(len(df), wide), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    idf = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
    order = np.lexsort((np.arange(len(df)), np.where(df > 1, df, np.iinfo(np.int64).max)))  # a term of one text finds none
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    ranks, shared = spark.sparkContext.broadcast(rank), int((df > 1).sum())
    mean = (total or 0) / max(n, 1)

    def routed(texts: DataFrame, wide: bool) -> DataFrame:
        """The texts with their seeds, in the shared folder."""
        share = min(1.0, ROUTES / max(texts.count(), 1))
        drawn = texts.where(F.pmod(F.xxhash64(F.lit(13), "doc_id", "start"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
        terms = drawn.select("ids").mapInArrow(_rarest(ranks, shared, wide), "terms array<int>").toArrow().column("terms").to_pylist()  # ROUTES * SEED_TERMS numbers, about
        seeds = spark.sparkContext.broadcast(Seeds(terms, rank))
        return keep(texts.mapInArrow(_route(seeds, idf, mean, wide), ROUTED), "routed")

    def packed(texts: DataFrame, wide: bool, last: bool) -> DataFrame:
        by = (*[f"seed{k}" for k in range(PREFIX)], "doc_id", "start")
        return texts.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(idf, mean, window, wide, with_ids, last), PIECES)

    texts = routed(tokens.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("doc_tokens"), "ids"), wide)
    forget(tokens)
    first = keep(packed(texts, wide, False), "packed")
    forget(texts)
    left = routed(first.where("sequence_id is null").select("doc_id", "start", "doc_tokens", "ids"), True)
    return first.where("sequence_id is not null").unionAll(packed(left, True, True))
