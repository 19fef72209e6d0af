"""Phrases whose words keep company: counts of all runs of up to four words, by suffix subtrees that are built independently.

Every word begins a suffix, which ends with its piece of text or after four words. The suffix tree of them all is partitioned vertically: a prefix, dealt
to a bucket by its hash, goes with everything below it to one group; buckets of one word that are beyond the memory budget are extended
to two words, those to three, and those to four. Buckets are put together to groups of about BUDGET rows. Each group's suffixes are sorted in a task of their own, which is
its subtree, cut at depth four: leaves are equal rows, and a node's count is the total of its leaves.

The texts are read twice. First words are counted, and how many different suffixes each block of text has in each bucket. Words with fewer than `least`
occurrences can be in no phrase, so suffixes end before them. The most frequent words (at most `dictionary`, chosen by a power of two that
their counts reach) become small numbers, which go to the executors; should there be more frequent words, those stand for themselves by hashes of 62 bits. Then each block states its
different suffixes once, with their counts, packed by group.

A candidate's parts are candidates or words themselves, so scores come from joins of the counted phrases with each other.

Defined results: null and empty texts have no words; a null language is `und`; texts of any length are worked through whole (a block is one text then). Rows count
each for itself, repeated ones and those without an id too. Ties are settled by count and phrase. Only the text and the language are read, so other
columns may have any names. An empty table gives no phrases. Words are compared by 64-bit hashes of language and word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.alignment import blocks
from claimloom.llm.base import keep, small_batches

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: [^\x20\x09]+ within pieces, which end at BREAKS; A-Z as a-z
WORD = W.WordClass(lambda b: b not in b" \t" + BREAKS, fold=True)
_BREAK = np.array([b in BREAKS for b in range(256)])
DEPTH = 4
BLOCK = 4 << 20
#: Rows that a group has at most by the count of different suffixes in blocks, but for half as many.
BUDGET = 1 << 20
DICTIONARY = 1 << 18
#: Words of more bytes aren't put in the dictionary, so its size is bound in bytes too.
LONGEST = 256
#: Codes of words beyond the dictionary begin here.
BEYOND = 1 << 62
CODES = [f"c{k}" for k in range(1, DEPTH + 1)]
NODES = ", ".join(f"{c} long" for c in CODES) + ", n long"


class Words:
    """A block's words in order: hashes that tell languages apart, which words begin a piece, and where they are."""

    def __init__(self, batch: pa.RecordBatch):
        languages = batch.column(0).dictionary_encode()
        self.data, offsets = W.buffer_of(batch.column(1))
        hashes, first, self.begin, self.end = W.scan(self.data, offsets, WORD, places=True)
        self.languages = languages.dictionary
        buffer, at = W.buffer_of(self.languages)
        salt = W.bytes_hash(buffer, at[:-1], at[1:])
        self.language = np.repeat(np.asarray(languages.indices), np.diff(first))
        self.hashes = W.mix(hashes * W._BASE + salt[self.language]) if len(hashes) else hashes
        breaks = offsets[0] + np.flatnonzero(_BREAK[self.data[int(offsets[0]) : int(offsets[-1])]])
        before = np.searchsorted(breaks, self.begin)
        self.starts = np.r_[True, before[1:] != before[:-1]][: len(hashes)]
        self.starts[first[:-1][np.diff(first) > 0]] = True


def suffixes(local: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each word the numbers of it and the words after it, 0 from where the piece ends or a word has the number 0."""
    out = [local]
    for k in range(1, DEPTH):
        column = np.zeros(len(local), local.dtype)
        if len(local) > k:
            column[:-k] = np.where((out[-1][:-k] > 0) & ~starts[k:], local[k:], 0)
        out.append(column)
    return out


def unique_rows(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows in ascending order and the sums of their weights (each 1 where none are given)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    keys, used = [], 64
    for column, width in zip(columns, bits):  # as many columns in a key as it has room for
        if used + width > 63:
            keys.append(column.astype(np.int64))
            used = width
        else:
            keys[-1] = keys[-1] << width | column
            used += width
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    if weights is None:
        n = np.diff(np.r_[starts, len(order)])
    else:
        n = np.add.reduceat(weights[order], starts)
    return [c[order[starts]] for c in columns], n


class Partition:
    """Which group a suffix belongs to, by how many rows the buckets of its prefixes of one, two and three words have."""

    def __init__(self, rows: np.ndarray, budget: int):
        self.size = rows.shape[1]
        self.tables, self.depth, at = [], [], 0
        for depth in range(1, DEPTH):
            n = rows[depth - 1]
            heavy = n > budget // 2
            filled = np.where(heavy, 0, n)
            group = at + (np.cumsum(filled) - filled) // budget
            self.depth += [depth] * int(group.max() + 1 - at)
            at = len(self.depth)
            self.tables.append(np.where(heavy, -1, group).astype(np.int32))
            if not heavy.any():
                break
        else:
            self.spread = int(-(-2 * n[heavy].sum() // budget))
            self.depth += [DEPTH] * self.spread

    def groups(self, prefixes: list[np.ndarray]) -> np.ndarray:
        """The groups of suffixes, given the hashes of their first word, first two words, and so on."""
        out = self.tables[0][bucket(prefixes[0], self.size)]
        for depth, table in enumerate(self.tables[1:], 2):
            below = np.flatnonzero(out < 0)
            out[below] = table[bucket(prefixes[depth - 1][below], self.size)]
        below = np.flatnonzero(out < 0)
        if len(below):
            out[below] = len(self.depth) - self.spread + bucket(prefixes[-1][below], self.spread)
        return out


def bucket(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def prefix_hashes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """From columns of word hashes (0 where there is none), the hashes of the first word, the first two, and so on."""
    out = [W.mix(columns[0])]
    for column in columns[1:]:
        out.append(W.mix(out[-1] * W._BASE + column))
    return out


def _count(buckets: int):
    """The first reading: a block's words with their counts, and the number of its different suffixes in each bucket of each depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK):
            words = Words(batch)
            values, first, back, n = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
            width = (words.end - words.begin)[first]
            raw = WORD.folded[words.data[W.ragged(words.begin[first], width)]]
            offsets = np.zeros(len(first) + 1, np.int64)
            np.cumsum(width, out=offsets[1:])
            strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())
            language = words.languages.take(pa.array(words.language[first])) if len(first) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int8)), language.cast(pa.string()), strings, pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], COUNTED)
            different, _ = unique_rows(suffixes((back + 1).astype(np.int64), words.starts))
            hashes = np.r_[np.uint64(0), values]
            for depth, hashed in enumerate(prefix_hashes([hashes[c] for c in different[: DEPTH - 1]]), 1):
                rows = np.bincount(bucket(hashed, buckets), minlength=buckets)
                at = np.flatnonzero(rows)
                none = pa.nulls(len(at), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), depth, np.int8)), none, none, pa.array(at), pa.array(rows[at])], COUNTED)

    return run


COUNTED = ["kind", "lang", "word", "key", "n"]


def packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows as bytes, column by column and rank by rank, compressed; the first byte is the width of a number."""
    width = 4 if max(int(c.max()) for c in (*columns, n)) < 1 << 32 else 8
    numbers = np.stack([*columns, n]).astype(f"<u{width}")
    return bytes([width]) + pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1, width).swapaxes(1, 2)), "zstd", asbytes=True)


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    width, k = raw[0], DEPTH + 1
    planes = np.frombuffer(pa.decompress(raw[1:], k * rows * width, "zstd", asbytes=True), np.uint8).reshape(k, width, rows)
    return np.ascontiguousarray(planes.swapaxes(1, 2)).view(f"<u{width}").reshape(k, rows).astype(np.int64)


def beyond(hashes: np.ndarray) -> np.ndarray:
    """Codes of words that aren't in the dictionary."""
    return (hashes & np.uint64(BEYOND - 1)).astype(np.int64) | BEYOND


def _state(known, partition: Partition, complete: bool):
    """The second reading: a block's different suffixes of two words or more, packed by group. known: broadcast, sorted hashes of the dictionary and their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = known.value
        for batch in blocks(batches, BLOCK):
            words = Words(batch)
            values, back = np.unique(words.hashes, return_inverse=True)
            code = np.zeros(len(values), np.int64) if complete else beyond(values)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                code = np.where(keys[at] == values, codes[at], code)
            # numbers of the block's own, in the order of hashes, for words that count at all
            own = np.cumsum(code > 0) * (code > 0)
            columns = suffixes(own[back], words.starts)
            two = columns[1] > 0
            columns, n = unique_rows([c[two] for c in columns])
            if not len(n):
                continue
            code, hashes = np.r_[0, code[code > 0]], np.r_[np.uint64(0), values[code > 0]]
            group = partition.groups(prefix_hashes([hashes[c] for c in columns]))
            order = np.argsort(group, kind="stable")
            group = group[order]
            columns = [code[c[order]] for c in columns]
            n = n[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(group)]
            payload = [packed([c[s:e] for c in columns], n[s:e]) for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(group[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(payload, pa.binary())], ["group", "n_rows", "rows"])

    return run


def subtree(rows: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of two words or more of a group's subtree, and their counts: leaves are equal suffixes, a node's count is the total of its leaves.

    Nodes above the group's depth are in other groups too, so all of them are given; of the others those that reach `least`.
    """
    columns, n = unique_rows(list(rows[:DEPTH]), rows[DEPTH])
    found, counts = [], []
    for level in range(DEPTH, 1, -1):
        if level < DEPTH:  # parents, from their children
            new = np.zeros(len(n), bool)
            new[:1] = True
            for c in columns[:level]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            columns = [*(c[starts] for c in columns[:level]), *[np.zeros(len(starts), np.int64)] * (DEPTH - level)]
            n = np.add.reduceat(n, starts) if len(starts) else n
        at = (columns[level - 1] > 0) & ((n >= least) | (level < depth))
        found.append(np.stack([c[at] for c in columns]))
        counts.append(n[at])
    return np.concatenate(found, axis=1), np.concatenate(counts)


def _build(depths: list[int], least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = [unpacked(raw, n) for raw, n in zip(table.column("rows").to_pylist(), table.column("n_rows").to_pylist(), strict=True)]
        nodes, n = subtree(np.concatenate(rows, axis=1), depths[key[0].as_py()], least)
        return pa.Table.from_arrays([pa.array(c) for c in (*nodes, n)], [*CODES, "n"])

    return run


class Counted:
    """Words and phrases that occur often enough.

    nodes: c1 to c4 (codes of words, 0 where there is none), n. spelling: frames of code, lang, word, n; totals: lang, n of all words.
    """

    def __init__(self, nodes: DataFrame, dictionary: DataFrame, rest: DataFrame | None, totals: DataFrame):
        self.nodes, self.dictionary, self.rest, self.totals = nodes, dictionary, rest, totals

    def spelled(self) -> DataFrame:
        """The nodes with lang, phrase, how many words it has, and the counts of its first and last word."""
        out = self.nodes
        for k, code in enumerate(CODES, 1):
            names = [F.col("word").alias(f"w{k}"), F.col("n").alias(f"u{k}"), *([F.col("lang")] if k == 1 else [])]
            out = out.join(F.broadcast(self.dictionary.select(F.col("code").alias(code), *names)), code, "left")  # at most `dictionary` words
            if self.rest is not None:
                others = self.rest.select(F.col("code").alias(code), *(F.col(c).alias(f"r_{c}") for c in ("word", "n", "lang")))
                out = out.join(others, code, "left").withColumn(f"w{k}", F.coalesce(f"w{k}", "r_word")).withColumn(f"u{k}", F.coalesce(f"u{k}", "r_n"))
                out = (out.withColumn("lang", F.coalesce("lang", "r_lang")) if k == 1 else out).drop("r_word", "r_n", "r_lang")
        words = F.lit(2) + (F.col("c3") > 0).cast("int") + (F.col("c4") > 0).cast("int")
        phrase = F.concat_ws(" ", *(f"w{k}" for k in range(1, DEPTH + 1)))
        return out.select(*CODES, F.col("n").alias("a"), "lang", words.alias("words"), phrase.alias("phrase"), F.col("u1").alias("first"), F.coalesce("u4", "u3", "u2").alias("last"))


def count(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", budget: int = BUDGET, dictionary: int = DICTIONARY) -> Counted:
    """Count all runs of one to four words, within pieces of text and by language."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(6, int(8 * n_bytes / 6 / budget).bit_length())  # some eight a group, if a word has six bytes
    counted = keep(texts.mapInArrow(_count(buckets), "kind byte, lang string, word string, key long, n long"), "counted")
    vocabulary = keep(counted.where("kind = 0").groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n")).where(F.col("n") >= least), "vocabulary")
    totals = counted.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    rows = np.zeros((DEPTH - 1, buckets), np.int64)
    sums = counted.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()  # three a bucket
    rows[np.asarray(sums.column("kind")) - 1, np.asarray(sums.column("key"))] = np.asarray(sums.column("n"))
    partition = Partition(rows, budget)

    short = F.octet_length("word") <= LONGEST
    sizes = {r["k"]: (r["short"], r["long"]) for r in vocabulary.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count_if(short).alias("short"), F.count_if(~short).alias("long")).collect()}
    held, lowest = 0, 64  # the lowest length of a count, in binary digits, from which on all words fit in
    for k in sorted(sizes, reverse=True):
        if held + sizes[k][0] > dictionary:
            break
        held, lowest = held + sizes[k][0], k
    inside = short & (F.length(F.bin("n")) >= lowest)
    complete = held == sum(a + b for a, b in sizes.values())
    table = vocabulary.where(inside).select("key", "n").toArrow().sort_by([("n", "descending"), ("key", "ascending")])
    codes = np.arange(1, len(table) + 1)
    keys = np.asarray(table.column("key")).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], codes[order]))
    coded = spark.createDataFrame(pa.table({"key": table.column("key"), "code": pa.array(codes, pa.int64())}), "key long, code long")
    # the words themselves don't come back from the driver, only their codes
    spelling = keep(vocabulary.where(inside).join(F.broadcast(coded), "key").select("lang", "word", "n", "code"), "spelling")
    del table
    rest = None if complete else vocabulary.where(~inside).select("lang", "word", "n", F.col("key").bitwiseAND(BEYOND - 1).bitwiseOR(BEYOND).alias("code"))

    stated = texts.mapInArrow(_state(known, partition, complete), "group int, n_rows int, rows binary")
    nodes = stated.groupBy("group").applyInArrow(_build(partition.depth, least), NODES)
    if max(partition.depth) > 2:  # nodes above a group's depth are in several groups
        nodes = nodes.groupBy(*CODES).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return Counted(keep(nodes, "nodes"), spelling, rest, totals)


#: Runs of a candidate's words that are candidates too: its length, the first word's and the last word's number, and which part of which cut it is (b: neither).
PARTS = [(3, 1, 2, "l2"), (3, 2, 3, "r1"), (4, 1, 2, "l2"), (4, 1, 3, "l3"), (4, 2, 4, "r1"), (4, 3, 4, "r2"), (4, 2, 3, "b")]


def candidates(counted: Counted, covered: int = 80) -> DataFrame:
    """lang, phrase, words, a, l, r, score, dropped: all phrases counted, the lowest-scoring cut's figures, and whether a longer one has `covered` per cent of the count."""
    phrases = keep(counted.spelled(), "phrases")
    keys = ["k1", "k2", "k3"]
    parts = F.array(*(F.when(F.col("words") == m, F.struct(*((F.col(f"c{i + k}") if i + k <= j else F.lit(0).cast("long")).alias(f"k{k + 1}") for k in range(3)), F.lit(name).alias("part"))) for m, i, j, name in PARTS))
    runs = phrases.where("words > 2").select(*CODES, "a", F.explode(F.array_compact(parts)).alias("p")).select(*CODES, "a", "p.*")
    counts = phrases.where("c4 = 0").select(*(F.col(c).alias(k) for c, k in zip(CODES, keys)), F.col("a").alias("f"))
    of_parts = runs.where("part <> 'b'").join(counts, keys).groupBy(*CODES).agg(*(F.max(F.when(F.col("part") == p, F.col("f"))).alias(p) for p in ("l2", "l3", "r1", "r2")))
    longer = runs.groupBy(*keys).agg(F.max("a").alias("longer")).select(*(F.col(k).alias(c) for c, k in zip(CODES, keys)), F.lit(0).cast("long").alias("c4"), "longer")
    scored = phrases.join(of_parts, CODES, "left").join(longer, CODES, "left")

    def cut(k: int, m: int):
        left = F.col("first") if k == 1 else F.col(f"l{k}")
        right = F.col("last") if k == m - 1 else F.col(f"r{k}")
        score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))")
        # decimals, as products may pass 64 bits; div gives the floor, since nothing is negative
        return F.struct(F.call_function("div", score, left.cast("decimal(20, 0)") + right.cast("decimal(20, 0)")).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    best = F.coalesce(*(F.when(F.col("words") == m, F.array_min(F.array(*(cut(k, m) for k in range(1, m))))) for m in (2, 3, 4)))
    dropped = F.coalesce(F.col("longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * covered, F.lit(False))
    return scored.select(*CODES, "lang", "phrase", "words", "a", best.alias("best"), dropped.alias("dropped")).select(*CODES, "lang", "phrase", "words", "a", "best.l", "best.r", "best.score", "dropped")


def mine(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """Each language's first phrases by score, count and phrase: lang, rank, phrase, a, l, r, n, score. The options are count()'s."""
    counted = count(docs, **options)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each of 64 parts of a language, then of these: the last task of a language has a bounded number of rows
    part = F.pmod(F.xxhash64(*CODES), F.lit(64)).alias("part")
    some = candidates(counted).where(~F.col("dropped")).select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(counted.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
