"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item, or the whole of a shorter item. Its shingles are ordered by
rarity over all documents; for exact containment the prefix that has to match is one shingle, the rarest. Documents and
windows are joined on that shingle; then come the bounds on position (the window must lie within the document) and
length, and the comparison of all the window's words (as 64-bit hashes) with the document's.

Documents are read once, by a scan over Arrow buffers that keeps only places whose shingle may occur in the benchmark: a
filter (two probes; 2**22 to 2**28 places, 32 MB at most, packed in the tasks as well) tells. It has eight places or more a shingle up to 2**25 shingles of the benchmark;
beyond, more places of documents pass it, and the joins do the rest.
A benchmark with more windows than `broadcast_rows` is joined by a shuffle.

Defined results: a null or empty text has no words, no hits and is not contaminated; texts of any length are read whole; an
empty benchmark hits nothing, and items without an id or words are left out; equal windows of several items count for each of them;
rows are judged each for itself, repeated ones and those without an id too; further columns of the inputs are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import keep, small_batches

SHINGLE = 5
#: The filter has 2**bits places: as many as keep it from filling up, within these bounds.
FILTER_BITS = 22, 28


def _windows(window: int):
    def run(batches):
        for batch in batches:
            data, offsets = W.buffer_of(batch.column(1))
            hashes, first = W.scan(data, offsets, W.ALNUM_LOWER)
            rows = {"item_id": [], "words": [], "shingle": [], "place": [], "window": []}
            for k, item in enumerate(batch.column(0).to_pylist()):
                own = hashes[first[k] : first[k + 1]]
                if item is None or not len(own):
                    continue
                length = min(window, len(own))
                size = min(SHINGLE, length)
                grams = W.ngrams(own, size).view(np.int64)
                for at in range(len(own) - length + 1):
                    for place in range(length - size + 1):
                        rows["item_id"].append(item)
                        rows["window"].append(at)
                        rows["words"].append(own[at : at + length].view(np.int64))
                        rows["shingle"].append(int(grams[at + place]))
                        rows["place"].append(place)
            yield pa.RecordBatch.from_pydict(
                {"item_id": pa.array(rows["item_id"], pa.int64()), "window": pa.array(rows["window"], pa.int32()), "words": pa.array(rows["words"], pa.list_(pa.int64())), "shingle": pa.array(rows["shingle"], pa.int64()), "place": pa.array(rows["place"], pa.int32())}
            )

    return run


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13) -> DataFrame:
    """A row for each item, window and shingle of the window: item_id, window, words, shingle, place (of the shingle in the window)."""
    return items.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(_windows(window), "item_id long, window int, words array<long>, shingle long, place int")


def _shifts(bits: int) -> tuple[int, int]:
    return 0, 64 - bits


def _probe(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return tuple(((h >> np.uint64(shift)) & mask).astype(np.int64) for shift in _shifts(bits))


def _bit(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 where the place is set in a filter of 64 places a word."""
    return (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


def _places(table, bits: int, sizes: list[int], window: int):
    """For each document its words' number, and the places whose shingle passes the filter, with the words around them."""

    def run(batches):
        held = np.frombuffer(table.value, np.uint64)
        for batch in batches:
            data, offsets = W.buffer_of(batch.column(1))
            hashes, first = W.scan(data, offsets, W.ALNUM_LOWER)
            at, gram = [], []
            for size in sizes:
                grams = W.ngrams(hashes, size)
                a, b = _probe(grams, bits)
                hit = np.flatnonzero(_bit(held, a) & _bit(held, b))
                doc = np.searchsorted(first, hit, "right") - 1
                hit = hit[hit + size <= first[doc + 1]]
                at.append(hit)
                gram.append(grams[hit])
            at, gram = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(gram or [np.zeros(0, np.uint64)])
            order = np.argsort(at, kind="stable")
            at, gram = at[order], gram[order]
            doc = np.searchsorted(first, at, "right") - 1
            low, high = np.maximum(at - window + 1, first[doc]), np.minimum(at + window, first[doc + 1])
            around = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32), hashes[W.ragged(low, high - low)].view(np.int64))
            each = pa.StructArray.from_arrays([pa.array((at - first[doc]).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array((low - first[doc]).astype(np.int32)), around], ["at", "shingle", "low", "around"])
            found = pa.ListArray.from_arrays(np.searchsorted(at, first).astype(np.int32), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first)), found], ["doc_id", "text_hash", "n_words", "found"])

    return run


def covered(spans: Column) -> Column:
    """How many words the spans (array<struct<start, stop>>) cover together."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), zero, lambda acc, s: F.struct(F.greatest(acc["upto"], s["stop"]).alias("upto"), (acc["n"] + F.greatest(s["stop"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("n")))["n"]


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, broadcast_rows: int = 50_000) -> DataFrame:
    """A row for each document: doc_id, text_hash (xxhash64), n_words, hits array<struct<item_id, start, stop>> (words; null if none)."""
    spark = docs.sparkSession
    small_batches(spark)
    windows = keep(benchmark_windows(items, window=window), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect())
    n = windows.count()
    bits = min(max(FILTER_BITS[0], int(8 * n).bit_length()), FILTER_BITS[1])
    held = np.zeros(1 << (bits - 6), np.uint64)
    mask = (1 << bits) - 1
    probes = F.explode(F.array(*[F.shiftrightunsigned("shingle", s).bitwiseAND(F.lit(mask)) for s in _shifts(bits)])).alias("p")
    # a word of 64 places a row, however many windows there are; the filter stays packed here and in the tasks
    words = windows.select(probes).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        held[row["w"]] = row["b"] & (1 << 64) - 1
    table = spark.sparkContext.broadcast(held.tobytes())
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_words long, found array<struct<at:int,shingle:long,low:int,around:array<long>>>"
    # once written, rows have numbers of their own that stay: ids may be null or repeated
    places = keep(read.mapInArrow(_places(table, bits, sizes, window), schema).withColumn("row", F.monotonically_increasing_id()), "places")
    found = places.where("size(found) > 0").select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")

    seen = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by(F.struct("shingle", "place"), F.struct("n", "shingle", "place"))
    prefix = windows.join(seen, "shingle").groupBy("item_id", "window").agg(rarest.alias("p"), F.first("words").alias("words"))
    # a window one of whose shingles is in no document is in none either; its rarest would be that one
    whole = windows.join(seen, "shingle", "left_anti").select("item_id", "window").distinct()
    prefix = keep(prefix.join(whole, ["item_id", "window"], "left_anti").select("item_id", "p.shingle", "p.place", "words"), "prefixes")
    if prefix.count() <= broadcast_rows:
        prefix = F.broadcast(prefix)
    else:
        found = keep(found, "found")
    start = F.col("at") - F.col("place")
    length = F.size("words")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("around", start - F.col("low") + 1, length) == F.col("words")
    hits = found.join(prefix, "shingle").where(fits).where(same).select("row", F.struct("item_id", start.alias("start"), (start + length).alias("stop")).alias("hit"))
    by_doc = hits.groupBy("row").agg(F.collect_set("hit").alias("hits"))
    return places.select("row", "doc_id", "text_hash", "n_words").join(by_doc, "row", "left").drop("row")


def report(docs: DataFrame, items: DataFrame, window: int = 13, least_share: int = 20, **names) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and least_share * n_hit >= n_words)."""
    hits = F.coalesce("hits", F.array().cast("array<struct<item_id:long,start:int,stop:int>>"))
    ids = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item_id"].cast("string"))))
    n_hit = covered(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop"))))
    out = occurrences(docs, items, window=window, **names).select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, window: int = 13, least_share: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    found = report(docs, items, window, least_share, doc_id=doc_id, text=text)
    gone = keep(found.where("contaminated").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct(), "gone")
    # ids may be null or repeated: a row goes if its text does
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__hash")), "left_anti")
