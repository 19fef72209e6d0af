"""Removal of repeated passages, with a log-structured fingerprint index.

Repeated are all stretches of `window` words whose word sequence starts in two places or more. The index keeps
fingerprints of windows: hashes of those of their sub-windows of SPAN words that are the smallest (minimisers).
Equal windows have equal minimisers in equal places, so a window can only repeat if its minimiser does; and as
neighbouring windows share minimisers, the index is about a tenth of the words' number.

The index is a folder of immutable runs, bucketed and sorted by fingerprint: (fingerprint, n). Each batch of texts is merge-joined with
each of the runs so far, bucket by bucket; what it finds there, or twice within itself, is a candidate. The batch then becomes a run, and compact()
merges runs once there are several.

An index that is given has a second kind of runs, sorted too: the hashes of all windows of the texts it took in. A candidate window
that is in one of them is repeated, though its other place is in a text of an earlier call. (An index that ends with its call
needs none: all its texts are here.)

Candidates are verified by 64-bit hashes of all their words (two windows share one with a probability of about 2**-58 a
pair). Neighbouring windows with one minimiser are a unit. A unit that occurs twice as a whole is all repeated; only where
a fingerprint has several different units are single windows counted, once for each different unit. So a group of copies
costs as much as one text, and nothing is paired up.

Defined results: a null or empty text has no words, nothing is removed from it, its kept text is empty; fewer than
`window` words are kept whole; texts of any length are read whole; repeated rows are copies of each other, whether they share an id, have
none, or ids of their own; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import forget, fresh_path, keep, small_batches

SPAN = 18
RUN = "fingerprint long, n long"
WINDOW_RUN = "w long"


def _minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each `width` grams in a row, the place of the smallest, the first of several."""
    best = grams.copy()
    place = np.arange(len(grams))
    done = 1
    while done < width:  # best[i] is the least of grams[i : i + done]
        step = min(done, width - done)
        left, right = best[:-step], best[step:]
        take = right < left
        place = np.where(take, place[step:], place[:-step])
        best = np.where(take, right, left)
        done += step
    return place


def _units(texts, window: int) -> dict[str, np.ndarray]:
    """The units of a batch of texts, in order: text, start (first window's first word, counted in the batch), n (windows), fingerprint, unit."""
    data, offsets = W.buffer_of(texts)
    hashes, first = W.scan(data, offsets, W.SPACED)
    count = W.inside(first, window)
    starts = W.ragged(first[:-1], count)
    out = {"hashes": hashes, "first": first}
    if not len(starts):
        none = np.zeros(0, np.int64)
        return out | {"text": none, "start": none, "n": none, "fingerprint": none.view(np.uint64), "unit": none.view(np.uint64)}
    grams = W.ngrams(hashes, SPAN)
    place = _minimisers(grams, window - SPAN + 1)[starts]
    text = np.repeat(np.arange(len(count)), count)
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.append(begin, len(starts)))
    start = starts[begin]
    return out | {"text": text[begin], "start": start, "n": n, "fingerprint": grams[place[begin]], "unit": W.stretches(hashes, start, start + n - 1 + window)}


def _first_pass(window: int):
    """doc_id, n_words, sha256 of the words joined by a space, and the distinct fingerprints."""

    def run(batches):
        for batch in batches:
            u = _units(batch.column(2), window)
            whole = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in batch.column(2).to_pylist()]
            order = np.lexsort((u["fingerprint"], u["text"]))
            text, value = u["text"][order], u["fingerprint"][order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
            text, value = text[new], value[new]
            # twice in one text is a repetition as well: such a fingerprint is listed twice
            twice = np.flatnonzero(~new)
            text, value = np.concatenate([text, u["text"][order][twice]]), np.concatenate([value, u["fingerprint"][order][twice]])
            order = np.argsort(text, kind="stable")
            lists = pa.ListArray.from_arrays(np.searchsorted(text[order], np.arange(batch.num_rows + 1)).astype(np.int32), value[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(u["first"])), pa.array(whole, pa.string()), lists], ["doc", "doc_id", "n_words", "whole", "fingerprints"])

    return run


def _candidates(window: int):
    """Columns doc_id, text, repeated (fingerprints): a row for each unit whose fingerprint is repeated; start counts the text's words."""

    def run(batches):
        for batch in batches:
            u = _units(batch.column(1), window)
            repeated = np.unique(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            on = np.flatnonzero(np.isin(u["fingerprint"].view(np.int64), repeated))
            if not len(on):
                continue
            text, start, n = u["text"][on], u["start"][on], u["n"][on]
            windows = W.ngrams(u["hashes"], window)[W.ragged(start, n)].view(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), windows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(start - u["first"][text]), pa.array(u["fingerprint"][on].view(np.int64)), pa.array(u["unit"][on].view(np.int64)), lists], ["doc", "start", "fingerprint", "unit", "windows"])

    return run


def _windows(window: int):
    """The distinct windows of each batch of texts."""

    def run(batches):
        for batch in batches:
            u = _units(batch.column(0), window)
            if len(u["start"]):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(W.ngrams(u["hashes"], window)[W.ragged(u["start"], u["n"])].view(np.int64)))], ["w"])

    return run


def _trim(window: int):
    """Columns doc_id, text, spans array<struct<start, n>> (runs of repeated windows): what is kept."""

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                parts = text.encode().split()
                depth = np.zeros(len(parts) + 1, np.int64)
                start, n = np.array([s["start"] for s in spans], np.int64), np.array([s["n"] for s in spans], np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + n - 1 + window, -1)
                gone = np.cumsum(depth)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([parts[k] for k in np.flatnonzero(~gone).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_removed", "kept"])

    return run


class FingerprintIndex:
    """Immutable runs of fingerprints, and of windows, in a folder that Spark reads; runs, windows: paths of runs from before, with the `buckets` they were written with.

    A run is a table bucketed and sorted by fingerprint (or window), so a batch is merge-joined with it without a shuffle of the run.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, runs: tuple[str, ...] = (), windows: tuple[str, ...] = (), buckets: int | None = None):
        self.spark = spark
        self.folder = folder or fresh_path(spark, "fingerprints")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs = list(runs)
        self.windows = list(windows)
        self.merged: list[tuple[str, str, str]] = []  # runs that compact() has replaced; frames from before may still read them

    @staticmethod
    def _name(path: str) -> str:
        return "claimloom_run_" + path.rstrip("/").rpartition("/")[2]

    def _write(self, rows: DataFrame, by: str = "fingerprint") -> str:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).option("path", path).saveAsTable(self._name(path))
        return path

    def _read(self, path: str, schema: str = RUN, by: str = "fingerprint") -> DataFrame:
        name = self._name(path)
        if not self.spark.catalog.tableExists(name):  # a run of another session
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _known(self, rows: DataFrame, runs: list[str], schema: str, by: str) -> DataFrame:
        """Those of the rows that are in a run, once for each."""
        found = self.spark.createDataFrame([], rows.schema)
        for path in runs:
            found = found.unionAll(rows.join(self._read(path, schema, by), by, "left_semi"))
        return found

    def _merged(self, runs: list[str], schema: str) -> DataFrame:
        """All rows of the runs, read as plain files: a union of bucketed scans keeps their partitioning in the plan, but not when it runs (Spark 4.1)."""
        return self.spark.read.schema(schema).parquet(*runs)

    def read(self) -> DataFrame:
        return self._merged(self.runs, RUN)

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Take in a batch's fingerprints (a column of that name, a row for each occurrence). Returns those of them that were in the runs before, or are in the batch twice."""
        new = self._write(fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")))
        batch = self._read(new)
        found = self._merged([new], RUN).where("n > 1").select("fingerprint").unionAll(self._known(batch.where("n = 1").select("fingerprint"), self.runs, RUN, "fingerprint"))
        self.runs.append(new)
        return found

    def known_windows(self, windows: DataFrame) -> DataFrame:
        """Those of the windows (w, each once) that an earlier call took in."""
        return self._known(windows.repartition(self.buckets, "w"), self.windows, WINDOW_RUN, "w").distinct()

    def add_windows(self, windows: DataFrame) -> None:
        """Take in the windows (w) of a call's texts."""
        self.windows.append(self._write(windows.distinct(), "w"))

    def drop(self) -> None:
        """Delete all runs, those replaced too."""
        for path, schema, by in [*self.merged, *((p, RUN, "fingerprint") for p in self.runs), *((p, WINDOW_RUN, "w") for p in self.windows)]:
            forget(self._read(path, schema, by))
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(path)}")
        self.runs, self.windows, self.merged = [], [], []

    def compact(self, at_least: int = 4) -> None:
        """Merge the runs of a kind into one once there are so many."""
        if len(self.windows) >= at_least:
            old, self.windows = self.windows, [self._write(self._merged(self.windows, WINDOW_RUN).distinct(), "w")]
            self.merged += [(path, WINDOW_RUN, "w") for path in old]
        if len(self.runs) >= at_least:
            old, self.runs = self.runs, [self._write(self.read().groupBy("fingerprint").agg(F.sum("n").alias("n")))]
            self.merged += [(path, RUN, "fingerprint") for path in old]


def trim(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space; null: all of them), kept_sha256.

    batches: in how many steps the index takes the texts in. An index with earlier runs may be given; it grows, and windows
    that are in a text of an earlier call are removed as well. Earlier results stay as they are. All calls need the same `window`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lasting = index is not None
    index = index if lasting else FingerprintIndex(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # ids may be null or repeated: a text is known by a hash of its id and what it says
    texts = docs.select(F.xxhash64(F.col(doc_id).cast("long"), body).alias("doc"), F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    doc = "doc long"
    per_doc = keep(texts.mapInArrow(_first_pass(window), f"{doc}, doc_id long, n_words long, whole string, fingerprints array<long>"), "per_doc")
    found = []
    for k in range(batches):
        part = per_doc if batches == 1 else per_doc.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k)
        found.append(index.add(part.select(F.explode("fingerprints").alias("fingerprint"))))
        if lasting:
            index.compact()
        elif k + 1 < batches:  # a merged run is for batches that come after it
            index.compact(at_least=max(2, batches - 1))
    repeated = keep(functools.reduce(DataFrame.unionAll, found).distinct(), "repeated")
    owners = keep(per_doc.select("doc", F.explode(F.array_distinct("fingerprints")).alias("fingerprint")).join(repeated, "fingerprint"), "owners")
    repeated_of = owners.groupBy("doc").agg(F.collect_set("fingerprint").alias("repeated"))
    known = keep(per_doc.drop("fingerprints"), "known")
    forget(per_doc, repeated)
    if not lasting:
        index.drop()
    suspects = keep(texts.drop("doc_id").join(repeated_of, "doc"), "suspects")
    forget(owners)

    units = keep(suspects.mapInArrow(_candidates(window), f"{doc}, start long, fingerprint long, unit long, windows array<long>"), "units")
    kinds = keep(units.groupBy("fingerprint", "unit").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"), F.min("doc").alias("doc"), F.min("start").alias("start")), "kinds")
    mixed = keep(kinds.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "mixed")
    twice = kinds.where("n > 1").select(F.col("unit").alias("u"))
    whole = units.select("doc", "start", F.size("windows").alias("n"), "unit").join(twice, F.col("unit") == F.col("u"), "left_semi").select("doc", "start", "n")
    # where units differ, windows count once for each different unit
    shared = kinds.join(mixed, "fingerprint", "left_semi").select(F.explode("windows").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
    shared = keep(shared, "shared")
    # a unit that occurs twice is repeated as a whole; of one that occurs once, kinds knows the place
    single = kinds.where("n = 1").join(mixed, "fingerprint", "left_semi").select("doc", "start", F.posexplode("windows").alias("at", "w"))
    single = single.join(shared, "w", "left_semi").select("doc", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n"))
    if index.windows:
        past = keep(index.known_windows(kinds.select(F.explode("windows").alias("w")).distinct()), "past")
        earlier = units.select("doc", "start", F.posexplode("windows").alias("at", "w")).join(past, "w", "left_semi")
        single = single.unionAll(earlier.select("doc", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("n")))
    if lasting:
        index.add_windows(texts.select("text").mapInArrow(_windows(window), WINDOW_RUN))
        index.compact()
    spans = whole.unionAll(single).groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    done = suspects.select("doc", "text").dropDuplicates(["doc"]).join(spans, "doc").mapInArrow(_trim(window), f"{doc}, n_removed long, kept string")
    done = done.select("doc", "n_removed", "kept", F.sha2("kept", 256).alias("trimmed"))
    return known.join(done, "doc", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept", F.coalesce("trimmed", "whole").alias("kept_sha256"))
