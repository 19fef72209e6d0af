"""Near-duplicates by MinHash: a signature-coordinate inverted join.

A text's set is that of its distinct word shingles, as 64-bit hashes. COORDINATES minimum hashes make its signature. Each
coordinate with its value is a token, and texts are posted under tokens. Pairs of texts with at least MATCHES equal coordinates are
candidates. At a similarity of 0.8 a pair has so many but for a probability of 8e-7.

* Prefix: tokens are ordered by rarity. Two texts with MATCHES tokens in common have one in common among the
  COORDINATES - MATCHES + 1 rarest of each, so texts are posted under those alone. Tokens of one text only match nothing;
  with them the prefix shrinks, and a text with too few other tokens is skipped.
* Counting: a pair that meets under one token or more is counted once over the whole signatures.
* Candidates are confirmed on the full sets: 100 * |A and B| >= percent * |A or B|.

Texts with equal sets are one member of the join. Texts of a posting list are not paired with each other but with one
head, that with the most tokens in common with others, and links join texts into components. For the pairs that are left:

* Both texts are near the list's head, and at least one of them isn't linked with it. How they differ from the head tells how they
  differ from each other: |A ^ B| = |A ^ H| + |B ^ H| - 2 * |(A ^ H) and (B ^ H)|. So they can only be linked if they share
  enough of their differences, and a prefix-filtered join over differences, rarest first and bounded by position, finds them.
* Texts that aren't near the head are paired with the others of the list that belong to another component, if enough of
  their shingles occur in any other of these texts.

Pairs of one component needn't be found. So in both cases components meet first, by their labels, within the bounds of their
texts, and then the texts of two labels that met. A large group of near copies, or several that are alike but not linked, cost
a multiple of their size, and no link between components is lost.

Defined results: an empty or null text has an empty set and is linked with nothing; fewer words than a shingle has make
one shingle; texts of any length are read whole. Rows that share an id get a row each: those of equal text are copies;
of unlike texts the one whose set has the smallest digest is linked for the id. A row without an id is linked with its exact copies only, and
has their component (null, and kept, if it has none). Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import forget, keep, small_batches

COORDINATES = 48
MATCHES = 24
#: Members of a head that are compared with it in one go.
PART = 2000

_rng = np.random.default_rng(48)
_MULTIPLY = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, one text after the other, and their numbers."""
    data, offsets = W.buffer_of(texts)
    hashes, first = W.scan(data, offsets, W.SPACED_LOWER)
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), count)
    values = np.empty(len(text), np.uint64)
    long_enough = (n_words >= size)[text]
    values[long_enough] = W.ngrams(hashes, size)[W.ragged(first[:-1][n_words >= size], count[n_words >= size])]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    values[~long_enough] = W.stretches(hashes, first[:-1][short], first[1:][short])
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.bincount(text[new], minlength=len(count))


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima for each set; zeros for empty ones."""
    out = np.zeros((len(counts), COORDINATES), np.uint32)
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    if len(values):
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat((values + _ADD[k]) * _MULTIPLY[k] >> np.uint64(32), starts)
    return out


def _sign(size: int):
    def run(batches):
        for batch in batches:
            values, counts = shingle_sets(batch.column(1), size)
            sig = signatures(values, counts)
            raw, ends = values.tobytes(), np.cumsum(counts) * 8
            digests = [hashlib.blake2b(raw[b - 8 * n : b], digest_size=16).digest() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays((np.arange(len(counts) + 1) * COORDINATES).astype(np.int32), sig.ravel().view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n", "digest", "sig"])

    return run


def _count_matches(least: int):
    """Columns a, b, sig_a, sig_b: the pairs with enough equal coordinates."""

    def run(batches):
        for batch in batches:
            x, y = (c.flatten().to_numpy().reshape(-1, COORDINATES) for c in (batch.column(2), batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def _compare(size: int, percent: int):
    """Columns a, part, b (null for the head's own row), text; sorted, each head before its members.

    A row for each member: the sizes of the full sets, whether those are alike, and what is in one of them only. A head is held while its
    members pass by, so its text is sent once a part.
    """

    def run(batches):
        head, own, last = None, None, None
        for batch in batches:
            values, counts = shingle_sets(batch.column(3), size)
            sets = np.split(values, np.cumsum(counts)[:-1]) if batch.num_rows else []
            rows, apart = [], []
            for k, (a, part, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if b is None:
                    if head != (a, part):  # an id that stands for several texts counts by the first
                        head, own, last = (a, part), sets[k].copy(), None
                elif head == (a, part) and b != last:
                    last = b
                    apart.append(np.setxor1d(own, sets[k], assume_unique=True))
                    rows.append((a, b, len(own), len(sets[k])))
            a, b, n_a, n_b = np.array(rows, np.int64).reshape(-1, 4).T
            d = np.array([len(x) for x in apart], np.int64)
            linked = d * (100 + percent) <= (n_a + n_b) * (100 - percent)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(d)]).astype(np.int32), np.concatenate([*apart, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in (a, b, n_a, n_b)), pa.array(linked), lists], ["a", "b", "n_a", "n_b", "linked", "apart"])

    return run


def _shingles(size: int):
    """doc_id and a row for each shingle."""

    def run(batches):
        for batch in batches:
            values, counts = shingle_sets(batch.column(1), size)
            ids = np.repeat(batch.column(0).to_numpy(), counts)
            for at in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + (1 << 16)]), pa.array(values[at : at + (1 << 16)].view(np.int64))], ["doc_id", "shingle"])

    return run


def shared_sizes(bodies: DataFrame, size: int) -> DataFrame:
    """doc_id, lone: how many of a text's shingles no other of these texts has; no row for none."""
    lone = bodies.mapInArrow(_shingles(size), "doc_id long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return lone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lone"))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that can be reached) for every node of the edges (a, b).

    Each round takes the least label among neighbours and then the label's own label; the rounds grow with the logarithm of
    the longest path. Labels are written to the shared folder each round.
    """
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.lit(-1).cast("long").alias("old"), F.least("node", "b").alias("label")), "labels")
    while True:
        current = labels.select("node", "label")
        near = both.join(current.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = current.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = current.join(up, "label", "left").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("up", "label"), "near").alias("label"))
        new = keep(new, "labels")
        forget(labels)
        labels = new
        if labels.where("label <> old").isEmpty():
            forget(both)
            return labels.select("node", "label")


def links(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members: doc_id, n (size of the set), rep (the smallest id with the same set; the own for empty sets), and labels of reps: node, label."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = keep(texts.mapInArrow(_sign(size), "doc_id long, n long, digest binary, sig array<int>"), "signed")
    groups = signed.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "rep")
    joined = signed.join(keep(groups, "groups"), "digest", "left").select("doc_id", "n", "digest", "sig", F.coalesce("rep", "doc_id").alias("rep"))
    members = keep(joined.select("doc_id", "n", "rep"), "members")
    # a member for each set; ids are distinct here, whatever rows there are
    one = F.min_by(F.struct("n", "sig"), "digest").alias("one")
    reps = keep(joined.where("n > 0 and doc_id = rep").groupBy("doc_id").agg(one).select("doc_id", "one.n", "one.sig"), "reps")
    forget(signed)

    posts = reps.select("doc_id", F.posexplode("sig").alias("k", "v")).select("doc_id", F.xxhash64("k", "v").alias("token"))
    common = keep(posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    useful = posts.join(common, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") >= MATCHES)
    prefix = F.slice("t", F.lit(1), F.size("t") - (MATCHES - 1))
    suspects = keep(useful.select("doc_id", F.size("t").alias("common"), F.transform(prefix, lambda t: t["token"]).alias("tokens")).join(reps, "doc_id"), "suspects")
    posted = keep(suspects.select("doc_id", "common", "n", F.explode("tokens").alias("token")), "posted")
    bodies = keep(texts.join(suspects.select("doc_id"), "doc_id"), "bodies")
    sigs = suspects.select("doc_id", "sig")

    def compared(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those with enough equal coordinates: a, b, n_a, n_b, linked, apart."""
        pairs = keep(pairs.distinct(), "pairs")
        both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        near = keep(both.mapInArrow(_count_matches(MATCHES), "a long, b long"), "near")
        # a head's members are dealt to parts of about PART; each part gets the head's text once
        parts = F.ceil(F.col("k") / PART)
        dealt = near.join(near.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "a").select("a", F.pmod(F.xxhash64("b"), parts).alias("part"), "b")
        dealt = keep(dealt, "dealt")
        heads = dealt.select("a", "part").distinct().join(bodies.toDF("a", "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        full = dealt.join(bodies.toDF("b", "text"), "b").select("a", "part", "b", "text").unionAll(heads)
        full = full.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return keep(full.mapInArrow(_compare(size, percent), "a long, b long, n_a long, n_b long, linked boolean, apart array<long>"), "compared")

    heads = posted.groupBy("token").agg(F.max_by(F.struct("doc_id", "n"), F.struct("common", -F.col("doc_id"))).alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
    heads = keep(heads.select("token", F.col("head.doc_id").alias("head"), F.col("head.n").alias("n_head")), "heads")
    listed = keep(posted.join(heads, "token").where("doc_id <> head").select("head", "n_head", "doc_id", "n", "token"), "listed")
    star = compared(listed.where(_alike("n", "n_head", percent)).select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    found = star.where("linked").select("a", "b")
    labels = components(found).withColumnRenamed("node", "doc_id")

    pairs = _by_differences(star, labels, percent)
    # texts far from their list's head, with the list's others
    near = star.select(F.col("a").alias("head"), F.col("b").alias("doc_id"), F.lit(True).alias("near"))
    rows = listed.join(near, ["head", "doc_id"], "left").join(labels, "doc_id", "left").select("token", "doc_id", "n", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("label", "doc_id").alias("label"))
    rows = keep(rows, "rows")
    rows = keep(rows.join(keep(rows.where("not near").select("token").distinct(), "far"), "token", "left_semi"), "rows")
    # a shingle that no other of these texts has can't be shared: what is left must be large enough for the similarity
    lone = keep(shared_sizes(bodies.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), size), "lone")
    rows = rows.join(lone, "doc_id", "left").withColumn("core", F.col("n") - F.coalesce("lone", F.lit(0))).where(100 * F.col("core") >= percent * F.col("n")).drop("lone")
    rows = keep(rows, "rows")
    # groups of texts under one token that have one label meet as groups first, so that texts of one label never meet each other
    ranges = [F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("core").alias("core_high")]
    sides = keep(rows.groupBy("token", "label").agg(F.max(~F.col("near")).alias("open"), *ranges), "sides")
    other = sides.select("token", *[F.col(c).alias(f"{c}_f") for c in ("label", "open", "n_low", "n_high", "core_high")]).where("open_f").drop("open_f")
    may = (100 * F.col("n_high") >= percent * F.col("n_low_f")) & (100 * F.col("n_high_f") >= percent * F.col("n_low"))
    may &= (100 + percent) * F.least("core_high", "core_high_f") >= percent * (F.col("n_low") + F.col("n_low_f"))
    sides = keep(sides.join(other, "token").where((F.col("label") != F.col("label_f")) & may).select("token", "label", "label_f"), "sides")
    far = rows.where("not near").select("token", *[F.col(c).alias(f"{c}_f") for c in ("doc_id", "n", "label", "core")])
    once = F.col("near") | (F.col("doc_id_f") < F.col("doc_id"))
    enough = (100 + percent) * F.least("core", "core_f") >= percent * (F.col("n") + F.col("n_f"))
    met = sides.join(far, ["token", "label_f"]).join(rows, ["token", "label"]).where(once & enough & _alike("n", "n_f", percent))
    pairs = pairs.unionByName(met.select(F.least("doc_id", "doc_id_f").alias("a"), F.greatest("doc_id", "doc_id_f").alias("b")))
    more = compared(pairs).where("linked").select("a", "b")
    if not more.isEmpty():
        labels = components(found.unionAll(more)).withColumnRenamed("node", "doc_id")
    return members, labels.withColumnRenamed("doc_id", "node")


def _alike(n_a: str, n_b: str, percent: int) -> Column:
    """Sizes of sets that may be similar enough."""
    return (100 * F.col(n_a) >= percent * F.col(n_b)) & (100 * F.col(n_b) >= percent * F.col(n_a))


def _by_differences(star: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts near one head, of different components, that share enough of their differences from it.

    d and n: sizes of a text's difference and set. A link needs 2 * shared >= d + d' - (n + n') * (100 - percent) / (100 + percent).
    Tokens are ordered by how many texts of the head's have them; those of one text alone come first and match nothing, `at`
    counts them. A pair that first meets at `at` and `at'` shares no more than the rest of either.
    """
    more, less = 100 + percent, 100 - percent
    open_ = star.where("not linked").select("a").distinct()
    rows = keep(star.join(open_, "a", "left_semi").select("a", "b", F.col("n_a"), F.col("n_b").alias("n"), "linked", F.size("apart").alias("d"), "apart"), "open")
    tokens = rows.select("a", "b", F.explode("apart").alias("t"))
    common = keep(tokens.groupBy("a", "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    sorted_ = tokens.join(common, ["a", "t"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("t"))
    whole = rows.drop("apart").join(sorted_, ["a", "b"]).join(labels.toDF("b", "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    # what a text must share at least: with one that isn't linked to the head, and, if it isn't itself, with any
    with_open = F.floor((F.col("d") * more + (F.col("n_a") - F.col("n")) * less) / (2 * more)) + 1
    with_any = F.ceil(F.col("d") - F.col("n") * less / percent)
    needs = F.greatest(F.lit(1), F.when(F.col("linked"), with_open).otherwise(with_any))
    places = whole.withColumn("needs", needs).select("a", "b", "n", "d", "linked", "label", "needs", (F.col("d") - F.size("t")).alias("lone"), F.posexplode("t").alias("k", "x"))
    places = places.select("a", "b", "n", "d", "linked", "label", F.col("x.t").alias("t"), (F.col("lone") + F.col("k")).alias("at"), "needs").where("at <= d - needs").drop("needs")
    places = keep(places, "places")
    # texts of one label never meet: labels meet first, where the bounds of their texts allow it
    ranges = [F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("d").alias("d_low"), F.max(F.col("d") - F.col("at")).alias("rest")]
    sides = keep(places.groupBy("a", "t", "label").agg(F.max(~F.col("linked")).alias("open"), *ranges), "sides")
    other = sides.select("a", "t", *[F.col(c).alias(f"{c}_x") for c in ("label", "open", "n_low", "n_high", "d_low", "rest")]).where("open_x").drop("open_x")
    may = 2 * more * F.least("rest", "rest_x") >= more * (F.col("d_low") + F.col("d_low_x")) - less * (F.col("n_high") + F.col("n_high_x"))
    may &= (100 * F.col("n_high") >= percent * F.col("n_low_x")) & (100 * F.col("n_high_x") >= percent * F.col("n_low"))
    sides = keep(sides.join(other, ["a", "t"]).where((F.col("label") != F.col("label_x")) & may).select("a", "t", "label", "label_x"), "sides")
    x = places.where("not linked").select("a", "t", *[F.col(c).alias(f"{c}_x") for c in ("b", "n", "d", "label", "at")])
    enough = 2 * more * F.least(F.col("d") - F.col("at"), F.col("d_x") - F.col("at_x")) >= more * (F.col("d") + F.col("d_x")) - less * (F.col("n") + F.col("n_x"))
    once = F.col("linked") | (F.col("b_x") < F.col("b"))
    met = sides.join(x, ["a", "t", "label_x"]).join(places, ["a", "t", "label"]).where(once & enough & _alike("n", "n_x", percent))
    return met.select(F.least("b", "b_x").alias("a"), F.greatest("b", "b_x").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **names) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id = component_id)."""
    members, labels = links(docs, size, percent, **names)
    out = members.select("doc_id", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns; rows with an empty or null text stay."""
    gone = keep(near_duplicates(docs, size, percent, doc_id=doc_id, text=text).where("not kept").select(F.col("doc_id").alias("__gone")), "gone")
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")  # rows without an id stay
