"""Quality by hierarchical empirical Bayes: a text's own evidence, combined with what is known of its path and host.

A logistic regression on a few figures of the text (shares of capitals, punctuation, digits and repeated words, lengths) gives the
document's evidence. Hosts, and paths within hosts (any two columns or expressions; a table without paths may give another column
for them, as the query does with the language), get posteriors: Beta distributions whose mean shrinks to the level above,
path to host to all documents. How much is estimated from the spread between sites (method of moments). Counts of labelled
rows are grouped sums; sites with few of them stay near the level above. A document's log-odds are those of its own
evidence plus what its path's posterior differs from the global mean. A labelled document's own labels are left out of the posteriors it is scored with.

The regression is fitted on about `train_rows` labelled rows at most, chosen by a hash of the id; site counts take all of them.

Defined results: a null or empty text has figures of zero; texts of any length are read whole; a null host or path is a site of its
own; sites without labels have the posterior of the level above; no labels at all give evidence 0.5. Rows that share an id are scored each
for itself, and the id's labels count for each of them (and are left out for each); several labels of one id all count; a row without an id has no labels; further columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import keep, small_batches

FIGURES = ("log_words", "word_length", "capitals", "punctuation", "digits", "repeated", "lines", "symbols_at_end")


def figures(texts) -> np.ndarray:
    """A row of FIGURES for each text."""
    data, offsets = W.buffer_of(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    hashes, first, begin, end = W.scan(data, offsets, W.SPACED_LOWER, places=True)

    def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[at])

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~upper & ~lower & ~digit
    n_words = np.diff(first)
    n_bytes = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(per_text(upper | lower, offsets), 1)
    text = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((hashes, text))
    same = np.zeros(len(hashes), bool)
    if len(hashes):
        h, t = hashes[order], text[order]
        same[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    some = np.maximum(n_words, 1)
    out = np.column_stack([
        np.log1p(n_words),
        per_text((data != 32) & (data != 10), offsets) / some,
        per_text(upper, offsets) / letters,
        per_text(mark, offsets) / n_bytes,
        per_text(digit, offsets) / n_bytes,
        per_text(same, first) / some,
        per_text(data == 10, offsets) / some,
        per_text(mark[end - 1] if len(end) else np.zeros(0, bool), first) / some,
    ])
    out[n_words == 0] = 0
    return out


def _figures(batches):
    for batch in batches:
        x = figures(batch.column(0))
        lists = pa.ListArray.from_arrays((np.arange(len(x) + 1) * len(FIGURES)).astype(np.int32), x.ravel())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [*batch.schema.names[1:], "x"])


@dataclass
class Evidence:
    """Logistic regression on standardised figures and their squares."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def logit(self, x: Column) -> Column:
        z = [(F.get(x, F.lit(k)) - m) / s for k, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))]
        total = F.lit(self.bias)
        for k, v in enumerate(z):
            v = F.least(F.greatest(v, F.lit(-4.0)), F.lit(4.0))
            total = total + self.weights[k] * v + self.weights[len(z) + k] * v * v
        return total


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> Evidence:
    if not len(y) or y.min() == y.max():
        n = len(FIGURES)
        return Evidence([0.0] * n, [1.0] * n, [0.0] * 2 * n, 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -4, 4)
    a = np.column_stack([z, z * z, np.ones(len(z))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) / len(y) + l2 * w)
    return Evidence(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def concentration(sites: DataFrame, centre: Column, least: float = 1.0, most: float = 1e6) -> float:
    """How many labels the level above is worth, by the method of moments. sites: good, n, and what centre needs."""
    s = sites.where("n >= 2").agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - centre, 2)).alias("between"), F.sum(centre * (1 - centre)).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * centre * (1 - centre)).alias("all")).first()
    if not s["k"] or not s["n"]:
        return 100.0
    excess = (s["between"] - s["within"]) / s["n"]
    return most if excess <= 0 else float(min(max(s["all"] / s["n"] / excess - 1, least), most))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", host: Column | str = "source", path: Column | str = "lang", train_rows: int = 20_000, broadcast_rows: int = 100_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_site (the path's posterior mean), score, keep."""
    spark = docs.sparkSession
    small_batches(spark)
    host, path = (F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in (host, path))
    read = docs.select(F.col(text).cast("string").alias("t"), F.col(doc_id).cast("long").alias("doc_id"), host.alias("host"), path.alias("path"))
    scored = keep(read.mapInArrow(_figures, "doc_id long, host string, path string, x array<double>"), "figures")
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = keep(scored.join(known, "doc_id"), "known")
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(9), F.col("doc_id")), F.lit(1 << 30))
    share = min(1.0, train_rows / max(n, 1))
    rows = known.where(draw < int(share * (1 << 30)) + (share == 1.0)).select("doc_id", "x", "y").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array([np.asarray(v) for v in rows.column("x").to_numpy()]).reshape(-1, len(FIGURES))[order]
    evidence = fit(x, rows.column("y").to_numpy()[order].astype(float))

    paths = keep(known.groupBy("host", "path").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    mean = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    of_all = concentration(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n")), F.lit(mean))

    def shrunk(good: Column, n: Column, centre: Column, weight: float) -> Column:
        return (good + weight * centre) / (n + weight)

    levels = keep(hosts, "hosts")
    of_host = concentration(paths.join(levels, "host").withColumn("host_mean", shrunk(F.col("host_good"), F.col("host_n"), F.lit(mean), of_all)), F.col("host_mean"))
    sites = paths.withColumnsRenamed({"good": "site_good", "n": "site_n"})
    if sites.count() <= broadcast_rows:
        sites, levels = F.broadcast(sites), F.broadcast(levels)

    def logit(p):
        return F.log(p / (1 - p))

    # what a document's own labels add to its site is taken off again, so that no label speaks for its own document
    own = known.groupBy("doc_id").agg(F.sum("y").alias("own_good"), F.count(F.lit(1)).alias("own_n"))
    odds = evidence.logit(F.col("x"))
    out = scored.join(sites, ["host", "path"], "left").join(levels, "host", "left").join(own, "doc_id", "left")

    def others(name: str) -> Column:
        return F.coalesce(name, F.lit(0)) - F.coalesce(f"own_{name.rpartition('_')[2]}", F.lit(0))

    host_mean = shrunk(others("host_good"), others("host_n"), F.lit(mean), of_all)
    out = out.select("doc_id", (1 / (1 + F.exp(-odds))).alias("p_text"), shrunk(others("site_good"), others("site_n"), host_mean, of_host).alias("p_site"), odds.alias("odds"))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("odds") + logit(F.col("p_site")) - logit(F.lit(mean)))))).drop("odds")
    return out.withColumn("keep", F.col("score") >= threshold)
