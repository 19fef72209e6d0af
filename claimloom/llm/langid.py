"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (bytes of the lower-cased UTF-8 text; whatever is not a letter separates
words as one blank). A text's vector is n-gram frequency (count / number of n-grams) times inverse document frequency. The weights
come from follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties, which makes them sparse; a
temperature fitted on labelled rows kept out of the training scales the scores into probabilities.

The weights are fitted on a sample of labelled rows, an equal part of each label, about `train_rows` in all at most; document
frequencies are grouped sums over all labelled rows. The model has 2**BITS * classes weights whatever the corpus, and goes to the executors as a broadcast of that
size. Prediction reads whole texts in one pass without a shuffle.

Defined results: a null or empty text, or one without a letter, is `und` with score 0; a text of any length is read whole, in
pieces; ties go to the language first in order; no labelled row leaves every text `und`; rows are predicted each for itself, repeated
ones and those without an id too; other columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import small_batches, stratified

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_SALT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes as features see them: a-z, bytes from 0x80 up; everything else is a blank."""
    letter = np.array([97 <= (b | 32) <= 122 and b < 128 or b >= 128 for b in range(256)])
    seen = np.where(letter, np.arange(256), 32).astype(np.uint8)
    seen[65:91] += 32
    return letter, seen


_LETTER, _SEEN = _classes()


def features(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of one stretch of bytes, for each order an array; runs of blanks are one blank."""
    c = _SEEN[data]
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = c[keep].astype(np.uint32) + np.uint32(1)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(257) + c[n - 1 :]
        x = h * _SALT[0] + np.uint32(n * int(_SALT[1]) & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x *= _SALT[2]
        out.append((x >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def pieces(data: np.ndarray):
    """A text's n-grams, in pieces of bounded length that overlap by what an n-gram needs."""
    for at in range(0, len(data), W.PIECE):
        found = features(data[max(at - ORDERS[-1] + 1, 0) : at + W.PIECE])
        yield from found


def has_letter(text: str | None) -> bool:
    return text is not None and (any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text[200:]))


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # buckets x classes, with the inverse document frequency already in them
    bias: np.ndarray
    temperature: float

    def scores(self, data: np.ndarray) -> np.ndarray:
        """Probabilities for one text, read in pieces of bounded length."""
        total, n = np.zeros(len(self.classes)), 0
        for f in pieces(data):
            total += np.bincount(f, minlength=1 << BITS) @ self.weights if len(f) > 1 << BITS else self.weights[f].sum(axis=0)
            n += len(f)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its n-grams."""
    counts = np.zeros(1 << BITS, np.int64)
    for f in pieces(np.frombuffer(text.encode(), np.uint8)):
        counts += np.bincount(f, minlength=1 << BITS)
    on = np.flatnonzero(counts)
    return on.astype(np.int32), (counts[on] / max(counts.sum(), 1)).astype(np.float32)


def _vectors(batches):
    for batch in batches:
        pairs = [_sparse(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32()))], ["label", "at", "share"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by FTRL-proximal; the last bucket's place is the bias. Returns weights and bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def _document_frequencies(batches):
    """How many texts of the task have each bucket."""
    df = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            found = list(pieces(np.frombuffer(t.encode(), np.uint8)))
            if found:
                df[np.unique(np.concatenate(found))] += 1
    on = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(df[on])], ["bucket", "df"])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", train_rows: int = 3000, calibration_share: float = 0.2, scale: float = 200.0) -> Model:
    """Rows with a null text or label take no part. Document frequencies are those of all rows.

    The weights are fitted on about train_rows rows at most, an equal part of each label (all rows of a rare one), drawn by a
    hash of the key; so every label is learned, however many rows the others have.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("string").alias("__k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("label"))
    counts = usable.select("t").mapInArrow(_document_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()  # 2**BITS rows at most
    df = np.zeros(1 << BITS)
    df[counts.column("bucket").to_numpy()] = counts.column("df").to_numpy()
    sample, strata = stratified(usable, ["label"], "__k", train_rows, 11)
    total = sum(n for n, _ in strata.values())
    found = sample.select("t", "label").mapInArrow(_vectors, "label string, at array<int>, share array<float>").toArrow()
    labels, at, xs = found.column("label").to_pylist(), [np.asarray(v, np.int32) for v in found.column("at").to_numpy()], [np.asarray(v, np.float64) for v in found.column("share").to_numpy()]
    classes = sorted(set(labels))
    if not classes:
        return Model([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0)
    order = sorted(range(len(labels)), key=lambda i: (labels[i], at[i].tobytes(), xs[i].tobytes()))  # whatever the order they came in
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = []
    for i in order:
        x = xs[i] * idf[at[i]] * scale
        rows.append((at[i], x, classes.index(labels[i])))
    every = max(2, round(1 / calibration_share))
    held = rows[::every] if len(rows) >= 5 * every else rows
    w, bias = ftrl([r for k, r in enumerate(rows) if k % every] if held is not rows else rows, len(classes))
    logits = np.array([x @ w[a] + bias for a, x, _ in held])
    y = np.array([c for *_, c in held])

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return Model(classes, (w * (idf * scale)[:, None]).astype(np.float32), bias, float(temperature))


def _predict(model):
    def run(batches):
        m = model.value
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(1).to_pylist():
                if m.classes == [UNKNOWN] or not has_letter(t):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = m.scores(np.frombuffer(t.encode(), np.uint8))
                k = int(p.argmax())
                langs.append(m.classes[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part


def accept(docs: DataFrame, model: Model, least: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text has a language: those of `und`, or with a score under `least`, go. All columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            good = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                good.append(m.classes != [UNKNOWN] and has_letter(t) and float(m.scores(np.frombuffer(t.encode(), np.uint8)).max()) >= least)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
