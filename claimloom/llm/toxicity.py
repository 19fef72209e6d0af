"""Toxicity by classifier chains.

Categories are predicted one after the other; each linear model sees the text's features and the probabilities of the
categories before it. For training, those probabilities are out of fold: made by models that have not seen the row.

Features are hashed words, and the words' first four and five bytes (2**BITS places, present or not); lower-cased A-Z. The
models are logistic regressions fitted by follow-the-regularised-leader with an L1 penalty, so most places are zero. They are fitted on
a sample of about `train_rows` labelled rows at most, chosen by a hash of the id within each combination of labels, so what can be
learned of a rare category doesn't shrink as the tables grow. Prediction is one pass over whole texts.

Defined results: a null or empty text has no features and gets the models' bias; labels that are null, or of ids without a
text, take no part; no labels at all give probabilities 0; several labels of one id count each; repeated rows are
predicted alike; further columns of the inputs are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import words as W
from claimloom.llm.base import small_batches, stratified

BITS = 20
PREFIXES = (4, 5)


def places(texts) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words' features, word by word for each kind of feature, and the texts they are of."""
    data, offsets = W.buffer_of(texts)
    hashes, first, begin, end = W.scan(data, offsets, W.ALNUM_LOWER, places=True)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    kinds = [hashes >> shift]
    if len(hashes):
        lower = W.ALNUM_LOWER.folded[data]
        kinds += [(W.bytes_hash(lower, begin, np.minimum(begin + n, end)) ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> shift for n in PREFIXES]
    return np.concatenate(kinds).astype(np.int64), np.tile(text, len(kinds))


def _distinct(at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(text << BITS | at)
    return keys & ((1 << BITS) - 1), keys >> BITS


def _vectors(batches):
    for batch in batches:
        at, text = _distinct(*places(batch.column(0)))
        lists = pa.ListArray.from_arrays(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32), at.astype(np.int32))
        yield pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], ["at", *batch.schema.names[1:]])


@dataclass
class Linear:
    weights: np.ndarray
    more: np.ndarray
    bias: float

    def logit(self, at: np.ndarray, more: np.ndarray) -> float:
        return float(self.weights[at].sum() + self.more @ more + self.bias)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


BATCH = 32


def ftrl(rows: list[np.ndarray], more: np.ndarray, y: np.ndarray, steps: int = 45_000, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, seed: int = 3) -> Linear:
    """Logistic regression on present places and some further numbers, by FTRL-proximal over batches of BATCH rows, about `steps` rows in all, each row 4 to 15 times.

    Further numbers and the bias have no L1 penalty. Places that one row alone has tell nothing of other rows, and are left out.
    """
    size = 1 << BITS
    n_more = more.shape[1] + 1
    z, n = np.zeros(size + n_more), np.zeros(size + n_more)
    penalty = np.full(size + n_more, l1)
    penalty[size:] = 0
    extra = np.column_stack([more, np.ones(len(rows))])
    free = np.arange(size, size + n_more)
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)])
    shared = np.bincount(flat, minlength=size)[flat] > 1
    owner, flat = owner[shared], flat[shared]
    lengths = np.bincount(owner, minlength=len(rows))
    first = np.cumsum(lengths) - lengths

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= penalty[at], 0.0, -(zz - np.sign(zz) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(min(15, max(4, steps // max(len(rows), 1)))):
        shuffled = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            k = shuffled[low : low + BATCH]
            row = np.repeat(np.arange(len(k)), lengths[k])
            at, back = np.unique(flat[W.ragged(first[k], lengths[k])], return_inverse=True)
            w, v = weights(at), weights(free)
            logit = np.bincount(row, weights=w[back], minlength=len(k)) + extra[k] @ v
            error = sigmoid(logit) - y[k]
            for places, g, old in ((at, np.bincount(back, weights=error[row], minlength=len(at)), w), (free, extra[k].T @ error, v)):
                sigma = (np.sqrt(n[places] + g * g) - np.sqrt(n[places])) / alpha
                z[places] += g - sigma * old
                n[places] += g * g
    w = weights(free)
    return Linear(weights(np.arange(size)).astype(np.float32), w[:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)



def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", train_rows: int = 8000, folds: int = 3) -> Chain:
    """categories: name and a Column (0 or 1) over the columns of labels, in the chain's order.

    About train_rows labelled rows at most are fitted on, an equal part of each combination of labels that occurs (all of a
    rare one), so rare categories are learned however many rows there are; the models' biases are set right for it.
    """
    names = list(categories)
    marks = [f"__y{k}" for k in range(len(names))]
    wanted = labels.select(F.col(doc_id).cast("long").alias("__k"), *[c.cast("int").alias(m) for m, c in zip(marks, categories.values(), strict=True)]).dropna()
    sample, strata = stratified(wanted, marks, "__k", train_rows, 5)
    rows = docs.select(F.col(doc_id).cast("long").alias("__k"), F.col(text).cast("string").alias("t")).where("t is not null").join(F.broadcast(sample), "__k")  # train_rows at most, about
    found = rows.select("t", "__k", *marks).mapInArrow(_vectors, f"at array<int>, k long, {', '.join(f'{m} int' for m in marks)}").toArrow()
    chain = Chain(names)
    if not found.num_rows:
        return chain
    vectors = [np.asarray(v, np.int64) for v in found.column("at").to_numpy()]
    keys = found.column("k").to_numpy()
    order = sorted(range(len(keys)), key=lambda i: (int(keys[i]), [found.column(m)[i].as_py() for m in marks], vectors[i].tobytes()))
    rows = [vectors[i] for i in order]
    fold = np.arange(len(rows)) % folds
    more = np.zeros((len(rows), 0))
    for k, c in enumerate(names):
        y = found.column(marks[k]).to_numpy()[order].astype(float)
        # of the rows with and without the category, other shares were drawn: the log odds are off by the logarithm of their ratio
        share = [sum(n * limit for s, (n, limit) in strata.items() if s[k] == v) / max(sum(n for s, (n, _) in strata.items() if s[k] == v), 1) for v in (0, 1)]
        shift = float(np.log(share[0] / share[1])) if min(share) > 0 else 0.0

        def corrected(m: Linear, shift: float = shift) -> Linear:
            return Linear(m.weights, m.more, m.bias + shift)

        chain.models.append(corrected(ftrl(rows, more, y)))
        if c != names[-1]:
            out = np.zeros(len(rows))
            for f in range(folds):
                m = corrected(ftrl([r for r, g in zip(rows, fold, strict=True) if g != f], more[fold != f], y[fold != f]))
                for i in np.flatnonzero(fold == f):
                    out[i] = sigmoid(m.logit(rows[i], more[i]))
            more = np.column_stack([more, out])
    return chain


def _predict(shared):
    def run(batches):
        chain: Chain = shared.value
        used = np.zeros(1 << BITS, bool)
        for m in chain.models:
            used |= m.weights != 0
        for batch in batches:
            at, text = places(batch.column(1))
            on = used[at]
            at, text = _distinct(at[on], text[on])
            p = np.zeros((batch.num_rows, len(chain.categories)))
            for k, m in enumerate(chain.models):
                p[:, k] = sigmoid(np.bincount(text, weights=m.weights[at], minlength=batch.num_rows) + p[:, :k] @ m.more + m.bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *[f"p_{c}" for c in chain.categories]])

    return run


def predict(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and p_<category> for each category."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2**BITS weights a category
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_predict(shared), schema)
