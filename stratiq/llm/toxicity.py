"""Toxicity: a factorization machine over hashed terms.

A text's terms (lower-cased words without surrounding punctuation, counted once)
are hashed to buckets.  The score is the logistic of

    bias + sum of weights + sum over pairs of terms of the product of their factors,

so that a pair such as an insult with the mention of a group gets a weight that
neither term has alone.  The pair sum costs one pass over the terms:
half of (the squared sum of factors less the sum of squares).

Fitting uses at most about ``sample_rows`` labelled rows, chosen by a hash of
the id; their terms are hashed in Spark tasks and the driver sees only bucket
numbers.  A bucket is in the model if ``least_rows`` sampled rows have it and either
its rows are toxic more or less often than any (by ``least_z`` standard
deviations), or it is in a pair whose rows are toxic more or less often than
those of each of the two (:func:`_paired`).  Weights of the others would be
noise that long texts add up.
Every text is scored whole, in numpy, a batch at a time.

Defined results
---------------
* Null, empty and wordless texts get the logistic of the bias.
* Labels other than 0 and 1, and null labels, do not train.  An id with labels
  that differ counts as toxic.  Without labelled rows every score is 0.
* Repeated rows give equal results; an empty table gives an empty result.
* Further columns are ignored by ``fit`` and kept by ``annotate``; ValueError is
  raised if the input already has a column named like an output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn

BITS, FACTORS = 24, 8
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_/\\"


class Terms(dict):
    """Buckets of words, for at most a million of them at a time; with ``places``, the bucket's place in a model."""

    def __init__(self, bits: int, places: dict[int, int] | None = None):
        super().__init__()
        self.mask, self.places = (1 << bits) - 1, places

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        bucket = zlib.crc32(word.strip(EDGES)) & self.mask
        found = self[word] = bucket if self.places is None else self.places.get(bucket, -1)
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        found = np.unique(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        return found[found >= 0]


@dataclass
class Machine:
    bits: int
    bias: float
    #: The buckets in the model, and for each its weight and its factors.
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: list[np.ndarray]) -> np.ndarray:
        """Of texts given by their terms' places."""
        out = np.full(len(terms), self.bias)
        for i, t in enumerate(terms):
            v = self.factors[t]
            out[i] += self.weights[t].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    def terms(self) -> Terms:
        return Terms(self.bits, {int(b): i for i, b in enumerate(self.buckets)})


def _constant(bits: int, bias: float) -> Machine:
    return Machine(bits, bias, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))


#: Into so many parts the terms are dealt for the screening of pairs.
PARTS = 48


def _pairs(part: int, flat: np.ndarray, starts: np.ndarray, y: np.ndarray, count: int, least_rows: int, chance: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Pairs tested whose first term is of this part, and those that pass for as many tests: terms, bound."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    seen, toxic = np.bincount(flat, minlength=count), np.bincount(flat, y[row], count)
    share = toxic / np.maximum(seen, 1)
    order = np.argsort(flat, kind="stable")
    holders = np.split(order, np.cumsum(seen)[:-1])
    tested, found = 0, []
    for a in range(part, count, PARTS):
        # Rows are sorted: what comes after a, so that each pair is met once.
        ahead = lambda at: np.bincount(np.concatenate([flat[i + 1 : starts[row[i] + 1]] for i in at] or [flat[:0]]), minlength=count)
        n = ahead(holders[a])
        b = np.flatnonzero(n >= least_rows)
        tested += len(b)
        n = n[b]
        q = ahead(holders[a][y[row[holders[a]]] == 1])[b] / np.maximum(n, 1)
        p = np.clip(q, np.minimum(share[a], share[b]), np.maximum(share[a], share[b])).clip(1e-6, 1 - 1e-6)
        bound = n * (q * np.log(np.maximum(q, 1e-12) / p) + (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - p)))
        far = bound > np.log(max(1, tested) / chance)
        found += [(a, int(k), float(x)) for k, x in zip(b[far], bound[far], strict=True)]
    return tested, found


def _paired(rows: list[np.ndarray], y: np.ndarray, count: int, least_rows: int, spread=map, chance: float = 0.01) -> np.ndarray:
    """Which of ``count`` terms are in a pair that is toxic more often than either term, or less often than either.

    The rows with both terms number n, a share q of them toxic; p is the share
    of the term nearer to q.  By Chernoff's bound, q is by chance with
    probability exp(-n KL(q, p)) at most: times the pairs that are tested, that
    must be below ``chance``.
    """
    starts = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows)
    parts = list(spread(lambda part: _pairs(part, flat, starts, y, count, least_rows, chance), range(PARTS)))
    least = np.log(max(1, sum(tested for tested, _ in parts)) / chance)
    out = np.zeros(count, bool)
    for a, b, bound in (x for _, found in parts for x in found):
        if bound > least:
            out[[a, b]] = True
    return out


def _summed(rows: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows that share a place, a column at a time."""
    return np.stack([np.bincount(at, rows[:, k], count) for k in range(rows.shape[1])], axis=1)


def _train(rows: list[np.ndarray], y: np.ndarray, bits: int, least_rows: int, least_z: float, epochs: int, rate: float, decay: float, seed: int, spread=map) -> Machine:
    """Mini-batch AdaGrad on the logistic loss, the two classes weighted to the same total."""
    draw = np.random.default_rng(seed)
    buckets, at = np.unique(np.concatenate(rows), return_inverse=True)
    lengths = np.array([len(t) for t in rows])
    seen, toxic = np.bincount(at, minlength=len(buckets)), np.bincount(at, np.repeat(y, lengths), len(buckets))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    z = (toxic - seen * share) / np.sqrt(seen * share * (1 - share))
    common = seen >= least_rows
    kept = [np.searchsorted(buckets[common], t[np.isin(t, buckets[common])]) for t in rows]
    paired = np.zeros(len(buckets), bool)
    paired[common] = _paired(kept, y, int(common.sum()), least_rows, spread)
    live = buckets[common & ((np.abs(z) >= least_z) | paired)]
    rows = [np.searchsorted(live, t[np.isin(t, live)]) for t in rows]
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, v = np.zeros(len(live)), draw.normal(0, 0.01, (len(live), FACTORS))
    gw, gv, bias, gb = np.full(len(live), 1e-6), np.full((len(live), FACTORS), 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for start in range(0, len(order), 128):
            part = order[start : start + 128]
            ids = np.concatenate([rows[i] for i in part])
            at = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            vi = v[ids]
            sums = _summed(vi, at, len(part))
            margin = bias + np.bincount(at, w[ids], len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(at, (vi * vi).sum(1), len(part)))
            error = cost[part] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[part]) / len(part)
            used, back = np.unique(ids, return_inverse=True)
            dw = np.bincount(back, error[at], len(used)) + decay * w[used]
            dv = _summed(error[at][:, None] * (sums[at] - vi), back, len(used)) + decay * v[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv * dv
            v[used] -= 0.1 * rate * dv / np.sqrt(gv[used])
            db = error.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return Machine(bits, float(bias), live, w, v)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 10_000,
    bits: int = BITS, least_rows: int = 10, least_z: float = 4.0, epochs: int = 60, rate: float = 0.3, decay: float = 1e-5, seed: int = 3,
) -> Machine:
    """Learn from about ``sample_rows`` of the labelled rows given."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    count = marked.count()
    if not count:
        return _constant(bits, -50.0)
    sample = marked.filter(drawn("_id", "toxicity", sample_rows / count))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Terms(bits)
        for batch in batches:
            found = [table.of(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["_id", "_y", "_terms"])

    got = texts.mapInArrow(run, "_id long, _y int, _terms array<int>").toArrow().sort_by("_id")
    rows = [x.values.to_numpy(zero_copy_only=False) for x in got["_terms"].combine_chunks()] if got.num_rows else []
    if not rows:
        return _constant(bits, -50.0)
    spread = lambda f, parts: docs.sparkSession.sparkContext.parallelize(parts, len(parts)).map(f).collect()
    return _train(rows, got["_y"].to_numpy().astype(float), bits, least_rows, least_z, epochs, rate, decay, seed, spread)


def annotate(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input with score (double) and predicted (1 if score >= threshold, else 0)."""
    if clash := {"score", "predicted"} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        table = machine.terms()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                score = machine.score([table.of(x.as_py()) for x in batch.column(at)])
                added = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
