"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x), with one weight vector w shared by all grades and ordered thresholds t_0 < t_1 < ... . x
holds the square roots of the shares of hashed byte trigrams of the whole text, and of words that repeat the one before. The expected grade and the tail probability
P(grade >= least) select documents.

Fitted on the driver over at most MAX_RATED rated texts (the smallest by a hash of the id), by Adam; the thresholds are a
first one and positive steps, so they keep their order.

Cases: a null or empty text has x = 0 and so the grades' base rates; texts under three bytes are padded with blanks; ids and
ratings that are null take no part in the fit, and of conflicting ratings of an id the larger counts (graded() names the
better grade the larger); with fewer than two
different grades every document has that grade (the lowest possible, 0, without any) and is kept; repeated rows give repeated
results; other columns are kept or ignored as the function says; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm._common import bounded_labels, release, slices

#: Bound of the rated sample.
MAX_RATED = 5000
BUCKET_BITS = 13
#: Texts of a block of the fit.
TEXTS = 256
STEPS, RATE, RIDGE = 200, 0.05, 1e-5
SCALE = 10.0
SCHEMA = "doc_id long, expected_grade double, tail_probability double, grade long, selected boolean"


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams and, last, of words that repeat the one before."""
    out = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    if text:
        data = np.frombuffer(text.encode().ljust(3), np.uint8).astype(np.uint32)
        mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        out[:-1] = np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS) / len(mixed)
        words = text.split()
        out[-1] = sum(map(str.__eq__, words, words[1:])) / max(1, len(words))
        np.sqrt(out, out)
        out *= SCALE
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, text: str) -> np.ndarray:
        """P(grade >= each of the grades but the lowest)."""
        return _sigmoid(float(features(text) @ self.weights) - self.thresholds)


class _Features:
    """The features of texts that aren't 0, in blocks of TEXTS rows: the driver holds six bytes for each, not a dense matrix."""

    def __init__(self, texts: list[str]):
        self.size, self.rows = (1 << BUCKET_BITS) + 1, len(texts)
        self.blocks = []
        for lo in range(0, len(texts), TEXTS):
            dense = np.stack([features(t) for t in texts[lo : lo + TEXTS]])
            at, places = np.nonzero(dense)
            self.blocks.append((np.bincount(at, minlength=len(dense)), places.astype(np.min_scalar_type(self.size)), dense[at, places]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """For each row its product with the weights."""
        out = np.zeros(self.rows, np.float32)
        for lo, (counts, places, values) in zip(range(0, self.rows, TEXTS), self.blocks):
            some = np.flatnonzero(counts)
            if some.size:
                out[lo + some] = np.add.reduceat(values * weights[places], (np.cumsum(counts) - counts)[some])
        return out

    def sums(self, shares: np.ndarray) -> np.ndarray:
        """The sum of all rows times their shares."""
        out = np.zeros(self.size)
        for lo, (counts, places, values) in zip(range(0, self.rows, TEXTS), self.blocks):
            out += np.bincount(places, values * np.repeat(shares[lo : lo + TEXTS], counts), self.size)
        return out


def fit(texts: list[str], ratings: list[int]) -> OrdinalModel:
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros((1 << BUCKET_BITS) + 1, np.float32), np.zeros(0))
    x = _Features(texts)
    place = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    at_most = np.clip([(place <= j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    cuts = np.log(at_most / (1 - at_most))
    # Parameters: weights, the first threshold, and logarithms of the steps to the others.
    b = np.concatenate([np.zeros(x.size), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v, size = np.zeros_like(b), np.zeros_like(b), x.size
    rows = np.arange(x.rows)
    for step in range(1, STEPS + 1):
        steps = np.exp(b[size + 1 :])
        t = b[size] + np.concatenate([[0.0], np.cumsum(steps)])
        below = _sigmoid(t[None, :] - x.times(b[:size].astype(np.float32))[:, None])  # P(grade <= j)
        edges = np.concatenate([np.zeros((x.rows, 1)), below, np.ones((x.rows, 1))], axis=1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[rows, place + 1] - edges[rows, place], 1e-9)
        upper, lower = slope[rows, place + 1] / p, slope[rows, place] / p
        to_t = np.zeros((x.rows, k + 2))
        to_t[rows, place + 1] -= upper
        to_t[rows, place] += lower
        to_t = to_t[:, 1:-1].mean(axis=0)
        gradient = np.empty_like(b)
        gradient[:size] = x.sums((upper - lower).astype(np.float32)) / x.rows + RIDGE * b[:size]
        gradient[size] = to_t.sum()
        gradient[size + 1 :] = np.cumsum(to_t[::-1])[::-1][1:] * steps
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        b -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    thresholds = b[size] + np.concatenate([[0.0], np.cumsum(np.exp(b[size + 1 :]))])
    return OrdinalModel([int(g) for g in grades], b[:size].astype(np.float32), thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and the grade that quality and toxic name: 0 toxic, 1 junk, 2 clean; null without either."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.col("quality") > 0, 2)
    return labels.select("doc_id", grade.alias("grade"))


def learn_ratings(docs: DataFrame, labels: DataFrame, rating: str = "quality") -> OrdinalModel:
    rated = bounded_labels(labels, MAX_RATED, [rating])  # at most MAX_RATED rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rated), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(rating).alias("rating")).orderBy(F.xxhash64("doc_id")).collect()
    model = fit([r.text for r in sample], [int(r.rating) for r in sample])
    del sample
    release()
    return model


def rate_documents(docs: DataFrame, model: OrdinalModel, least: int | None = None, probability: float = 0.5) -> DataFrame:
    """Per document the expected grade, P(grade >= least), the grade with the median, and whether that probability suffices.

    least: the highest grade where none is given.
    """
    grades, cut = np.array(model.grades), _cut(model, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            expected, tails, medians = [], [], []
            for text in texts:
                tail = model.at_least(text)
                expected.append(float(grades[0] + (tail * np.diff(grades)).sum()))
                tails.append(float(tail[cut]) if len(tail) else 1.0)
                medians.append(int(grades[(tail >= 0.5).sum()]))
            columns = [pa.array(expected), pa.array(tails), pa.array(medians, pa.int64()), pa.array([t >= probability for t in tails])]
            yield pa.record_batch([part.column(0), *columns], ["doc_id", "expected_grade", "tail_probability", "grade", "selected"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _cut(model: OrdinalModel, least: int | None) -> int:
    return len(model.grades) - 2 if least is None else max(0, int(np.searchsorted(model.grades, least)) - 1)


def keep_quality(docs: DataFrame, model: OrdinalModel, least: int | None = None, probability: float = 0.5) -> DataFrame:
    """The documents, all columns, with P(grade >= least) of `probability` or more."""
    cut = _cut(model, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            keep = [len(model.thresholds) == 0 or bool(model.at_least(t)[cut] >= probability) for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
