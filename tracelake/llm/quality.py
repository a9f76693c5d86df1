"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K come from rated documents.  One weight vector over hashed
words is shared by all grades, and ordered thresholds t_1 < ... < t_K turn the
score s of a text into tail probabilities P(grade >= k) = sigmoid(s - t_k).
Their sum is the expected grade, and the tail at a chosen grade selects
documents.

A text's features are which of ``DIMENSIONS`` hashed places its words (runs of
letters, lower-cased, of the whole text) take, and a few of its shape: the share
of capitals, of digits and of other signs, of repeated words, and its length.
For fitting, a place counts as strongly as the rated documents with and without
it differ in grade (the logarithm of the ratio of its shares, at the grade where
that is largest); places in fewer than ``LEAST`` rated documents count nothing.
Fitting takes a bounded, hashed sample of ``MAX_RATED`` rated rows: their
sparse features are made by Spark tasks and the likelihood is maximised on the
driver, from at most ``MAX_RATED`` sparse rows (full-batch Adam); thresholds stay ordered since only the first and the
logarithms of the steps between them are free.

Defined cases: a null or wordless text has no word features; a rating row that
is null, names no document or rates a document twice is left out, or counts each
time; with no rated row or one grade only, all tails are 0.5; repeated rows
are scored like others; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

DIMENSIONS = 1 << 16
SHAPE = 6
#: Bound of the sample of rated rows that the model is fitted on.
MAX_RATED = 12_000
ROUNDS, RATE, PENALTY = 200, 0.05, 1e-3
#: How much the features of the shape count in the fit, next to words.
SHAPE_STRENGTH = 10
#: Rated documents that a word must be in.
LEAST = 5
#: Weights that a task remembers by word; it starts afresh beyond.
REMEMBERED_WORDS = 300_000

FEATURES = T.StructType([T.StructField("places", T.BinaryType()), T.StructField("values", T.BinaryType())])


WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


def shape_of(text: str | None, words: list[bytes]) -> np.ndarray:
    """Shares of capitals, digits, other signs and repeated words, and the logarithm of the length."""
    out = np.zeros(SHAPE, np.float32)
    if words:
        codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(codes)
        kinds = np.bincount(KINDS[codes], minlength=4)
        out[:] = kinds[1] / n, kinds[2] / n, kinds[3] / n, 1 - len(set(words)) / len(words), np.log1p(len(words)) / 10, 1
    return out


KINDS = np.zeros(256, np.int64)
KINDS[65:91] = 1
KINDS[48:58] = 2
for _sign in b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~":
    KINDS[_sign] = 3


def place(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % DIMENSIONS


def features(rows: DataFrame, text_col: str, *others: str) -> DataFrame:
    """``others`` and the sparse features of each text, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                at = np.unique(np.fromiter(map(place, words), np.int32, len(words)))
                shape = shape_of(text, words)
                places.append(np.concatenate([at, DIMENSIONS + np.arange(SHAPE)]).astype("<i4").tobytes())
                values.append(np.concatenate([np.ones(len(at)), shape]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=schema.names)

    schema = T.StructType([rows.schema[c] for c in others] + FEATURES.fields)
    return mapped(rows.select(text_col, *others), run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a row for each score."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def strengths(at: np.ndarray, row: np.ndarray, grade: np.ndarray, top: int) -> np.ndarray:
    """How much each place counts in the fit; those of the shape count alike."""
    width = DIMENSIONS + SHAPE
    out = np.zeros(width)
    for k in range(1, top + 1):
        high = grade >= k
        with_high, with_low = (np.bincount(at[m[row]], minlength=width) for m in (high, ~high))
        ratio = np.log((with_high + 1) / (high.sum() + 2)) - np.log((with_low + 1) / ((~high).sum() + 2))
        out = np.maximum(out, np.abs(ratio))
    out[np.bincount(at, minlength=width) < LEAST] = 0
    out[DIMENSIONS:] = SHAPE_STRENGTH
    return out


def fit(rated: list[tuple[int, bytes, bytes]], top: int) -> Model:
    """Maximum likelihood of the cumulative-link model; ``rated`` has (grade, places, values)."""
    width = DIMENSIONS + SHAPE
    if not rated or len({g for g, _, _ in rated}) < 2:
        return Model(np.zeros(width, np.float32), np.zeros(max(1, top)))
    at = [np.frombuffer(p, "<i4") for _, p, _ in rated]
    row = np.repeat(np.arange(len(rated)), [len(a) for a in at])
    at, value = np.concatenate(at), np.concatenate([np.frombuffer(v, "<f4") for _, _, v in rated]).astype(np.float64)
    grade = np.array([g for g, _, _ in rated])
    strength = strengths(at, row, grade, top)
    value *= strength[at]
    share = np.clip([(grade >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    weights, free = np.zeros(width), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, free)]
    for step in range(1, ROUNDS + 1):
        thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(row, value * weights[at], minlength=len(grade))
        tail = np.concatenate([np.ones((len(grade), 1)), sigmoid(score[:, None] - thresholds), np.zeros((len(grade), 1))], axis=1)
        slope = tail * (1 - tail)
        index = np.arange(len(grade))
        mass = np.maximum(tail[index, grade] - tail[index, grade + 1], 1e-9)
        by_score = -(slope[index, grade] - slope[index, grade + 1]) / mass / len(grade)
        by_threshold = np.zeros(top)
        for k in range(1, top + 1):
            by_threshold[k - 1] = (np.where(grade == k, slope[:, k], 0) - np.where(grade == k - 1, slope[:, k], 0)).dot(1 / mass) / len(grade)
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradients = [
            np.bincount(at, value * by_score[row], minlength=width) + PENALTY * weights,
            np.concatenate([later[:1], later[1:] * np.exp(free[1:])]),
        ]
        for p, g, m in zip((weights, free), gradients, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model((weights * strength).astype(np.float32), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def learn(rated: DataFrame, grade_col: str = "grade", text_col: str = "text") -> tuple[Model, int]:
    """(model, top grade) from ``rated`` rows, a sample of MAX_RATED of them at most, nearly."""
    rows = rated.where(F.col(grade_col).isNotNull()).select(F.col(grade_col).cast("int").alias("grade"), F.col(text_col).alias("text"))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.max("grade").alias("top")).first()
    if not counted["n"]:
        return fit([], 1), 1
    draw = F.pmod(F.xxhash64("text", "grade"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < MAX_RATED / counted["n"]) if counted["n"] > MAX_RATED else rows
    found = features(sample, "text", "grade").collect()
    found.sort(key=lambda r: (r["grade"], bytes(r["places"]), bytes(r["values"])))  # the sums don't depend on the order of rows
    return fit([(r["grade"], bytes(r["places"]), bytes(r["values"])) for r in found], counted["top"]), counted["top"]


class Weigher(dict):
    """Places of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        self[word] = found = place(word)
        return found


def score(docs: DataFrame, model: Model, at_least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, a tail for each grade and ``selected`` (tail at ``at_least`` of one half or more)."""
    top = len(model.thresholds)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("expected_grade", T.DoubleType())]
        + [T.StructField(f"p_at_least_{k}", T.DoubleType()) for k in range(1, top + 1)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, places = shipped.value, Weigher()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                at = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                scores[i] = model.weights[np.unique(at)].sum(dtype=np.float64) + shape_of(text, words).dot(model.weights[DIMENSIONS:])
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), *map(pa.array, tails.T.copy())], names=schema.names)

    out = mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema)
    return out.withColumn("selected", F.col(f"p_at_least_{min(at_least, top)}") >= 0.5)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades of binary labels: 0 toxic, 1 of low quality, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled documents, score all.

    Labels are sampled before they meet texts, so the join broadcasts MAX_RATED
    of them at most, nearly, and shuffles no text.
    """
    graded = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id is not null and grade is not null")
    n = graded.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = graded.where(draw < MAX_RATED / n) if n > MAX_RATED else graded
    model, _ = learn(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    return score(docs, model, at_least=2)
