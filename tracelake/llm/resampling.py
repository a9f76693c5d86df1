"""Importance resampling towards a target distribution, over deduplicated segments.

A text's features are all runs of one to ``max_n`` consecutive words, each in
the bucket that its CRC-32 names.  A bucket's gain is the logarithm of how much
more frequent it is in the target texts than in the documents; a document's
weight is the sum of the gains of its features, repeats included.  With Gumbel
noise of the document's id added, the highest scores are a draw without
replacement in proportion to the weights.

Line feeds separate words, so they cut a text into segments whose features don't
depend on what stands around them.  The distinct lines of all documents are
found once, with their occurrences; tasks fold their own lines before these are
shuffled.  A distinct line's features are counted once and multiplied by its
occurrences for the corpus counts, and its weight is summed once for all
documents that have it.  Only runs of words that cross a line's end are
counted by document, and added separately (none for ``max_n`` 1).  A document
keeps its lines as 128 bits of their SHA-256 and how often each occurs.

The counts of the corpus and the target have ``n_buckets`` entries each, whatever the
input, and alone come to the driver.  Lines that very many documents share are
joined by broadcast (fewer than HOT_SHARE), the others by shuffle.  Ranks come
from a sort by ranges: a row's place in its range and the rows of the ranges
before it, of which the driver sees one count per range.

Defined cases: a text without words, or null, has no feature and weight 0; a
null ``doc_id`` counts as empty in the noise; repeated rows are rows of their
own, in any order among each other; without target words the gains are those of
``T = 0``; an empty table gives an empty result; other columns are not read, or
carried through untouched by ``draw``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_order, looked_up, mapped

MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Letters and digits of ASCII, and all beyond it, in lower-case UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Different features whose bucket a task remembers, and bytes of lines it folds before it passes them on.
KNOWN, FOLD_BYTES = 1 << 18, 16 << 20

DOCS = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("crossing", T.ArrayType(T.IntegerType())),
     T.StructField("lines", T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("times", T.LongType())])))]
)
LINES = T.StructType([T.StructField("line", T.BinaryType()), T.StructField("times", T.LongType()), T.StructField("uses", T.LongType())])
FEATURES = T.StructType(
    [T.StructField("key", T.BinaryType()), T.StructField("times", T.LongType()), T.StructField("uses", T.LongType()), T.StructField("n_words", T.LongType()),
     T.StructField("buckets", T.ArrayType(T.IntegerType()))]
)
COUNTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
WEIGHTS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("uses", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", T.LongType())])
CROSSING = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", T.LongType())])


class Hasher(dict):
    """feature (bytes) -> bucket, remembered."""

    def __init__(self, n_buckets: int) -> None:
        self.n_buckets = n_buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.n_buckets
        return found


def segments(text: bytes | None) -> list[bytes]:
    """The lines of a text that have a word, A-Z in lower case."""
    return [x for x in (text or b"").lower().split(b"\n") if WORD.search(x)]


def key(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()[:16]


def runs(words: list[bytes], max_n: int) -> Iterator[bytes]:
    """All runs of one to ``max_n`` words."""
    return itertools.chain(words, *(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) for n in range(2, max_n + 1)))


def crossing_runs(lines: list[bytes], max_n: int) -> Iterator[bytes]:
    """The runs that start in one line and end in another."""
    if max_n == 1:
        return
    cut_words = [WORD.findall(x) for x in lines]
    words = [w for ws in cut_words for w in ws]
    start = 0
    for ws in cut_words[:-1]:
        end = start + len(ws)
        for n in range(2, max_n + 1):
            for i in range(max(start, end - n + 1), min(end, len(words) - n + 1)):
                yield b" ".join(words[i : i + n])
        start = end


def profiles(docs: DataFrame, max_n: int, n_buckets: int) -> DataFrame:
    """DOCS of rows (row, doc_id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Hasher(n_buckets)
        for batch in batches:
            lines = [segments(t.as_py()) for t in batch.column(2)]
            crossing = [[bucket[f] for f in crossing_runs(ls, max_n)] for ls in lines]
            counted = [[{"key": k, "times": n} for k, n in Counter(map(key, ls)).items()] for ls in lines]
            schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("crossing", pa.list_(pa.int32())), ("lines", pa.list_(pa.struct([("key", pa.binary()), ("times", pa.int64())])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crossing, schema.field(2).type), pa.array(counted, schema.field(3).type)], schema=schema)

    return mapped(docs, run, DOCS)


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(line, times, uses) of a column of texts as bytes: occurrences of each line, and texts that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter = Counter()
        uses: Counter = Counter()
        held = 0

        def folded() -> pa.RecordBatch:
            lines = list(times)
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(list(times.values()), pa.int64()), pa.array([uses[x] for x in lines], pa.int64())], ["line", "times", "uses"])

        for batch in batches:
            for t in batch.column(0):
                lines = segments(t.as_py())
                times.update(lines)
                uses.update(set(lines))
                held += sum(map(len, lines))
                if held >= FOLD_BYTES:
                    yield folded()
                    times, uses, held = Counter(), Counter(), 0
        yield folded()

    return mapped(texts, run, LINES).groupBy("line").agg(F.sum("times").alias("times"), F.sum("uses").alias("uses"))


def line_features(lines: DataFrame, max_n: int, n_buckets: int) -> DataFrame:
    """FEATURES of distinct lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Hasher(n_buckets)
        for batch in batches:
            words = [WORD.findall(x.as_py()) for x in batch.column(0)]
            found = [[bucket[f] for f in runs(ws, max_n)] for ws in words]
            keys = pa.array([key(x.as_py()) for x in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(1), batch.column(2), pa.array(map(len, words), pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["key", "times", "uses", "n_words", "buckets"]
            )

    return mapped(lines, run, FEATURES)


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of an array of lists."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), lengths


def bucket_counts(lists: DataFrame, n_buckets: int) -> np.ndarray:
    """Features in each bucket, of rows (buckets, times); a task passes on one count per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for batch in batches:
            values, lengths = flat(batch.column(0))
            np.add.at(counts, values, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), lengths))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for bucket, n in mapped(lists, run, COUNTS).groupBy("bucket").agg(F.sum("n")).collect():  # n_buckets rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which each bucket is more frequent in the target, floored."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.astype(float), target.astype(float), strict=True)], np.int64)


def sums(lists: pa.Array, gain: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(entries, sum of their gains) of each list of buckets."""
    values, lengths = flat(lists)
    ends = np.concatenate([[0], np.cumsum(gain[values])])
    at = np.concatenate([[0], np.cumsum(lengths)])
    return pa.array(lengths.astype(np.int64)), pa.array(ends[at[1:]] - ends[at[:-1]])


def line_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sums(batch.column(3), gain)], ["key", "uses", "n_words", "n", "w"])

    return mapped(features.select("key", "uses", "n_words", "buckets"), run, WEIGHTS)


def crossing_weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *sums(batch.column(2), gain)], ["row", "doc_id", "n", "w"])

    return mapped(docs.select("row", "doc_id", "crossing"), run, CROSSING)


def profiled(rows: DataFrame, max_n: int, n_buckets: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(documents, distinct lines, bucket counts) of rows (row, doc_id, text as bytes)."""
    docs = cut(profiles(rows, max_n, n_buckets))
    lines = cut(line_features(distinct_lines(rows.select("text")), max_n, n_buckets))
    counts = bucket_counts(lines.select("buckets", "times"), n_buckets)
    if max_n > 1:
        counts += bucket_counts(docs.select("crossing", F.lit(1).cast("long")), n_buckets)
    return docs, lines, counts


def byte_rows(df: DataFrame, row, id_col: str | None, text_col: str) -> DataFrame:
    ident = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return df.select(row.alias("row"), ident.alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the ``percent`` of rows with ``min_words`` words that score highest."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ordered = in_order(scored.where(F.col("n_words") >= min_words), order)
    drawn, rank = percent * ordered.count() // 100, F.col("place") + 1
    placed = ordered.withColumn("rank", F.when(rank <= drawn, rank)).drop("place")
    return placed.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def scores(rows: DataFrame, target: DataFrame, max_n: int, n_buckets: int, min_words: int, percent: int, seed: int) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of rows (row, doc_id, text as bytes)."""
    docs, lines, corpus = profiled(rows, max_n, n_buckets)
    gain = gains(corpus, profiled(target, max_n, n_buckets)[2])
    known = cut(line_weights(lines, gain))
    places = docs.select("row", F.inline("lines"))
    times = F.col("times")
    shared = looked_up(places, known, ["key"], "uses").select("row", F.lit(None).cast("long").alias("doc_id"), (times * F.col("n_words")).alias("n_words"), (times * F.col("n")).alias("n"), (times * F.col("w")).alias("w"))
    own = crossing_weights(docs, gain).select("row", "doc_id", F.lit(0).cast("long").alias("n_words"), "n", "w")
    summed = own.unionByName(shared).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(a) for c, a in (("n_words", "n_words"), ("n", "n_features"), ("w", "weight"))])
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(named, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return ranked(cut(summed.withColumn("score", F.col("weight") + noise.cast("long"))), min_words, percent)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    max_n: int = MAX_N, n_buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; ``rank`` is null where it isn't drawn."""
    rows = byte_rows(docs, F.monotonically_increasing_id(), id_col, text_col)
    wanted = byte_rows(target, F.monotonically_increasing_id(), None, target_col)
    return scores(rows, wanted, max_n, n_buckets, min_words, percent, seed).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", **settings: int) -> DataFrame:
    """The drawn rows of ``docs``, whole; they are written once with a number each, so that the same rows are scored and kept."""
    number = "_row_" + "_".join(docs.columns)
    numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()))
    given = {"max_n": MAX_N, "n_buckets": BUCKETS, "min_words": MIN_WORDS, "percent": PERCENT, "seed": SEED} | settings
    found = scores(byte_rows(numbered, F.col(number), id_col, text_col), byte_rows(target, F.monotonically_increasing_id(), None, target_col), **given)
    return numbered.join(found.where(F.col("rank").isNotNull()).select(F.col("row").alias(number)), number, "left_semi").select(*docs.columns)
