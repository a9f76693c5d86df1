"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of the texts of a
bounded sample of labelled rows.  A text is compressed whole with every
dictionary, in pieces of ``PIECE`` bytes whose sizes add up; the language whose
dictionary gives the fewest bytes wins.  Without pieces a very long text would
become its own dictionary, and its margin would shrink with its length.  Texts
and dictionaries are lower-cased and their runs of other characters than
letters become single spaces, so that shouting, tables and decoration weigh
nothing.  The margin is the second-best size over the best, less one, in which
sizes leave out the frame's constant bytes.  Margins under ``DOUBTFUL`` are
taken anew with a compressor that searches for the cheapest parse and for
matches of three bytes; one under ``NARROW`` then rejects the text.

The sample takes whole texts whose hash falls under a threshold set from the
number of different ones of their language (estimated within a few percent), so
it spreads over the whole table in one pass and has ``SAMPLE_ROWS`` different
texts of each language on average, all of them where there are fewer, however
often they are repeated, and fewer where these would have over SAMPLE_BYTES.
Every language that a labelled text has gets a dictionary.  What the driver
gathers and broadcasts is bounded for each language: SAMPLE_ROWS texts and
SAMPLE_BYTES on average.  Compressors have windows and tables as large as their
dictionary asks, so they find what stands at its start too, up to 16 MB
(zstandard indexes no more of a dictionary); predictions read whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and rejected; without any labelled row every text is; of languages with equal
sizes the more frequent in the labelled rows wins (and is rejected); rows that repeat
or have no ``doc_id`` are predicted like others; other columns play no part.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, held, mapped

#: Different texts that a language's dictionary is made of, and their bytes, on average at most.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 8 << 20
#: Levels of the first compressor and of the finer one, and the margin below which that decides.
LEVEL, FINE_LEVEL, DOUBTFUL = 3, 6, 0.05
#: Bytes of a text that are compressed together; every piece of a long text meets the dictionary afresh.
PIECE = 8192
#: Smaller relative margins reject.
NARROW = 0.002
#: Share of a text's bytes that counts as one unit of evidence in the score.
SHARPNESS = 40.0
UNKNOWN = "und"

PREDICTED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
     T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from labelled ``rows``."""
    labelled = rows.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"), F.avg(F.octet_length("text")).alias("bytes"))
    top = counts.orderBy(F.desc("count"), "lang").collect()  # a row for each language
    # Copies are drawn or left together, so the chance is that of a text.
    chances = [(r["lang"], min(1.0, SAMPLE_ROWS / r["texts"], SAMPLE_BYTES / (r["texts"] * r["bytes"]))) for r in top]
    told = rows.sparkSession.createDataFrame(chances, "lang string, chance double")
    drawn = labelled.join(F.broadcast(told) if len(chances) <= BROADCAST_IDS else told, "lang")
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = drawn.where(draw < F.col("chance")).select("lang", "text")
    content: dict[str, list[str]] = {}
    for r in sample.distinct().orderBy("lang", F.xxhash64("text")).collect():  # about SAMPLE_ROWS a language
        content.setdefault(r["lang"], []).append(r["text"])
    return {r["lang"]: b"".join(map(plain, content[r["lang"]])) for r in top if r["lang"] in content}


OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters, with one space for each run of other characters."""
    return f" {OTHER.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass")


def reach(size: int, level: int) -> dict[str, int]:
    """Logarithms of the window and tables that let a compressor see a dictionary of ``size`` bytes to its start.

    A level's own ones are made for short texts: of a dictionary over 1 MB they see the end alone.
    """
    usual = zstandard.ZstdCompressionParameters.from_level(level, dict_size=size)
    bits = (size + PIECE).bit_length()
    return {"window_log": max(usual.window_log, bits), "hash_log": max(usual.hash_log, bits), "chain_log": max(usual.chain_log, bits)}


class Sizes:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, content: dict[str, bytes]) -> None:
        self.langs = list(content)
        self.coarse = self.compressors(content.values(), LEVEL)
        self.fine = self.compressors(content.values(), FINE_LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTOPT, search_log=3)
        self.empty = min((len(c(b"")) for c in self.coarse), default=0)

    @staticmethod
    def compressors(dictionaries: Iterable[bytes], level: int, **more: int) -> list[Callable[[bytes], bytes]]:
        out = []
        for data in dictionaries:
            how = zstandard.ZstdCompressionParameters.from_level(
                level, dict_size=len(data), write_content_size=False, write_checksum=False, write_dict_id=False, **(reach(len(data), level) | more)
            )
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress)
        return out

    def best(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin)."""
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        for compressors in (self.coarse, self.fine):
            sizes = [max(1, sum(len(c(p)) - self.empty for p in pieces)) for c in compressors]
            order = sorted(range(len(sizes)), key=sizes.__getitem__)
            first = sizes[order[0]]
            margin = sizes[order[1]] / first - 1.0 if len(order) > 1 else 1.0
            if margin >= DOUBTFUL:
                break
        odds = sum(math.exp(-SHARPNESS * (s - first) / len(data)) for s in sizes)
        return self.langs[order[0]], 1.0 / odds, margin


def predict(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) of each row."""
    spark = docs.sparkSession
    shipped_as = uuid.uuid4().hex
    shipped = spark.sparkContext.broadcast(content)  # the texts of about SAMPLE_ROWS rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = held(f"dictionaries {shipped_as}", lambda: Sizes(shipped.value))
        for batch in batches:
            rows = []
            for text, letter in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(sizes.best(text) if letter and sizes.langs else (UNKNOWN, 0.0, 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.float64()), pa.array([r[2] < NARROW for r in rows], pa.bool_())],
                names=PREDICTED.names,
            )

    return mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col), has_letter(F.col(text_col))), run, PREDICTED)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from; so are rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that aren't held out; predict every row."""
    content = learn(docs.where(~held_out()))
    return predict(docs, content).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that identification rejects, ``lang`` as predicted."""
    content = learn(docs.where(~held_out()))
    shipped_as = uuid.uuid4().hex
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    schema = docs.schema
    lang_at, text_at = docs.columns.index("lang"), docs.columns.index("text")
    letter = next(f"_letter{i}" for i in range(len(schema) + 1) if f"_letter{i}" not in {c.lower() for c in docs.columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = held(f"dictionaries {shipped_as}", lambda: Sizes(shipped.value))
        for batch in batches:
            langs: list[str | None] = []
            for text, has in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lang, _, margin = sizes.best(text) if has and sizes.langs else (UNKNOWN, 0.0, 0.0)
                langs.append(lang if margin >= NARROW else None)
            columns = list(batch.columns[:-1])
            columns[lang_at] = pa.array(langs, pa.string())
            found = pa.array([x is not None for x in langs], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(found)

    return mapped(docs.withColumn(letter, has_letter(F.col("text"))), run, schema)
