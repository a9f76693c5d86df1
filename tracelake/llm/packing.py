"""Best-fit packing of tokenised documents by exact-complement hashing.

``tokenise`` cuts documents into pieces of at most ``capacity`` tokens;
``pack`` gives every piece a sequence and a place in it; ``sequences`` puts the
ids of packed pieces together.

The plan depends only on how many pieces there are of each length, a histogram
of at most ``capacity`` counts whatever the input.  Single lengths, pairs and
triples are indexed by their sums.  For the gap that a length leaves they are
looked up in this order; a combination that fills the gap exactly is consumed as
often as all its members are available.  What finds no exact complement is
packed by best fit: the longest length that still fits enters, and the rest of
the gap is looked up again, until nothing fits.  Each step exhausts a length, so
the plan is a short list of patterns (lengths side by side) with the number of
sequences made of each, and each pattern hands out ranges of ranks to its
lengths.

Pieces then get a rank among those of their length.  Ranks are counted within
(length, salt) groups and shifted by the sizes of the groups before.  A length
that c pieces have is dealt to sqrt(c) groups of about sqrt(c) pieces, so one
that a third of all pieces have is spread over many tasks at every size.  A
join of the ranks with the plan's ranges yields sequence and offset.  Token ids
stay in the table of pieces; only places and lengths are shuffled.

Defined cases: a null text is an empty one; an empty document is its end token
alone; repeated rows are packed as separate documents; an empty table gives an
empty result; other columns of the pieces are carried through by ``pack``.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, held, mapped, shared_path

CAPACITY = 1024
END_ID = 2
#: Bytes of triples that the plan keeps; those asked for the longest ago are found anew.
TRIPLE_BYTES = 32 << 20

PLACE = [("doc_id", T.LongType(), pa.int64()), ("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64())]

#: How a byte-level tokenizer splits a text before it merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The split pattern tracks back over white space, and has no room left for that in runs of a million characters; runs from this length on are cut out first.
LONG_RUN = 100_000
#: What white space is in the pattern (Python's own has four more).
WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


class TextIds:
    """Token ids (little-endian unsigned 32-bit) of texts, as the tokenizers library gives them for a file.

    A byte-level BPE whose ids follow its merges is its own table of ranks, and
    a rank encoder gives the same ids in a quarter of the time; other files are
    left to the tokenizers library.  Added tokens of the file are tokens
    wherever their strings stand in a text.
    """

    def __init__(self, path: str) -> None:
        self.fast = self.slow = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if ranks := self.ranks_of(spec):
            import tiktoken

            encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.fast, self.one_piece = encoding.encode_to_numpy, encoding._encode_single_piece
            self.run = re.compile(f"(?<!{WHITE}){WHITE}{{{LONG_RUN},}}")
            self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    @staticmethod
    def ranks_of(spec: dict) -> dict[bytes, int] | None:
        """Ranks of byte strings, if the ids of the file follow its merges."""
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or {k: splitter.get(k) for k in plain} != plain:
            return None
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        in_order = all(vocabulary.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merged))
        if not in_order or len(vocabulary) != 256 + len(merged) or model.get("end_of_word_suffix"):
            return None
        return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}

    def of(self, text: str) -> bytes:
        if self.fast is None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.mark is None or not any(t in text for t in self.added):
            return self.between_marks(text).astype("<u4", copy=False).tobytes()
        ids = [np.array([self.added[t]], "<u4") if t in self.added else self.between_marks(t) for t in self.mark.split(text) if t]
        return np.concatenate([np.empty(0, "<u4"), *ids]).astype("<u4").tobytes()

    def between_marks(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens.

        A run of white space is one piece of the split, but for its last
        character where more text follows, so long ones are encoded alone.
        """
        if len(text) < LONG_RUN:
            return self.fast(text, disallowed_special=())
        ids, at = [], 0
        for found in self.run.finditer(text):
            start, end = found.start(), found.end() - (found.end() < len(text))
            ids += [self.fast(text[at:start], disallowed_special=()), np.array(self.one_piece(text[start:end]), "<u4")]
            at = end
        return np.concatenate([*ids, self.fast(text[at:], disallowed_special=())])


def text_ids(path: str) -> TextIds:
    """One for each worker process, which runs many tasks."""
    return held(f"ids of {path}", lambda: TextIds(path))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and ``end_id``, cut into pieces."""
    end = np.array([end_id], "<u4").tobytes()
    names, types, arrow = zip(*PLACE, ("ids", T.BinaryType(), pa.binary()), strict=True)
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(tokenizer)
        for batch in (whole.slice(at, 400) for whole in batches for at in range(0, whole.num_rows, 400)):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encoder.of(text or "") + end)
                rows += [(doc, i, s, n, bytes(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
            if rows:
                columns = zip(zip(*rows, strict=True), arrow, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=list(names))

    return mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, schema)


class Sums:
    """Hash indexes of the sums of one, two and three lengths; an entry is made when its sum is first asked for.

    Single sums are the lengths themselves.  An entry of ``pairs`` or ``triples``
    has every combination of lengths with that sum, longest member first, so its
    size depends on the capacity alone.  All triples together grow with its cube,
    so only TRIPLE_BYTES of them are kept.
    """

    def __init__(self, lengths: Iterable[int], capacity: int) -> None:
        self.has = np.zeros(capacity + 1, bool)
        self.has[list(lengths)] = True
        self._pairs: dict[int, np.ndarray] = {}
        self._triples: dict[int, np.ndarray] = {}
        self.kept = 0

    def pairs(self, total: int) -> np.ndarray:
        """Rows (a, b) with a >= b."""
        if total not in self._pairs:
            a = np.arange((total + 1) // 2, total)[::-1]
            a = a[self.has[a] & self.has[total - a]]
            self._pairs[total] = np.stack([a, total - a], axis=1).astype(np.int16)
        return self._pairs[total]

    def triples(self, total: int) -> np.ndarray:
        """Rows (a, b, c) with a >= b >= c."""
        rows = self._triples.pop(total, None)
        if rows is None:
            lengths = np.flatnonzero(self.has)[::-1].astype(np.int16)
            a, b = lengths[(lengths <= total - 2) & (lengths >= -(-total // 3))][:, None], lengths[lengths <= total // 2]
            c = total - a - b
            x, y = np.nonzero((b <= a) & (c <= b) & (c > 0) & self.has[np.maximum(c, 0)])
            rows = np.stack([a[x, 0], b[y], c[x, y]], axis=1).astype(np.int16)
            self.kept += rows.nbytes
            while self._triples and self.kept > TRIPLE_BYTES:
                self.kept -= self._triples.pop(next(iter(self._triples))).nbytes
        self._triples[total] = rows  # the last asked for is the last to go
        return rows


class Available:
    """Counts of free pieces by length, taken by exact complements and by best fit."""

    def __init__(self, counts: dict[int, int], capacity: int, sums: Sums) -> None:
        self.capacity, self.sums = capacity, sums
        self.free = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.free[n] = c
        self.made: list[tuple[tuple[int, ...], int]] = []

    def consume(self, pattern: tuple[int, ...]) -> None:
        """Make as many sequences of a pattern as its pieces are there for."""
        need = Counter(pattern)
        if times := min(int(self.free[n]) // k for n, k in need.items()):
            for n, k in need.items():
                self.free[n] -= k * times
            self.made.append((pattern, times))

    def complement(self, pattern: tuple[int, ...], floor: int) -> tuple[int, ...] | None:
        """``pattern`` with the one, two or three free lengths that fill its gap exactly.

        Of several combinations the one whose scarcest length is the most
        available is taken; two and three lengths have ``floor`` tokens or more.
        """
        gap, used = self.capacity - sum(pattern), Counter(pattern)
        if not gap:
            return pattern
        if self.free[gap] > used[gap]:
            return (*pattern, gap)
        for index in (self.sums.pairs, self.sums.triples) if gap > 1 else ():
            rows = index(gap)
            rows = rows[(rows[:, 0] <= pattern[-1]) & (rows[:, -1] >= floor)]
            spare = self.free[rows].min(axis=1)
            while len(rows) and spare.max() > 0:
                row = rows[best := int(spare.argmax())].tolist()
                if all(self.free[n] >= k + used[n] for n, k in Counter(row).items()):
                    return (*pattern, *row)
                spare[best] = 0
        return None

    def filled(self, first: int, floor: int) -> tuple[int, ...]:
        """``first`` with an exact complement; where there is none, best fit adds the longest free length that fits, and so on."""
        pattern, used = (first,), Counter([first])
        while True:
            if whole := self.complement(pattern, floor):
                return whole
            fitting = np.flatnonzero(self.free[: self.capacity - sum(pattern) + 1])[::-1]
            longest = next((n for n in fitting.tolist() if self.free[n] > used[n]), 0)
            if not longest:
                return pattern
            pattern, used = (*pattern, longest), used + Counter([longest])


#: Parts of the capacity that the lengths in pairs and triples have at least; each is tried until the sequences can't be fewer.
FLOORS = (0, 1 / 64, 3 / 64, 3 / 32, 9 / 64, 3 / 16)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of sequences) for the pieces counted by length.

    Single complements are consumed first, for all lengths.  Then lengths are
    taken from the longest down, and a gap is filled by an exact pair or triple
    wherever the indexes have one that is free; best fit packs the residuals.
    The smallest lengths fill the gaps of many longer ones, so pairs and triples
    may have to leave them alone: floors are tried from 1 up, until the tokens need as many
    sequences as there are; the plan with the fewest sequences stays.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    sums, best = Sums(counts, capacity), []
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    size = lambda made: sum(times for _, times in made)
    for floor in FLOORS:
        state = Available(counts, capacity, sums)
        lengths = sorted(counts, reverse=True)
        for first in lengths:
            gap = capacity - first
            if state.free[first] and (not gap or state.free[gap]):
                state.consume((first, gap) if gap else (first,))
        for first in lengths:
            while state.free[first]:
                state.consume(state.filled(first, int(floor * capacity)))
        if not best or size(state.made) < size(best):
            best = state.made
        if size(best) == least:
            break
    return best


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of each place of each pattern."""
    out, given, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            out.append((n, given[n], given[n] + times, sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice and must give the same rows both times: pass a
    table or a checkpoint.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    give_back()  # the driver would keep what its indexes took
    slots = spark.createDataFrame(
        ranges(made), "_len long, _from long, _to long, _sequence long, offset long"
    )
    salts = spark.createDataFrame([(n, math.isqrt(c - 1) + 1) for n, c in counts.items()], "_len long, _salts long")
    hashed = F.xxhash64("doc_id", "piece")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_len")).drop("_len")  # at most `capacity` rows
    salted = salted.withColumn("_salt", F.pmod(hashed, F.col("_salts"))).drop("_salts")
    group = Window.partitionBy("length", "_salt").orderBy(*[c for c in ("doc_id", "piece") if c in pieces.columns])
    # The sizes of the groups before a group.
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = (
        salted.withColumn("_turn", F.row_number().over(group) - 1)
        .join(shift, ["length", "_salt"])
        .withColumn("_rank", F.col("_turn") + F.col("_shift"))
    )
    placed = ranked.join(  # the plan has a few thousand ranges, whatever the input
        F.broadcast(slots),
        (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    )
    return placed.select(
        *pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence's pieces, one after another."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length",
        F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
    )


def written(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    path = shared_path(docs.sparkSession, "pieces")
    tokenise(docs, tokenizer, capacity=capacity).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their ids in ``sequence_id`` and ``offset``; ``sequences`` joins them.

    Pieces are written once to the shared folder, ids and all.
    """
    return pack(written(docs, tokenizer, capacity), capacity)


def digests(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packed pieces with ``ids_crc32`` in place of the ids, which are digested where the pieces are read."""
    pieces = written(docs, tokenizer, capacity)
    return pack(pieces.select(*[n for n, _, _ in PLACE], F.crc32("ids").alias("ids_crc32")), capacity)
