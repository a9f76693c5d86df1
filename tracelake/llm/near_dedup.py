"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct five-word shingles (the whole sequence
when it has fewer words).  Two permutations make the signature: the first
scrambles a shingle's hash, the second ranks it, and coordinate k ranks the
scrambled values shifted circularly by k.  So all ``COORDINATES`` minima come
from one set of values, with an addition in place of each further permutation.
``ROWS`` coordinates form the key of a band; documents that share a band key
are candidates.

Equal sets are folded to one representative first (their smallest ``doc_id``),
so copies cost nothing further.  Candidates of a bucket are not paired with
each other.  In a star round every representative takes one candidate, the
bucket's centre that agrees with it best; its link is verified on the full sets
and verified links are joined into components.  Buckets whose members all lie
in one component are settled.  In a bucket that still spans components, every
pair of members in different components is considered, in blocks of bounded
size inside the tasks, twice.  First on longer digests alone, which tells the
members that have a pair to verify at all; then these, with their texts, are
verified, the most alike pairs first, and only links that join components leave
a task.  No candidate is left out, pairs within a component never arise, and
texts are copied to blocks for those members only.

Before a candidate pair is verified, it must pass two tests on what the
representatives carry: the ratio of set sizes that the threshold
needs (exact), and the agreement of two-bit digests of the coordinates, with
bounds 5 (star round) and 4.5 (later) standard deviations below what the
threshold implies.  Links are confirmed on the full sets, as sets of 64-bit
hashes of the shingles.

Chances at similarity 0.75, less at every higher one: a pair shares no band with
probability (1 - 0.75 ** 4) ** 32 = 5e-6, and fails a digest test with 4e-6.

Defined cases: a null or wordless text has an empty set, is its own component
and kept; rows without ``doc_id`` get no component and are kept; rows that
repeat a ``doc_id`` are rows of one node; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, cut, held, mapped, only_ids
from .graph import components

WORDS = 5
#: A pair is linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Two-bit digests that must agree, of COORDINATES: 104 expected at 0.75, less five deviations of 4.4.
AGREE = 82
#: Values of shingles handled at once, to stay within a processor's cache.
BLOCK = 1 << 16
#: Star rounds before the remaining pairs across components are sought.
STAR_ROUNDS = 1
#: Coordinates of the finer digests, and how many must agree: 832 expected at 0.75, less 4.5 deviations of 12.5.
FINE_COORDINATES, FINE_AGREE = 1024, 776
#: Members of a bucket, and shingles of them, that are compared in one piece, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1000, 4_000_000
#: Rows of one key that a share of a join has, about.
SHARE_ROWS = 5_000
#: Sizes of sets by powers of this: sets two classes apart differ by more than the threshold allows (4/3, and some room for rounding).
SIZE_CLASS = 1.34
#: Copies in which the sizes of very many large buckets are joined.
SHARES = 64

SIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
     T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
)
FINE = T.StructType(
    [T.StructField("rep", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.BinaryType()),
     T.StructField("wide", T.BinaryType())]
)
HOPEFUL = T.StructType([T.StructField("band", T.LongType()), T.StructField("rep", T.LongType())])
LINKED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

U64 = np.uint64
MULTIPLIERS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, U64)
    n = len(words)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, n)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(hashed.tobytes(), seed=n)], U64)
    total = hashed[: n - WORDS + 1] * MULTIPLIERS[0]
    for j in range(1, WORDS):
        total = total + hashed[j : n - WORDS + 1 + j] * MULTIPLIERS[j]
    return np.unique(mix(total))


def rank(x: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation, of 32-bit values, in place."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row of ``coordinates`` minima for each non-empty set."""
    out = np.empty((len(sets), coordinates), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= BLOCK):
            size += len(sets[j])
            j += 1
        # The first permutation scrambles; its upper half is uniform over 32 bits.
        scrambled = (np.concatenate(sets[i:j]) * U64(0xFF51AFD7ED558CCD) >> U64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        ranked, spare = np.empty_like(scrambled), np.empty_like(scrambled)
        for k in range(coordinates):
            np.add(scrambled, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=ranked)  # the circular shift
            rank(ranked, spare)
            out[i:j, k] = np.minimum.reduceat(ranked, starts)
        i = j
    return out


def banded(minima: np.ndarray) -> np.ndarray:
    """Band keys of each row."""
    x = minima.astype(U64).reshape(len(minima), BANDS, ROWS)
    keys = mix(x[:, :, 0] | x[:, :, 1] << U64(32)) + mix((x[:, :, 2] | x[:, :, 3] << U64(32)) + U64(1)) * MULTIPLIERS[0]
    return mix(keys + np.arange(BANDS, dtype=U64) * MULTIPLIERS[1]).view(np.int64)


def digested(minima: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates in a 64-bit value."""
    bits = ((minima ^ minima >> np.uint32(13)) & np.uint32(3)).astype(U64).reshape(len(minima), minima.shape[1] // 32, 32)
    return np.bitwise_or.reduce(bits << (U64(2) * np.arange(32, dtype=U64)), axis=2).view(np.int64)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nothing")
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                minima = signatures(full)
                bands, sketch = iter(banded(minima)), iter(digested(minima))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(len, sets), pa.int64()),
                     pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                     pa.array([next(sketch) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    names=SIGNED.names,
                )

    return mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, SIGNED)


def agreeing(x: str, y: str):
    """How many two-bit digests of two sketches agree."""
    total = None
    for i in range(COORDINATES // 32):
        odd = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        differ = F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        total = differ if total is None else total + differ
    return F.lit(COORDINATES) - total


def plausible(p: str, q: str):
    """The tests that need no text, on columns n_<p>, sketch_<p> and n_<q>, sketch_<q>."""
    n, m = F.col(f"n_{p}"), F.col(f"n_{q}")
    sized = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return sized & (agreeing(f"sketch_{p}", f"sketch_{q}") >= AGREE)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets; ``docs`` is (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nothing")
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, U64))  # pairs of one centre follow each other
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if y != last[0]:
                    last = (y, shingles(y))
                if jaccard_linked(shingles(x), last[1]):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=LINKED.names)

    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = only_ids(docs, "doc_id", ids, ids.count())
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = in_shares(with_a, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b", "a", pairs)
    return mapped(both.sortWithinPartitions("b"), run, LINKED)


def in_shares(rows: DataFrame, side: DataFrame, key: str, spread: str, counted: DataFrame) -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, which many rows may have: each SHARE_ROWS of them get a copy of the side.

    ``counted`` has the same keys as ``rows``, as often; ``spread`` deals the rows of a key.
    """
    hot = cut(counted.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("shares")).where(F.col("shares") > 1))
    n = hot.count()
    if not n:
        return rows.join(side, key)
    hot = F.broadcast(hot) if n <= BROADCAST_IDS else hot
    shares = F.coalesce("shares", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("share", F.pmod(F.xxhash64(spread), shares).cast("int")).drop("shares")
    right = side.join(hot, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    return left.join(right, [key, "share"]).drop("share")


def star_pairs(members: DataFrame, reps: DataFrame, turn: int) -> DataFrame:
    """For each representative outside a bucket's largest component: its best plausible centre.

    ``members`` is (band, rep, label) of unsettled buckets.  Centre of a bucket
    is a member of its most frequent label, another one each turn.
    """
    order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    by_label = members.groupBy("band", "label").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "rep"))["rep"].alias("centre"))
    top = by_label.groupBy("band").agg(F.max(F.struct("n", (-F.col("label")).alias("l"), "centre")).alias("top"))
    centres = top.select("band", (-F.col("top.l")).alias("main"), F.col("top.centre").alias("c"))
    met = in_shares(members, centres, "band", "rep", members).where(F.col("label") != F.col("main"))
    met = cut(met.select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct())
    with_a = met.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    met = in_shares(with_a, reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b", "a", met)
    near = met.where(plausible("a", "b")).select("a", "b", agreeing("sketch_a", "sketch_b").alias("agree"))
    return near.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b"))


def fine(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, key of the text, n, bands, wide) of the given ``rep`` ids: band keys and two-bit digests of FINE_COORDINATES minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nothing")
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingles(t) for t in batch.column(1).to_pylist()]
                kept = pa.array([len(s) > 0 for s in sets], pa.bool_())
                sets = [s for s in sets if len(s)]
                minima = signatures(sets, FINE_COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(kept), batch.column(2).filter(kept), pa.array(map(len, sets), pa.int64()),
                     pa.array([r.tobytes() for r in banded(minima[:, :COORDINATES])], pa.binary()),
                     pa.array([r.tobytes() for r in digested(minima)], pa.binary())],
                    names=FINE.names,
                )

    ids = cut(reps.select(F.col("rep").alias("doc_id")).distinct())
    return mapped(only_ids(docs, "doc_id", ids, ids.count()).select("doc_id", "text", F.xxhash64("text")), run, FINE)


def jaccard_linked(s: np.ndarray, t: np.ndarray) -> bool:
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return shared > 0 and 100 * shared >= PERCENT * (len(s) + len(t) - shared)


class Block:
    """Members of one pair of blocks ``at`` = (band, i, j), by column."""

    def __init__(self, at: tuple, rows: dict[str, list]) -> None:
        self.at, self.texts = at, rows.get("text", [])
        self.rep, self.label, self.n, self.block = (np.array(rows[c]) for c in ("rep", "label", "n", "block"))
        self.bands = np.frombuffer(b"".join(rows["bands"]), np.int64).reshape(len(self.rep), BANDS)
        self.wide = np.frombuffer(b"".join(rows["wide"]), U64).reshape(len(self.rep), -1)

    def partners(self, x: int) -> list[int]:
        """Members of other components that pass the digest test with ``x``, the most alike first.

        A pair that shares several bands is seen in the first of them alone.
        """
        # Within one block each pair once; between two blocks the first block's rows against the second's.
        band, i, j = self.at
        other = (self.rep > self.rep[x]) if i == j else (self.block != self.block[x]) & (self.block[x] == i)
        sized = np.minimum(self.n, self.n[x]) * 100 >= np.maximum(self.n, self.n[x]) * PERCENT
        y = np.flatnonzero(other & (self.label != self.label[x]) & sized)
        odd = self.wide[y] ^ self.wide[x]
        agree = FINE_COORDINATES - np.bitwise_count((odd | odd >> U64(1)) & U64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
        y, agree = y[agree >= FINE_AGREE], agree[agree >= FINE_AGREE]
        first = self.bands[x][(self.bands[y] == self.bands[x]).argmax(axis=1)] == band
        return y[first][np.argsort(-agree[first], kind="stable")].tolist()

    def hopeful(self) -> list[tuple[int, int]]:
        """(band, rep) of the members with a pair to verify."""
        found = set()
        for x in range(len(self.rep)):
            if partners := self.partners(x):
                found |= {x, *partners}
        return [(self.at[0], int(self.rep[k])) for k in sorted(found)]

    def links(self) -> list[tuple[int, int]]:
        """Verified links that join components; a pair whose components the block has joined already needs no test."""
        sets: dict[int, np.ndarray] = {}
        found = []
        for x in range(len(self.rep)):
            for k in self.partners(x):
                if self.label[k] == self.label[x]:
                    continue
                for m in (x, k):
                    if m not in sets:
                        sets[m] = shingles(self.texts[m])
                if jaccard_linked(sets[x], sets[k]):
                    found.append((int(self.rep[x]), int(self.rep[k])))
                    self.label[self.label == self.label[k]] = self.label[x]
        return found


def each_block(batches: Iterator[pa.RecordBatch], told: Callable[[Block], list[tuple[int, int]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What is ``told`` of each pair of blocks; rows come in order of band, i, j."""
    rows: dict[str, list] = {}
    at: tuple | None = None
    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for values in zip(*columns.values(), strict=True):
            r = dict(zip(columns, values, strict=True))
            if (r["band"], r["i"], r["j"]) != at:
                if at:
                    out += told(Block(at, rows))
                at, rows = (r["band"], r["i"], r["j"]), {c: [] for c in columns}
            for c, v in r.items():
                rows[c].append(v)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
    if at and (out := told(Block(at, rows))):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)


def dealt(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of buckets, dealt to blocks, once for each pair of blocks that can have a link; rows of a pair lie together.

    The blocks of a large bucket hold sets of one class of sizes, and meet those
    of the same and the next classes; others differ too much to be linked.

    ``sizes`` has (band, rep, n) of the same members.  Only buckets of several
    blocks are told to their members: few are broadcast, more are joined in
    SHARES copies, so the members of a large bucket never meet in one task.
    """
    size_class = lambda n: F.floor(F.log(n) / math.log(SIZE_CLASS)).cast("int")
    enough = F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)
    by_class = sizes.groupBy("band", size_class("n").alias("class")).agg(enough.alias("enough"))
    classes = F.array_sort(F.collect_list(F.struct("class", F.ceil("enough").cast("int").alias("blocks"))))
    large = by_class.groupBy("band").agg(F.sum("enough").alias("all"), classes.alias("classes")).where(F.col("all") > 1)
    start = lambda k: F.aggregate(F.slice("classes", F.lit(1), k), F.lit(0), lambda n, x: n + x["blocks"])
    numbered = F.transform("classes", lambda x, k: F.struct(x["class"].alias("class"), x["blocks"].alias("blocks"), start(k).alias("start")))
    large = cut(large.select("band", numbered.alias("classes")))
    if large.count() <= BROADCAST_IDS // 64:  # a bucket has some dozens of classes at most
        told = members.join(F.broadcast(large), "band", "left")
    else:
        copies = large.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        told = members.withColumn("share", F.pmod(F.hash("rep"), F.lit(SHARES))).join(copies, ["band", "share"], "left")
    placed = told.withColumn("own", size_class("n"))
    mine = F.filter("classes", lambda x: x["class"] == F.col("own"))[0]
    block = F.coalesce(mine["start"] + F.pmod(F.xxhash64("rep"), mine["blocks"]).cast("int"), F.lit(0))
    near = F.filter("classes", lambda x: F.abs(x["class"] - F.col("own")) <= 1)
    others = F.flatten(F.transform(near, lambda x: F.sequence(x["start"], x["start"] + x["blocks"] - 1)))
    placed = placed.withColumns({"block": block, "others": F.coalesce(others, F.array(F.lit(0)))})
    pairs = F.transform("others", lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    return placed.select(*members.columns, "block", F.inline(pairs)).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def cross_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of members of a bucket; every pair across components is considered.

    Members of a bucket are dealt to blocks of BLOCK_MEMBERS, and each pair of
    blocks is compared by itself, so a large bucket is spread over many tasks.
    """
    digests = cut(fine(members, docs))
    rows = members.select("band", "rep", "label").join(digests, "rep")
    hopeful = cut(mapped(dealt(rows.drop("key"), rows), lambda batches: each_block(batches, Block.hopeful, HOPEFUL.names), HOPEFUL).distinct())
    ids = cut(hopeful.select(F.col("rep").alias("doc_id")).distinct())
    texts = only_ids(docs, "doc_id", ids, ids.count()).select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("key"), "text")
    # An id may stand for several texts.
    left = rows.join(hopeful, ["band", "rep"])
    chosen = left.join(texts.dropDuplicates(["rep", "key"]), ["rep", "key"]).drop("key")
    return mapped(dealt(chosen, left), lambda batches: each_block(batches, Block.links, LINKED.names), LINKED)


def classes(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, component) of each distinct non-empty set: the smallest doc_id reachable."""
    kept = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    folded = cut(
        kept.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        )
    )
    reps = folded.groupBy("rep").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    banded_reps = folded.select("rep", F.explode("bands").alias("band"))
    shared = banded_reps.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi"))
    members = cut(banded_reps.join(shared.select("band"), "band").distinct())
    reps = cut(reps.join(members.select("rep").distinct(), "rep", "left_semi"))
    edges = labels = None
    open_members = members.withColumn("label", F.col("rep"))
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            linked = cut(verify(cut(star_pairs(open_members, reps, turn)), docs))
        else:
            linked = cut(cross_links(open_members, docs))
        if linked.limit(1).count():
            edges = linked if edges is None else edges.union(linked)
            labels = components(edges)
            joined = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            labelled = joined.select("rep", "band", F.coalesce("label", "rep").alias("label"))
            spread = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi"))
            open_members = labelled.join(spread.select("band"), "band")
            if turn < STAR_ROUNDS:
                open_members = cut(open_members)  # the next turn reads them many times
    out = folded.select("digest", "rep")
    if labels is None:
        return out.select("digest", F.col("rep").alias("component"))
    return out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(sign(texts))
    found = classes(signed, texts)
    rows = signed.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller ``doc_id``."""
    gone = cut(assign(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct())
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
