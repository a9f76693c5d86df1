"""Near-duplicate classes by SimHash, compared exactly in tiles.

A text's features are its shingles of ``SHINGLE`` words, repeats included (the
whole sequence when it has fewer words), and each is hashed by XXH64.  A bit of
the fingerprint is set where it is set in over half the hashes.  Documents are
linked when their fingerprints differ in at most ``RADIUS`` bits.

Equal fingerprints are folded first.  The others are compared in tiles.  A tile
holds the fingerprints with the same population counts in all ``PARTS`` parts of
their bits.  A bit that differs changes one part's count by one, so the counts
of two fingerprints differ by no more, summed over the parts, than the
fingerprints do.  Tile pairs whose counts differ by more than the radius are
skipped: they never meet.  Tiles within the radius have a count vector between
them that is at most one step from either, so each tile is sent to its own cell
and to those one step away (33 cells), and all pairs within the radius meet in
a cell.  There numpy compares whole blocks by exclusive or and bit counts.  Of the
links of a block only a spanning forest leaves the task; it joins the same
documents.  A cell with more than ``CELL_ROWS`` fingerprints is dealt to blocks,
and each pair of blocks is a group of its own, so memory stays bounded and no
pair is left out.

Comparisons still grow with the square of the number of fingerprints in a cell;
for fingerprints of unrelated texts a cell of 16 parts has about one in
3,000,000 of all pairs.

Defined cases: a text without words, or null, has fingerprint zero and is linked
like any other; repeated rows stay, each with its class; rows without
``doc_id`` never name a class (their own ``component_id`` is null if the class
has no id at all); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .common import BROADCAST_IDS, cut, looked_up, mapped

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Parts of a fingerprint whose population counts name its tile, and the bits of each part and of its count.
PARTS, PART_BITS, COUNT_BITS = 16, 4, 3
#: Fingerprints in a cell, or in a block of a larger cell, about.
CELL_ROWS = 8_192
#: Shingle hashes whose bits are counted at once; rows and columns of fingerprints compared at once.
HASHES, ROWS, COLUMNS = 1 << 14, 256, 1 << 14
#: Groups of up to this many are compared by shifts of the whole batch.
SMALL = 48

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, HASHES):
        ones += np.unpackbits(hashes[i : i + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, FINGERPRINTS)


def tile(fp: str = "fp"):
    """The population counts of a fingerprint's parts, COUNT_BITS bits each."""
    out = F.lit(0).cast("long")
    for k in range(PARTS):
        part = F.shiftrightunsigned(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1))
        out = out + F.shiftleft(F.bit_count(part).cast("long"), COUNT_BITS * k)
    return out


def cells(key: str = "tile"):
    """A tile's own cell and those one step away."""
    near = [F.col(key)]
    for k in range(PARTS):
        count, step = F.shiftrightunsigned(key, COUNT_BITS * k).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)), F.lit(1 << COUNT_BITS * k)
        near += [F.when(count < PART_BITS, F.col(key) + step), F.when(count > 0, F.col(key) - step)]
    return F.array_compact(F.array(*near))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) pairs that join the same nodes as the links a-b do."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        for side in (x, y):  # the root of either side gets the smaller label too
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def compared(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links between two blocks, tile by tile."""
    for j in range(0, len(y), COLUMNS):
        part = y[j : j + COLUMNS]
        for i in range(0, len(x), ROWS):
            r, c = np.nonzero(np.bitwise_count(x[i : i + ROWS, None] ^ part[None, :]) <= RADIUS)
            if len(r):
                yield x[i + r], part[c]


def large_group(cell: int, fp: np.ndarray, tiles: np.ndarray, block: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The links that a group of one cell and one pair of blocks has to find.

    Fingerprints of the same tile are compared in that tile's own cell only.
    """
    left, right = block == pair[0], block == pair[1]
    a = b = fp[:0]
    for t in np.unique(tiles[left]):
        others = right if t == cell else right & ((tiles > t) if pair[0] == pair[1] else (tiles != t))
        for x, y in compared(fp[left & (tiles == t)], fp[others]):
            different = x != y
            a, b = forest(np.concatenate([a, x[different]]), np.concatenate([b, y[different]]))
    return a, b


def small_groups(cell: np.ndarray, fp: np.ndarray, tiles: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links within each of many small groups, whose rows follow each other."""
    a, b = [fp[:0]], [fp[:0]]
    rows = np.arange(len(fp))
    for k in range(1, SMALL):
        rows = rows[rows + k < len(fp)]
        rows = rows[group[rows] == group[rows + k]]
        if not len(rows):
            break
        here = rows[(tiles[rows] != tiles[rows + k]) | (tiles[rows] == cell[rows])]
        here = here[np.bitwise_count(fp[here] ^ fp[here + k]) <= RADIUS]
        a.append(fp[here])
        b.append(fp[here + k])
    return np.concatenate(a), np.concatenate(b)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, i, j, tile, block, fp) that come sorted by group (cell, i, j)."""
    columns = ("cell", "i", "j", "tile", "block", "fp")
    rest: list[np.ndarray] | None = None

    def links(c: list[np.ndarray]) -> pa.RecordBatch:
        new = np.ones(len(c[0]), bool)
        new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        group, fp = np.cumsum(new), c[5].view(np.uint64)
        small = (sizes <= SMALL)[group - 1]
        a, b = small_groups(c[0][small], fp[small], c[3][small], group[small])
        a, b = [a], [b]
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            x, y = large_group(c[0][s], fp[s : s + n], c[3][s : s + n], c[4][s : s + n], (c[1][s], c[2][s]))
            a.append(x)
            b.append(y)
        a, b = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in columns]
        now = now if rest is None else [np.concatenate(p) for p in zip(rest, now, strict=True)]
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        end = len(same) if not same.any() else int(np.argmax(same))  # where the last group starts, which may go on
        rest = [x[end:] for x in now]
        if end:
            yield links([x[:end] for x in now])
    if rest is not None:
        yield links(rest)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints ``fp`` that join all that are within the radius of each other."""
    keyed = cut(distinct.select("fp", tile().alias("tile")))
    counted = keyed.groupBy("tile").count().select(F.explode(cells()).alias("cell"), "count").groupBy("cell").agg(F.sum("count").alias("n"))
    large = cut(counted.where(F.col("n") > CELL_ROWS).select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("blocks")))
    n_large = large.count()
    placed = keyed.select("fp", "tile", F.explode(cells()).alias("cell"))
    if n_large:
        placed = placed.join(F.broadcast(large) if n_large <= BROADCAST_IDS else large, "cell", "left")
        blocks = F.coalesce("blocks", F.lit(1))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int"))
        placed = placed.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    else:
        placed = placed.withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    dealt = placed.select("cell", "i", "j", "tile", "block", "fp").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(linked, LINKS)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: 16 hexadecimal digits, and the smallest ``doc_id`` reachable by links."""
    rows = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    classes = graph.components(cut(links(distinct)))
    labelled = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = cut(labelled.select("fp", F.coalesce("label", "fp").alias("label"), "least", "n"))
    named = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    known = cut(looked_up(labelled.select("fp", "label", "n"), named, ["label"], "members").select("fp", "component_id", "n"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return looked_up(rows, known, ["fp"], "n").select("doc_id", digits.alias("fingerprint"), "component_id")
