"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (lines).  A paragraph hashes to a wide
vector, and the fingerprint of a text is the sum of its paragraphs' vectors,
each lane modulo a power of two.  Sums don't depend on order, so texts with the
same paragraphs in another order have the same fingerprint, and ``inserted`` /
``deleted`` update a fingerprint by the vectors of the paragraphs that come or
go, without the rest of the text.

A vector has two sections.  ``EQUAL_LANES`` lanes modulo 2**32 hold bits of
seeded 64-bit hashes of the whole paragraph: equality of these sums is equality
of the multisets but for hash collisions.  ``NEAR_LANES`` lanes modulo 2**24
hold a signed count sketch of the paragraph's adjacent word pairs (first and
last words are paired with the paragraph's edge): each pair adds +1 or -1 to one
lane.  The cosine of two such sections estimates how much of their texts two
documents share, also when every paragraph was touched; ``likeness`` is that
cosine, no less than 0, and exactly 1 for equal fingerprints.

``with_neighbours`` needs each document's successor by ``doc_id``.  Rows are
dealt to ranges of ids in two steps, both by approximate quantiles: at most
STEP parts of all ids, and of each part at most STEP ranges, so a table of a
billion rows has a million ranges of RANGE_ROWS rows, and one of fifty billion
has ranges of 50,000.  The first row of each range also enters the range before
it as a guest.  All that follows (successors, the edited texts, sums per
document, successors' fingerprints) keeps that partitioning, so texts are
shuffled once.

Defined cases: a null text is an empty one, which is one empty paragraph; two
texts without any word are alike if they are equal; rows that tie on ``doc_id``
follow each other by text; rows without ``doc_id`` come last, in the order of
hashes of their texts; a single row is its own successor; an empty table gives
an empty result; other columns play no part.  Rows of one id stay in one range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut

EQUAL_LANES, EQUAL_BITS = 16, 32
NEAR_LANES, NEAR_BITS = 64, 24
#: Rows in a range of ids, about, while STEP * STEP ranges are enough.
RANGE_ROWS, STEP = 1_000, 1_000

EDGE = "\u0000"


def paragraphs(text: Column) -> Column:
    """The lines of a text; joined by line feeds they give it back."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def pair_hashes(paragraph: Column) -> Column:
    """A 64-bit hash of each pair of adjacent words; the edges count as words."""
    words = F.filter(F.split(paragraph, "[ \t\r\x0b\f]+"), lambda w: w != "")
    left, right = F.concat(F.array(F.lit(EDGE)), words), F.concat(words, F.array(F.lit(EDGE)))
    return F.when(F.size(words) > 0, F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def lane(value: Column, bits: int) -> Column:
    """``value`` modulo 2**bits."""
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def equal_sums(lines: Column) -> Column:
    """The sums of the equality lanes over the paragraphs of a text, not yet reduced."""
    low = (1 << 32) - 1

    def more(seed: Column):
        def add(sums: Column, line: Column) -> Column:
            h = F.xxhash64(seed, line)
            return F.struct((sums["high"] + F.shiftrightunsigned(h, 32)).alias("high"), (sums["low"] + h.bitwiseAND(F.lit(low))).alias("low"))

        return add

    zero = F.struct(F.lit(0).cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("low"))
    one = lambda seed: F.aggregate(lines, zero, more(F.lit(seed)), lambda s: F.array(s["high"], s["low"]))
    return F.concat(*[one(seed) for seed in range(EQUAL_LANES // 2)])


def summed(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and the fingerprint's lanes (array ``lanes``) of each group of ``keys``.

    A text's units are its word pairs and the sums of its equality lanes.  Units
    are folded by (keys, lane) where they arise, before any exchange; a second
    fold puts the lanes of a text side by side.
    """
    split_up = rows.select(*keys, paragraphs(F.col(text_col)).alias("_lines"))
    both = split_up.select(*keys, F.flatten(F.transform("_lines", pair_hashes)).alias("_pairs"), equal_sums(F.col("_lines")).alias("_equal"))
    # Arrays here are never empty; the outer form keeps Spark from adding a filter that computes them twice.
    units = both.select(*keys, F.posexplode_outer(F.concat("_equal", "_pairs")).alias("_at", "_unit"))
    pair = F.col("_at") >= EQUAL_LANES
    place = F.when(pair, EQUAL_LANES + F.pmod(F.shiftrightunsigned("_unit", 1), F.lit(NEAR_LANES))).otherwise(F.col("_at"))
    value = F.when(pair, F.when(F.col("_unit").bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)).otherwise(F.col("_unit"))
    folded = units.select(*keys, place.cast("int").alias("_place"), value.alias("_value")).groupBy(*keys, "_place").agg(F.sum("_value").alias("_value"))
    sums = [F.sum(F.when(F.col("_place") == j, F.col("_value")).otherwise(F.lit(0))).alias(f"_s{j}") for j in range(EQUAL_LANES + NEAR_LANES)]
    return reduced(folded.groupBy(*keys).agg(*sums), keys)


def reduced(sums: DataFrame, keys: list[str]) -> DataFrame:
    lanes = [lane(F.col(f"_s{i}"), EQUAL_BITS if i < EQUAL_LANES else NEAR_BITS) for i in range(EQUAL_LANES + NEAR_LANES)]
    return sums.select(*keys, F.array(*lanes).alias("lanes"))


def text_of(lanes: Column) -> Column:
    """The fingerprint as hexadecimal digits, lane after lane."""
    digits = lambda bits: lambda x: F.lpad(F.lower(F.hex(x)), bits // 4, "0")
    equal = F.transform(F.slice(lanes, 1, EQUAL_LANES), digits(EQUAL_BITS))
    near = F.transform(F.slice(lanes, EQUAL_LANES + 1, NEAR_LANES), digits(NEAR_BITS))
    return F.concat(F.array_join(equal, ""), F.array_join(near, ""))


def changed(lanes: Column, by: Column, times: int) -> Column:
    power = F.sequence(F.lit(0), F.lit(EQUAL_LANES + NEAR_LANES - 1))
    mask = lambda i: F.when(i < EQUAL_LANES, F.lit((1 << EQUAL_BITS) - 1)).otherwise(F.lit((1 << NEAR_BITS) - 1))
    return F.transform(power, lambda i: (lanes[i] + by[i] * times).bitwiseAND(mask(i)))


def inserted(lanes: Column, more: Column) -> Column:
    """Lanes of a text with the paragraphs that ``more`` was summed from added, anywhere in it."""
    return changed(lanes, more, 1)


def deleted(lanes: Column, less: Column) -> Column:
    """Lanes of a text without the paragraphs that ``less`` was summed from."""
    return changed(lanes, less, -1)


def signed(value: Column) -> Column:
    """A near lane as the signed number it stands for."""
    return F.when(value >= 1 << (NEAR_BITS - 1), value - (1 << NEAR_BITS)).otherwise(value).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of word pairs in common, 0 to 1, of two texts' lanes."""
    near = lambda lanes: F.slice(lanes, EQUAL_LANES + 1, NEAR_LANES)
    product = lambda x, y: F.aggregate(F.zip_with(near(x), near(y), lambda p, q: signed(p) * signed(q)), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(product(a, a) * product(b, b))
    cosine = F.when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), product(a, b) / norms))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lanes, fingerprint) of each row; rows of one id and text give one row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("_key"), "text")
    one = keyed.dropDuplicates(["doc_id", "_key"])
    return summed(one, ["doc_id", "_key"]).select("doc_id", "lanes", text_of(F.col("lanes")).alias("fingerprint"))


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def quantiles(value: str, parts: int) -> Column:
    """Values that begin each of ``parts`` parts but the first, about equally large."""
    return F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts) if parts > 1 else F.array().cast("array<bigint>")


def at_most(bounds: Column, value: Column) -> Column:
    """How many of ``bounds`` are no more than ``value``."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with ``_range``, which rises with ``doc_id``, and ``key``.

    ``key`` is the id; rows without one have a hash of the text and ranges after
    all others, by the hash.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")).first()
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1)) if seen["named"] < seen["n"] else F.col("doc_id"))
    steps = max(1, min(STEP, math.isqrt(seen["named"] // RANGE_ROWS)))
    coarse = sorted(set(rows.agg(quantiles("doc_id", steps)).first()[0] or []))
    part = at_most(F.array(*map(F.lit, coarse)), F.col("doc_id")) if coarse else F.lit(0)
    # At most STEP rows of STEP values.
    inner = rows.where(F.col("doc_id").isNotNull()).groupBy(part.alias("_part")).agg(quantiles("doc_id", -(-seen["named"] // (steps * RANGE_ROWS)) if steps < STEP else STEP).alias("_bounds"))
    fine = F.broadcast(cut(inner))
    own = F.col("_part") * (STEP + 1) + at_most(F.col("_bounds"), F.col("doc_id"))
    unnamed = -(-(seen["n"] - seen["named"]) // RANGE_ROWS)
    after = (STEP + 1) ** 2 + F.floor(F.col("key") / float(1 << 63) * unnamed)
    found = keyed.withColumn("_part", part).join(fine, "_part", "left")
    return found.withColumn("_range", F.when(F.col("doc_id").isNull(), after).otherwise(own).cast("long")).drop("_part", "_bounds")


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of each row.

    The edited text has the last floor(n_chars / 4) code points replaced by as
    many of the next document's first ones (or all of them).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = ranged(rows).withColumn("_none", F.col("doc_id").isNull())
    in_order = Window.orderBy("_range")  # over a narrow row for each range
    table = cut(keyed.groupBy("_range").agg(F.min("_none").alias("_none"), F.min("key").alias("key")))
    before, final = F.lag("_range").over(in_order), F.max("_range").over(Window.partitionBy())
    firsts = table.select("_none", "key", F.coalesce(before, final).alias("_before"), F.when(before.isNull(), 2).otherwise(1).alias("_guest"))
    columns = ["doc_id", "text", "key"]
    own = keyed.select("_range", F.lit(0).alias("_guest"), *columns)
    # The first row follows the last one.
    guests = keyed.drop("_range").join(small(cut(firsts), table.count()), ["_none", "key"]).select(F.col("_before").alias("_range"), "_guest", *columns)
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").isNull(), "key", "doc_id", "text")
    placed = own.unionByName(guests).select(
        "_range", "_guest", "doc_id", "text", F.row_number().over(order).alias("_turn"), F.lead("text").over(order).alias("_next")
    )
    sized = placed.withColumn("n_chars", F.char_length("text"))
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 4), substring(coalesce(_next, text), 1, int(n_chars div 4)))")
    told = sized.select("_range", "_turn", "_guest", "doc_id", F.col("n_chars").cast("long"), "text", edited.alias("_edited"))
    told = told.withColumn("edited_sha256", F.sha2("_edited", 256))
    both = F.array(F.struct(F.lit(0).alias("_which"), F.col("text").alias("_text")), F.struct(F.lit(1).alias("_which"), F.col("_edited").alias("_text")))
    keys = ["_range", "_turn", "_guest", "doc_id", "n_chars", "edited_sha256", "_which"]
    lanes = summed(told.select(*keys[:-1], F.inline_outer(both)), keys, "_text")
    # Of each row its own lanes, then those of its edited text; the next row's own lanes follow.
    follow = Window.partitionBy("_range").orderBy("_turn", "_which")
    joined = lanes.select("*", F.lead("lanes", 1).over(follow).alias("_edited"), F.lead("lanes", 2).over(follow).alias("_after"))
    return joined.where((F.col("_which") == 0) & (F.col("_guest") == 0)).select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("lanes")).alias("fingerprint"), text_of(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("lanes"), F.coalesce("_after", "lanes")).alias("near_next"),
    )
