"""A trie of rebuilt conversations, from composable fingerprints of their turns.

Every conversation is rebuilt as a head, the first turns of its base (the
conversation at the start of its block of ``block`` ids), followed by its own
turns after as many.  The rebuilt texts are never made.  A sequence of turns has
a fingerprint in a monoid: its length n and the sum G of t_i * B^i over its
turns, in LANES lanes modulo a prime; (n, G) joined with (m, H) is
(n + m, G + B^n * H).  One running sum over each stored conversation gives the
element of all its prefixes, and the element of a rebuilt prefix is that of the
base's head joined with that of a run of own turns, G(pos) - G(h), shifted by a
power of B: a few multiplications a turn.  Sequences longer than CHUNK turns
are summed in chunks, whose totals are summed in turn.

Rebuilt prefixes with one depth and fingerprint are a node.  Each keeps a
reference to the stored turn that it ends in, and equality is verified through
these: within a node all references must lead to one content.  As the
fingerprint of the sequence without its last turn follows from both, it then
holds for all turns before, up to the root.  Contents are compared by 120 bits
of SHA-256, which are checked to tell all stored turns apart.  Where a node
fails, all of it is done again with other bases.

What is summed over subtrees needs no walk.  A node's first member (smallest
id) stands for it; a conversation stands for its prefixes from some depth on.
So of a member's turns those below that depth are saved by sharing, and a
childless node is counted along its first member's prefixes.  Each measure is
one aggregation over (conversation, depth) rows.  Attributes of conversations
and of parents that very many rows ask for are broadcast (fewer than HOT_SHARE).
The hash of a node's ends is of a sequence, so one task reads them in order; they
come to it as texts of PIECE ids, made by the tasks of a sort by ranges.

Defined cases: turns are ordered by number (null first), then by the SHA-256 of
their content; a null role or text counts as empty; rows without ``conv_id``
belong to no conversation; repeated rows are turns of their own; an empty table has
no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_order, looked_up, mapped

PRIME, LANES = (1 << 31) - 1, 4
#: Conversations in a block, whose first one lends heads of 0 to HEADS - 1 turns.
BLOCK, HEADS = 20, 4
#: Turns summed in one window; ids in a text of a node's ends; choices of bases before giving up.
CHUNK, PIECE, TRIES = 4_096, 512, 5
#: Bits of an exponent's digit, and digits.
DIGIT, DIGITS = 6, 6
NODE = ["depth", "f", "g"]

PIECES = T.StructType([T.StructField("depth", T.LongType()), T.StructField("f", T.LongType()), T.StructField("g", T.LongType()), T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())])
ENDS = T.StructType([T.StructField("depth", T.LongType()), T.StructField("f", T.LongType()), T.StructField("g", T.LongType()), T.StructField("ends_sha256", T.StringType())])


class Unverified(RuntimeError):
    """Fingerprints or digests don't tell different turns apart."""


# Fingerprints.


def bases(choice: int) -> list[int]:
    return [2 + int(hashlib.sha256(f"{choice}:{k}".encode()).hexdigest(), 16) % (PRIME - 3) for k in range(LANES)]


def times(a: Column, b: Column) -> Column:
    return (a * b) % PRIME


def power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo PRIME, by the exponent's digits."""
    out = F.lit(1).cast("long")
    for j in range(DIGITS):
        table = F.lit([pow(base, d << DIGIT * j, PRIME) for d in range(1 << DIGIT)]).cast("array<bigint>")
        digit = F.shiftright(exponent, DIGIT * j).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        out = times(out, F.element_at(table, digit + 1))
    return out


def lanes_of(c: Column, d: Column) -> list[Column]:
    """A content's value in each lane, never zero."""
    low = F.lit((1 << 30) - 1)
    return [F.shiftright(x, s).bitwiseAND(low) + 1 for x in (c, d) for s in (30, 0)]


def packed(lanes: list[Column]) -> tuple[Column, Column]:
    two = lambda a, b: F.shiftleft(a.cast("long"), 31).bitwiseOR(b.cast("long"))
    return two(*lanes[:2]), two(*lanes[2:])


def unpacked(f: Column, g: Column) -> list[Column]:
    return [x for p in (f, g) for x in (F.shiftright(p, 31), p.bitwiseAND(F.lit(PRIME)))]


# Stored turns.


def contents(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, c, d, words): of each stored turn its content's digest and number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda k: F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part(0).alias("c"), part(1).alias("d"), words.alias("words"))
    return in_order(rows, ["conv_id", F.asc_nulls_first("turn"), "c", "d"])


def check_digests(turns: DataFrame, stored: DataFrame) -> None:
    """Raise if two different contents have one digest."""
    texts = turns.where(F.col("conv_id").isNotNull()).select(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    if texts != stored.select("c", "d").distinct().count():
        raise Unverified("two different turns have the same digest")


def conversations(stored: DataFrame, block: int, heads: int) -> DataFrame:
    """(conv_id, first, n, total, h, base, head): of each conversation where its turns start, how many it has, and what it takes from its base."""
    own = cut(stored.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("words").alias("total")))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    return own.withColumns({"h": h, "base": base}).join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")


def summed(placed: DataFrame, choice: int) -> DataFrame:
    """``placed`` turns (conv_id, pos, c, d, words) with the fingerprint and words of all turns up to each, and before it."""
    terms = {f"t{k}": times(x, power(b, F.col("pos"))) for k, (x, b) in enumerate(zip(lanes_of(F.col("c"), F.col("d")), bases(choice), strict=True))}
    rows = placed.withColumns(terms).withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("long"))
    sums = [*terms, "words"]
    here = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumns({f"s_{c}": F.sum(c).over(here) for c in sums})
    totals = rows.groupBy("conv_id", "chunk").agg(*[(F.sum(c) % PRIME if c != "words" else F.sum(c)).alias(f"b_{c}") for c in sums])
    totals = totals.select("conv_id", "chunk", *[F.coalesce(F.sum(f"b_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in sums])
    rows = inner.join(totals, ["conv_id", "chunk"])
    upto = [(F.col(f"s_{c}") + F.col(f"b_{c}")) % PRIME for c in terms]
    past = [F.pmod(F.col(f"s_{c}") + F.col(f"b_{c}") - F.col(c), F.lit(PRIME)) for c in terms]
    f, g = packed(upto)
    pf, pg = packed(past)
    w = F.col("s_words") + F.col("b_words")
    return rows.select("conv_id", "pos", "place", "c", "d", "words", f.alias("f"), g.alias("g"), pf.alias("pf"), pg.alias("pg"), w.alias("w"), "h", "head")


# Rebuilt prefixes.


def prefixes(turns: DataFrame, convs: DataFrame, choice: int) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): a row for each conversation and depth, with its node, its parent's and the turn that it ends in.

    ``before`` counts the words of the turns before that one; ``length`` and
    ``all_words`` of a conversation are those of its rebuilt form.
    """
    first = turns.where(F.col("pos") < HEADS - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "place", "c", "d", "words", "f", "g", "pf", "pg", "w"))).alias("turns"))
    lent = first.select(F.col("conv_id").alias("base"), F.col("turns").alias("lent"))
    known = convs.join(first, "conv_id", "left").join(lent, "base", "left")
    last = lambda turns, n, what: F.when(n > 0, F.try_element_at(turns, n.cast("int"))[what])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    h, head = F.col("h"), F.col("head")
    known = cut(
        known.select(
            "conv_id", "n", "h", "head", "lent", *[zero(last(F.col("lent"), head, x)).alias(f"base_{x}") for x in ("f", "g", "w")], *[zero(last(F.col("turns"), h, x)).alias(f"own_{x}") for x in ("f", "g", "w")],
            (head + F.greatest(F.col("n") - h, F.lit(0))).alias("length"), "total",
        ).withColumn("all_words", F.col("base_w") + F.when(F.col("n") > h, F.col("total") - F.col("own_w")).otherwise(0))
    )
    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", "f", "g", "pf", "pg", "c", "d", "words", "before")]
    roots = known.select("conv_id", "length", *nothing, F.lit(None).cast("long").alias("place"))
    taken = known.where(head > 0).select("conv_id", "length", F.explode(F.slice("lent", F.lit(1), head.cast("int"))).alias("t"))
    taken = taken.select("conv_id", "length", (F.col("t.pos") + 1).alias("depth"), "t.f", "t.g", "t.pf", "t.pg", "t.c", "t.d", "t.words", (F.col("t.w") - F.col("t.words")).alias("before"), "t.place")
    offsets = known.select("conv_id", "length", "n", *[f"{side}_{x}" for side in ("base", "own") for x in ("f", "g", "w")])
    own = looked_up(turns, offsets, ["conv_id"], "n").where(F.col("pos") >= F.col("h"))
    at, start = unpacked(F.col("base_f"), F.col("base_g")), unpacked(F.col("own_f"), F.col("own_g"))
    back = [F.element_at(F.lit([pow(b, -k, PRIME) for k in range(HEADS)]).cast("array<bigint>"), (h - head + 1).cast("int")) for b in bases(choice)]

    def joined(f: str, g: str) -> tuple[Column, Column]:
        """The head's element joined with that of the own turns after the first h."""
        run = [times(s, F.pmod(x - y, F.lit(PRIME))) for s, x, y in zip(back, unpacked(F.col(f), F.col(g)), start, strict=True)]
        return packed([(a + r) % PRIME for a, r in zip(at, run, strict=True)])

    (f, g), (pf, pg) = joined("f", "g"), joined("pf", "pg")
    own = own.select(
        "conv_id", "length", (F.col("pos") - h + head + 1).alias("depth"), f.alias("f"), g.alias("g"), pf.alias("pf"), pg.alias("pg"), "c", "d", "words",
        (F.col("base_w") + F.col("w") - F.col("own_w") - F.col("words")).alias("before"), "place",
    )
    rows = cut(roots.unionByName(taken).unionByName(own))
    return rows, known.select("conv_id", "length", "all_words")


def verified(turns: DataFrame, block: int, heads: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, conversations, nodes) of ``prefixes``, with fingerprints that hold."""
    stored = contents(turns)
    check_digests(turns, stored)
    convs = cut(conversations(stored, block, heads).withColumn("uses", F.col("n")))
    placed = looked_up(stored, convs.select("conv_id", "first", "h", "head", "uses"), ["conv_id"], "uses").withColumn("pos", F.col("place") - F.col("first"))
    placed = cut(placed.select("conv_id", "pos", "place", "c", "d", "words", "h", "head"))
    for choice in range(TRIES):
        rows, known = prefixes(cut(summed(placed, choice)), convs, choice)
        same = [(F.min(x) == F.max(x)).alias(f"one_{x}") for x in ("c", "d")]
        nodes = cut(rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("longest"), F.min("before").alias("before"), *same))
        if not nodes.where(~F.col("one_c") | ~F.col("one_d")).limit(1).count():
            return rows, known, nodes
    raise Unverified("no choice of bases tells all prefixes apart")


# Nodes.


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of PIECE ids at most of rows (depth, f, g, conv_id) in order, as texts."""
    node, ids, out = None, [], []

    def done() -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != node or len(ids) >= PIECE:
                done()
                node, ids = key, []
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], PIECES.names)
            out.clear()
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], PIECES.names)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order."""
    node, state, out = None, None, []
    for batch in batches:
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ENDS.names)
            out.clear()
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ENDS.names)


def ends(rows: DataFrame) -> DataFrame:
    """(depth, f, g, ends_sha256) of the nodes in which a conversation ends."""
    whole = rows.where(F.col("depth") == F.col("length")).select(*NODE, "conv_id").orderBy(*NODE, "conv_id")
    return mapped(mapped(whole, pieces, PIECES).repartition(*NODE).sortWithinPartitions(*NODE, "first"), digests, ENDS)


def trie(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """A row for each node.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, place): ``place`` is the stored turn that the node
    ends in, as a place in ``contents``.
    """
    if heads > HEADS:
        raise ValueError(f"heads of up to {HEADS - 1} turns")
    rows, known, nodes = verified(turns, block, heads)
    leaf = (F.col("longest") == F.col("depth")).cast("long")
    firsts = nodes.groupBy("conv_id").agg(F.min("depth").alias("stands_from"), F.min("before").alias("shared_words"), F.max(leaf).alias("leaf"))
    uses = F.col("length") + 1
    known = cut(
        known.join(firsts, "conv_id", "left").select(
            "conv_id", F.coalesce("stands_from", uses).alias("stands_from"), F.coalesce("shared_words", "all_words").alias("shared_words"), F.coalesce("leaf", F.lit(0)).alias("leaf"), uses.alias("uses")
        )
    )
    child = ((F.col("length") > F.col("depth")) & (F.col("stands_from") <= F.col("depth") + 1)).cast("long")
    saved = F.greatest(F.col("shared_words") - F.col("before"), F.lit(0))
    measured = looked_up(rows, known, ["conv_id"], "uses").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
        F.min("pf").alias("pf"), F.min("pg").alias("pg"), F.min("place").alias("place"),
    )
    none = hashlib.sha256(b"").hexdigest()
    measured = cut(measured.join(ends(rows), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))))
    parents = measured.where(F.col("n_children") > 0).select(F.col("depth").alias("up"), F.col("f").alias("pf"), F.col("g").alias("pg"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("uses"))
    below = looked_up(measured.where(F.col("depth") > 0).withColumn("up", F.col("depth") - 1), parents, ["up", "pf", "pg"], "uses").drop("up")
    root = measured.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(root).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "place")
