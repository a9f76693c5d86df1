"""License scans by canonical digest look-up, in DataFrame functions only.

Texts are brought to a canonical form: lower case, copyright lines and "all
rights reserved" dropped, equivalent spellings made one, everything but letters
and digits turned into single spaces.  The SHA-256 of the canonical form is
hash-joined to the digests of known licenses, whose table is made by the same
expressions.  Looked up are the whole text, each of its lines, each of its
blocks (text between blank lines), and each run of blocks that begins with the
first block of a known text and has as many blocks, so a license in its usual
form is found within a longer document too, and a one-line grant as well.

Known are full texts (``license_texts.KNOWN``; long ones by their digests, in
``license_texts.LONG``) and one-line grants.  ``texts`` puts other ones in their
place.

Parts are digested only where they hold a stem.  The stems are words chosen from
the known texts such that each of these has one, so no part without any can
match; ``stems_of`` chooses them anew for the texts at hand.

Not found: a license text that shares its block with other lines.

Defined cases: a null text is empty and matches nothing; copyright lines alone
leave the empty form, which matches nothing; known texts without a word match
nothing; repeated rows and rows without ``doc_id`` are scanned like others; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN, LONG

#: Spellings that mean the same (fixed values): pattern and replacement, on lower-case words with single spaces.
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("https", "http"),
    ("v 2 0", "version 2 0"),
    ("v2 0", "version 2 0"),
    ("version 3 0", "version 3"),
    ("gpl v3", "gplv3"),
)
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*$"
RESERVED = r"all rights reserved"
OTHER = r"[^\p{L}\p{N}\n]+"

def canonical(text: Column) -> Column:
    """Canonical form with the line feeds left in it; only the first and last line may have a space outside."""
    out = F.lower(F.coalesce(text, F.lit("")))
    noticed = out.contains("copyright") | out.contains("(c)") | out.contains("©")
    out = F.when(noticed, F.regexp_replace(out, COPYRIGHT, "")).otherwise(out)
    out = F.replace(out, F.lit(RESERVED), F.lit(""))
    out = F.regexp_replace(out, OTHER, " ")
    for spelling, same in (*EQUIVALENT, (" \n", "\n"), ("\n ", "\n")):
        out = F.replace(out, F.lit(spelling), F.lit(same))
    return out


def joined(form: Column) -> Column:
    """A canonical form as one line."""
    line = F.replace(form, F.lit("\n"), F.lit(" "))
    return F.trim(F.when(line.contains("  "), F.regexp_replace(line, " +", " ")).otherwise(line))


def blocks_of(form: Column) -> Column:
    """The blocks of a canonical form, each as one line; empty ones are left out."""
    return F.filter(F.transform(F.split(form, "\n\n+", -1), joined), lambda b: b != "")


class Known:
    """Known texts: digests with their license, and what their runs of blocks begin with.

    ``forms`` are few (texts that a program names), so they pass through the driver.
    """

    def __init__(self, spark: SparkSession, texts: dict[str, list[str]] | None = None) -> None:
        rows = [(name, text) for name, several in (KNOWN if texts is None else texts).items() for text in several]
        frame = spark.createDataFrame(rows, "license string, text string").select("license", canonical(F.col("text")).alias("form"))
        forms = frame.select("license", F.sha2(joined(F.col("form")), 256).alias("digest"), blocks_of(F.col("form")).alias("blocks")).where(F.size("blocks") > 0).collect()
        self.rows = [(r["license"], r["digest"], r["blocks"][0], len(r["blocks"])) for r in forms] + (list(LONG) if texts is None else [])
        single = [(r["license"], " ".join(r["blocks"])) for r in forms if len(r["blocks"]) == 1]
        self.stems = stems_of([text for _, text in single] + [first for _, _, first, n in self.rows if n > 1])

    def frame(self, spark: SparkSession) -> DataFrame:
        """(digest, license): a table of fixed size."""
        return spark.createDataFrame(sorted({(digest, name) for name, digest, _, _ in self.rows}), "digest string, license string")

    def may_match(self, part: Column) -> Column:
        """Whether a part holds a stem of the known texts."""
        return reduce(lambda a, b: a | b, [part.contains(s) for s in self.stems], F.lit(False))

    def runs(self, blocks: Column) -> Column:
        """Runs of blocks as long as a known text that begins with the same block, each as one line."""
        sizes: dict[str, set[int]] = {}
        for _, _, first, n in self.rows:
            if n > 1:
                sizes.setdefault(first, set()).add(n)
        none = F.array().cast("array<string>")
        if not sizes:
            return none
        known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, sorted(x))) for pair in sizes.items() for x in pair])
        at = lambda b, i: F.transform(F.coalesce(F.try_element_at(known, b), F.array().cast("array<int>")), lambda n: F.struct(i.alias("i"), n.alias("n")))
        begun = F.flatten(F.transform(blocks, at))
        inside = F.filter(begun, lambda r: r["i"] + r["n"] <= F.size(blocks))
        return F.transform(inside, lambda r: F.array_join(F.slice(blocks, r["i"] + 1, r["n"]), " "))


def stems_of(texts: Iterable[str]) -> list[str]:
    """Few words such that each text has one of them; of a text those that are long enough to be rare may serve."""
    words = []
    for text in texts:
        own = set(text.split())
        longest = max(map(len, own))
        words.append({w for w in own if len(w) >= min(6, longest)})
    out = []
    while words:
        counted = Counter(w for own in words for w in own)
        best = max(counted, key=lambda w: (counted[w], len(w), w))
        out.append(best)
        words = [own for own in words if best not in own]
    return out


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_digest, license (of the whole text), n_matches and licenses (of whole, runs, blocks and lines) of each row."""
    spark = docs.sparkSession
    known = Known(spark, texts)
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("_form")
    ).select("_row", "doc_id", "_form", F.sha2(joined(F.col("_form")), 256).alias("text_digest"))
    rows = rows.withColumn("_maybe", known.may_match(F.col("_form")))
    rows = rows.withColumn("_blocks", F.when(F.col("_maybe") & F.col("_form").contains("\n\n"), blocks_of(F.col("_form"))).otherwise(none))
    lines = F.transform(F.filter(F.split("_form", "\n", -1), known.may_match), joined)
    parts = F.concat(lines, F.filter("_blocks", known.may_match), known.runs(F.col("_blocks")))
    found = F.when(F.col("_maybe"), F.transform(parts, lambda p: F.sha2(p, 256))).otherwise(none)
    digests = F.array_distinct(F.concat(F.array("text_digest"), found))
    units = rows.select("_row", "doc_id", "text_digest", F.explode_outer(digests).alias("digest"))
    found = units.join(F.broadcast(known.frame(spark)), "digest", "left")
    # A row's units lie together, so they are folded before the exchange.
    return (
        found.groupBy("_row", "doc_id", "text_digest")
        .agg(
            F.max(F.when(F.col("digest") == F.col("text_digest"), F.col("license"))).alias("license"),
            F.count("license").alias("n_matches"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        )
        .drop("_row")
    )
