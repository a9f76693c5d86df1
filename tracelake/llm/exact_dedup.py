"""Exact deduplication over an extendible-hash index in shared files.

Texts are equal when they are identical after lower-casing A-Z.  Each text has
a 64-bit key.  The leading ``depth`` bits of a key select a slot of the
directory, and each slot points to a bucket.  A bucket with more than
``capacity`` keys is split on its next bit; when its own depth has reached the
directory's, the directory doubles first.  Splitting works on counts of keys
per bucket (one Spark aggregate per round), so no text moves before the
directory is settled.  The directory is not gathered anywhere: its first slots
follow from the number of keys, and each doubling is a table of the buckets that
it splits, which is empty or small as keys are hashes.

Each map task first folds its copies of a text into one entry, so a text that
a third of all rows share reaches its owner as one entry per task.  The entries
then go to owner tasks.  An owner has a range of keys, BUCKETS_OWNED of the
first buckets with all that they were split into, so owners grow in number, not
in size.  It walks its range in order, chains the entries whose keys collide and
compares their bytes.  The resolved index (bucket, key, chain position, keeper,
size) is written as Parquet files in the shared folder; lookups join against
those files, and groups of more than HOT_ROWS rows are salted there.

Defined cases: a null text counts as empty; of rows that tie on the largest
``doc_id`` (repeated rows) one stays; a group without any ``doc_id`` keeps one
row with ``keep_id`` null; an empty table gives an empty result; other columns
of the input are carried through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held, mapped, shared_path

#: Keys in a bucket before it splits.
CAPACITY = 5_000
#: Bytes of text a map task holds before it passes its folded entries on.
FOLD_BYTES = 16 << 20
#: First buckets that one owner task has.
BUCKETS_OWNED = 4
#: Rows of a group that one task looks up, about.
HOT_ROWS = 100_000
#: Tables of up to this many rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 1 << 20

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ENTRY = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("norm", T.BinaryType()),
     T.StructField("keep_id", T.LongType()), T.StructField("size", T.LongType())]
)
INDEX = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("key", T.LongType()), T.StructField("chain", T.IntegerType()),
     T.StructField("sha", T.StringType()), T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType())]
)


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, sha, norm) of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm")).select(
        "doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"), "norm"
    )


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Directory:
    """An extendible-hash directory over the leading bits of keys.

    A bucket's number is the first prefix that points to it, followed by zeros
    to 48 bits, so bucket numbers rise with the keys and never change meaning
    when the directory doubles.  ``splits`` has a table of the buckets that each
    doubling splits, with its size.
    """

    BITS = 48

    def __init__(self, depth: int) -> None:
        self.first = depth
        self.splits: list[tuple[DataFrame, int]] = []

    @property
    def depth(self) -> int:
        return self.first + len(self.splits)

    def double(self, overfull: DataFrame, n: int) -> None:
        """One bit more; ``overfull`` (bucket) are split on it, all others keep two slots for one."""
        self.splits.append((overfull, n))

    def locate(self, df: DataFrame) -> DataFrame:
        """``df`` with the bucket of each key."""
        out = df.withColumn("bucket", F.shiftleft(prefix(self.first), self.BITS - self.first))
        for depth, (split, n) in enumerate(self.splits, self.first + 1):
            bit = F.shiftleft(F.shiftrightunsigned("key", 64 - depth).bitwiseAND(F.lit(1)), self.BITS - depth)
            out = out.join(small(split.select("bucket", F.lit(True).alias("_split")), n), "bucket", "left")
            out = out.withColumn("bucket", F.when(F.col("_split"), F.col("bucket").bitwiseOR(bit)).otherwise(F.col("bucket"))).drop("_split")
        return out

    def slots(self, spark) -> DataFrame:
        """(prefix, bucket) of each slot."""
        prefixes = spark.range(1 << self.depth).withColumnRenamed("id", "prefix")
        return self.locate(prefixes.withColumn("key", F.shiftleft("prefix", (64 - self.depth) % 64))).drop("key")

    @property
    def owners(self) -> int:
        return max(1, (1 << self.first) // BUCKETS_OWNED)

    def owner(self):
        """The owner of a key: first buckets are dealt in order."""
        return F.shiftright(prefix(self.first) * self.owners, self.first).cast("int")


def prefix(depth: int):
    """The leading ``depth`` bits of the key, as a number from 0."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """A directory under which no bucket has more than ``capacity`` distinct keys.

    ``keys`` has one row for each distinct key, so equal texts never overfill a
    bucket, and a hash spreads distinct ones: a few rounds settle it.
    """
    directory = Directory((keys.count() // capacity).bit_length())
    while directory.depth < Directory.BITS:
        sizes = directory.locate(keys).groupBy("bucket").count()
        overfull = cut(sizes.where(F.col("count") > capacity).select("bucket"))
        n = overfull.count()
        if not n:
            break
        directory.double(overfull, n)
    return directory


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each text of a map task: its largest doc_id and its count."""
    held("nothing")
    texts_of: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = list(texts_of.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([e[0] for _, e in rows], pa.int64()), pa.array([e[1] for _, e in rows], pa.string()),
             pa.array([t for t, _ in rows], pa.binary()), pa.array([e[2] for _, e in rows], pa.int64()),
             pa.array([e[3] for _, e in rows], pa.int64())],
            names=ENTRY.names,
        )

    for batch in batches:
        texts = batch.column("norm").cast(pa.binary()).to_pylist()
        for text, key, sha, doc in zip(
            texts, batch.column("key").to_pylist(), batch.column("sha").to_pylist(), batch.column("doc_id").to_pylist(), strict=True
        ):
            entry = texts_of.get(text)
            if entry is None:
                texts_of[text] = [key, sha, doc, 1]
                size += len(text) + 200
            else:
                entry[3] += 1
                if doc is not None and (entry[2] is None or doc > entry[2]):
                    entry[2] = doc
        if size > FOLD_BYTES:
            yield flush()
            texts_of.clear()
            size = 0
    if texts_of:
        yield flush()


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's range of keys, in order: chain the entries of a key, compare bytes, resolve keepers."""
    at: tuple | None = None
    chain: list[list] = []  # of the current key: [norm, sha, keep_id, size]

    def resolved(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=INDEX.names,
        )

    def close() -> list[tuple]:
        return [(*at, i, sha, keep, size) for i, (_, sha, keep, size) in enumerate(chain)]

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("bucket", "key", "norm", "sha", "keep_id", "size")]
        for bucket, key, norm, sha, keep, size in zip(*columns, strict=True):
            if (bucket, key) != at:
                if at:
                    out += close()
                at, chain = (bucket, key), []
            for entry in chain:
                if entry[0] == norm:
                    entry[3] += size
                    if keep is not None and (entry[2] is None or keep > entry[2]):
                        entry[2] = keep
                    break
            else:
                chain.append([norm, sha, keep, size])
        if out:
            yield resolved(out)
    if at:
        yield resolved(close())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Write the index of ``docs`` to the shared folder; the result reads its files."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    keys = cut(rows.select("key").distinct())
    directory = grow_directory(keys, capacity)
    entries = directory.locate(mapped(rows, fold, ENTRY))
    path = shared_path(spark, "exact-index")
    owned = entries.repartitionById(directory.owners, directory.owner()).sortWithinPartitions("bucket", "key")
    mapped(owned.select("bucket", "key", "norm", "sha", "keep_id", "size"), own, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def looked_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` joined with the index on (key, sha); the rows of a large group are dealt to several tasks."""
    hot = cut(index.where(F.col("group_size") > HOT_ROWS).select("key", "sha", F.ceil(F.col("group_size") / HOT_ROWS).cast("int").alias("_salts")))
    n = hot.count()
    if not n:
        return rows.join(index, ["key", "sha"])
    salts = small(hot, n)
    dealt = rows.withColumn("_turn", F.monotonically_increasing_id()).join(salts, ["key", "sha"], "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod("_turn", "_salts"), F.lit(0)).cast("int")).drop("_turn", "_salts")
    every = index.join(salts, ["key", "sha"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(every, ["key", "sha", "_salt"]).drop("_salt")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows that repeat the keeper's id (or, in a group without ids, of all its
    rows) one is kept: the first of each task's rows, then the first of those.
    """
    index = build_index(docs, id_col, text_col, capacity).select("key", "sha", "keep_id", "group_size")
    rows = looked_up(keyed(docs, id_col, text_col).select("doc_id", "key", "sha", F.spark_partition_id().alias("_task")), index)
    within = Window.partitionBy("doc_id", "sha", "_task").orderBy("keep_id")
    rows = rows.withColumn("_first", F.row_number().over(within) == 1)
    among = Window.partitionBy("doc_id", "sha", F.when(F.col("_first"), -1).otherwise(F.col("_task"))).orderBy("_task")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("_first")
    return rows.withColumn("_turn", F.row_number().over(among)).select(
        "doc_id", "keep_id", "group_size", (top & (F.col("_turn") == 1)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest id.

    Rows are kept by (id, digest) of the index, a join without hot keys.  Only
    keys that several rows have (repeated rows) need their rows brought together.
    """
    names = {c.lower() for c in docs.columns}
    mark = next(f"_sha{i}" for i in range(len(names) + 1) if f"_sha{i}" not in names)
    index = build_index(docs, id_col, text_col, capacity)  # a written table, so its reads cost little
    keys = index.select(F.col("keep_id").alias(f"{mark}_id"), F.col("sha").alias(f"{mark}_key"))
    rows = docs.withColumn(mark, F.sha2(normalised(text_col), 256))
    own = rows[id_col].cast("long").eqNullSafe(keys[f"{mark}_id"]) & (rows[mark] == keys[f"{mark}_key"])
    kept = rows.join(keys, own, "left_semi")
    ids = rows.groupBy(F.col(id_col).alias(f"{mark}_id"), F.col(mark).alias(f"{mark}_key")).count()
    several = cut(ids.where("count > 1").drop("count"))
    if not several.limit(1).count():
        return kept.select(*docs.columns)
    again = kept[id_col].eqNullSafe(several[f"{mark}_id"]) & (kept[mark] == several[f"{mark}_key"])
    once = kept.join(several, again, "left_semi").dropDuplicates([id_col, mark])
    return kept.join(several, again, "left_anti").unionByName(once).select(*docs.columns)
