"""Small helpers the operators share: table access, checkpoints, shared paths."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ids up to this many are broadcast to thin out a table before a shuffle (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000
#: A key with more than this part of all rows is joined by broadcast; there are fewer such keys than this number.
HOT_SHARE = 1_000
#: Rows in an Arrow batch, and the setting that holds them.
BATCH_ROWS, BATCH_KEY = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, gets a temporary folder
    where it names none; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        named = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of BATCH_ROWS rows, unless the session sets another number.

    Rows here hold whole texts, of which Spark's usual 10,000 in a batch would
    take tens of megabytes on both sides of the pipe, several times over.
    """
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_ROWS))

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory to the system; a worker process that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def only_ids(df: DataFrame, id_col: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (one distinct column ``id_col``).

    ``n_ids`` is the counted size of ``ids``: few are broadcast, so that the
    rows of ``df`` need no shuffle; more are joined.
    """
    if n_ids <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, id_col, "left_semi")


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], uses: str) -> DataFrame:
    """``rows`` joined with ``known``, which has one row for each of their keys and in ``uses`` the number of rows with it.

    Keys with more than a HOT_SHARE-th of all rows, which are fewer than
    HOT_SHARE, are broadcast, so no key is a large group in a shuffle.  Both
    sides should be written tables, as they are read twice.
    """
    total = known.agg(F.sum(uses)).first()[0] or 0
    is_hot = F.col(uses) * HOT_SHARE > total
    hot = F.broadcast(known.where(is_hot).drop(uses))
    cold = rows.join(F.broadcast(known.where(is_hot).select(*keys)), keys, "left_anti").join(known.where(~is_hot).drop(uses), keys)
    return rows.join(hot, keys).unionByName(cold)


def in_order(df: DataFrame, order: list) -> DataFrame:
    """``df`` written in order, with ``place``, the number of rows before each.

    The sort is by ranges; the driver sees one count per range.
    """
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dict(sorted(map(tuple, rows.groupBy(part).count().collect())))
    before = list(zip(sizes, itertools.accumulate(sizes.values(), initial=0), strict=False))
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn("place", place).drop("_part", "_before", "_at")


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object] | None = None):
    """What a worker process keeps from task to task under ``name``, made on first use.

    A process runs tasks of many operators in turn; it keeps things for the
    current one only, so their memory doesn't add up.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make() if make else None
    return _held[name]
