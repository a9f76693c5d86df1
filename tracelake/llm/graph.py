"""Connected components over an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut

#: Links of a node that one task joins, about; the links of nodes with more are dealt to several tasks.
HUB_LINKS = 100_000
#: Up to this many links, labels are broadcast and tasks have so many rows, as a task costs more than its rows.
FEW_LINKS, TASK_ROWS = 400_000, 20_000


def first_labels(both: DataFrame) -> DataFrame:
    """(node, label) of links in both directions: the smallest of a node and its neighbours."""
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))


def few_components(both: DataFrame, tasks: int) -> DataFrame:
    """``components`` of so few links, in both directions, that labels can be broadcast."""
    both = both.coalesce(max(1, tasks))
    labels = cut(first_labels(both).coalesce(max(1, tasks)))
    while True:
        near = both.join(F.broadcast(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = near.join(F.broadcast(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        jumped = lower.join(F.broadcast(heads), "label", "left").select("node", "old", F.least("label", "head").alias("label"))
        jumped = cut(jumped.coalesce(max(1, tasks)))
        moved = jumped.where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): the smallest node reachable.

    Each round gives a node the smallest label among its neighbours and then
    the label of that label, so chains shorten at least by half a round.
    Neighbours' labels are folded by ``min`` before and after the shuffle, and
    the label of a node with very many links is joined in several copies, each
    with a share of its links, so no node is a large group on either side.
    Of few links, a round shuffles nothing but the folded neighbours' labels.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    m = both.count()
    if m <= FEW_LINKS:
        return few_components(both, math.ceil(m / TASK_ROWS))
    labels = cut(first_labels(both))
    hubs = cut(both.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_LINKS).cast("int").alias("salts")).where(F.col("salts") > 1))
    n = hubs.count()
    hubs = F.broadcast(hubs) if n <= BROADCAST_IDS else hubs

    def copied(known: DataFrame) -> DataFrame:
        """Labels by (b, salt)."""
        known = known.withColumnRenamed("node", "b")
        if not n:
            return known.withColumn("salt", F.lit(0))
        return known.join(hubs, "b", "left").select("b", "label", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))

    salt = F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")
    links = cut(both.join(hubs, "b", "left").select("a", "b", F.coalesce(salt, F.lit(0)).alias("salt"))) if n else both.withColumn("salt", F.lit(0))
    while True:
        near = links.join(copied(labels), ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        jumped = cut(lower.join(heads, "label", "left").select("node", "old", F.least("label", "head").alias("label")))
        moved = jumped.where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels
