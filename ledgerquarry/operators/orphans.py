"""References to records that do not exist, and what hangs on them.

``find_orphans`` judges each reference against the keys known of the referenced table: missing, late or deleted.
``cascade`` then walks down the foreign-key graph: a record that refers to an orphaned record is orphaned indirectly,
level by level until nothing new turns up.

Defined cases: a null or unparsable key is no reference; repeated references count once; a target without a
creation time is never late; a target with any undeleted line is not deleted; empty tables give no rows, or make every
reference missing.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerquarry.runtime import cut


def key_lifetimes(target: DataFrame, key: Column, created: Column, deleted: Column | None = None) -> DataFrame:
    """One row per key: first creation and, if every row was deleted, the last deletion. Aggregated before any join."""
    gone = F.when(F.count(F.when(deleted.isNull(), 1)) == 0, F.max(deleted)) if deleted is not None else F.lit(None).cast("timestamp")
    return target.where(key.isNotNull()).groupBy(key.alias("ref_key")).agg(F.min(created).alias("first_seen"), gone.alias("all_gone"))


def find_orphans(refs: DataFrame, lifetimes: DataFrame, at: str) -> DataFrame:
    """Rows of ``refs`` (with ``ref_key`` and time ``at``) whose target is absent, not yet there or deleted; adds ``reason``."""
    known = lifetimes.select("ref_key", "first_seen", "all_gone", F.lit(True).alias("__known"))
    reason = (
        F.when(F.col("__known").isNull(), "missing")
        .when(F.col("first_seen") > F.col(at), "late")
        .when(F.col("all_gone") <= F.col(at), "deleted")
    )
    return refs.join(known, "ref_key", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("first_seen", "all_gone", "__known")


def cascade(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes orphaned directly (depth 0) or through a parent (depth of the shortest chain).

    ``direct``: node ids, ``edges``: (node, parent). Each level is one semi-join of the edges with the last level and an
    anti-join with what is known, until a level is empty; lineage is cut in the shared folder. No node is taken twice, so
    cycles end and there are at most as many levels as the longest chain.
    """
    node_type = dict(edges.dtypes)["node"]
    links = cut(edges.where("node is not null and parent is not null").distinct())
    known = last = cut(direct.select(F.col("node").cast(node_type).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)))
    for depth in itertools.count(1):
        found = links.join(last.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct()
        last = cut(found.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            return known
        known = known.unionByName(last)
        known = cut(known) if depth % 10 == 0 else known


def orphan_report(direct: DataFrame, edges: DataFrame, nodes: DataFrame, node: str, field: str) -> DataFrame:
    """Direct and inherited orphans in one table: the rows of ``direct`` (with ``node``, ``field_name``, ``ref_key``,
    ``reason``, ``period``) at depth 0, and for every record that hangs on an orphaned one a row with reason
    ``inherited``, the ``field`` it hangs by, an empty key and the ``period`` of ``nodes``."""
    direct = cut(direct.select(node, "field_name", "ref_key", "reason", "period"))
    depths = cascade(direct.select(F.col(node).alias("node")), edges)
    inherited = depths.where("depth > 0").join(nodes.select(F.col(node).alias("node"), "period").dropDuplicates(["node"]), "node").select(
        F.col("node").alias(node), F.lit(field).alias("field_name"), F.lit("").alias("ref_key"), F.lit("inherited").alias("reason"), "period", "depth"
    )
    return direct.withColumn("depth", F.lit(0)).unionByName(inherited)
