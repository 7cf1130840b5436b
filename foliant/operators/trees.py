"""Trees held as rows of id and parent_id, resolved in rounds that double the reach, so that depth costs its logarithm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.review import _cut as cut


def paths(nodes: DataFrame, step: Column) -> DataFrame:
    """(id, path) of every node below a root (a node without a parent): the steps from the root down, the node's own last.

    Nodes below a parent that is not there, or on a cycle, have no path.
    """
    most = nodes.count()
    state = cut(nodes.select("id", F.col("parent_id").alias("up"), F.array(step).alias("path")))
    done, left = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
    while not left.isEmpty():
        above = done.unionByName(left).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        moved = left.join(above, "up").select("id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        # A way longer than there are nodes goes round.
        moved = cut(moved.filter(F.size("path") <= most))
        done, left = done.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    return done.select("id", "path")


def with_ancestors(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """id of the chosen nodes and of all above them, once each."""
    kept = cut(chosen.select("id").distinct())
    up = cut(nodes.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("above")).join(nodes.select(F.col("id").alias("above")).distinct(), "above", "left_semi"))
    while True:
        # All that is up to the reach above the chosen is kept; what is as far above these comes next.
        found = up.join(kept, "id", "left_semi").select(F.col("above").alias("id")).distinct().join(kept, "id", "left_anti")
        found = cut(found)
        if found.isEmpty():
            return kept
        kept = kept.union(found)
        up = cut(up.join(up.select(F.col("id").alias("above"), F.col("above").alias("next")), "above").select("id", F.col("next").alias("above")))
