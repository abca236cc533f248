"""Down-sampling that a rerun repeats: order by a hash, never by a running generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 47


def _order(seed: int, keys: list[str]) -> list:
    return [F.xxhash64(F.lit(seed), *keys), *keys]


def reservoir(rows: DataFrame, by: list[str], keys: list[str], k: int, seed: int = SEED) -> DataFrame:
    """k rows of each group at most, as if drawn at random; keys tell rows of a group apart.

    Rows beyond the k least hashes are cut before the shuffle by the group limit that the planner derives from the rank.
    """
    w = Window.partitionBy(*by).orderBy(*_order(seed, keys))
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def leveling(rows: DataFrame, groups: list[str], by: list[str], keys: list[str], target: int, least: int = 1, seed: int = SEED) -> DataFrame:
    """Rows of a group thinned to target in all: one is taken from each stack (by) in turn, from the first in order, none below least.

    As many whole turns are taken as there is something to remove for; the first stacks that still can give one give the rest. Which rows
    of a stack stay follows from a hash. A group within the target stays whole.
    """
    heights = rows.groupBy(*groups, *by).agg(F.count(F.lit(1)).alias("n")).withColumn("can", F.greatest(F.lit(0), F.col("n") - least))
    up = Window.partitionBy(*groups).orderBy("can", *by)
    before = F.coalesce(F.sum("can").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stacks = heights.withColumns({"excess": F.sum("n").over(Window.partitionBy(*groups)) - target, "given": before, "rest": F.count(F.lit(1)).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # the turns end within the least stack that they would not empty; none is left if all of it can't reach the target
    whole = F.floor((F.col("excess") - F.col("given")) / F.col("rest"))
    ends = stacks.where("given + can * rest > excess").groupBy(*groups).agg(F.min_by(F.struct(whole.alias("turns"), (F.col("excess") - F.col("given") - whole * F.col("rest")).alias("spare")), F.struct("can", *by)).alias("t"))
    stacks = stacks.join(ends, groups, "left")
    more = F.col("can") > F.col("t.turns")
    place = Window.partitionBy(*groups).orderBy(*by)
    taken = F.when(F.col("excess") <= 0, F.lit(0)).when(F.col("t").isNull(), F.col("can")).otherwise(F.least("can", F.col("t.turns")) + F.when(more & (F.sum(more.cast("int")).over(place) <= F.col("t.spare")), 1).otherwise(0))
    quota = stacks.withColumn("quota", F.col("n") - taken).select(*groups, *by, "quota")
    w = Window.partitionBy(*groups, *by).orderBy(*_order(seed, keys))
    return rows.withColumn("__rank", F.row_number().over(w)).join(quota, [*groups, *by]).where("__rank <= quota").select(*rows.columns)


def permutation(rows: DataFrame, keys: list[str], k: int | None = None, seed: int = SEED) -> DataFrame:
    """All rows in an order as if shuffled, or the first k of it."""
    out = rows.orderBy(*_order(seed, keys))
    return out if k is None else out.limit(k)
