"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_broadcast, documents, materialize

#: Default targets: a value's token share to this power, normed; below 1 lifts what is rare.
POWERS = {"source": 0.7, "lang": 0.9, "topic": 1.0}
#: So many cells are raked in one partition without shuffles; more are shuffled by each margin in turn.
ONE_PARTITION_CELLS = 100_000
SWEEPS = 6
TOLERANCE = 1e-6
SEED = 20240229


def tokens(text: str = "text") -> Column:
    """Words of the whole text, apart at white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def with_topic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a topic by their labels: toxic, good, plain, or unrated without any; of several labels the largest count."""
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"), F.max("quality").alias("__quality"))
    topic = F.when(F.col("__toxic") == 1, "toxic").when(F.col("__quality") == 1, "good").when(F.col("__quality") == 0, "plain").otherwise("unrated")
    joined = docs.drop("topic").join(bounded_broadcast(rated, labels.count(), 32), "doc_id", "left")
    return joined.select(*docs.drop("topic").columns, topic.alias("topic"))


def rake(cells: DataFrame, dims: list[str], targets: dict[str, dict] | None = None, powers: dict[str, float] | None = None, max_rounds: int = 30) -> DataFrame:
    """cells (dims, tokens) with weight: the table nearest to tokens whose margins have the target shares.

    A dimension's targets are given as {value: share}, normed to the values that have tokens (others get none), or follow
    from powers as (token share) ** power, 1 where none is given. Null is a value of its own. Cells without tokens get
    weight 0. Margins that can't all be met, as where empty cells bind them to each other: targets that were given raise ValueError; those that follow from powers
    give the table of the last sweep once sweeps bring it no nearer, in which the last dimension's margins hold. An empty table gives an empty one.
    """
    powers = {**{d: 1.0 for d in dims}, **(powers or {})}
    cells = materialize(cells.where("tokens > 0").select(*dims, F.col("tokens").cast("double").alias("tokens")), "cells")
    one = cells.count() <= ONE_PARTITION_CELLS
    out = cells.coalesce(1) if one else cells
    for d in dims:
        w = Window.partitionBy(d)
        given = (targets or {}).get(d)
        goal = F.pow(F.sum("tokens").over(w), F.lit(powers[d])) if given is None else F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(d)], F.lit(0.0)) if given else F.lit(0.0)
        out = out.withColumns({f"__goal_{d}": goal, f"__cells_{d}": F.count(F.lit(1)).over(w)})
    sums = out.agg(*[F.sum(F.col(f"__goal_{d}") / F.col(f"__cells_{d}")).alias(d) for d in dims]).first()
    if sums[dims[0]] is None:
        return cells.withColumn("weight", F.lit(0.0))
    out = out.select(*dims, "tokens", *[(F.col(f"__goal_{d}") / F.lit(sums[d])).alias(f"__goal_{d}") for d in dims], (F.col("tokens") / F.lit(cells.agg(F.sum("tokens")).first()[0])).alias("weight"))
    before = float("inf")
    for _ in range(max_rounds):
        for d in dims * SWEEPS:
            total = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"__goal_{d}") / total).otherwise(F.lit(0.0)))
        out = materialize(out, "raked")
        out = out.coalesce(1) if one else out
        off = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"__goal_{d}")).alias(f"__off_{d}") for d in dims]
        worst = out.select(*off).agg(F.max(F.greatest(*[f"__off_{d}" for d in dims], F.lit(0.0)))).first()[0]
        if worst < TOLERANCE or (not targets and worst > 0.99 * before):
            return out.select(*dims, "tokens", "weight")
        before = worst
    if not targets:
        return out.select(*dims, "tokens", "weight")
    raise ValueError(f"margins are off by {worst:g} after {max_rounds * SWEEPS} sweeps: the targets contradict each other")


def probabilities(raked: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, probability): in proportion to weight / tokens, 1 for the cell that the target lifts most, so no document need repeat."""
    top = raked.agg(F.max(F.col("weight") / F.col("tokens"))).first()[0]
    return raked.select(*dims, (F.col("weight") / F.col("tokens") / F.lit(top or 1.0)).alias("probability"))


def mix(rows: DataFrame, dims: list[str], targets: dict[str, dict] | None = None, powers: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """rows (doc_id, dims, tokens, others) with probability and kept.

    kept compares the probability of the row's cell with a hash of seed and doc_id, so rows with equal ids fare alike in a
    cell, and a rerun keeps the same. Rows without tokens, and rows with a null doc_id, have probability 1 and stay.
    """
    rows = rows.drop("probability", "kept")
    raked = rake(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), dims, targets, powers)
    cells = materialize(probabilities(raked, dims).select(*[F.col(d).alias(f"__{d}") for d in dims], "probability"), "probabilities")
    n = cells.count()
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"__{d}"))
    unit = F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    p = F.when((F.col("tokens") > 0) & F.col("doc_id").isNotNull(), F.col("probability")).otherwise(F.lit(1.0))
    joined = rows.join(bounded_broadcast(cells, n, 128), same, "left").withColumn("probability", p)
    return joined.withColumn("kept", unit < F.col("probability")).withColumn("kept", F.coalesce(F.col("kept"), F.lit(True)) | (F.col("probability") >= 1)).select(*rows.columns, "probability", "kept")


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs sampled to POWERS' shares of source, language and topic, in docs' own columns."""
    inner = docs.select("doc_id", "source", "lang", tokens().alias("tokens"), F.struct(*docs.columns).alias("__in"))
    return mix(with_topic(inner, labels), list(POWERS), powers=POWERS).where("kept").select("__in.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", tokens().alias("tokens"))
    rows = materialize(with_topic(docs, documents(spark, sf_dir, "labels")), "counted")
    return mix(rows, list(POWERS), powers=POWERS)


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
