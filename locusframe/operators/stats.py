"""Statistics by site: rank sums, exact tests, strand bias, histograms."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Below this many values on both sides a rank sum is tested exactly.
EXACT_BELOW = 10
#: Fisher's test takes tables of up to so many entries.
FISHER_MAX = 2000
#: Tables are scaled to so many entries before the strand test.
STRAND_TABLE, STRAND_LIMIT = 200.0, 400
REL_ERR = 1 - 1e-6


def ranks(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """values with rank: the mean of the places that equal values share, from 1 in each group."""
    w = Window.partitionBy(*by)
    return values.withColumn("rank", F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1) / 2.0)


def rank_sum(values: DataFrame, by: list[str], value: str = "value", first: str = "is_alt") -> DataFrame:
    """(by, n1, n2, u, z): Mann-Whitney of the rows where `first` holds against the others; z is null if either side is empty.

    Values are counted before they are ranked, so a site's rows are combined ahead of the shuffle and its window holds distinct values
    only. The normal approximation corrects for ties and, where there are any, for continuity; below EXACT_BELOW values on both sides z follows
    from all permutations.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("float").alias("v")).agg(F.count_if(first).alias("a"), F.count_if(~F.col(first)).alias("b"))
    before = F.coalesce(F.sum(F.col("a") + F.col("b")).over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = F.col("a") + F.col("b")
    placed = counted.withColumn("rank", before + (t + 1) / 2.0)
    sums = placed.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("ties"), F.count(F.lit(1)).alias("values"),
        F.when(F.greatest(F.sum("a"), F.sum("b")) < EXACT_BELOW, F.sort_array(F.collect_list(F.struct("rank", "a", "b")))).alias("small"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    ties = F.when(F.col("values") > 1, F.col("ties")).otherwise(0)
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    shift = F.when(ties == 0, F.lit(0.0)).otherwise(F.lit(-0.5))
    near = F.when(sigma > 0, (u - n1 * n2 / 2 - shift) / sigma)
    return sums.where("n1 > 0 and n2 > 0").select(*by, "n1", "n2", u.alias("u"), F.when(F.col("small").isNotNull(), _exact_z(F.col("small"), F.col("r1"))).otherwise(near).alias("z"))


def _exact(small: list, r1: float) -> float:
    n1 = int(sum(x["a"] for x in small))
    ways: dict[tuple[int, int], int] = {(0, 0): 1}  # (taken, twice the rank sum): subsets
    for x in small:
        twice, m = round(2 * x["rank"]), int(x["a"] + x["b"])
        grown: dict[tuple[int, int], int] = {}
        for (k, s), n in ways.items():
            for c in range(min(m, n1 - k) + 1):
                at = (k + c, s + c * twice)
                grown[at] = grown.get(at, 0) + n * math.comb(m, c)
        ways = grown
    mine = round(2 * r1)
    below = sum(n for (k, s), n in ways.items() if k == n1 and s < mine)
    equal = sum(n for (k, s), n in ways.items() if k == n1 and s == mine)
    p = (below + equal / 2) / sum(n for (k, _), n in ways.items() if k == n1)
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


@F.pandas_udf(DoubleType())
def _exact_z(small: pd.Series, r1: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else _exact(list(s), r) for s, r in zip(small, r1)], dtype="float64")


def _log_factorials() -> Column:
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, FISHER_MAX + 1)))))
    return F.split(F.lit(",".join(f"{x:.12f}" for x in table)), ",").cast("array<double>")


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table [[a, b], [c, d]]: all tables with its margins that are no likelier, up to rounding."""
    table = _log_factorials()
    f = lambda n: F.element_at(table, (n + 1).cast("int"))
    m, n, k = a + b, c + d, a + c
    low, high = F.greatest(F.lit(0), k - n), F.least(k, m)
    log_p = lambda x: f(m) + f(n) + f(k) + f(m + n - k) - f(m + n) - f(x) - f(m - x) - f(k - x) - f(n - k + x)
    mine = log_p(a)
    total = F.aggregate(F.transform(F.sequence(low, high), log_p), F.lit(0.0), lambda s, x: s + F.when(x <= mine * REL_ERR, F.exp(x)).otherwise(0.0))
    return F.when(low == high, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def fisher_strand(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Phred-scaled p of the strand table; tables beyond STRAND_LIMIT entries are scaled to STRAND_TABLE and truncated."""
    total = a + b + c + d
    factor = total / STRAND_TABLE
    cells = [F.when(total > STRAND_LIMIT, (x / factor).cast("int")).otherwise(x.cast("int")) for x in (a, b, c, d)]
    return F.lit(-10.0) * F.log10(F.greatest(fisher_two_sided(*cells), F.lit(1e-320)))


def strand_odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log of the symmetric odds ratio with a pseudo-count, by the balance of the reference and the alternative strands."""
    a, b, c, d = ((x + 1).cast("double") for x in (a, b, c, d))
    ratio = (a / b) * (d / c) + (b / a) * (c / d)
    return F.log(ratio) + F.log(F.least(a, b) / F.greatest(a, b)) - F.log(F.least(c, d) / F.greatest(c, d))


def _right_tail(het: int, hom: int, other: int) -> float:
    rare = 2 * min(hom, other) + het
    n = het + hom + other
    if n == 0 or rare == 0:
        return 1.0
    mid = rare * (2 * n - rare) // (2 * n - 1)
    mid += (mid % 2) != (rare % 2)
    weights = {mid: 1.0}
    h, p = mid, 1.0
    while h >= 2 and p > 1e-16:
        r = (rare - h) // 2
        p *= h * (h - 1) / (4.0 * (r + 1) * (n - h - r + 1))
        h -= 2
        weights[h] = p
    h, p = mid, 1.0
    while h + 2 <= rare and p > 1e-16:
        r = (rare - h) // 2
        p *= 4.0 * r * (n - h - r) / ((h + 2.0) * (h + 1.0))
        h += 2
        weights[h] = p
    total = sum(weights.values())
    return min(1.0, max(0.0, sum(w for k, w in weights.items() if k >= het) / total))


@F.pandas_udf(DoubleType())
def hardy_weinberg_right_tail(het: pd.Series, hom_ref: pd.Series, hom_var: pd.Series) -> pd.Series:
    """Probability of as many heterozygotes or more, given the allele counts."""
    return pd.Series([_right_tail(int(h), int(a), int(b)) for h, a, b in zip(het, hom_ref, hom_var)], dtype="float64")


def inbreeding(het: Column, hom_ref: Column, hom_var: Column) -> Column:
    n = het + hom_ref + hom_var
    p = (2 * hom_ref + het) / (2.0 * n)
    expected = 2.0 * p * (1.0 - p) * n
    return F.when(expected > 0, 1.0 - het / expected)


def rms(square_sum: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.sqrt(square_sum / n))


def histogram_bin(value: Column, width: float = 0.1, epsilon: float = 0.01) -> Column:
    """Number of the bin; null for NaN."""
    return F.when(~F.isnan(value), F.round(F.floor((value + F.lit(epsilon * width)) / F.lit(width))).cast("long"))


def histogram(values: DataFrame, by: list[str], value: str = "value", width: float = 0.1) -> DataFrame:
    """(by, bin, n)."""
    return values.withColumn("bin", histogram_bin(F.col(value), width)).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram_median(hist: DataFrame, by: list[str], width: float = 0.1) -> DataFrame:
    """(by, median): the value of the bin that holds the middle entry, the lower of two."""
    w = Window.partitionBy(*by)
    walked = hist.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    return walked.where(F.col("upto") >= F.floor((F.col("total") + 1) / 2)).groupBy(*by).agg((F.min("bin") * F.lit(width)).alias("median"))


def median_half_up(value: Column) -> Column:
    """Median of a group, rounded half up."""
    return F.floor(F.percentile(value, F.lit(0.5)) + 0.5)


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def dirichlet_posterior(log10: np.ndarray, prior: float = 1.0) -> np.ndarray:
    """Allele pseudo-counts from an alleles by evidence matrix: fixed point of expected counts under their own Dirichlet."""
    counts = np.ones(len(log10))
    natural = log10 * math.log(10)
    while True:
        weights = natural + (_digamma(counts) - _digamma(np.array([counts.sum()])))[:, None]
        weights = np.exp(weights - weights.max(axis=0))
        new = prior + (weights / weights.sum(axis=0)).sum(axis=1)
        if np.abs(new - counts).sum() / new.sum() < 0.001:
            return new
        counts = new


def pseudo_depth(ll: DataFrame) -> DataFrame:
    """(site, sample, allele, dd, df): posterior pseudo-counts less the prior, and their shares; one site and sample is a group.

    An allele without a likelihood for some evidence can't have given rise to it.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="allele", columns="ev", values="ll", aggfunc="max", sort=True).fillna(-np.inf)
        dd = dirichlet_posterior(wide.to_numpy()) - 1.0
        return pd.DataFrame({"site": pdf["site"].iloc[0], "sample": pdf["sample"].iloc[0], "allele": wide.index, "dd": dd, "df": dd / max(dd.sum(), 1e-300)})

    fields = {f.name: f.dataType.simpleString() for f in ll.schema}
    return ll.groupBy("site", "sample").applyInPandas(fit, f"site {fields['site']}, sample {fields['sample']}, allele {fields['allele']}, dd double, df double")
