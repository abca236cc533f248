"""Evidence by allele log-likelihoods in long form: (site, sample, ev, allele, ll), allele 0 the reference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Evidence tells alleles apart if the best leads by more than this, in log10 units.
INFORMATIVE = 0.2
KEY = ["site", "sample", "ev"]


def best_alleles(ll: DataFrame, priority: str | None = None, can_be_reference: bool = True) -> DataFrame:
    """(site, sample, ev, best, best_ll, second_ll, confidence, is_informative): the likeliest allele of each piece of evidence.

    Ties go to the lower allele. With a priority column, where the best leads by less than the threshold, the best and the second are those
    with the highest priority among alleles within the threshold of the likeliest; of equal priorities the likeliest comes first, then the
    second likeliest, then the lower allele. Without the reference, allele 0 can be neither, but stands in as the second of a lone
    other allele. The threshold is INFORMATIVE, in natural units for likelihoods that to_natural_log made. One grouped pass over lists
    that hold an entry an allele.
    """
    limit = F.lit(INFORMATIVE * math.log(10) if _is_natural(ll) else INFORMATIVE)
    rank = F.col(priority).cast("double") if priority else F.lit(0.0)
    entry = F.struct((-F.col("ll")).alias("d"), F.col("allele").alias("allele"), F.col("ll").alias("ll"), rank.alias("p"))
    listed = ll.groupBy(*KEY).agg(F.sort_array(F.collect_list(entry)).alias("x"))
    if not can_be_reference:
        others = F.filter("x", lambda a: a["allele"] != 0)
        # nothing but the reference can be the second of a lone allele
        listed = listed.withColumn("x", F.when(F.size(others) == 1, F.concat(others, F.filter("x", lambda a: a["allele"] == 0))).otherwise(others)).where(F.size(others) > 0)
    first, second = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    if priority:
        lead = first["ll"] - second["ll"]
        near = F.filter("x", lambda a: first["ll"] - a["ll"] <= limit)
        ordered = F.transform(near, lambda a: F.struct((-a["p"]).alias("r"), F.when(a["allele"] == first["allele"], 0).when(a["allele"] == second["allele"], 1).otherwise(2).alias("o"), a["allele"].alias("allele"), a["ll"].alias("ll")))
        listed = listed.withColumn("x", F.when((F.size("x") > 1) & (lead < limit) & (F.lit(can_be_reference) | (second["allele"] != 0)), F.transform(F.array_sort(ordered), lambda a: F.struct((-a["ll"]).alias("d"), a["allele"].alias("allele"), a["ll"].alias("ll"), (-a["r"]).alias("p")))).otherwise(F.col("x")))
    out = listed.select(*KEY, first["allele"].alias("best"), first["ll"].alias("best_ll"), second["ll"].alias("second_ll"))
    lead = F.when(F.col("best_ll") == F.col("second_ll"), F.lit(0.0)).otherwise(F.col("best_ll") - F.coalesce("second_ll", F.lit(float("-inf"))))
    return out.withColumn("confidence", lead).withColumn("is_informative", F.col("confidence") > limit)


def _is_natural(ll: DataFrame) -> bool:
    return bool(ll.schema["ll"].metadata.get("natural"))


def ranked_alleles(ll: DataFrame) -> DataFrame:
    """ll with rank, 1 for the likeliest allele of the evidence."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("ll"), "allele")
    return ll.withColumn("rank", F.row_number().over(w))


def marginalize(ll: DataFrame, mapping: DataFrame) -> DataFrame:
    """ll over new alleles, each as likely as the likeliest old one mapped to it; mapping is (allele, new_allele)."""
    return ll.join(F.broadcast(mapping), "allele").groupBy(*KEY, F.col("new_allele").alias("allele")).agg(F.max("ll").alias("ll"))


def by_fragment(ll: DataFrame, names: DataFrame) -> DataFrame:
    """ll of fragments: sums over the evidence with the same read name; names is (ev, name)."""
    joined = ll.join(names, "ev")
    return joined.groupBy("site", "sample", F.col("name").alias("ev"), "allele").agg(F.sum("ll").alias("ll"))


def to_natural_log(ll: DataFrame) -> DataFrame:
    """ll in natural units, which its column remembers; doing so twice raises ValueError."""
    if _is_natural(ll):
        raise ValueError("the likelihoods are natural logarithms already")
    return ll.withColumn("ll", (F.col("ll") * math.log(10)).alias("ll", metadata={"natural": True}))


def allele_depths(best: DataFrame) -> DataFrame:
    """(site, sample, allele, ad): informative evidence of each allele."""
    return best.where("is_informative").groupBy("site", "sample", F.col("best").alias("allele")).agg(F.count(F.lit(1)).alias("ad"))


def is_f2r1(first_of_pair: Column, reverse: Column) -> Column:
    """Orientation of a read's fragment: the second read forward."""
    return reverse == first_of_pair
