"""Annotations: statistics by site and by sample.

Evidence (L) is a table with site, sample, ev, best (allele, 0 the reference), is_informative and read columns: mapq, is_reverse, qual, read_pos (distance to the
nearer end), isize, start, hard_clipped, best_ll, base, contig. Genotypes (G) have site, sample, gt (array<int>, -1 for no call), ad, pl (array<int>), gq, dp. Sites (R) have site,
ref, alts (array<string>) and before / after, the reference bases on either side.
Each function gives one row a site, or a site and sample, and leaves out those where the statistic is absent.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.types import StringType

from locusframe.operators import stats

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


def _alt() -> Column:
    return F.col("best") > 0


def _called() -> Column:
    return (F.size("gt") > 0) & ~F.exists("gt", lambda a: a < 0)


def _hom_ref() -> Column:
    return _called() & F.forall("gt", lambda a: a == 0)


def _het() -> Column:
    return _called() & (F.size(F.array_distinct("gt")) > 1)


def _hom_var() -> Column:
    return _called() & (F.size(F.array_distinct("gt")) == 1) & (F.get("gt", F.lit(0)) > 0)


def usable_mapq() -> Column:
    return ~F.col("mapq").isin(0, 255)


# --- genotypes


@register("ChromosomeCounts")
def chromosome_counts(g: DataFrame) -> DataFrame:
    """(site, an, ac, af) by alternative allele; sites where nobody is called are absent."""
    alleles = g.select("site", F.explode("gt").alias("allele")).where("allele >= 0")
    total = alleles.groupBy("site").agg(F.count(F.lit(1)).alias("an"))
    return alleles.where("allele > 0").groupBy("site", "allele").agg(F.count(F.lit(1)).alias("ac")).join(total, "site").withColumn("af", F.col("ac") / F.col("an"))


@register("SampleList")
def sample_list(g: DataFrame) -> DataFrame:
    return g.where(_called() & ~_hom_ref()).groupBy("site").agg(F.array_join(F.sort_array(F.collect_set("sample")), ",").alias("samples"))


@register("GenotypeSummaries")
def genotype_summaries(g: DataFrame) -> DataFrame:
    """(site, ncc, gq_mean, gq_stddev): samples not called, and the mean and sample deviation of the qualities there are."""
    return g.groupBy("site").agg(F.count_if(~_called()).alias("ncc"), F.avg("gq").alias("gq_mean"), F.when(F.count("gq") > 1, F.stddev_samp("gq")).alias("gq_stddev"))


def genotype_counts(g: DataFrame) -> DataFrame:
    """(site, hom_ref, het, hom_var) of called samples."""
    return g.groupBy("site").agg(F.count_if(_hom_ref()).alias("hom_ref"), F.count_if(_het()).alias("het"), F.count_if(_hom_var()).alias("hom_var"))


@register("ExcessHet")
def excess_het(g: DataFrame) -> DataFrame:
    p = stats.hardy_weinberg_right_tail("het", "hom_ref", "hom_var")
    tail = genotype_counts(g).where("hom_ref + het + hom_var > 0").withColumn("p", p)
    return tail.select("site", F.when(F.col("p") < 1e-59, F.lit(160.0)).otherwise(F.abs(F.lit(-10.0) * F.log10("p"))).alias("excess_het"))


@register("InbreedingCoeff")
def inbreeding_coeff(g: DataFrame, least: int = 10) -> DataFrame:
    n = F.col("hom_ref") + F.col("het") + F.col("hom_var")
    return genotype_counts(g).where(n >= least).select("site", stats.inbreeding(F.col("het"), F.col("hom_ref"), F.col("hom_var")).alias("f"))


@register("AS_InbreedingCoeff")
def as_inbreeding_coeff(g: DataFrame, least: int = 10) -> DataFrame:
    """(site, allele, f): each alternative allele against all others."""
    called = g.where(_called())
    n = called.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    of = called.select("site", "gt", F.explode(F.array_distinct(F.filter("gt", lambda a: a > 0))).alias("allele"))
    copies = F.size(F.filter("gt", lambda a: a == F.col("allele")))
    counts = of.groupBy("site", "allele").agg(F.count_if(copies == 1).alias("het"), F.count_if(copies == 2).alias("hom_var")).join(n, "site")
    return counts.select("site", "allele", stats.inbreeding(F.col("het"), F.col("n") - F.col("het") - F.col("hom_var"), F.col("hom_var")).alias("f"))


@register("RawGtCount")
def raw_gt_count(raw: DataFrame) -> DataFrame:
    """(site, raw_gt_count) of raw (site, text `hom_ref,het,hom_var`): sums, the first printed as `.`, wrapped to 32 bits."""
    parts = F.transform(F.split("text", ","), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    wrap = lambda x: F.pmod(x + 2**31, F.lit(2**32)) - 2**31
    sums = raw.select("site", parts.alias("p")).groupBy("site").agg(*[F.sum(F.get("p", F.lit(i))).alias(f"n{i}") for i in (1, 2)])
    return sums.select("site", F.concat_ws(",", F.lit("."), wrap(F.col("n1")).cast("string"), wrap(F.col("n2")).cast("string")).alias("raw_gt_count"))


@register("QualByDepth")
def qual_by_depth(g: DataFrame, sites: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(site, qd, refused) of sites (site, qual): quality by the depth of samples that carry an alternative.

    Samples whose alternatives have more than one read count alone if there are any. Without allele depths the evidence counts, else dp. 35 or more is
    refused: qd is null.
    """
    alt = F.aggregate(F.slice("ad", F.lit(2), F.greatest(F.size("ad") - 1, F.lit(0))), F.lit(0), lambda s, x: s + x)
    total = F.aggregate("ad", F.lit(0), lambda s, x: s + x)
    carriers = g.where(_called() & ~_hom_ref())
    d = carriers.groupBy("site").agg(F.sum(total).alias("all"), F.sum(F.when(alt > 1, total)).alias("restricted"), F.sum("dp").alias("dp"))
    depth = F.coalesce(F.when(F.col("restricted") > 0, F.col("restricted")), F.when(F.col("all") > 0, F.col("all")))
    out = sites.join(d, "site")
    if evidence is not None:
        out = out.join(evidence.groupBy("site").agg(F.count(F.lit(1)).alias("n_ev")), "site", "left")
        depth = F.coalesce(depth, F.when(F.col("n_ev") > 0, F.col("n_ev")))
    out = out.withColumn("depth", F.coalesce(depth, F.col("dp"))).where("depth > 0").withColumn("x", F.col("qual") / F.col("depth"))
    return out.select("site", F.when(F.col("x") < 35, F.col("x")).alias("qd"), (F.col("x") >= 35).alias("refused"))


@register("AS_QD")
def as_qual_by_depth(g: DataFrame, as_qual: DataFrame) -> DataFrame:
    """(site, allele, qd, refused) of as_qual (site, allele, qual): by the reads of the allele and the reference."""
    ads = g.where(_called() & ~_hom_ref()).select("site", F.posexplode("ad").alias("allele", "n")).groupBy("site", "allele").agg(F.sum("n").alias("n"))
    ref = ads.where("allele = 0").select("site", F.col("n").alias("ref_n"))
    out = as_qual.join(ads, ["site", "allele"]).join(ref, "site").withColumn("depth", F.col("n") + F.col("ref_n")).where("depth > 0").withColumn("x", F.col("qual") / F.col("depth"))
    return out.select("site", "allele", F.when(F.col("x") < 35, F.col("x")).alias("qd"), (F.col("x") >= 35).alias("refused"))


@register("AlleleFraction")
def allele_fraction(g: DataFrame) -> DataFrame:
    """(site, sample, af): shares of the alternatives among the allele depths."""
    total = F.aggregate("ad", F.lit(0.0), lambda s, x: s + x)
    return g.where(F.size("ad") > 0).withColumn("t", total).where("t > 0").select("site", "sample", F.transform(F.slice("ad", F.lit(2), F.size("ad") - 1), lambda x: x / F.col("t")).alias("af"))


def _trios(g: DataFrame, trios: DataFrame) -> DataFrame:
    """Genotypes of child, mother and father side by side; trios is a small table (family, mother, father, child)."""
    side = lambda who: g.select("site", F.col("sample").alias(who), F.struct(*[F.col(c) for c in g.columns if c not in ("site", "sample")], _hom_ref().alias("ref"), _het().alias("het"), _hom_var().alias("var")).alias(f"{who}_g"))
    out = side("child").join(F.broadcast(trios), "child")
    return out.join(side("mother"), ["site", "mother"]).join(side("father"), ["site", "father"])


@register("PossibleDeNovo")
def possible_de_novo(g: DataFrame, trios: DataFrame, parent_gq: int = 20, depth: int = 0, hi: int = 20, lo: int = 10) -> DataFrame:
    """(site, hi_conf, lo_conf): children heterozygous beneath two reference parents, where the allele is rare among all samples."""
    n = g.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("gt", lambda a: a > 0))).alias("ac")).where(F.col("ac") < F.greatest(F.lit(4.0), F.col("n") * 0.001))
    t = _trios(g, trios).where("child_g.het and mother_g.ref and father_g.ref").join(n, "site")
    gq = lambda who: F.coalesce(F.col(f"{who}_g.gq"), F.lit(-1))
    deep = F.least(*[F.coalesce(F.col(f"{w}_g.dp"), F.lit(-1)) for w in ("child", "mother", "father")]) >= depth
    parents = F.least(gq("mother"), gq("father"))
    high = (gq("child") >= hi) & (parents >= parent_gq) & deep
    low = (gq("child") >= lo) & (parents > 0) & deep & ~high
    marked = t.select("site", F.when(high, F.col("child")).alias("h"), F.when(low, F.col("child")).alias("l"))
    return marked.groupBy("site").agg(F.sort_array(F.collect_set("h")).alias("hi_conf"), F.sort_array(F.collect_set("l")).alias("lo_conf")).where("size(hi_conf) + size(lo_conf) > 0")


@register("TransmittedSingleton")
def transmitted_singleton(g: DataFrame, trios: DataFrame, min_dp: int = 20, min_gq: int = 20, call_rate: float = 0.9) -> DataFrame:
    """(site, transmitted, not_transmitted): one parent alone carries the allele, and the child has it or not. Depth is asked of the child only."""
    n = g.groupBy("site").agg(F.count_if(_called() & (F.coalesce("gq", F.lit(-1)) > min_gq)).alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("gt", lambda a: a > 0))).alias("ac"))
    t = _trios(g, trios).join(n.where(F.col("good") / F.col("n") >= call_rate), "site").where(F.coalesce(F.col("child_g.dp"), F.lit(-1)) >= min_dp)
    ok = F.least(*[F.coalesce(F.col(f"{w}_g.gq"), F.lit(-1)) for w in ("child", "mother", "father")]) >= min_gq
    one = (F.col("mother_g.het") & F.col("father_g.ref")) | (F.col("mother_g.ref") & F.col("father_g.het"))
    parent = F.when(F.col("mother_g.het"), F.col("mother")).otherwise(F.col("father"))
    marked = t.where(ok & one).select("site", F.when((F.col("ac") == 2) & F.col("child_g.het"), parent).alias("y"), F.when((F.col("ac") == 1) & F.col("child_g.ref"), parent).alias("x"))
    return marked.groupBy("site").agg(F.sort_array(F.collect_set("y")).alias("transmitted"), F.sort_array(F.collect_set("x")).alias("not_transmitted")).where("size(transmitted) + size(not_transmitted) > 0")


# --- evidence


@register("Coverage")
def coverage(ev: DataFrame) -> DataFrame:
    return ev.groupBy("site").agg(F.count(F.lit(1)).alias("dp"))


@register("MappingQualityZero")
def mapping_quality_zero(ev: DataFrame) -> DataFrame:
    return ev.groupBy("site").agg(F.count_if(F.col("mapq") == 0).alias("mq0"))


@register("CountNs")
def count_ns(ev: DataFrame) -> DataFrame:
    return ev.groupBy("site").agg(F.count_if(F.upper("base") == "N").alias("ncount"))


@register("OriginalAlignment")
def original_alignment(ev: DataFrame, tlod: DataFrame) -> DataFrame:
    """(site, ocm): reads of the alternative with the largest tlod (site, allele, tlod) whose original contig (oa_contig) is another."""
    top = tlod.groupBy("site").agg(F.max_by("allele", F.struct("tlod", -F.col("allele"))).alias("top"))
    return ev.join(top, "site").where("is_informative and best = top").groupBy("site").agg(F.count_if(F.coalesce(F.col("oa_contig") != F.col("contig"), F.lit(False))).alias("ocm"))


def _median_by_allele(ev: DataFrame, value: Column, name: str, empty: int, alts_only: bool = False) -> DataFrame:
    """Median by allele of informative reads, over all alleles (site, allele) that the evidence names as n_alleles."""
    alleles = ev.groupBy("site").agg(F.max("n_alleles").alias("n")).select("site", F.explode(F.sequence(F.lit(1 if alts_only else 0), F.col("n") - 1)).alias("allele"))
    held = ev.where("is_informative").where(usable_mapq()).groupBy("site", F.col("best").alias("allele")).agg(stats.median_half_up(value).cast("int").alias(name))
    return alleles.join(held, ["site", "allele"], "left").withColumn(name, F.coalesce(name, F.lit(empty)))


@register("BaseQuality")
def base_quality(ev: DataFrame) -> DataFrame:
    return _median_by_allele(ev, F.col("qual"), "mbq", 0)


@register("MappingQuality")
def mapping_quality(ev: DataFrame) -> DataFrame:
    return _median_by_allele(ev, F.col("mapq"), "mmq", 60)


@register("ReadPosition")
def read_position(ev: DataFrame) -> DataFrame:
    return _median_by_allele(ev, F.col("read_pos"), "mpos", 50, alts_only=True)


@register("FragmentLength")
def fragment_length(ev: DataFrame) -> DataFrame:
    return _median_by_allele(ev, F.abs("isize"), "mfrl", 0)


def _rank_sum(ev: DataFrame, value: Column, name: str) -> DataFrame:
    """(site, name): z of alternative reads against reference reads, to three decimals."""
    held = ev.where("is_informative").where(usable_mapq()).select("site", value.alias("value"), _alt().alias("is_alt"))
    return stats.rank_sum(held, ["site"]).where("z is not null").select("site", F.round("z", 3).alias(name))


@register("BaseQualityRankSum")
def base_quality_rank_sum(ev: DataFrame) -> DataFrame:
    return _rank_sum(ev, F.col("qual"), "base_q_rank_sum")


@register("MappingQualityRankSum")
def mapping_quality_rank_sum(ev: DataFrame) -> DataFrame:
    return _rank_sum(ev, F.col("mapq"), "mq_rank_sum")


@register("ReadPosRankSum")
def read_pos_rank_sum(ev: DataFrame) -> DataFrame:
    return _rank_sum(ev, F.col("read_pos"), "read_pos_rank_sum")


@register("ClippingRankSum")
def clipping_rank_sum(ev: DataFrame) -> DataFrame:
    return _rank_sum(ev, F.col("hard_clipped"), "clipping_rank_sum")


@register("LikelihoodRankSum")
def likelihood_rank_sum(ev: DataFrame) -> DataFrame:
    return _rank_sum(ev, F.col("best_ll"), "likelihood_rank_sum")


def strand_tables(ev: DataFrame, least: int = 0) -> DataFrame:
    """(site, rf, rr, af, ar): reference and alternative reads by strand, over samples with more than `least` informative reads."""
    rev = F.col("is_reverse")
    held = ev.where("is_informative").where(usable_mapq())
    one = held.groupBy("site", "sample").agg(F.count_if(~_alt() & ~rev).alias("rf"), F.count_if(~_alt() & rev).alias("rr"), F.count_if(_alt() & ~rev).alias("af"), F.count_if(_alt() & rev).alias("ar"))
    return one.where(F.col("rf") + F.col("rr") + F.col("af") + F.col("ar") > least).groupBy("site").agg(*[F.sum(c).alias(c) for c in ("rf", "rr", "af", "ar")])


def _cells() -> list[Column]:
    return [F.col(c) for c in ("rf", "rr", "af", "ar")]


@register("FisherStrand")
def fisher_strand(ev: DataFrame) -> DataFrame:
    return strand_tables(ev, 2).select("site", stats.fisher_strand(*_cells()).alias("fs"))


@register("StrandOddsRatio")
def strand_odds_ratio(ev: DataFrame) -> DataFrame:
    return strand_tables(ev, 0).select("site", stats.strand_odds_ratio(*_cells()).alias("sor"))


@register("StrandBiasBySample")
def strand_bias_by_sample(ev: DataFrame) -> DataFrame:
    rev = F.col("is_reverse")
    held = ev.where("is_informative").where(usable_mapq())
    return held.groupBy("site", "sample").agg(F.count_if(~_alt() & ~rev).alias("rf"), F.count_if(~_alt() & rev).alias("rr"), F.count_if(_alt() & ~rev).alias("af"), F.count_if(_alt() & rev).alias("ar"))


@register("UniqueAltReadCount")
def unique_alt_read_count(ev: DataFrame) -> DataFrame:
    """(site, allele, n_unique): distinct start and fragment length of each alternative's reads."""
    return ev.where("is_informative").where(_alt()).groupBy("site", F.col("best").alias("allele")).agg(F.count_distinct("start", "isize").alias("n_unique"))


@register("BaseQualityHistogram")
def base_quality_histogram(ev: DataFrame) -> DataFrame:
    """(site, qual, allele, n)."""
    return ev.where("is_informative").where(usable_mapq()).groupBy("site", "qual", F.col("best").alias("allele")).agg(F.count(F.lit(1)).alias("n"))


@register("DepthPerAllele")
def depth_per_allele(ev: DataFrame) -> DataFrame:
    return ev.where("is_informative").groupBy("site", "sample", F.col("best").alias("allele")).agg(F.count(F.lit(1)).alias("ad"))


@register("DepthPerSample")
def depth_per_sample(ev: DataFrame) -> DataFrame:
    return ev.groupBy("site", "sample").agg(F.count_if("is_informative").alias("dp"))


@register("RMSMappingQuality")
def rms_mapping_quality(ev: DataFrame) -> DataFrame:
    return finalize_mapping_quality(combine_mapping_quality(raw_mapping_quality(ev)))


def raw_mapping_quality(ev: DataFrame, *by: str) -> DataFrame:
    """(site, by, square_sum, n): the partial form; an unknown quality counts for neither."""
    known = F.col("mapq") != 255
    return ev.groupBy("site", *by).agg(F.coalesce(F.sum(F.when(known, F.col("mapq").cast("long") * F.col("mapq"))), F.lit(0)).alias("square_sum"), F.count_if(known).alias("n"))


def combine_mapping_quality(raw: DataFrame) -> DataFrame:
    return raw.groupBy("site").agg(F.sum("square_sum").alias("square_sum"), F.sum("n").alias("n"))


def finalize_mapping_quality(combined: DataFrame) -> DataFrame:
    return combined.select("site", stats.rms(F.col("square_sum"), F.col("n")).alias("mq"))


def _by_alt(ev: DataFrame, value: Column, name: str) -> DataFrame:
    """(site, allele, name): the median of each alternative's one-sample statistic over samples."""
    held = ev.where("is_informative").where(usable_mapq()).select("site", "sample", "best", value.alias("value"))
    ref = held.where("best = 0")
    alts = held.where("best > 0").select("site", "sample", F.col("best").alias("allele")).distinct()
    both = held.where("best > 0").select("site", "sample", F.col("best").alias("allele"), "value", F.lit(True).alias("is_alt")).unionByName(ref.join(alts, ["site", "sample"]).select("site", "sample", "allele", "value", F.lit(False).alias("is_alt")))
    z = stats.rank_sum(both, ["site", "sample", "allele"]).where("z is not null").select("site", "allele", F.col("z").alias("value"))
    return stats.histogram_median(stats.histogram(z, ["site", "allele"]), ["site", "allele"]).withColumnRenamed("median", name)


@register("AS_BaseQualityRankSum")
def as_base_quality_rank_sum(ev: DataFrame) -> DataFrame:
    return _by_alt(ev, F.col("qual"), "as_base_q_rank_sum")


@register("AS_MappingQualityRankSum")
def as_mapping_quality_rank_sum(ev: DataFrame) -> DataFrame:
    return _by_alt(ev, F.col("mapq"), "as_mq_rank_sum")


@register("AS_ReadPosRankSum")
def as_read_pos_rank_sum(ev: DataFrame) -> DataFrame:
    return _by_alt(ev, F.col("read_pos"), "as_read_pos_rank_sum")


def raw_strand_table(ev: DataFrame, least: int = 2) -> DataFrame:
    """(site, sample, allele, fwd, rev): the partial form, of samples with more than `least` informative reads."""
    held = ev.where("is_informative").where(usable_mapq())
    enough = held.groupBy("site", "sample").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > least).select("site", "sample")
    return held.join(enough, ["site", "sample"]).groupBy("site", "sample", F.col("best").alias("allele")).agg(F.count_if(~F.col("is_reverse")).alias("fwd"), F.count_if("is_reverse").alias("rev"))


def combine_strand_table(raw: DataFrame) -> DataFrame:
    return raw.groupBy("site", "allele").agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"))


def _against_ref(table: DataFrame) -> DataFrame:
    ref = table.where("allele = 0").select("site", F.col("fwd").alias("rf"), F.col("rev").alias("rr"))
    alt = table.where("allele > 0").select("site", "allele", F.col("fwd").alias("af"), F.col("rev").alias("ar"))
    return alt.join(ref, "site", "left").fillna(0, ["rf", "rr"])


@register("AS_FisherStrand")
def as_fisher_strand(ev: DataFrame) -> DataFrame:
    return _against_ref(combine_strand_table(raw_strand_table(ev))).select("site", "allele", stats.fisher_strand(*_cells()).alias("as_fs"))


@register("AS_StrandOddsRatio")
def as_strand_odds_ratio(ev: DataFrame) -> DataFrame:
    return _against_ref(combine_strand_table(raw_strand_table(ev))).select("site", "allele", stats.strand_odds_ratio(*_cells()).alias("as_sor"))


@register("AS_RMSMappingQuality")
def as_rms_mapping_quality(ev: DataFrame) -> DataFrame:
    """(site, allele, as_mq): root mean square over the informative reads of each allele."""
    known = F.col("mapq") != 255
    return ev.where("is_informative").where(known).groupBy("site", F.col("best").alias("allele")).agg(F.sqrt(F.sum(F.col("mapq").cast("long") * F.col("mapq")) / F.count(F.lit(1))).alias("as_mq"))


@register("OrientationBiasReadCounts")
def orientation_bias(ll: DataFrame, reads: DataFrame, least_qual: int = 20) -> DataFrame:
    """(site, sample, allele, f1r2, f2r1): informative fragments by the allele that their summed likelihoods favour.

    reads has (site, sample, ev, name, mapq, qual, is_reverse, is_first). The first read (by ev) stands for its fragment (name), which counts if that read's mapping
    and base quality admit it.
    """
    from locusframe.operators import likelihood as lk

    names = reads.select("ev", "name").distinct()
    best = lk.best_alleles(lk.by_fragment(ll, names)).where("is_informative").select("site", "sample", F.col("ev").alias("name"), F.col("best").alias("allele"))
    first = reads.groupBy("site", "sample", "name").agg(F.min_by(F.struct("mapq", "qual", "is_reverse", "is_first"), "ev").alias("r"))
    held = best.join(first, ["site", "sample", "name"]).where(~F.col("r.mapq").isin(0, 255) & (F.coalesce("r.qual", F.lit(0)) >= least_qual))
    f2r1 = F.col("r.is_reverse") == F.col("r.is_first")
    return held.groupBy("site", "sample", "allele").agg(F.count_if(~f2r1).alias("f1r2"), F.count_if(f2r1).alias("f2r1"))


@register("FragmentDepthPerAllele")
def fragment_depth_per_allele(ll: DataFrame, names: DataFrame) -> DataFrame:
    from locusframe.operators import likelihood as lk

    return lk.allele_depths(lk.best_alleles(lk.by_fragment(ll, names))).withColumnRenamed("ad", "fad")


@register("HaplotypeFiltering")
def haplotype_filtering(haplotypes: DataFrame) -> DataFrame:
    """(site, assembled_haps, filtered_haps) of haplotypes (site, bases, filtered)."""
    return haplotypes.groupBy("site").agg(F.count_distinct("bases").alias("assembled_haps"), F.max("filtered").alias("filtered_haps"))


@register("AllelePseudoDepth")
def allele_pseudo_depth(ll: DataFrame) -> DataFrame:
    """(site, sample, allele, dd, df), as text of two and four digits."""
    return stats.pseudo_depth(ll).select("site", "sample", "allele", F.expr("format_number(dd, '#.##')").alias("dd"), F.expr("format_number(df, '#.####')").alias("df"))


# --- reference windows


@register("ReferenceBases")
def reference_bases(sites: DataFrame, flank: int = 10) -> DataFrame:
    """(site, ref_bases): flank bases on either side of the first base, padded with N on the right."""
    middle = F.concat(F.substring("before", -flank, flank), F.col("ref"), F.col("after"))
    return sites.select("site", F.rpad(F.substring(middle, 1, 2 * flank + 1), 2 * flank + 1, "N").alias("ref_bases"))


def _repeats(bases: Column, unit: Column) -> Column:
    """How often unit stands at the start of bases."""
    marked = F.replace(bases, unit, F.lit(" "))
    return F.length(marked) - F.length(F.ltrim(marked))


@register("TandemRepeat")
def tandem_repeat(sites: DataFrame) -> DataFrame:
    """(site, ru, rpa) of indels whose changed bases repeat in what follows: the unit, and its count in each allele.

    An allele repeats as often as the unit stands at the start of its bases without the padding base, with the context behind. Any count of zero drops the site.
    """
    padded = sites.select("site", "after", F.array_insert("alts", 1, F.col("ref")).alias("alleles"))
    tails = F.transform("alleles", lambda a: F.substr(a, F.lit(2)))
    changed = F.get(F.filter(tails, lambda t: F.length(t) > 0), F.lit(0))
    unit = F.regexp_extract(changed, r"^(.+?)\1*$", 1)
    out = padded.withColumns({"tails": tails, "ru": unit}).where(F.length("ru") > 0).where(F.size(F.array_distinct(F.transform("alleles", F.length))) > 1)
    counted = F.transform("tails", lambda t: _repeats(F.concat(t, F.col("after")), F.col("ru")))
    return out.withColumn("rpa", counted).where(~F.exists("rpa", lambda n: n == 0)).select("site", "ru", "rpa")


def _indel() -> Column:
    return F.exists("alts", lambda a: F.length(a) != F.length("ref"))


@register("FlowVariantType")
def variant_type(sites: DataFrame) -> DataFrame:
    """(site, variant_type, indel_classify, indel_length) by the first alternative."""
    alt = F.get("alts", F.lit(0))
    length = F.length(alt) - F.length("ref")
    kind = F.when(length == 0, "snp").when(_hmer_length() > 0, "h-indel").otherwise("non-h-indel")
    return sites.select("site", kind.alias("variant_type"), F.when(length > 0, "ins").when(length < 0, "del").alias("indel_classify"), F.abs(length).alias("indel_length"))


def _hmer_length() -> Column:
    """Length of the run of the changed base that follows, 0 if the changed bases are of more than one kind or the run is empty."""
    alt = F.get("alts", F.lit(0))
    changed = F.when(F.length(alt) > F.length("ref"), F.substr(alt, F.length("ref") + 1)).otherwise(F.substr(F.col("ref"), F.length(alt) + 1))
    base = F.substring(changed, 1, 1)
    one = F.length(F.replace(changed, base, F.lit(""))) == 0
    run = F.length("after") - F.length(F.ltrim(F.replace(F.col("after"), base, F.lit(" "))))
    return F.when(one & (F.length(changed) > 0), run).otherwise(0)


@register("FlowHmerIndel")
def hmer_indel(sites: DataFrame) -> DataFrame:
    """(site, hmer_indel_length, hmer_indel_nuc)."""
    alt = F.get("alts", F.lit(0))
    longer = F.when(F.length(alt) > F.length("ref"), alt).otherwise(F.col("ref"))
    return sites.where(_indel()).withColumn("n", _hmer_length()).select("site", F.col("n").alias("hmer_indel_length"), F.when(F.col("n") > 0, F.substring(F.reverse(longer), 1, 1)).alias("hmer_indel_nuc"))


@register("FlowMotifs")
def motifs(sites: DataFrame, size: int = 5) -> DataFrame:
    return sites.select("site", F.substring("before", -size, size).alias("left_motif"), F.substring("after", 1, size).alias("right_motif"))


@register("FlowGcContent")
def gc_content(sites: DataFrame, size: int = 10) -> DataFrame:
    window = F.concat(F.substring("before", -(size // 2), size // 2), F.substring(F.concat("ref", "after"), 1, size - size // 2))
    return sites.select("site", F.when(F.length(window) > 0, F.length(F.regexp_replace(window, "[^GCgc]", "")) / F.length(window)).alias("gc_content"))


def flow_key(bases: str, order: str = "TGCA") -> list[int] | None:
    """Run lengths along the flow cycle, 0 where the flow's base doesn't come; N goes with any. None after a whole cycle without a base."""
    out, at, idle, flow = [], 0, 0, 0
    while at < len(bases):
        base, n = order[flow % len(order)], 0
        while at < len(bases) and bases[at] in (base, "N"):
            n, at = n + 1, at + 1
        idle = 0 if n else idle + 1
        if idle > len(order):
            return None
        out.append(n)
        flow += 1
    return out


@register("FlowCycleSkip")
def cycle_skip(sites: DataFrame, order: str = "TGCA", size: int = 5) -> DataFrame:
    """(site, cycleskip_status) of substitutions: non-skip, possible or cycle-skip, by how the flow keys with either base differ."""

    def status(left: pd.Series, ref: pd.Series, alt: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, r, x, b in zip(left, ref, alt, right):
            one, two = flow_key(a + r + b, order), flow_key(a + x + b, order)
            if one is None or two is None:
                out.append(None)
            elif len(one) != len(two):
                out.append("cycle-skip")
            else:
                out.append("possible-cycle-skip" if any((p == 0) != (q == 0) for p, q in zip(one, two)) else "non-skip")
        return pd.Series(out, dtype="object")

    status = F.pandas_udf(status, StringType(), PandasUDFType.SCALAR)
    snps = sites.where(~_indel() & (F.length("ref") == 1))
    return snps.select("site", status(F.substring("before", -size, size), "ref", F.get("alts", F.lit(0)), F.substring("after", 1, size)).alias("cycleskip_status"))
