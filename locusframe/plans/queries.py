"""Registered queries over the fixtures, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import scalar
from locusframe.functions.expression import compile_predicate
from locusframe.operators import annotate, clipping, filters, intervals, likelihood, pileup, regions, sample, stats
from locusframe.operators import reads as rd
from locusframe.plans import fixtures as fx
from locusframe.plans import tools
from locusframe.sources import formats
from locusframe.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HEADER = filters.Header(tuple((n, k) for _, n, k in fx.CONTIGS), {f"rg{i}": {"LB": f"lib{i}", "SM": f"s{i}", "PL": ("ILLUMINA", "ULTIMA", "PACBIO")[i], "PU": f"unit{i}"} | ({"FO": "TGCA"} if i == 1 else {}) for i in range(3)})
_CASES = {k: "case rg " + " ".join(f"when '{g}' then '{a[k]}'" for g, a in HEADER.read_groups.items() if k in a) + " end" for k in ("LB", "SM", "PL", "PU", "FO")}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _sum(ops: str, of: str = "cigar") -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({of}, '([0-9]+)[{ops}]', 1), lambda x: cast(x as int))), 0)"


_READS = f"""with r0 as ({fx.READS}), r as (select *, (flags & 4) <> 0 or ref_idx = -1 or start_pos = 0 as um, (flags & 8) <> 0 or mate_ref = -1 or mate_start = 0 as mum, (flags & 1) <> 0 as pr, (flags & 16) <> 0 as rv, (flags & 32) <> 0 as mrv,
 regexp_replace(replace(cigar, '*', ''), '[0-9]+', '', 'g') as ops, start_pos + {_sum('MDN=X')} - 1 as end_pos, length(bases) as n from r0)"""

# --- filters: predicate in this engine, and in SQL over r

_WELL = [
    ("ValidAlignmentStart", "um or start_pos > 0"),
    ("ValidAlignmentEnd", "um or end_pos - start_pos + 1 >= 0"),
    ("AlignmentAgreesWithHeader", "um or (ref_idx between 0 and 4 and start_pos <= 20000)"),
    ("HasReadGroup", "rg is not null"),
    ("MatchingBasesAndQuals", "n = n_quals"),
    ("ReadLengthEqualsCigarLength", f"um or n = {_sum('MIS=X')}"),
    ("SeqIsStored", "n > 0"),
    ("CigarContainsNoNOperator", "cigar not like '%N%'"),
]
_GOOD = r"""(ops = '' or not (regexp_matches(cigar, '(^|[^0-9])0+[MIDNSHP=X]') or regexp_matches(ops, '^.+H.+$') or (regexp_matches(ops, '^[^H]S.') and not regexp_matches(ops, '^.SH$')) or regexp_matches(ops, '^..+S([^H]|H.)') or regexp_matches(ops, 'I[DSH]*I|D[ISH]*D') or not regexp_matches(ops, '[MIDN=X]')))
 and not regexp_matches(ops, '[ID][ID]|^[SH]*D|D[SH]*$')"""
_FACING = "(pr and not um and not mum and rv <> mrv)"
_FILTERS: list[tuple[str, Callable[[], Column], str | None]] = [
    ("AllowAllReads", filters.allow_all_reads, "true"),
    ("Mapped", filters.mapped, "not um"),
    ("MappingQualityAvailable", filters.mapping_quality_available, "mapq <> 255"),
    ("MappingQualityNotZero", filters.mapping_quality_not_zero, "mapq <> 0"),
    ("NotDuplicate", filters.not_duplicate, "(flags & 1024) = 0"),
    ("NotSecondaryAlignment", filters.not_secondary_alignment, "(flags & 256) = 0"),
    ("NotSupplementaryAlignment", filters.not_supplementary_alignment, "(flags & 2048) = 0"),
    ("PassesVendorQualityCheck", filters.passes_vendor_quality_check, "(flags & 512) = 0"),
    ("Paired", filters.paired, "pr"),
    ("NotProperlyPaired", filters.not_properly_paired, "pr and (flags & 2) = 0"),
    ("ProperlyPaired", filters.properly_paired, "pr and (flags & 2) <> 0"),
    ("FirstOfPair", filters.first_of_pair, "pr and (flags & 64) <> 0"),
    ("SecondOfPair", filters.second_of_pair, "pr and (flags & 128) <> 0"),
    ("NonZeroFragmentLength", filters.non_zero_fragment_length, "isize <> 0"),
    ("MatchingBasesAndQuals", filters.matching_bases_and_quals, "n = n_quals"),
    ("HasReadGroup", filters.has_read_group, "rg is not null"),
    ("MateDifferentStrand", filters.mate_different_strand, _FACING),
    ("MateOnSameContigOrNoMappedMate", filters.mate_on_same_contig_or_no_mapped_mate, "not pr or mum or (not um and ref_idx = mate_ref)"),
    ("CigarContainsNoNOperator", filters.cigar_contains_no_n_operator, "cigar not like '%N%'"),
    ("GoodCigar", filters.good_cigar, _GOOD),
    ("NonZeroReferenceLengthAlignment", filters.non_zero_reference_length_alignment, f"{_sum('MDN=X')} > 0"),
    ("PrimaryLine", filters.primary_line, "(flags & 2304) = 0"),
    ("ReadLengthEqualsCigarLength", filters.read_length_equals_cigar_length, f"um or n = {_sum('MIS=X')}"),
    ("SeqIsStored", filters.seq_is_stored, "n > 0"),
    ("ValidAlignmentStart", filters.valid_alignment_start, "um or start_pos > 0"),
    ("ValidAlignmentEnd", filters.valid_alignment_end, "um or end_pos - start_pos + 1 >= 0"),
    ("MateUnmappedAndUnmapped", filters.mate_unmapped_and_unmapped, "not (um or (pr and mum))"),
    ("NonChimericOriginalAlignment", filters.non_chimeric_original_alignment, "coalesce(split_part(oa, ',', 1) = xm, true)"),
    ("MappingQuality", lambda: filters.mapping_quality(10, 40), "mapq between 10 and 40"),
    ("ReadLength", lambda: filters.read_length(50, 100), "n between 50 and 100"),
    ("FragmentLength", lambda: filters.fragment_length(50, 400), "not pr or abs(isize) between 50 and 400"),
    ("MateDistant", lambda: filters.mate_distant(5000), "pr and not um and not mum and (abs(start_pos - mate_start) >= 5000 or ref_idx <> mate_ref)"),
    ("ReadName", lambda: filters.read_name(["r1_1", "r7_3", "r100_2"]), "name in ('r1_1', 'r7_3', 'r100_2')"),
    ("ReadStrand", lambda: filters.read_strand(True), "rv"),
    ("AmbiguousBase", lambda: filters.ambiguous_base(None, 0.07), "length(regexp_replace(bases, '[ACGTacgt*]', '', 'g')) <= cast(trunc(n * 0.07e0) as int)"),
    ("SoftClipped", lambda: filters.soft_clipped(ratio=0.08), f"coalesce({_sum('S')} * 1.0e0 / nullif({_sum('MIDNSHP=X')}, 0), 0.0e0) <= 0.08e0"),
    ("SoftClippedEnds", lambda: filters.soft_clipped(leading_trailing=0.05), f"""coalesce(({_sum('S', "regexp_extract(cigar, '^[0-9]+S')")} + {_sum('S', "regexp_extract(cigar, '[0-9]+S$')")}) * 1.0e0 / nullif({_sum('MIDNSHP=X')}, 0), 0.0e0) <= 0.05e0"""),
    ("Overclipped", lambda: filters.overclipped(46, True), f"{_sum('MI=X')} >= 46 or len(regexp_extract_all(ops, 'S+')) < 1"),
    ("ExcessiveEndClipped", lambda: filters.excessive_end_clipped(2), f"""{_sum('SH', "regexp_extract(cigar, '^([0-9]+[SH])*')")} <= 2 and {_sum('SH', "regexp_extract(cigar, '([0-9]+[SH])*$')")} <= 2"""),
    ("ReadGroup", lambda: filters.read_group("rg1"), "rg = 'rg1'"),
    ("NotOpticalDuplicate", filters.not_optical_duplicate, "case when od is null then true else try_cast(od as int) = 0 end"),
    ("Metrics", lambda: filters.metrics(True, True), "(flags & 2816) = 0 and not um"),
    ("ReadTagValue", lambda: filters.read_tag_value("NM", "GREATER", 0.5), "case when nm is null then false when try_cast(nm as float) is null then null else try_cast(nm as float) > 0.5 end"),
    ("HmerQualitySymmetric", filters.hmer_quality_symmetric, None),
    ("FlowBasedTpAttributeSymmetric", filters.flow_based_tp_attribute_symmetric, "false"),
    ("FlowBasedTpAttributeValid", filters.flow_based_tp_attribute_valid, "false"),
    ("Library", lambda: filters.library(HEADER, ["lib0", "lib2"]), f"coalesce({_CASES['LB']} in ('lib0', 'lib2'), false)"),
    ("Sample", lambda: filters.sample(HEADER, ["s1"]), f"coalesce({_CASES['SM']} in ('s1'), false)"),
    ("Platform", lambda: filters.platform(HEADER, ["illum", "pac"]), f"coalesce(contains({_CASES['PL']}, 'ILLUM') or contains({_CASES['PL']}, 'PAC'), false)"),
    ("PlatformUnit", lambda: filters.platform_unit(HEADER, ["unit1"]), f"coalesce({_CASES['PU']} <> 'unit1', true)"),
    ("ReadGroupBlackList", lambda: filters.read_group_black_list(HEADER, ["SM:s2", "ID:rg0"]), f"coalesce(rg not in ('rg0') and {_CASES['SM']} <> 's2', true)"),
    ("AlignmentAgreesWithHeader", lambda: filters.alignment_agrees_with_header(HEADER), _WELL[2][1]),
    ("IntervalOverlap", lambda: filters.interval_overlap([("chr1", 100, 5000), ("chr3", 9000, 9500)]), "not um and ((contig = 'chr1' and start_pos <= 5000 and end_pos >= 100) or (contig = 'chr3' and start_pos <= 9500 and end_pos >= 9000))"),
    ("ReadGroupHasFlowOrder", lambda: filters.read_group_has_flow_order(HEADER), "coalesce(rg = 'rg1', false)"),
    ("WellformedFlowBased", lambda: filters.wellformed_flow_based(HEADER), None),
    ("Wellformed", lambda: filters.wellformed(HEADER), " and ".join(f"({p})" for _, p in _WELL)),
    ("JexlExpressionReadTagValue", lambda: filters.jexl_expression_read_tag_value(["NM == 1 || NM > 2.5"]), "case when nm is null then null when try_cast(nm as bigint) = 1 then true when not regexp_matches(nm, '^[+-]?[0-9]+$') then null when try_cast(nm as double) is null then null else cast(nm as double) > 2.5 end"),
]


#: A number that tells reads apart; its sums by decision tell which reads were kept.
_MARK = "cast(start_pos as bigint) * 1009 + mapq * 131 + isize * 17 + flags"


def _decisions(spark: SparkSession, sf_dir: str, test: Callable[[], Column]) -> DataFrame:
    mark = F.col("start").cast("long") * 1009 + F.col("mapq") * 131 + F.col("isize") * 17 + F.col("flags")
    marked = fx.reads(spark, sf_dir).select("contig", test().alias("k"), mark.alias("mark"))
    sums = [F.sum(F.when(k, F.col("mark"))).alias(n) for n, k in (("kept_marks", F.col("k")), ("dropped_marks", ~F.col("k")), ("refused_marks", F.col("k").isNull()))]
    return marked.groupBy("contig").agg(F.count_if("k").alias("n_kept"), F.count_if(~F.col("k")).alias("n_dropped"), F.count_if(F.col("k").isNull()).alias("n_refused"), *sums)


_MARKS = ", ".join(f"cast(sum(mark) filter (where {k}) as bigint) as {n}" for n, k in (("kept_marks", "k"), ("dropped_marks", "not k"), ("refused_marks", "k is null")))
for _name, _test, _sql in _FILTERS:
    query(f"filter_{_name}", _sql and f"{_READS} select contig, count(*) filter (where k) as n_kept, count(*) filter (where not k) as n_dropped, count(*) filter (where k is null) as n_refused, {_MARKS} from (select contig, {_sql} as k, {_MARK} as mark from r) t group by contig")(lambda spark, sf_dir, test=_test: _decisions(spark, sf_dir, test))


@query("filter_rejection_counts", f"{_READS} select case " + " ".join(f"when not ({p}) then '{n}'" for n, p in _WELL) + " end as filter, count(*) as n_rejected from r group by 1")
def rejection_counts(spark, sf_dir):
    return filters.rejection_counts(fx.reads(spark, sf_dir), filters._wellformed_chain(HEADER))


# --- intervals

_IV = f"iv as ({fx.INTERVALS}), ex as ({fx.EXCLUDED})"


def _merged(src: str, slack: int, out: str) -> str:
    return f"{out}_f as (select *, case when s > max(e) over (partition by contig order by s, e rows between unbounded preceding and 1 preceding) + {slack} then 1 else 0 end as f from {src}), {out}_g as (select *, sum(f) over (partition by contig order by s, e rows unbounded preceding) as g from {out}_f), {out} as (select contig, min(s) as s, max(e) as e from {out}_g group by contig, g)"


_M = _merged("iv", 1, "m")
_ORDER = 'contig, s as "start", e as "end"'


@query("intervals_merge_all", f"with {_IV}, {_M} select {_ORDER} from m")
def merge_all(spark, sf_dir):
    return intervals.merge(fx.intervals(spark, sf_dir))


@query("intervals_merge_overlapping", f"with {_IV}, {_merged('iv', 0, 'm')} select {_ORDER} from m")
def merge_overlapping(spark, sf_dir):
    return intervals.merge(fx.intervals(spark, sf_dir), intervals.OVERLAPPING_ONLY)


_PADDED = "p as (select iv_id, contig, greatest(1, s - 30) as s, least(20000, e + 30) as e from iv where s - 30 <= 20000 and e + 30 >= 1)"


@query("intervals_pad", f"with {_IV}, {_PADDED} select iv_id, {_ORDER} from p")
def pad(spark, sf_dir):
    return intervals.pad(fx.intervals(spark, sf_dir), fx.contigs(spark), 30)


@query("intervals_flanks", f"with {_IV}, {_PADDED}, {_merged('p', 1, 'm')} select {_ORDER} from m")
def flanks(spark, sf_dir):
    return intervals.with_flanks(fx.intervals(spark, sf_dir), fx.contigs(spark), 30)


@query("intervals_union", f"with {_IV} select {_ORDER} from iv union all select {_ORDER} from ex")
def union(spark, sf_dir):
    return intervals.union(fx.intervals(spark, sf_dir), fx.intervals(spark, sf_dir, fx.EXCLUDED))


@query("intervals_intersection", f'with {_IV}, {_M} select m.contig, greatest(m.s, ex.s) as "start", least(m.e, ex.e) as "end" from m join ex on m.contig = ex.contig and m.s <= ex.e and ex.s <= m.e')
def intersection(spark, sf_dir):
    return intervals.intersect(intervals.merge(fx.intervals(spark, sf_dir)), fx.intervals(spark, sf_dir, fx.EXCLUDED))


_GAPS = f"{_merged('ex', 1, 'h')}, gaps as (select contig, e + 1 as s, coalesce(lead(s) over (partition by contig order by s) - 1, 2147483647) as e from h union all select contig, 1, min(s) - 1 from h group by contig having min(s) > 1)"
_SUBTRACTED = "x as (select m.contig, greatest(m.s, gaps.s) as s, least(m.e, gaps.e) as e from m join gaps on m.contig = gaps.contig and m.s <= gaps.e and gaps.s <= m.e where gaps.s <= gaps.e union all select contig, s, e from m where contig not in (select contig from h))"


@query("intervals_subtract", f"with {_IV}, {_M}, {_GAPS}, {_SUBTRACTED} select {_ORDER} from x")
def subtract(spark, sf_dir):
    return intervals.resolve(fx.intervals(spark, sf_dir), fx.intervals(spark, sf_dir, fx.EXCLUDED), fx.contigs(spark))


@query("intervals_shards", f'with {_IV}, {_M} select contig, cast(s + k * 25 as int) as "start", cast(least(e, s + k * 25 + 24) as int) as "end", cast(k as int) as shard from (select *, unnest(generate_series(0, cast(floor((e - s) / 25.0e0) as int))) as k from m) t')
def shards(spark, sf_dir):
    return intervals.shards(intervals.merge(fx.intervals(spark, sf_dir)), 25)


@query("intervals_loci", f"with {_IV}, {_M} select contig, cast(count(*) as bigint) as n, cast(sum(p) as bigint) as pos_sum from (select contig, unnest(generate_series(s, e)) as p from m) t group by contig")
def loci(spark, sf_dir):
    return intervals.loci(intervals.merge(fx.intervals(spark, sf_dir))).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


def _spans(spark, sf_dir):
    r = fx.reads(spark, sf_dir).where(~rd.is_unmapped())
    return r.withColumn("end", rd.end()).select("name", "contig", "start", "end", "mapq")


@query("intervals_overlap_join", f"{_READS}, {_IV} select iv_id, count(*) as n_reads, cast(sum(mapq) as bigint) as mapq_sum from r join iv on r.contig = iv.contig and r.start_pos <= iv.e and iv.s <= r.end_pos where not um group by iv_id")
def overlap_join(spark, sf_dir):
    return intervals.overlap_totals(_spans(spark, sf_dir), fx.intervals(spark, sf_dir), ("iv_id",), ("mapq",)).toDF("iv_id", "n_reads", "mapq_sum")


@query("intervals_semi_join", f"{_READS}, {_IV}, {_M} select contig, count(*) as n from r where not um and exists (select 1 from m where m.contig = r.contig and r.start_pos <= m.e and m.s <= r.end_pos) group by contig")
def semi_join(spark, sf_dir):
    return intervals.overlap_join(_spans(spark, sf_dir), intervals.merge(fx.intervals(spark, sf_dir)), "left_semi").groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


@query("intervals_anti_join", f"{_READS}, {_IV}, {_M} select contig, count(*) as n from r where not um and not exists (select 1 from m where m.contig = r.contig and r.start_pos <= m.e and m.s <= r.end_pos) group by contig")
def anti_join(spark, sf_dir):
    return intervals.overlap_join(_spans(spark, sf_dir), intervals.merge(fx.intervals(spark, sf_dir)), "left_anti", small=False).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


@query("intervals_novel_features", f"with {_IV}, l as (select contig, s, e, lag(s) over (partition by contig order by s, e) as ps, lag(e) over (partition by contig order by s, e) as pe from iv) select l.contig, count(*) as n, cast(sum(ex.iv_id) as bigint) as ids from ex join l on ex.contig = l.contig and ex.s <= l.e and l.s <= ex.e where not coalesce(ex.s <= pe and ps <= ex.e, false) group by l.contig")
def novel_features(spark, sf_dir):
    return intervals.novel_features(fx.intervals(spark, sf_dir, fx.EXCLUDED), fx.intervals(spark, sf_dir)).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("iv_id").alias("ids"))


@query("intervals_windows", f"with {_IV} select contig, cast(sum(greatest(1, s - 100)) as bigint) as w0, cast(sum(least(20000, e + 50)) as bigint) as w1 from iv group by contig")
def windows(spark, sf_dir):
    return intervals.windows(fx.intervals(spark, sf_dir), fx.contigs(spark), 100, 50).groupBy("contig").agg(F.sum("window_start").alias("w0"), F.sum("window_end").alias("w1"))


@query("intervals_position_against", f"{_READS} select case when end_pos < 5000 then 'before' when start_pos > 9000 then 'after' when start_pos >= 5000 and end_pos <= 9000 then 'contained' else 'overlapping' end as place, count(*) as n from r where not um group by 1")
def position_against(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy(intervals.position_against(F.col("start"), F.col("end"), F.lit(5000), F.lit(9000)).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("intervals_parse", f'with {_IV}, t as (select contig || \':\' || s || \'-\' || e as text, * from iv) select text, contig, s as "start", e as "end", cast(null as varchar) as reason from t')
def parse(spark, sf_dir):
    text = fx.intervals(spark, sf_dir).select(F.format_string("%s:%d-%d", "contig", "start", "end").alias("text"))
    return intervals.parse_text(text, fx.contigs(spark)).select("text", "contig", "start", "end", "reason")


@query("flagship_target_quality", f"{_READS}, {_IV}, {_M} select contig, count(*) as n_reads, round(sqrt(sum(case when mapq <> 255 then mapq * mapq end) * 1.0e0 / count(*) filter (where mapq <> 255)), 6) as rms_mapq from r where {' and '.join(f'({p})' for _, p in _WELL)} and not um and exists (select 1 from m where m.contig = r.contig and r.start_pos <= m.e and m.s <= r.end_pos) group by contig")
def flagship(spark, sf_dir):
    held = tools.read_walker(fx.reads(spark, sf_dir), [("Wellformed", filters.wellformed(HEADER)), ("Mapped", filters.mapped())], fx.intervals(spark, sf_dir))
    known = F.col("mapq") != 255
    return held.groupBy("contig").agg(F.count(F.lit(1)).alias("n_reads"), F.round(stats.rms(F.sum(F.when(known, F.col("mapq") * F.col("mapq"))), F.count_if(known)), 6).alias("rms_mapq"))


@query("reads_coordinates", f"""{_READS} select contig, cast(sum(end_pos) as bigint) as ends, cast(sum(start_pos - {_sum('S', "regexp_extract(cigar, '^([0-9]+[SH])*')")}) as bigint) as soft_starts, cast(sum(end_pos + {_sum('S', "regexp_extract(cigar, '([0-9]+[SH])*$')")}) as bigint) as soft_ends,
 cast(sum(start_pos - {_sum('SH', "regexp_extract(cigar, '^([0-9]+[SH])*')")}) as bigint) as unclipped_starts, cast(sum(end_pos + {_sum('SH', "regexp_extract(cigar, '([0-9]+[SH])*$')")}) as bigint) as unclipped_ends from r group by contig""")
def coordinates(spark, sf_dir):
    columns = {"ends": rd.end(), "soft_starts": rd.soft_start(), "soft_ends": rd.soft_end(), "unclipped_starts": rd.unclipped_start(), "unclipped_ends": rd.unclipped_end()}
    return fx.reads(spark, sf_dir).groupBy("contig").agg(*[F.sum(c).alias(n) for n, c in columns.items()])


_FRAGMENT = "isize <> 0 and pr and not um and not mum and rv <> mrv and case when rv then end_pos > mate_start else start_pos <= mate_start + isize end"


@query("reads_adaptor_boundary", f"{_READS} select contig, count(*) filter (where f) as n_known, cast(coalesce(sum(case when f then case when rv then mate_start - 1 else start_pos + abs(isize) end end), 0) as bigint) as boundaries from (select *, {_FRAGMENT} as f from r) t group by contig")
def adaptor_boundary(spark, sf_dir):
    return fx.reads(spark, sf_dir).select("contig", rd.adaptor_boundary().alias("b")).groupBy("contig").agg(F.count("b").alias("n_known"), F.coalesce(F.sum("b"), F.lit(0)).alias("boundaries"))


@query("reads_reverse_complement", f"{_READS} select contig, count(distinct reverse(translate(bases, 'ACGTacgt', 'TGCAtgca'))) as n_distinct, max(reverse(translate(bases, 'ACGTacgt', 'TGCAtgca'))) as last_one from r group by contig")
def reverse_complement(spark, sf_dir):
    return fx.reads(spark, sf_dir).select("contig", rd.reverse_complement("bases").alias("b")).groupBy("contig").agg(F.count_distinct("b").alias("n_distinct"), F.max("b").alias("last_one"))


@query("reads_unmapped_tail", f"{_READS} select count(*) as n from r where ref_idx = -1")
def unmapped_tail(spark, sf_dir):
    return formats.unmapped_tail(fx.reads(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query("clip_low_quality_ends")
def clip_low_quality(spark, sf_dir):
    r = fx.reads(spark, sf_dir).where(filters.good_cigar() & filters.mapped() & filters.read_length_equals_cigar_length() & filters.matching_bases_and_quals())
    return clipping.low_quality_ends(r, 5).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bases")).alias("bases"), F.sum("start").alias("starts"))


# --- pileup: the SQL walks cigars by running sums over their elements

_ADAPTOR = "isize <= 100 and isize <> 0 and pr and not um and not mum and rv <> mrv and case when rv then end_pos > mate_start else start_pos <= mate_start + isize end"
_ENDS_DELETED = "regexp_matches(regexp_replace(cigar, '[0-9]+[SHP]', '', 'g'), '^([0-9]+I)*[0-9]+D|[0-9]+D([0-9]+I)*$')"


def _piled(reads: str) -> str:
    return f"""{_READS}, q as (select *, row_number() over () as rid, case when {_ADAPTOR} then case when rv then mate_start - 1 else start_pos + abs(isize) end end as bound from r where {reads} and not {_ENDS_DELETED}),
 el as (select *, cast(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)[i] as int) as l, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)[i] as o from (select *, unnest(generate_series(1, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')))) as i from q) t),
 seg as (select *, coalesce(sum(case when o in ('M', 'D', 'N', '=', 'X') then l end) over w, 0) as at_ref, coalesce(sum(case when o in ('M', 'I', 'S', '=', 'X') then l end) over w, 0) as at_read from el window w as (partition by rid order by i rows between unbounded preceding and 1 preceding)),
 pl as (select *, start_pos + cast(at_ref as int) + cast(k as int) as pos, cast(case when o = 'D' then greatest(at_read - 1, 0) else at_read + k end as int) as off from (select *, unnest(generate_series(0, l - 1)) as k from seg where o in ('M', '=', 'X', 'D')) t),
 pile as (select *, o as op, case when o = 'D' then 'D' else substr(bases, off + 1, 1) end as base, case when o = 'D' then 16 when off < n_quals then (q0 + off * 7) % 41 end as qual from pl where bound is null or (case when rv then pos > bound else pos < bound end))"""


_PILE = _piled("not um and (flags & 1536) = 0")


def _pile(spark, sf_dir):
    """Of every read but those that pileup.elements refuses."""
    return pileup.elements(pileup.passing(fx.reads(spark, sf_dir).where(~pileup.ends_in_deletion())))


@query("pileup_depth", f"{_PILE} select contig, pos, count(*) as depth from pile group by contig, pos")
def depth(spark, sf_dir):
    return pileup.depth(_pile(spark, sf_dir))


@query("pileup_base_counts", f"{_PILE} select contig, pos, count(*) filter (where base = 'A') as a, count(*) filter (where base = 'C') as c, count(*) filter (where base = 'G') as g, count(*) filter (where base = 'T') as t from pile where op <> 'D' group by contig, pos")
def base_counts(spark, sf_dir):
    return pileup.base_counts(_pile(spark, sf_dir))


@query("pileup_usable", f"{_PILE} select contig, count(*) filter (where op <> 'D' and mapq not in (0, 255) and qual >= 6) as n_usable, count(*) filter (where op = 'D') as n_deleted, cast(sum(qual) as bigint) as qual_sum from pile group by contig")
def usable(spark, sf_dir):
    return _pile(spark, sf_dir).groupBy("contig").agg(F.count_if(pileup.usable()).alias("n_usable"), F.count_if("is_deletion").alias("n_deleted"), F.sum("qual").alias("qual_sum"))


@query("pileup_gap_filled", f"{_PILE}, {_IV}, {_M}, d as (select contig, pos, count(*) as depth from pile group by contig, pos), a as (select contig, unnest(generate_series(s, e)) as pos from m) select a.contig, cast(a.pos as int) as pos, coalesce(depth, 0) as depth from a left join d on a.contig = d.contig and a.pos = d.pos")
def gap_filled(spark, sf_dir):
    return pileup.route(pileup.depth(_pile(spark, sf_dir)), intervals.merge(fx.intervals(spark, sf_dir)), True)


@query("pileup_within_targets", f"{_PILE}, {_IV}, {_M}, d as (select contig, pos, count(*) as depth from pile group by contig, pos) select * from d where exists (select 1 from m where m.contig = d.contig and d.pos between m.s and m.e)")
def within_targets(spark, sf_dir):
    return pileup.route(pileup.depth(_pile(spark, sf_dir)), intervals.merge(fx.intervals(spark, sf_dir)), False)


_FIXED = "ranked as (select *, count(*) over (partition by contig, pos, name) as n2, row_number() over (partition by contig, pos, name order by case when (flags & 64) <> 0 then 0 else 1 end, flags, off, base, qual nulls first) as at2 from pile), pairs as (select contig, pos, name, max(case when at2 = 1 then base end) as bx, max(case when at2 = 2 then base end) as yb, max(case when at2 = 1 then qual end) as x, max(case when at2 = 2 then qual end) as y from ranked where n2 = 2 group by 1, 2, 3), fixed as (select r.contig, case when x is null or y is null then qual when bx = yb then case when at2 = 1 then least(x + y, 93) else 0 end when (x >= y) = (at2 = 1) then cast(trunc(greatest(x, y) * 0.8e0) as int) else 0 end as qual from ranked r left join pairs p on r.contig = p.contig and r.pos = p.pos and r.name = p.name)"


@query("pileup_pair_fix", f"{_PILE}, {_FIXED} select contig, cast(sum(qual) as bigint) as qual_sum, count(*) filter (where qual = 0) as n_zero from fixed group by contig")
def pair_fix(spark, sf_dir):
    return pileup.fixed_totals(pileup.passing(fx.reads(spark, sf_dir)), "contig", drop_refused=True)


# --- likelihoods and annotations

_BEST = f"ll as ({fx.LOGLIK}), k as (select *, row_number() over (partition by site, sample, ev order by ll desc, allele) as rn from ll), b as (select site, sample, ev, max(case when rn = 1 then allele end) as best, max(case when rn = 1 then ll end) as best_ll, max(case when rn = 2 then ll end) as second_ll from k group by 1, 2, 3), bb as (select *, best_ll - second_ll as confidence, best_ll - second_ll > 0.2e0 as is_informative from b), ev as (select site, sample, ev, best, best_ll, is_informative, {', '.join(fx.EVIDENCE)} from bb), u as (select * from ev where is_informative and mapq not in (0, 255))"


def _ev(sql: str) -> str:
    return f"with {_BEST} {sql}"


@query("likelihood_best_allele", _ev("select site, sample, ev, best, best_ll, second_ll, round(confidence, 6) as confidence, is_informative from bb"))
def best_allele(spark, sf_dir):
    return likelihood.best_alleles(fx.likelihoods(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("likelihood_marginalize", _ev("select site, sample, ev, case when allele = 0 then 0 else 1 end as allele, max(ll) as ll from ll group by 1, 2, 3, 4"))
def marginalize(spark, sf_dir):
    return likelihood.marginalize(fx.likelihoods(spark, sf_dir), spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "allele int, new_allele int"))


@query("likelihood_by_fragment", _ev("select site, sample, concat('f', cast(ev % 50 as string)) as ev, allele, round(sum(ll), 6) as ll from ll group by 1, 2, 3, 4"))
def by_fragment(spark, sf_dir):
    ll = fx.likelihoods(spark, sf_dir)
    names = ll.select("ev", F.concat(F.lit("f"), (F.col("ev") % 50).cast("string")).alias("name")).distinct()
    return likelihood.by_fragment(ll, names).withColumn("ll", F.round("ll", 6))


@query("likelihood_natural_log", _ev("select site, allele, round(sum(ll * 2.302585092994046e0), 4) as ll from ll group by 1, 2"))
def natural_log(spark, sf_dir):
    return likelihood.to_natural_log(fx.likelihoods(spark, sf_dir)).groupBy("site", "allele").agg(F.round(F.sum("ll"), 4).alias("ll"))


def _annotation(name: str, sql: str | None, run: Callable[[DataFrame], DataFrame] | None = None, digits: dict[str, int] | None = None) -> None:
    def f(spark, sf_dir):
        ev = fx.evidence(spark, sf_dir)
        out = run(ev) if run else annotate.REGISTRY[name](ev)
        return out.withColumns({c: F.round(c, d) for c, d in (digits or {}).items()})

    query(f"annotation_{name}", sql and _ev(sql))(f)


_annotation("Coverage", "select site, count(*) as dp from ev group by site")
_annotation("MappingQualityZero", "select site, count(*) filter (where mapq = 0) as mq0 from ev group by site")
_annotation("CountNs", "select site, count(*) filter (where base = 'N') as ncount from ev group by site")


def _median(value: str, name: str, empty: int, first: int = 0) -> str:
    return f"select site, allele, coalesce({name}, {empty}) as {name} from (select distinct site, cast(unnest(generate_series({first}, 2)) as int) as allele from ev) s left join (select site, best as allele, cast(floor(quantile_cont({value}, 0.5) + 0.5) as int) as {name} from u group by 1, 2) m using (site, allele)"


_annotation("BaseQuality", _median("qual", "mbq", 0))
_annotation("MappingQuality", _median("mapq", "mmq", 60))
_annotation("ReadPosition", _median("read_pos", "mpos", 50, 1))
_annotation("FragmentLength", _median("abs(isize)", "mfrl", 0))
_annotation("UniqueAltReadCount", "select site, best as allele, count(distinct (start, isize)) as n_unique from ev where is_informative and best > 0 group by 1, 2")
_annotation("BaseQualityHistogram", "select site, qual, best as allele, count(*) as n from u group by 1, 2, 3")
_annotation("DepthPerAllele", "select site, sample, best as allele, count(*) as ad from ev where is_informative group by 1, 2, 3")
_annotation("DepthPerSample", "select site, sample, count(*) filter (where is_informative) as dp from ev group by 1, 2")
_annotation("RMSMappingQuality", "select site, round(sqrt(sum(mapq * mapq) * 1.0e0 / count(*)), 6) as mq from ev where mapq <> 255 group by site", digits={"mq": 6})
_annotation("AS_RMSMappingQuality", "select site, best as allele, round(sqrt(sum(mapq * mapq) * 1.0e0 / count(*)), 6) as as_mq from ev where is_informative and mapq <> 255 group by 1, 2", digits={"as_mq": 6})
_SB = "count(*) filter (where best = 0 and not is_reverse) as rf, count(*) filter (where best = 0 and is_reverse) as rr, count(*) filter (where best > 0 and not is_reverse) as af, count(*) filter (where best > 0 and is_reverse) as ar"
_annotation("StrandBiasBySample", f"select site, sample, {_SB} from u group by 1, 2")
_SOR = "ln(((rf+1.0e0)/(rr+1.0e0))*((ar+1.0e0)/(af+1.0e0)) + ((rr+1.0e0)/(rf+1.0e0))*((af+1.0e0)/(ar+1.0e0))) + ln(least(rf+1.0e0, rr+1.0e0)/greatest(rf+1.0e0, rr+1.0e0)) - ln(least(af+1.0e0, ar+1.0e0)/greatest(af+1.0e0, ar+1.0e0))"


def _tables(least: int) -> str:
    return f"(select site, sum(rf) as rf, sum(rr) as rr, sum(af) as af, sum(ar) as ar from (select site, sample, {_SB} from u group by 1, 2) t where rf + rr + af + ar > {least} group by site) t"


def _fisher(table: str, key: str, name: str) -> str:
    return f"""select {key}, round(-10.0e0 * log10(greatest(case when lo = hi then 1.0e0 else least(1.0e0, p) end, 1e-320)) + 0.0e0, 5) as {name} from (select {key}, lo, hi, sum(case when lx <= l0 * (1 - 1e-6) then exp(lx) else 0.0e0 end) as p from
 (select *, lgamma(m+1)+lgamma(n+1)+lgamma(q+1)+lgamma(m+n-q+1)-lgamma(m+n+1)-lgamma(x+1)-lgamma(m-x+1)-lgamma(q-x+1)-lgamma(n-q+x+1) as lx, lgamma(m+1)+lgamma(n+1)+lgamma(q+1)+lgamma(m+n-q+1)-lgamma(m+n+1)-lgamma(a+1)-lgamma(m-a+1)-lgamma(q-a+1)-lgamma(n-q+a+1) as l0 from
 (select *, unnest(generate_series(lo, hi)) as x from (select *, greatest(0, q - n) as lo, least(q, m) as hi from (select {key}, a, a + b as m, c + d as n, a + c as q from (select {key}, {', '.join(f"cast(case when rf+rr+af+ar > 400 then trunc({x} / ((rf+rr+af+ar) / 200.0e0)) else {x} end as bigint) as {y}" for x, y in zip(("rf", "rr", "af", "ar"), "abcd"))} from {table}) w) v) z) y) x0 group by {key}, lo, hi) p0"""


_annotation("StrandOddsRatio", f"select site, round({_SOR}, 6) as sor from {_tables(0)}", digits={"sor": 6})
_annotation("FisherStrand", _fisher(_tables(2), "site", "fs"), digits={"fs": 5})
_AGAINST = "(select a.site, a.allele, coalesce(r.f, 0) as rf, coalesce(r.v, 0) as rr, a.f as af, a.v as ar from c a left join c r on a.site = r.site and r.allele = 0 where a.allele > 0) t"
_RAW = ", e2 as (select site, sample from u group by 1, 2 having count(*) > 2), c as (select site, best as allele, count(*) filter (where not is_reverse) as f, count(*) filter (where is_reverse) as v from u join e2 using (site, sample) group by 1, 2)"


def _raw(sql: str) -> str:
    return f"with {_BEST}{_RAW} {sql}"


for _n, _s, _d in (("AS_StrandOddsRatio", f"select site, allele, round({_SOR}, 6) as as_sor from {_AGAINST}", {"as_sor": 6}), ("AS_FisherStrand", _fisher(_AGAINST, "site, allele", "as_fs"), {"as_fs": 5})):
    _annotation(_n, None, digits=_d)
    ORACLES[f"annotation_{_n}"] = _raw(_s)


def _ranksum(value: str, name: str) -> str:
    return f"""select site, cast(sum(a) as bigint) as n1, cast(sum(b) as bigint) as n2, sum(a * rk) - sum(a) * (sum(a) + 1) / 2.0e0 as u,
 case when greatest(sum(a), sum(b)) < 10 then null else round((sum(a * rk) - sum(a) * (sum(a) + 1) / 2.0e0 - sum(a) * sum(b) / 2.0e0 - case when count(*) > 1 and sum(t*t*t - t) <> 0 then -0.5e0 else 0.0e0 end)
 / nullif(sqrt(sum(a) * sum(b) / 12.0e0 * (sum(a) + sum(b) + 1 - case when count(*) > 1 then sum(t*t*t - t) else 0 end / ((sum(a) + sum(b)) * (sum(a) + sum(b) - 1.0e0)))), 0), 4) end as {name}
 from (select *, coalesce(sum(t) over (partition by site order by v rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2.0e0 as rk from (select site, {value} as v, count(*) filter (where best > 0) as a, count(*) filter (where best = 0) as b, count(*) as t from u group by 1, 2) c) d group by site having sum(a) > 0 and sum(b) > 0"""


def _rank_query(value: str, name: str) -> Callable[[DataFrame], DataFrame]:
    def f(ev: DataFrame) -> DataFrame:
        held = ev.where("is_informative").where(annotate.usable_mapq()).select("site", F.col(value).alias("value"), (F.col("best") > 0).alias("is_alt"))
        small = F.greatest("n1", "n2") < stats.EXACT_BELOW
        return stats.rank_sum(held, ["site"]).select("site", "n1", "n2", "u", F.when(~small, F.round("z", 4)).alias(name))

    return f


for _n, _v in (("BaseQualityRankSum", "qual"), ("MappingQualityRankSum", "mapq"), ("ReadPosRankSum", "read_pos"), ("ClippingRankSum", "hard_clipped"), ("LikelihoodRankSum", "best_ll")):
    _annotation(_n, _ranksum(_v, "z") if _v != "best_ll" else _ranksum("cast(best_ll as float)", "z"), _rank_query(_v, "z"))
for _n in ("BaseQualityRankSum", "MappingQualityRankSum", "ReadPosRankSum", "ClippingRankSum", "LikelihoodRankSum"):
    # with the exact test of small sites, which SQL has no normal quantile for
    query(f"annotation_{_n}_exact")(lambda spark, sf_dir, name=_n: annotate.REGISTRY[name](fx.evidence(spark, sf_dir)))
for _n in ("AS_BaseQualityRankSum", "AS_MappingQualityRankSum", "AS_ReadPosRankSum"):
    _annotation(_n, None)


@query("annotation_OriginalAlignment", _ev("select site, count(*) filter (where oa_contig <> contig) as ocm from ev where is_informative and best = 1 + site % 2 group by site"))
def original_alignment(spark, sf_dir):
    ev = fx.evidence(spark, sf_dir)
    tlod = ev.select("site").distinct().select("site", F.explode(F.array(F.struct(F.lit(1).alias("allele"), (F.lit(1.0) - F.col("site") % 2).alias("tlod")), F.struct(F.lit(2).alias("allele"), F.lit(0.5).alias("tlod")))).alias("x")).select("site", "x.allele", "x.tlod")
    return annotate.original_alignment(ev, tlod)


_FRAGMENTS = "f as (select site, sample, concat('f', cast(ev % 50 as string)) as name, allele, sum(ll) as ll from ll group by 1, 2, 3, 4), fk as (select *, row_number() over (partition by site, sample, name order by ll desc, allele) as rn from f), fb as (select site, sample, name, max(case when rn = 1 then allele end) as allele from fk group by 1, 2, 3 having round(max(case when rn = 1 then ll end) - max(case when rn = 2 then ll end), 6) > 0.2e0), fr as (select site, sample, name, arg_min(mapq, ev) as mq, arg_min(qual, ev) as q, arg_min(is_reverse, ev) as rv, arg_min(is_first, ev) as fi from ev group by 1, 2, 3)"


@query("annotation_OrientationBias", f"with {_BEST}, {_FRAGMENTS} select site, sample, allele, count(*) filter (where rv <> fi) as f1r2, count(*) filter (where rv = fi) as f2r1 from fb join fr using (site, sample, name) where mq not in (0, 255) and q >= 20 group by 1, 2, 3")
def orientation_bias(spark, sf_dir):
    # likelihoods are tenths: to six decimals a lead of 0.2 is the same however its sum was rounded
    ll = fx.likelihoods(spark, sf_dir).withColumn("ll", F.round(F.col("ll"), 6))
    return annotate.orientation_bias(ll, fx.evidence(spark, sf_dir))


@query("annotation_FragmentDepth", _ev(", f as (select site, sample, ev % 50 as fr, allele, round(sum(ll), 6) as ll from ll group by 1, 2, 3, 4), g as (select *, row_number() over (partition by site, sample, fr order by ll desc, allele) as rn from f) select site, sample, b as allele, count(*) as fad from (select site, sample, fr, max(case when rn = 1 then allele end) as b, max(case when rn = 1 then ll end) - max(case when rn = 2 then ll end) as c from g group by 1, 2, 3) t where round(c, 6) > 0.2e0 group by 1, 2, 3").replace(") ,", "),").replace("u as (select * from ev where is_informative and mapq not in (0, 255)) , f", "u as (select 1), f"))
def fragment_depth(spark, sf_dir):
    ll = fx.likelihoods(spark, sf_dir).withColumn("ll", F.col("ll"))
    names = ll.select("ev", F.concat(F.lit("f"), (F.col("ev") % 50).cast("string")).alias("name")).distinct()
    summed = likelihood.by_fragment(ll, names).withColumn("ll", F.round("ll", 6))
    best = likelihood.best_alleles(summed).withColumn("is_informative", F.round("confidence", 6) > likelihood.INFORMATIVE)
    return likelihood.allele_depths(best).withColumnRenamed("ad", "fad")


@query("annotation_AllelePseudoDepth")
def pseudo_depth(spark, sf_dir):
    return annotate.allele_pseudo_depth(fx.likelihoods(spark, sf_dir))


_G = f"g as ({fx.GENOTYPES})"
_N = "count(*) filter (where gt = '0/0') as hr, count(*) filter (where gt = '0/1') as ht, count(*) filter (where gt = '1/1') as hv"


def _genotype(name: str, sql: str | None, digits: dict[str, int] | None = None, run: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def f(spark, sf_dir):
        g = fx.genotypes(spark, sf_dir)
        return (run or annotate.REGISTRY[name])(g).withColumns({c: F.round(c, d) for c, d in (digits or {}).items()})

    query(f"annotation_{name}", sql and f"with {_G} {sql}")(f)


_genotype("ChromosomeCounts", "select site, 1 as allele, ht + 2 * hv as ac, 2 * (hr + ht + hv) as an, round((ht + 2 * hv) * 1.0e0 / (2 * (hr + ht + hv)), 6) as af from (select site, " + _N + " from g group by site) t where ht + hv > 0", {"af": 6})
_genotype("SampleList", "select site, string_agg(distinct sample, ',' order by sample) as samples from g where gt in ('0/1', '1/1') group by site")
_genotype("GenotypeSummaries", "select site, count(*) filter (where gt = './.') as ncc, round(avg(gq), 6) as gq_mean, round(case when count(gq) > 1 then stddev_samp(gq) end, 6) as gq_stddev from g group by site", {"gq_mean": 6, "gq_stddev": 6})
_F = "round(1.0e0 - ht / (2.0e0 * p * (1 - p) * (hr + ht + hv)), 6)"
_genotype("InbreedingCoeff", f"select site, case when p * (1 - p) > 0 then {_F} end as f from (select *, (2.0e0 * hr + ht) / (2 * (hr + ht + hv)) as p from (select site, {_N} from g group by site) t where hr + ht + hv >= 10) s", {"f": 6})
_genotype("AS_InbreedingCoeff", f"select site, 1 as allele, case when p * (1 - p) > 0 then {_F} end as f from (select *, (2.0e0 * hr + ht) / (2 * (hr + ht + hv)) as p from (select site, {_N} from g group by site) t where hr + ht + hv >= 10 and ht + hv > 0) s", {"f": 6})
_genotype("ExcessHet", f"""select site, round(abs(-10.0e0 * log10(sum(case when k >= ht then w end) / sum(w))), 5) as excess_het from (select *, exp(lgamma(n + 1) - lgamma((rare - k) / 2.0e0 + 1) - lgamma(k + 1.0e0) - lgamma(n - k - (rare - k) / 2.0e0 + 1) + k * ln(2.0e0) - mx) as w from
 (select *, lgamma(n + 1) * 0 + n as mx, rare % 2 + 2 * j as k from (select *, unnest(generate_series(0, cast(floor(rare / 2) as int))) as j from (select site, ht, hr + ht + hv as n, 2 * least(hr, hv) + ht as rare from (select site, {_N} from g group by site) t where hr + ht + hv > 0) a) b) c where k <= rare) d group by site, ht""", {"excess_het": 5})
_genotype("AlleleFraction", "select site, sample, round(ad1 * 1.0e0 / (ad0 + ad1), 6) as af from g where ad0 + ad1 > 0", run=lambda g: annotate.allele_fraction(g).withColumn("af", F.round(F.get("af", F.lit(0)), 6)))
_TRIOS = [("f1", "s1", "s2", "s0"), ("f2", "s4", "s5", "s3")]
_TRIO_SQL = "tr as (select * from (values ('s1', 's2', 's0'), ('s4', 's5', 's3')) t(m, f, c)), j as (select c.site, c.sample as child, c.gt as cgt, m.gt as mgt, f.gt as fgt, coalesce(c.gq, -1) as cq, coalesce(m.gq, -1) as mq, coalesce(f.gq, -1) as fq, coalesce(c.dp, -1) as cd, coalesce(m.dp, -1) as md, coalesce(f.dp, -1) as fd, m.sample as mo, f.sample as fa from tr join g c on c.sample = tr.c join g m on m.sample = tr.m and m.site = c.site join g f on f.sample = tr.f and f.site = c.site), st as (select site, sum(case gt when '0/1' then 1 when '1/1' then 2 else 0 end) as ac, count(*) as n, count(*) filter (where gt <> './.' and coalesce(gq, -1) > 20) as good from g group by site)"


@query("annotation_PossibleDeNovo", f"with {_G}, {_TRIO_SQL} select site, string_agg(child, ',' order by child) filter (where cq >= 20 and least(mq, fq) >= 20) as hi, string_agg(child, ',' order by child) filter (where cq >= 10 and least(mq, fq) > 0 and not (cq >= 20 and least(mq, fq) >= 20)) as lo from j join st using (site) where cgt = '0/1' and mgt = '0/0' and fgt = '0/0' and ac < greatest(4.0e0, n * 0.001e0) group by site having count(*) filter (where cq >= 10 and least(mq, fq) > 0) > 0")
def de_novo(spark, sf_dir):
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return annotate.possible_de_novo(fx.genotypes(spark, sf_dir), spark.createDataFrame(_TRIOS, "family string, mother string, father string, child string")).select("site", text("hi_conf").alias("hi"), text("lo_conf").alias("lo"))


@query("annotation_TransmittedSingleton", f"with {_G}, {_TRIO_SQL} select site, string_agg(case when ac = 2 and cgt = '0/1' then p end, ',' order by p) as yes, string_agg(case when ac = 1 and cgt = '0/0' then p end, ',' order by p) as no from (select *, case when mgt = '0/1' then mo else fa end as p from j join st using (site) where good * 1.0e0 / n >= 0.2e0 and cd >= 5 and least(cq, mq, fq) >= 5 and ((mgt = '0/1' and fgt = '0/0') or (mgt = '0/0' and fgt = '0/1'))) t group by site having count(case when (ac = 2 and cgt = '0/1') or (ac = 1 and cgt = '0/0') then 1 end) > 0")
def transmitted(spark, sf_dir):
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    trios = spark.createDataFrame(_TRIOS, "family string, mother string, father string, child string")
    return annotate.transmitted_singleton(fx.genotypes(spark, sf_dir), trios, 5, 5, 0.2).select("site", text("transmitted").alias("yes"), text("not_transmitted").alias("no"))


_CARRY = "d as (select site, sum(ad0 + ad1) as al, sum(case when ad1 > 1 then ad0 + ad1 end) as re, sum(dp) as dp from g where gt in ('0/1', '1/1') group by site)"


@query("annotation_QualByDepth", f"with {_G}, {_CARRY} select site, case when x < 35 then round(x, 6) end as qd, x >= 35 as refused from (select site, (site % 300 + 1) * 1.0e0 / coalesce(case when re > 0 then re end, case when al > 0 then al end, dp) as x from d where coalesce(case when re > 0 then re end, case when al > 0 then al end, dp) > 0) t")
def qual_by_depth(spark, sf_dir):
    g = fx.genotypes(spark, sf_dir)
    sites = g.select("site").distinct().withColumn("qual", (F.col("site") % 300 + 1).cast("double"))
    return annotate.qual_by_depth(g, sites).withColumn("qd", F.round("qd", 6))


@query("annotation_AS_QualByDepth", f"with {_G}, a as (select site, sum(ad0) as a0, sum(ad1) as a1 from g where gt in ('0/1', '1/1') group by site) select site, 1 as allele, case when x < 35 then round(x, 6) end as qd, x >= 35 as refused from (select site, (site % 300 + 1) * 1.0e0 / (a0 + a1) as x from a where a0 + a1 > 0) t")
def as_qual_by_depth(spark, sf_dir):
    g = fx.genotypes(spark, sf_dir)
    quals = g.select("site").distinct().select("site", F.lit(1).alias("allele"), (F.col("site") % 300 + 1).cast("double").alias("qual"))
    return annotate.as_qual_by_depth(g, quals).withColumn("qd", F.round("qd", 6))


@query("annotation_RawGtCount", f"with {_G} select site, '.,' || sum(gq_) || ',' || sum(dp) as raw_gt_count from (select site, coalesce(gq, 0) as gq_, dp from g) t group by site")
def raw_gt_count(spark, sf_dir):
    return annotate.raw_gt_count(fx.genotypes(spark, sf_dir).select("site", F.concat_ws(",", F.lit("1"), F.coalesce("gq", F.lit(0)).cast("string"), F.col("dp").cast("string")).alias("text")))


@query("annotation_HaplotypeFiltering", "select cast(p_partkey % 50 as int) as site, count(distinct p_brand) as assembled_haps, max(p_size) as filtered_haps from part group by 1")
def haplotypes(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return annotate.haplotype_filtering(part.select((F.col("p_partkey") % 50).cast("int").alias("site"), F.col("p_brand").alias("bases"), F.col("p_size").alias("filtered")))


_SITES = "select p_partkey as site, substr('ACGT', cast(1 + p_partkey % 4 as int), 1) as ref, substr('CGTA', cast(1 + p_partkey % 4 as int), 1) as alt, substr(repeat('ACCGTTTAGC', 3), cast(1 + p_partkey % 10 as int), 12) as before, substr(repeat('GGATTCA', 4), cast(1 + p_partkey % 7 as int), 12) as after from part"


def _sites(spark, sf_dir):
    return fx.view(spark, sf_dir, _SITES, "part").select("site", "ref", F.when(F.col("site") % 3 == 0, F.array(F.concat("ref", F.substring("after", 1, 2)))).otherwise(F.array("alt")).alias("alts"), "before", "after")


@query("annotation_ReferenceBases", f"select site, rpad(substr(right(before, 10) || ref || after, 1, 21), 21, 'N') as ref_bases from ({_SITES}) t")
def reference_bases(spark, sf_dir):
    return annotate.reference_bases(_sites(spark, sf_dir))


@query("annotation_FlowMotifs", f"select site, right(before, 5) as left_motif, left(after, 5) as right_motif from ({_SITES}) t")
def flow_motifs(spark, sf_dir):
    return annotate.motifs(_sites(spark, sf_dir))


@query("annotation_FlowGcContent", f"select site, round(length(regexp_replace(right(before, 5) || left(ref || after, 5), '[^GC]', '', 'g')) / 10.0e0, 6) as gc_content from ({_SITES}) t")
def flow_gc(spark, sf_dir):
    return annotate.gc_content(_sites(spark, sf_dir)).withColumn("gc_content", F.round("gc_content", 6))


_INS = "(site % 3 = 0)"
_RUN = "length(after) - length(ltrim(replace(after, left(after, 1), ' ')))"
_ONE = "left(after, 1) = substr(after, 2, 1)"
ORACLES["annotation_FlowVariantType"] = f"select site, case when not {_INS} then 'snp' when {_ONE} then 'h-indel' else 'non-h-indel' end as variant_type, case when {_INS} then 'ins' end as indel_classify, case when {_INS} then 2 else 0 end as indel_length from ({_SITES}) t"
ORACLES["annotation_FlowHmerIndel"] = f"select site, cast(case when {_ONE} then {_RUN} else 0 end as int) as hmer_indel_length, case when {_ONE} then left(after, 1) end as hmer_indel_nuc from ({_SITES}) t where {_INS}"
for _n in ("FlowVariantType", "FlowHmerIndel", "FlowCycleSkip", "TandemRepeat"):
    query(f"annotation_{_n}")(lambda spark, sf_dir, name=_n: annotate.REGISTRY[name](_sites(spark, sf_dir)))


# --- expressions, scalars, samples, regions, tools, streams


@query("expression_predicate", "select event_type, count(*) filter (where k) as n_true, count(*) filter (where not k) as n_false, count(*) filter (where k is null) as n_null from (select event_type, case when event_type = 'click' or event_type = 'view' then cast(value as double) * 2 > 20 else false end as k from events) t group by event_type")
def expression_predicate(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = compile_predicate("(type == 'click' || type == 'view') && value * 2.0d > 20", lambda n: e["event_type"] if n == "type" else e["value"].cast("string"))
    return e.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count_if("k").alias("n_true"), F.count_if(~F.col("k")).alias("n_false"), F.count_if(F.col("k").isNull()).alias("n_null"))


@query("scalar_qualities", "select p_size, round(1 - pow(10.0e0, -p_size / 10.0e0), 8) as prob, cast(floor(p_retailprice / 7 + 0.5) as bigint) as rounded from part")
def scalar_qualities(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_size", F.round(scalar.qual_to_prob(F.col("p_size")), 8).alias("prob"), scalar.fast_round(F.col("p_retailprice") / 7).alias("rounded"))


@query("scalar_log_sum", _ev("select site, sample, ev, round(mx + log10(sum(pow(10.0e0, ll - mx))), 6) as total from (select *, max(ll) over (partition by site, sample, ev) as mx from ll) t group by site, sample, ev, mx"))
def scalar_log_sum(spark, sf_dir):
    return fx.likelihoods(spark, sf_dir).groupBy("site", "sample", "ev").agg(F.collect_list("ll").alias("v")).select("site", "sample", "ev", F.round(scalar.log10_sum_log10(F.col("v")), 6).alias("total"))


@query("stats_histogram", _ev("select site, cast(floor((best_ll + 0.001e0) / 0.1e0) as bigint) as bin, count(*) as n from ev group by 1, 2"))
def histogram(spark, sf_dir):
    return stats.histogram(fx.evidence(spark, sf_dir).withColumnRenamed("best_ll", "value"), ["site"])


@query("sample_reservoir")
def reservoir(spark, sf_dir):
    return sample.reservoir(fx.reads(spark, sf_dir).select("contig", "name", "start", "mapq", "cigar", "flags").distinct(), ["contig"], ["name", "start", "cigar", "flags", "mapq"], 50)


@query("sample_leveling", f"""{_READS}, h as (select contig, start_pos % 10 as stack, count(*) as n, sum(count(*)) over (partition by contig) - 300 as excess from r where not um group by 1, 2),
 t as (select contig, max(turns) as turns from (select contig, turns, sum(least(n - 1, turns)) as given, max(excess) as excess from h, (select unnest(generate_series(0, (select max(n) from h))) as turns) g group by 1, 2) x where given <= greatest(excess, 0) group by 1),
 u as (select h.*, turns, excess - sum(least(n - 1, turns)) over (partition by contig) as spare, sum(case when n - 1 > turns then 1 else 0 end) over (partition by contig order by stack) as place from h join t using (contig))
 select contig, stack, cast(n - least(n - 1, turns) - case when excess > 0 and n - 1 > turns and place <= spare then 1 else 0 end as int) as n from u""")
def leveling(spark, sf_dir):
    r = _spans(spark, sf_dir).withColumn("stack", F.col("start") % 10)
    return sample.leveling(r, ["contig"], ["stack"], ["name", "start", "mapq"], 300).groupBy("contig", "stack").agg(F.count(F.lit(1)).cast("int").alias("n"))


_TAPS = "taps as (select i, w / sum(w) over () as w from (select i, exp(-i * i / (2 * 17.0e0 * 17.0e0)) as w from (select cast(unnest(generate_series(-50, 50)) as int) as i) a) b)"


@query("region_band_pass", f"{_PILE}, d as (select contig, pos, case when count(*) > 4 then 0.9e0 else 0.0e0 end as prob from pile group by 1, 2), {_TAPS} select contig, pos, round(sum(prob), 9) as prob from (select contig, pos, 0.0e0 as prob from d union all select contig, pos + i, prob * w from d, taps where prob > 0 and pos + i between 1 and 20000) t group by 1, 2")
def band_pass(spark, sf_dir):
    d = pileup.depth(_pile(spark, sf_dir)).select("contig", "pos", F.when(F.col("depth") > 4, F.lit(0.9)).otherwise(F.lit(0.0)).alias("prob"))
    return regions.band_pass(d, fx.contigs(spark)).withColumn("prob", F.round("prob", 9))


@query("region_runs", f"{_PILE}, d as (select contig, pos, count(*) > 4 as active from pile group by contig, pos), w as (select *, pos - row_number() over (partition by contig, active order by pos) as g from d) select contig, active, cast(min(pos) as int) as \"start\", cast(max(pos) as int) as \"end\" from w group by contig, active, g")
def region_runs(spark, sf_dir):
    d = pileup.depth(_pile(spark, sf_dir)).select("contig", "pos", F.when(F.col("depth") > 4, F.lit(0.9)).otherwise(F.lit(0.0)).alias("prob"))
    return regions.runs(d)


@query("region_cut")
def region_cut(spark, sf_dir):
    d = pileup.depth(_pile(spark, sf_dir)).select("contig", "pos", F.when(F.col("depth") > 4, F.lit(0.9)).otherwise(F.lit(0.0)).alias("prob"))
    return regions.with_padding(regions.regions(regions.band_pass(d, fx.contigs(spark))), fx.contigs(spark))


@query("walker_assembly_region")
def assembly_region(spark, sf_dir):
    r = fx.reads(spark, sf_dir).where(~pileup.ends_in_deletion())
    activity = lambda pile: pileup.depth(pile).select("contig", "pos", F.when(F.col("depth") > 4, F.lit(0.9)).otherwise(F.lit(0.0)).alias("prob"))
    held = tools.assembly_region_walker(r, HEADER, fx.contigs(spark), activity)
    return held.groupBy("contig", "r_region_start", "r_region_end", "r_active").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("start").alias("starts"))


@query("walker_variant", f"with {_IV}, {_M}, l as (select contig, s, e, lag(s) over (partition by contig order by s, e) as ps, lag(e) over (partition by contig order by s, e) as pe from m) select ex.iv_id, l.contig, l.s as r_start from ex join l on ex.contig = l.contig and ex.s <= l.e and l.s <= ex.e where not coalesce(ex.s <= pe and ps <= ex.e, false)")
def variant_walker(spark, sf_dir):
    found = tools.variant_walker(fx.intervals(spark, sf_dir, fx.EXCLUDED), intervals.merge(fx.intervals(spark, sf_dir)))
    return found.select("iv_id", "contig", "r_start")


@query("walker_multiple_passes", f"{_READS} select 0 as pass, contig, count(*) as n from r where not um group by contig union all select 1 as pass, contig, count(*) as n from r where (flags & 1024) <> 0 group by contig")
def multiple_passes(spark, sf_dir):
    count = lambda rows, i: rows.groupBy("contig").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("pass"), "contig", "n")
    tests = (filters.mapped(), ~filters.not_duplicate())
    first, second = tools.multiple_passes(fx.reads(spark, sf_dir), [lambda rows, i, t=t: count(rows.where(t), i) for t in tests])
    return first.unionByName(second)


@query("scalar_normalise", _ev("select site, sample, ev, allele, round(ll - mx - log10(sum(pow(10.0e0, ll - mx)) over (partition by site, sample, ev)), 6) as ll from (select *, max(ll) over (partition by site, sample, ev) as mx from ll) t"))
def scalar_normalise(spark, sf_dir):
    ll = fx.likelihoods(spark, sf_dir)
    total = scalar.log10_sum_log10(F.col("v"))
    listed = ll.groupBy("site", "sample", "ev").agg(F.collect_list(F.struct("allele", "ll")).alias("x"))
    listed = listed.withColumn("v", F.transform("x", lambda e: e["ll"])).withColumn("total", total)
    return listed.select("site", "sample", "ev", "total", F.explode("x").alias("e")).select("site", "sample", "ev", "e.allele", F.round(F.col("e.ll") - F.col("total"), 6).alias("ll"))


@query("tool_print_reads", f"{_READS} select contig, count(*) as n, cast(sum(start_pos) as bigint) as starts from r where {' and '.join(f'({p})' for _, p in _WELL)} group by contig")
def print_reads(spark, sf_dir):
    return tools.print_reads(fx.reads(spark, sf_dir), HEADER).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@query("tool_unmark_duplicates", f"{_READS} select flags & ~1024 as flags, count(*) as n from r group by 1")
def unmark(spark, sf_dir):
    return tools.unmark_duplicates(fx.reads(spark, sf_dir)).groupBy("flags").agg(F.count(F.lit(1)).alias("n"))


@query("tool_fix_misencoded", f"{_READS} select contig, cast(sum(list_sum(list_transform(generate_series(0, n_quals - 1), lambda i: (i + 1) * ((q0 + i * 7) % 41 + 3)))) as bigint) as qual_marks from r where n_quals > 0 group by contig")
def fix_misencoded(spark, sf_dir):
    raised = fx.reads(spark, sf_dir).where("size(quals) > 0").withColumn("quals", F.transform("quals", lambda q: q + 34))
    fixed = tools.fix_misencoded_qualities(raised)
    marks = F.aggregate(F.transform("quals", lambda q, i: (i + 1) * q), F.lit(0), lambda s, x: s + x)
    return fixed.groupBy("contig").agg(F.sum(marks).alias("qual_marks"))


@query("tool_original_alignment", f"{_READS} select contig, case when um then '*,0,*,*,0,0;' else 'chr' || (ref_idx + 1) || ',' || start_pos || ',' || (case when rv then '-' else '+' end) || ',' || cigar || ',' || mapq || ',' || coalesce(nm, 'null') || ';' end as oa, count(*) as n from r where pr group by 1, 2")
def original_tags(spark, sf_dir):
    r = fx.reads(spark, sf_dir).where(rd.is_paired())
    out = tools.add_original_alignment(r, [c for _, c, _ in fx.CONTIGS])
    return out.groupBy("contig", rd.tag("OA").alias("oa")).agg(F.count(F.lit(1)).alias("n"))


@query("walker_interval", f"{_READS}, {_IV}, {_M} select m.contig, m.s as r_start, count(*) as n from r join m on r.contig = m.contig and r.start_pos <= m.e and m.s <= r.end_pos group by 1, 2")
def interval_walker(spark, sf_dir):
    return tools.interval_walker(fx.reads(spark, sf_dir), intervals.merge(fx.intervals(spark, sf_dir))).groupBy("contig", "r_start").agg(F.count(F.lit(1)).alias("n"))


_WELLFORMED = " and ".join(f"({p})" for _, p in _WELL)


@query("walker_locus", f"{_piled(f'not um and {_WELLFORMED}')}, {_IV}, {_M}, d as (select contig, pos, count(*) as depth from pile group by contig, pos) select contig, pos, depth from d where exists (select 1 from m where m.contig = d.contig and d.pos between m.s and m.e)")
def locus_walker(spark, sf_dir):
    r = fx.reads(spark, sf_dir).where(~pileup.ends_in_deletion())
    return tools.locus_walker(r, HEADER, fx.intervals(spark, sf_dir))


@query("stream_windowed_depth", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value_sum from events group by 1, 2")
def windowed_depth(spark, sf_dir):
    return events.windowed_depth(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("value_sum", F.round("value_sum", 4))
