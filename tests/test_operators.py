"""Operators on micro-fixtures whose results are worked out by hand or by a row-at-a-time model."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from locusframe.functions import scalar
from locusframe.functions.expression import ExpressionError, compile_expression, compile_predicate
from locusframe.operators import annotate, cigar, clipping, filters, intervals, likelihood, pileup, regions, sample, stats
from locusframe.operators import reads as rd
from locusframe.plans import tools
from locusframe.sources import formats
from locusframe.streaming import events

CONTIGS = [(0, "chr1", 2000), (1, "chr2", 1000)]
HEADER = filters.Header((("chr1", 2000), ("chr2", 1000)), {"a": {"LB": "L", "SM": "S", "PL": "ILLUMINA", "PU": "P", "FO": "TGCA"}, "b": {}})


def _read(name="r", flags=0, ref=0, start=100, mapq=60, cg="10M", mate_ref=0, mate_start=200, isize=0, bases="ACGTACGTAC", quals=None, **tags):
    quals = [30] * len(bases) if quals is None else quals
    return (name, flags, ref, CONTIGS[ref][1] if ref >= 0 else None, start, mapq, cg, mate_ref, mate_start, isize, bases, quals, {k: (v if isinstance(v, tuple) else ("Z", v)) for k, v in ({"RG": "a"} | tags).items() if v is not None})


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame(CONTIGS, "idx int, name string, length int")


def _decide(spark, test, *reads):
    return [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(reads)], "i int, " + rd.SCHEMA).orderBy("i").select(test).collect()]


def _valid(text):
    ops = clipping.parse(text)
    n = len(ops)
    if not ops:
        return True
    real = False
    for i, (k, op) in enumerate(ops):
        if k == 0:
            return False
        if op == "H" and 0 < i < n - 1:
            return False
        if op == "S" and 0 < i < n - 1:
            near_start = i == 1 and (ops[0][1] == "H" or (n == 3 and ops[2][1] == "H"))
            near_end = i == n - 2 and i != 1 and ops[-1][1] == "H"
            if not (near_start or near_end):
                return False
        if op in "MIDN=X":
            real = True
        if op in "ID":
            for _, o in ops[i + 1 :]:
                if o in "MN=XP":
                    break
                if o == op:
                    return False
        if op == "P" and i and (i == n - 1 or ops[i - 1][1] not in "MIDN=X" or ops[i + 1][1] not in "MIDN=X"):
            return False
    return real


def test_cigar_validity_matches_a_row_model(spark):
    rng = random.Random(1)
    texts = ["*", "10M", "3S4M3S", "5S5M", "9H1S9M", "1S2S5M2S", "2H2S6M2S2H", "2S1D8M", "8M1D2S", "4M2N4M", "10I", "0M"] + ["".join(f"{rng.choice([1, 1, 2, 0 if rng.random() < 0.1 else 3])}{rng.choice('MIDNSHP')}" for _ in range(rng.randrange(1, 6))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "cigar string").select("cigar", cigar.is_valid().alias("v"), cigar.is_good().alias("g"), cigar.reference_length().alias("r")).collect()
    for row in got:
        ops = "".join(o for _, o in clipping.parse(row.cigar))
        assert row.v == _valid(row.cigar), row.cigar
        core = ops.strip("SH")
        assert row.g == (row.v and not any(a in "ID" and b in "ID" for a, b in zip(ops, ops[1:])) and not core.startswith("D") and not core.endswith("D")), row.cigar
        assert row.r == sum(n for n, o in clipping.parse(row.cigar) if o in "MDN=X")


def test_soft_clip_filters(spark):
    reads = [_read(cg="2H2S6M2S2H"), _read(cg="5S5M"), _read(cg="10S"), _read(cg="*"), _read(cg="1S2S5M2S")]
    assert _decide(spark, filters.soft_clipped(ratio=4 / 14), *reads) == [True, False, False, True, False]
    assert _decide(spark, filters.soft_clipped(leading_trailing=0.4), *reads) == [True, False, False, True, True]
    assert _decide(spark, filters.overclipped(6), *reads) == [True, True, True, True, False]
    assert _decide(spark, filters.excessive_end_clipped(3), *reads) == [False, False, False, True, True]
    with pytest.raises(ValueError):
        filters.soft_clipped()


def test_refusals_are_null_and_strict_raises(spark):
    reads = [_read(), _read(RG=None), _read(RG="b")]
    assert _decide(spark, filters.read_group("a"), *reads) == [True, None, False]
    assert _decide(spark, filters.not_optical_duplicate(), _read(OD="0"), _read(OD="3"), _read(OD="x"), _read()) == [True, False, None, True]
    with pytest.raises(Exception, match="can't decide"):
        _decide(spark, filters.strict(filters.read_group("a"), "ReadGroup"), *reads)


def test_tag_comparison_keeps_zeros_and_nan_apart(spark):
    reads = [_read(NM="0"), _read(NM="-0.0"), _read(NM="nan"), _read(NM="high"), _read(NM="1f"), _read()]
    assert _decide(spark, filters.read_tag_value("NM", "EQUAL", 0.0), *reads) == [True, False, False, None, None, False]
    assert _decide(spark, filters.read_tag_value("NM", "EQUAL", math.nan), *reads)[2] is True
    assert _decide(spark, filters.read_tag_value("NM", "LESS_OR_EQUAL", 0.0), *reads)[:3] == [True, True, False]


def test_header_filters(spark):
    reads = [_read(), _read(RG="b"), _read(RG="zz"), _read(RG=None), _read(PU="P2")]
    assert _decide(spark, filters.library(HEADER, ["L"]), *reads) == [True, False, False, False, True]
    assert _decide(spark, filters.platform(HEADER, ["illum"]), *reads) == [True, False, False, False, True]
    assert _decide(spark, filters.platform_unit(HEADER, ["P"]), *reads) == [False, True, True, True, True]
    assert _decide(spark, filters.read_group_black_list(HEADER, ["SM:S"]), *reads) == [False, True, True, True, False]
    assert _decide(spark, filters.has_read_group(), *reads) == [True, True, True, False, True]


def test_homopolymer_filters(spark):
    reads = [
        _read(bases="AATT", cg="4M", quals=[1, 1, 2, 2]), _read(bases="AATT", cg="4M", quals=[1, 2, 2, 2]), _read(bases="AATT", cg="1H4M", quals=[1, 2, 2, 2]),
        _read(bases="AATT", cg="*", quals=[1, 1, 2, 2]), _read(bases="AATT", cg="4M", quals=[1, 1]),
    ]
    assert _decide(spark, filters.hmer_quality_symmetric(), *reads) == [True, False, True, None, None]
    tp = [_read(bases="AAT", cg="3M", tp=("B", v)) for v in ("0,0,1", "-3,0,1", "0,0", "11,11,0")] + [_read(bases="AAT", cg="3M"), _read(bases="AAT", cg="3M", tp=("i", "3"))]
    assert _decide(spark, filters.flow_based_tp_attribute_valid(12), *tp) == [True, False, None, False, False, None]
    assert _decide(spark, filters.flow_based_tp_attribute_symmetric(), *tp) == [True, False, None, True, False, None]


def test_rejections_count_for_the_first_failure(spark):
    df = spark.createDataFrame([_read(), _read(flags=0x400, mapq=0), _read(mapq=0)], rd.SCHEMA)
    tests = [("NotDuplicate", filters.not_duplicate()), ("MappingQualityNotZero", filters.mapping_quality_not_zero())]
    assert {r["filter"]: r.n_rejected for r in filters.rejection_counts(df, tests).collect()} == {None: 1, "NotDuplicate": 1, "MappingQualityNotZero": 1}
    assert filters.summary(df, tests).endswith("2 total reads filtered out of 3 reads processed")


def test_all_filters_are_registered():
    assert len(filters.REGISTRY) == 56


def _positions(rows):
    return {(r.contig, p) for r in rows for p in range(r.start, r.end + 1)}


def test_interval_algebra_against_sets_of_positions(spark):
    rng = random.Random(7)
    make = lambda n: spark.createDataFrame([(rng.choice(["chr1", "chr2"]), s := rng.randrange(1, 300), s + rng.randrange(0, 12)) for _ in range(n)], "contig string, start int, end int").cache()
    a, b = make(25), make(25)
    pa, pb = _positions(a.collect()), _positions(b.collect())
    for rule in (intervals.ALL, intervals.OVERLAPPING_ONLY):
        m = intervals.merge(a, rule).collect()
        assert _positions(m) == pa and sum(r.end - r.start + 1 for r in m) == len(pa)
        for width in (1, 7, 50):
            assert sorted(intervals.merge(a, rule, width=width).collect()) == sorted(m)
    assert _positions(intervals.subtract(a, b).collect()) == pa - pb
    assert _positions(intervals.intersect(a, b).collect()) == pa & pb
    assert _positions(intervals.shards(intervals.merge(a), 4).collect()) == pa
    assert {tuple(r) for r in intervals.loci(intervals.merge(a)).collect()} == pa
    rows_a, rows_b = a.collect(), b.collect()
    hits = [(x, y) for x in rows_a for y in rows_b if x.contig == y.contig and x.start <= y.end and y.start <= x.end]
    for small in (True, False):
        for width in (5, 1000):
            assert intervals.overlap_join(a, b, width=width, small=small).count() == len(hits)
            assert intervals.overlap_join(a, b, "left_semi", width, small).count() == sum(any(h[0] is x for h in hits) for x in rows_a)
            assert intervals.overlap_join(a, b, "left_anti", width, small).count() == sum(all(h[0] is not x for h in hits) for x in rows_a)
            assert intervals.overlap_join(a, b, "left", width, small).count() == len(hits) + sum(all(h[0] is not x for h in hits) for x in rows_a)


@pytest.mark.parametrize("small", [True, False])
def test_overlap_totals_equal_the_pairs_without_making_them(spark, small):
    rnd = random.Random(3)
    reads = [(rnd.choice(["a", "b", None]), s := rnd.randint(-40_000, 40_000), s + rnd.choice([-1, 0, 5, 300, 20_000]), rnd.choice([None, 3, 60])) for _ in range(300)]
    spans = [(i % 90, rnd.choice(["a", "b", "c"]), s := rnd.randint(-40_000, 40_000), s + rnd.choice([0, 1, 40, 9_000, -1, -30])) for i in range(150)]
    left = spark.createDataFrame(reads, "contig string, start int, end int, mapq int")
    right = spark.createDataFrame(spans, "id int, contig string, start int, end int")
    want = {}
    for i, c, s, e in spans:
        for contig, start, end, mapq in reads:
            if contig == c and start <= e and s <= end:
                want.setdefault(i, []).append(mapq)
    want = {(i, len(q), sum(x for x in q if x is not None) if any(x is not None for x in q) else None) for i, q in want.items()}
    out = intervals.overlap_totals(left, right, ("id",), ("mapq",), small)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 50
    assert intervals.overlap_totals(left, right.limit(0), ("id",), ("mapq",), small).count() == 0
    # a thousand times a thousand rows at one place: no join makes their pairs
    many = spark.range(1000).select(F.lit("a").alias("contig"), F.lit(1).alias("start"), F.lit(50).alias("end"), F.lit(2).alias("mapq"), "id")
    plan = intervals.overlap_totals(many, many, ("id",), ("mapq",), small)
    assert {(r.n, r.sum_mapq) for r in plan.collect()} == {(1000, 2000)} and plan.count() == 1000
    with pytest.raises(Exception, match="ends before its start"):
        intervals.overlap_totals(spark.createDataFrame([("a", 9, 5, 1)], left.schema), right, ("id",), ("mapq",)).collect()


def test_overlap_joins_have_no_nested_loop(spark):
    a = spark.createDataFrame([("chr1", 1, 5)], "contig string, start int, end int")
    for how in ("inner", "left_semi"):
        for small in (True, False):
            plan = intervals.overlap_join(a, a, how, small=small)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and not _contig_only(plan)
    assert not _contig_only(intervals.subtract(a, a)._jdf.queryExecution().executedPlan().toString())


def _contig_only(plan):
    """Joins with the contig as their only key."""
    return re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[contig#\d+\], \[r?_?contig#\d+\]", plan)


def test_padding_and_text(spark, contigs):
    df = spark.createDataFrame([("chr2", 5, 990), ("chr2", 1500, 1600)], "contig string, start int, end int")
    assert [tuple(r) for r in intervals.pad(df, contigs, 20).collect()] == [("chr2", 1, 1000)]
    assert intervals.pad(df, contigs, 0).count() == 2
    text = spark.createDataFrame([("chr1:1,000-1,200",), ("chr2:7",), ("chr1:100+",), ("chr2",), ("chrX:1-2",), ("chr1:9-3",)], "text string")
    got = [(r.contig, r.start, r.end, r.reason) for r in intervals.parse_text(text, contigs).collect()]
    assert got == [("chr1", 1000, 1200, None), ("chr2", 7, 7, None), ("chr1", 100, 2000, None), ("chr2", 1, 1000, None), (None, None, None, "unknown"), (None, None, None, "invalid")]
    with pytest.raises(ValueError):
        intervals.resolve(df.limit(1), intervals.whole_reference(contigs), contigs)


def test_pileup_walk(spark):
    df = spark.createDataFrame([_read(cg="2S3M1D2M1I1M", bases="ACGTACGTA")], rd.SCHEMA)
    rows = pileup.elements(df).orderBy("pos").collect()
    assert [(r.pos, r.offset, r.base) for r in rows] == [(100, 2, "G"), (101, 3, "T"), (102, 4, "A"), (103, 4, "D"), (104, 5, "C"), (105, 6, "G"), (106, 8, "A")]
    assert [r.pos for r in rows if r.before_insertion] == [105] and rows[5].next_inserted == "T" and [r.pos for r in rows if r.before_deletion] == [102] and [r.pos for r in rows if r.after_soft_clip] == [100]
    with pytest.raises(Exception, match="deletion at the end"):
        pileup.elements(spark.createDataFrame([_read(cg="2S1D8M")], rd.SCHEMA)).collect()


def test_depth_sums_to_aligned_lengths_and_gaps_are_filled(spark):
    df = spark.createDataFrame([_read(name=f"r{i}", start=50 + 3 * i, cg=c) for i, c in enumerate(["10M", "4M2N4M", "3M1I1D5M", "2S8M"])], rd.SCHEMA)
    d = pileup.depth(pileup.elements(df, deletions=False))
    assert d.agg(F.sum("depth")).first()[0] == 10 + 8 + 8 + 8
    filled = pileup.with_empty_loci(d, spark.createDataFrame([("chr1", 45, 52)], "contig string, start int, end int")).orderBy("pos").collect()
    assert [r.depth for r in filled] == [0] * 5 + [1, 1, 1]


def test_overlapping_pairs(spark):
    df = spark.createDataFrame([_read(flags=0x41, bases="AC", cg="2M", quals=[60, 20]), _read(flags=0x81, bases="AT", cg="2M", quals=[50, 31])], rd.SCHEMA)
    got = sorted((r.pos, r.flags, r.qual) for r in pileup.fix_overlapping_pairs(pileup.elements(df)).collect())
    assert got == [(100, 0x41, 93), (100, 0x81, 0), (101, 0x41, 0), (101, 0x81, 24)]


def test_pairs_that_tie_in_everything_have_one_winner(spark):
    df = spark.createDataFrame([_read(flags=0x41, bases="A", cg="1M", quals=[30]), _read(flags=0x41, bases="C", cg="1M", quals=[20]), _read(name="q", flags=0x81, bases="A", cg="1M", quals=[9]), _read(name="q", flags=0x81, bases="A", cg="1M", quals=[9])], rd.SCHEMA)
    got = sorted((r.name, r.base, r.qual) for r in pileup.fix_overlapping_pairs(pileup.elements(df)).collect())
    assert got == [("q", "A", 0), ("q", "A", 18), ("r", "A", 24), ("r", "C", 0)]


def test_read_coordinates(spark):
    df = spark.createDataFrame([_read(cg="2H3S4M1D3M", bases="ACGTACGTAC")], rd.SCHEMA)
    row = df.select(rd.end().alias("e"), rd.soft_start().alias("s"), rd.unclipped_start().alias("u"), rd.offset_at(F.lit(97)).alias("a"), rd.offset_at(F.lit(104)).alias("d"), rd.offset_at(F.lit(105)).alias("x"), rd.base_at(F.lit(100)).alias("b")).first()
    assert tuple(row) == (107, 97, 95, 0, None, 7, "T")


def test_expressions(spark):
    df = spark.createDataFrame([_read(NM="10", XX="abc", EE="")], rd.SCHEMA)
    cases = {
        "NM > 9": True, "NM > '9'": False, "NM == 10.0": True, "XX == 'abc' && !(NM lt 3)": True, "NM + 1 == 11": True, "NM / 4 == 2": True, "NM / 4.0 == 2.5": True, "NM % 0 == 1": None,
        "missing == 1": None, "XX > 1": None, "XX + 1 == 'abc1'": True, "empty EE": True, "null == null": True, "null < 1": False, "NM": False, "0x0A == NM": True, "012 == NM": True, "NM == 1 || XX == 'abc'": True, "-NM == -10": True,
    }
    got = df.select(*[compile_predicate(k).alias(str(i)) for i, k in enumerate(cases)]).first()
    assert dict(zip(cases, got)) == cases
    for bad in ("NM =~ 'x'", "(NM", "NM @ 1", "5h", "NM NM"):
        with pytest.raises(ExpressionError):
            compile_expression(bad)


def test_best_alleles(spark):
    rows = [(1, "s", 1, 0, -1.0), (1, "s", 1, 1, -1.0), (1, "s", 1, 2, -3.0), (1, "s", 2, 0, -5.0), (1, "s", 2, 1, -1.0)]
    got = {r.ev: (r.best, r.confidence, r.is_informative) for r in likelihood.best_alleles(spark.createDataFrame(rows, "site int, sample string, ev int, allele int, ll double")).collect()}
    assert got == {1: (0, 0.0, False), 2: (1, 4.0, True)}


def test_priorities_count_within_the_threshold(spark):
    lls = {1: [-1.0, -1.1, -1.15, -9.0], 2: [-1.0, -1.3, -1.1, -1.0], 3: [-1.0, -1.5, -1.15, -1.1], 4: [-2.0, -1.0, -1.05, -1.1], 5: [-1.0, -1.05], 6: [-1.0], 7: [-1.0, -3.0]}
    prio = [0, 5, 9, 1]
    rows = [(1, "s", ev, a, x, prio[a]) for ev, xs in lls.items() for a, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "site int, sample string, ev int, allele int, ll double, p int")

    def rule(xs, reference):
        order = sorted((-x, a) for a, x in enumerate(xs) if reference or a)
        if not order:
            return None
        best = order[0][1]
        second = order[1][1] if len(order) > 1 else None
        if second is None and not reference:
            second = 0
        elif second is not None and xs[best] - xs[second] < 0.2:
            first, then = best, second
            for a in range(len(xs)):
                if a == best or not reference and not a or xs[order[0][1]] - xs[a] > 0.2:
                    continue
                if prio[a] > prio[best]:
                    best, second = a, best
                elif prio[a] > prio[second]:
                    second = a
        return best, None if second is None else xs[second]

    for reference in (True, False):
        got = {r.ev: (r.best, r.second_ll) for r in likelihood.best_alleles(df, "p", reference).collect()}
        assert got == {ev: rule(xs, reference) for ev, xs in lls.items() if rule(xs, reference)}, reference
    natural = likelihood.to_natural_log(df.drop("p"))
    assert [r.is_informative for r in likelihood.best_alleles(natural.where("ev = 7")).collect()] == [True]
    assert [r.is_informative for r in likelihood.best_alleles(natural.where("ev = 5")).collect()] == [False]
    with pytest.raises(ValueError):
        likelihood.to_natural_log(natural)


def test_missing_likelihoods_are_impossible_not_certain(spark):
    rows = [(1, "s", ev, 0, -0.1) for ev in range(6)] + [(1, "s", ev, 1, -4.0) for ev in range(3)]
    got = {r.allele: r.dd for r in stats.pseudo_depth(spark.createDataFrame(rows, "site int, sample string, ev int, allele int, ll double")).collect()}
    assert got[0] > 5.9 and got[1] < 0.1


def test_rank_sum_small_and_large(spark):
    rows = [(1, float(v), True) for v in (1, 2, 3)] + [(1, float(v), False) for v in (4, 5, 6)] + [(2, float(v), v % 2 == 0) for v in range(40)] + [(3, 1.0, True)]
    got = {r.site: (r.u, r.z) for r in stats.rank_sum(spark.createDataFrame(rows, "site int, value double, is_alt boolean"), ["site"]).collect()}
    assert got[1][0] == 0 and got[1][1] == pytest.approx(-1.9600, abs=1e-3) and got[2][0] == 190 and abs(got[2][1]) < 0.3 and 3 not in got


def test_exact_tests(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (10, 0, 0, 10), (5, 0, 0, 0)], "a int, b int, c int, d int")
    c = [F.col(x) for x in "abcd"]
    p = [r[0] for r in df.select(stats.fisher_two_sided(*c)).collect()]
    assert p == pytest.approx([0.4857142857, 1.0825e-5, 1.0], rel=1e-3)
    assert stats._right_tail(0, 5, 5) == pytest.approx(1.0) and stats._right_tail(10, 0, 0) < 0.1
    assert stats.dirichlet_posterior(__import__("numpy").array([[0.0] * 10, [-20.0] * 10]))[0] == pytest.approx(11, abs=0.05)


def test_histogram_median_and_scalars(spark):
    h = stats.histogram(spark.createDataFrame([(1, x) for x in (0.1, 0.1, 0.5, 0.9)], "site int, value double"), ["site"])
    assert stats.histogram_median(h, ["site"]).first().median == pytest.approx(0.1)
    row = spark.range(1).select(scalar.string_hash(F.lit("hello world")), scalar.repeat_unit(F.lit("ACACAC")), scalar.log10_sum_log10(F.array(F.lit(-1.0), F.lit(-1.0))), scalar.flatten_bases(F.lit("acgtRYKM"))).first()
    assert tuple(row) == (1794106052, "AC", pytest.approx(-0.69897, abs=1e-5), "ACGTNNNN")


def test_raw_counts_and_medians(spark):
    raw = spark.createDataFrame([(1, "1,2,3"), (1, "1,2,3")], "site int, text string")
    assert annotate.raw_gt_count(raw).first().raw_gt_count == ".,4,6"
    assert annotate.flow_key("TTGA") == [2, 1, 0, 1] and annotate.flow_key("TXA") is None
    sites = spark.createDataFrame([(1, "A", ["ACT"], "GGGGGGGGGG", "CTCTGG")], "site int, ref string, alts array<string>, before string, after string")
    row = annotate.tandem_repeat(sites).first()
    assert (row.ru, list(row.rpa)) == ("CT", [2, 3])


def test_regions_and_kernel(spark, contigs):
    k = regions.kernel()
    assert sum(k) == pytest.approx(1) and k == k[::-1] and len(k) % 2 == 1
    profile = spark.createDataFrame([("chr1", 100 + i, 0.9 if i < 20 else 0.0) for i in range(40)], "contig string, pos int, prob double")
    assert regions.regions(profile).count() == 2
    assert regions.regions(regions.band_pass(profile, contigs).where("pos between 100 and 139")).count() == 1
    two = spark.createDataFrame([("chr1", i, {121: 0.01, 251: 0.8}.get(i, 0.9)) for i in range(1, 401)], "contig string, pos int, prob double")
    assert sorted((r.start, r.end) for r in regions.regions(two).collect()) == [(1, 121), (122, 400)]
    exact = spark.createDataFrame([("chr1", i, 0.1 if i == 101 else 0.9) for i in range(1, 301)], "contig string, pos int, prob double")
    assert sorted((r.start, r.end) for r in regions.regions(exact).collect()) == [(1, 101), (102, 300)]


def _regions_by_hand(probs, threshold, least, most):
    """Regions popped one by one from the front of the states, as positions from 0."""
    out, at = [], 0
    while at < len(probs):
        states = probs[at:]
        active = states[0] > threshold
        end = 0
        while end < len(states) and end < most and (states[end] > threshold) == active:
            end += 1
        if active and end == most:
            best, low = end - 1, float("inf")
            for i in range(end - 1, least - 2, -1):
                dip = 1 <= i < len(states) - 1 and states[i] <= states[i + 1] and states[i] < states[i - 1]
                if dip and states[i] < low:
                    best, low = i, states[i]
            end = best + 1
        out.append((at, at + end - 1, active))
        at += end
    return out


def test_regions_match_the_states_popped_one_by_one(spark):
    rng = random.Random(23)
    for least, most in ((1, 7), (3, 10), (5, 5)):
        rows, want = [], []
        for k in range(12):
            probs = [rng.choice([0.0, 0.1, 0.2, 0.5, 0.5, 0.9]) if rng.random() < 0.9 else 0.0 for _ in range(rng.randrange(1, 80))]
            rows += [(f"c{k}", i + 1, p) for i, p in enumerate(probs)]
            want += [(f"c{k}", a + 1, b + 1, active) for a, b, active in _regions_by_hand(probs, 0.05, least, most)]
        got = regions.regions(spark.createDataFrame(rows, "contig string, pos int, prob double"), 0.05, least, most).collect()
        assert sorted((r.contig, r.start, r.end, r.active) for r in got) == sorted(want)


def test_assembly_regions_hold_the_reads_that_overlap_them(spark, contigs):
    reads = [_read(name=f"r{i}", start=200 + 2 * i, cg="10M") for i in range(20)] + [_read(name="far", start=900, cg="10M")]
    df = spark.createDataFrame(reads, rd.SCHEMA)
    activity = lambda pile: pileup.depth(pile).select("contig", "pos", F.when(F.col("depth") > 2, 1.0).otherwise(0.0).alias("prob"))
    got = tools.assembly_region_walker(df, HEADER, contigs, activity, padding=10).collect()
    spans = {(r.r_region_start, r.r_region_end) for r in got}
    assert spans and all(r.start <= r.r_end and r.r_start <= r.end for r in got)
    assert {r.name for r in got if r.r_active} == {f"r{i}" for i in range(20)}


def test_down_sampling(spark):
    df = spark.createDataFrame([(g, s, i) for g in "ab" for s, n in (("x", 30), ("y", 5), ("z", 12)) for i in range(n)], "g string, s string, i int")
    r = sample.reservoir(df, ["g"], ["s", "i"], 10)
    assert r.groupBy("g").count().where("count = 10").count() == 2 and sorted(r.collect()) == sorted(sample.reservoir(df, ["g"], ["s", "i"], 10).collect())
    kept = {(r.g, r.s): r["count"] for r in sample.leveling(df, ["g"], ["s"], ["i"], 25).groupBy("g", "s").count().collect()}
    assert {k[1]: v for k, v in kept.items() if k[0] == "a"} == {"x": 21, "y": 1, "z": 3}
    rng = random.Random(3)
    for target, least in ((60, 1), (25, 3), (0, 2), (500, 1), (13, 0)):
        sizes = {(g, s): rng.randrange(1, 40) for g in range(3) for s in range(rng.randrange(1, 6))} | {(9, 0): 100, (9, 1): 10}
        df = spark.createDataFrame([(g, s, i) for (g, s), n in sizes.items() for i in range(n)], "g int, s int, i int")
        got = {(r.g, r.s): r["count"] for r in sample.leveling(df, ["g"], ["s"], ["i"], target, least).groupBy("g", "s").count().collect()}
        assert got == {k: v for g in {g for g, _ in sizes} for k, v in _leveled({k: n for k, n in sizes.items() if k[0] == g}, target, least).items() if v}


def _leveled(sizes, target, least):
    """One from each stack in turn."""
    sizes, order = dict(sorted(sizes.items())), sorted(sizes)
    remove, at, stuck = sum(sizes.values()) - target, 0, 0
    while remove > 0 and stuck < len(order):
        if sizes[order[at]] > least:
            sizes[order[at]] -= 1
            remove, stuck = remove - 1, 0
        else:
            stuck += 1
        at = (at + 1) % len(order)
    return sizes


def test_clipping(spark):
    df = spark.createDataFrame([_read(quals=[1, 2, 30, 30, 1, 30, 30, 30, 2, 2]), _read(name="bad", quals=[1] * 10)], rd.SCHEMA)
    good, bad = clipping.low_quality_ends(df).orderBy(F.desc("name")).collect()
    assert (good.cigar, good.start, good.bases, good.quals) == ("2H6M2H", 102, "GTACGT", [30, 30, 1, 30, 30, 30]) and bad.bases == "" and bad.flags & 4
    one = spark.createDataFrame([_read(cg="3S7M")], rd.SCHEMA)
    more = spark.createDataFrame([_read(cg=c) for c in ("2H3S4M1I2S", "3S5I2S", "5M5S3H", "10M", "2S1M2D7M")], rd.SCHEMA)
    assert [r.cigar for r in clipping.revert_soft_clips(more).collect()] == ["2H7M1I2M", "3M5I2M", "10M3H", "10M", "3M2D7M"]
    assert clipping.revert_soft_clips(one).first().start == 97 and clipping.soft_clipped_bases(one).first().cigar == "3H7M"
    cut = clipping.to_region(spark.createDataFrame([_read()], rd.SCHEMA), 103, 106, clipping.SOFTCLIP).first()
    assert (cut.cigar, cut.start) == ("3S4M3S", 103)
    masked = clipping.by_read_coordinates(spark.createDataFrame([_read()], rd.SCHEMA), 2, 4, clipping.WRITE_NS).first()
    assert masked.bases == "ACNNNCGTAC"
    with pytest.raises(ValueError):
        clipping.build([(1, "M"), (2, "S"), (1, "M")])
    assert clipping.build([(2, "S"), (1, "D"), (3, "M"), (2, "I"), (1, "D"), (1, "M")]) == [(2, "S"), (3, "M"), (1, "D"), (2, "I"), (1, "M")]


def test_tools(spark):
    df = spark.createDataFrame([_read(flags=0x411, OQ="".join(chr(33 + i) for i in range(10)), quals=[40] * 10)], rd.SCHEMA)
    assert tools.unmark_duplicates(df).first().flags == 0x11 and tools.revert_base_qualities(df).first().quals == list(range(10)) and tools.fix_misencoded_qualities(df).first().quals == [9] * 10
    assert tools.add_original_alignment(df, ["chr1", "chr2"]).select(rd.tag("OA"), rd.tag("XM")).first()[:] == ("chr1,100,-,10M,60,null;", "chr1")
    plain = spark.createDataFrame([_read()], rd.SCHEMA)
    for broken in (tools.revert_base_qualities(plain), tools.fix_misencoded_qualities(plain), tools.add_original_alignment(plain, ["chr1"])):
        with pytest.raises(Exception, match="r"):
            broken.collect()
    with pytest.raises(ValueError):
        tools.locus_walker(plain, HEADER, max_depth=-1)


def test_formats(spark, tmp_path, contigs):
    (tmp_path / "x.bed").write_text("track x\nchr1\t0\t10\tn\nchr2\t5\t6\n")
    assert [tuple(r) for r in formats.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 1, 10, "n"), ("chr2", 6, 6, None)]
    (tmp_path / "x.vcf").write_text("##v\n#CHROM\nchr1\t10\tid\tACG\tA,T\t50\tPASS\tDP=3\nchr1\t20\t.\tA\t<DEL>\t.\t.\tEND=40\n")
    assert [(r.start, r.end, r.qual) for r in formats.read_vcf(spark, str(tmp_path / "x.vcf")).collect()] == [(10, 12, 50.0), (20, 40, None)]
    got = formats.load_intervals(spark, [str(tmp_path / "x.bed"), "chr1:5-9"], contigs).collect()
    assert sorted(tuple(r) for r in got) == [("chr1", 1, 10), ("chr1", 5, 9), ("chr2", 6, 6)]
    with pytest.raises(ValueError, match="unknown"):
        formats.load_intervals(spark, ["chrZ:1-2"], contigs)
    assert formats.program_record(["t", "t.1"], "t", "1", "c")["ID"] == "t.2"
    (tmp_path / "x.fa").write_text(">chr1 d\nACGT\nacgr\n>chr2\nTT\n")
    fa = formats.read_fasta(spark, str(tmp_path / "x.fa"))
    assert formats.sequence(fa, "chr1", 3, 8) == "GTACGN"
    with pytest.raises(ValueError):
        formats.sequence(fa, "chr2", 1, 3)
    (tmp_path / "x.list").write_text("\n")
    with pytest.raises(ValueError):
        formats.read_interval_lines(spark, str(tmp_path / "x.list"), contigs)
    formats.write_reads(spark.createDataFrame([_read(), _read(name="far", start=1500)], rd.SCHEMA), str(tmp_path / "reads"))
    scan = formats.scan_reads(spark, str(tmp_path / "reads"), "chr1", 90, 120)
    formats.write_reads(spark.createDataFrame([_read(name="long", start=10, cg="5M3000000N5M"), _read(name="near", start=2_500_000)], rd.SCHEMA), str(tmp_path / "long"))
    assert sorted(r.name for r in formats.scan_reads(spark, str(tmp_path / "long"), "chr1", 2_500_005, 2_500_006).collect()) == ["long", "near"]
    assert [r.name for r in scan.collect()] == ["r"] and "PartitionFilters: [isnotnull(contig" in scan._jdf.queryExecution().executedPlan().toString()


def test_streamed_depth_equals_the_table(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(src)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_depth(events.read_events(spark, str(tmp_path / "in"), table.schema), late="3650 days")
    q = stream.writeStream.format("memory").queryName("depths").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("depths").agg(F.sum("n")).first()[0] == table.count()
