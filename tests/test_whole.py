"""Registered queries read all rows of their tables."""

import re

from pyspark.sql import functions as F

from locusframe.operators import intervals, pileup
from locusframe.plans import fixtures as fx
from locusframe.plans import queries as core


def test_intervals_hold_every_order_on_both_sides(spark, tmp_path):
    orders = [(k, k * 7 % 11) for k in range(1, 41)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    sf = str(tmp_path)
    one = {(k, f"chr{1 + c % 5}", 1 + k * 53 % 20000, 20 + k * 53 % 20000 + c % 40) for k, c in orders}
    two = {(k, f"chr{1 + c % 4}", 1 + k * 71 % 20000, 5 + k * 71 % 20000 + c % 25) for k, c in orders}
    assert {tuple(r) for r in fx.intervals(spark, sf).collect()} == one
    assert {tuple(r) for r in fx.intervals(spark, sf, fx.EXCLUDED).collect()} == two
    assert core.QUERIES["intervals_union"](spark, sf).count() == 80
    covered = {(c, p) for _, c, s, e in one for p in range(s, e + 1)} - {(c, p) for _, c, s, e in two for p in range(s, e + 1)}
    got = [(r.contig, p) for r in core.QUERIES["intervals_subtract"](spark, sf).collect() for p in range(r.start, r.end + 1)]
    assert len(got) == len(set(got)) and set(got) == covered
    pairs = intervals.overlap_join(fx.intervals(spark, sf), fx.intervals(spark, sf, fx.EXCLUDED), width=200)
    assert sorted((r.iv_id, r.r_iv_id) for r in pairs.collect()) == sorted((a[0], b[0]) for a in one for b in two if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])


def _walk(r):
    """(pos, base, qual) of a read by hand, adaptor positions aside."""
    paired = r.flags & 1 and not r.flags & 12 and r.ref_idx != -1 and r.start and r.mate_ref != -1 and r.mate_start and bool(r.flags & 16) != bool(r.flags & 32) and r.isize
    reverse, end = r.flags & 16, r.start + sum(int(n) for n, o in re.findall("([0-9]+)(.)", r.cigar) if o in "MDN=X") - 1
    known = paired and (end > r.mate_start if reverse else r.start <= r.mate_start + r.isize) and r.isize <= 100
    pos, at, out = r.start, 0, []
    for n, o in re.findall("([0-9]+)(.)", r.cigar):
        for _ in range(int(n)):
            if o in "MD" and not (known and (pos <= r.mate_start - 1 if reverse else pos >= r.start + abs(r.isize))):
                out.append((pos, "D" if o == "D" else r.bases[at : at + 1], 16 if o == "D" else r.quals[at] if at < len(r.quals) else None))
            pos += o in "MDN"
            at += o in "MIS"
    return out


def test_pileups_without_sql_hold_every_read_that_the_operator_accepts(spark, tmp_path):
    # the second read of a name starts 13 positions before the first
    lines = (1, 2, 4, 5, 7, 10, 13)
    rows = [(k, 20 + k * 3 % 70 - 14 * c, k % 5, lines[k % 7] + 5 * c, 1.0 + k % 50) for k in range(1, 300) for c in (0, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    sf = str(tmp_path)
    reads = [r for r in fx.reads(spark, sf).collect() if not r.flags & 1540 and r.ref_idx != -1 and r.start > 0 and r.cigar not in ("2S3D48M", "10I2D40M")]
    assert {"20M3I27M", "3H47M3S", "10M100N40M"} <= {r.cigar for r in reads} and {49, 50} <= {len(r.bases) for r in reads}
    piled, depth = {}, {}
    for r in reads:
        for pos, base, qual in _walk(r):
            piled.setdefault((r.contig, pos, r.name), []).append((not r.flags & 64, base, qual))
            depth[r.contig, pos] = depth.get((r.contig, pos), 0) + 1
    assert {(r.contig, r.pos): r.depth for r in core._pile(spark, sf).groupBy("contig", "pos").count().withColumnRenamed("count", "depth").collect()} == depth
    assert {(r.contig, r.pos) for r in core.QUERIES["region_band_pass"](spark, sf).where("pos between 1 and 20000").collect()} >= set(depth)
    cut = [(r.contig, p) for r in core.QUERIES["region_cut"](spark, sf).collect() for p in range(r.start, r.end + 1)]
    assert len(cut) == len(set(cut)) and set(cut) >= {k for k in depth if k[1] <= 20000}
    assert sum(len(x) == 2 for x in piled.values()) > 1000 and any(len(x) == 2 and None in (x[0][2], x[1][2]) for x in piled.values())
    sums = {}
    for (contig, _, _), found in piled.items():
        quals = [q for _, _, q in found]
        if len(found) == 2 and None not in quals and found[0][0] != found[1][0]:
            (_, b1, q1), (_, b2, q2) = sorted(found)
            quals = [min(q1 + q2, 93), 0] if b1 == b2 else [int(max(q1, q2) * 0.8), 0]
        else:
            assert len(found) == 1 or None in quals
        n = sums.setdefault(contig, [0, 0])
        n[0] += sum(q for q in quals if q is not None)
        n[1] += quals.count(0)
    assert {r.contig: [r.qual_sum, r.n_zero] for r in core.QUERIES["pileup_pair_fix"](spark, sf).collect()} == sums


def test_pair_totals_equal_the_pairs_fixed_element_by_element(spark, tmp_path):
    lines = (1, 2, 4, 5, 7, 10, 13)
    rows = [(k, 20 + k * 3 % 70 - 14 * c, k % 5, lines[k % 7] + 5 * c, 1.0 + k % 50) for k in range(1, 200) for c in range(1 + k % 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    sf = str(tmp_path)
    plain = pileup.fix_overlapping_pairs(core._pile(spark, sf)).groupBy("contig").agg(F.sum("qual").alias("qual_sum"), F.count_if(F.col("qual") == 0).alias("n_zero"))
    want = sorted(map(tuple, plain.collect()))
    reads = pileup.passing(fx.reads(spark, sf))
    for bounds in ({}, {"broadcast_names": 0}, {"broadcast_cigars": 0}):
        assert sorted(map(tuple, pileup.fixed_totals(reads, "contig", drop_refused=True, **bounds).collect())) == want
