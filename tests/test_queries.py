"""Registered queries against their SQL at the smallest scale, and plans that must hold."""

import duckdb
import pytest

import __spark_entry__ as entry
from locusframe.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["flagship_target_quality", "filter_GoodCigar", "filter_Wellformed", "filter_rejection_counts", "intervals_merge_all", "intervals_subtract", "intervals_overlap_join", "pileup_gap_filled", "likelihood_best_allele", "annotation_FisherStrand", "annotation_BaseQualityRankSum", "annotation_ExcessHet", "annotation_PossibleDeNovo", "tool_print_reads"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    want = duck.sql(core.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_read_only_the_columns_that_they_need(spark):
    plan = core.QUERIES["filter_MappingQualityNotZero"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "PythonUDF" not in plan and "ArrowEval" not in plan
