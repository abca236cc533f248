"""The pipeline against each stage's own rule, on a small table."""

import random

import corpus_pipeline
from locusframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = random.Random(1)
    words = "the and of house thing with that from into over under these those where which while about after again".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak = text(14)
    rows = [(i, text(60), "en", f"s{i % 2}", 1) for i in range(60)] + [(100, "12 34", "en", "s0", 1), (101, None, "en", "s0", 1), (102, text(30) + " " + leak, "en", "s0", 1)]
    rows += [(200 + i, rows[3][1], "en", "s1", 1) for i in range(5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        seen.append(ids)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert seen[0] == {r[0] for r in rows} - {100, 101}
    assert seen[1] == seen[0] - {200, 201, 202, 203, 204}
    assert seen[2] == seen[1] - {102}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    final = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(final.doc_id) == seen[4] and final.shard.between(0, 39).all()


def test_stages_bear_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark string, node int, topic string, shard string"
    text = "the house and the thing with that from over there again and again under these"
    rows = [(1, text, None, None, None, "c", 1, "t", "s")] * 2 + [(None, text, "en", "s", 1, "c", 1, "t", "s"), (2, None, "en", "s", 1, "c", 1, "t", "s"), (3, "", "en", "s", 1, "c", 1, "t", "s"), (4, (text + " ") * 5000, "en", "s", 1, "c", 1, "t", "s")]
    for name, data, bench in (("odd", rows, [("b", "nothing of this"), (None, None)]), ("empty", [], [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        got = out.select("doc_id", "text", "shard", "slot").collect()
        assert len(got) <= len(data) and {r.doc_id for r in got} <= {1, None, 4}
        assert name == "empty" or len(got) > 0


def test_each_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 11))
