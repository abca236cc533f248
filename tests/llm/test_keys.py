"""Groups of keys: keys of different ids stay apart, however alike their ids' hashes, and repeated rows change nothing."""

from pyspark.sql import functions as F

from locusframe.llm import common, components


def test_keys_whose_ids_agree_in_31_bits_are_kept_apart(spark):
    ids = spark.range(1, 400_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("h")).agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").collect()
    assert ids
    rows = []
    for i, r in enumerate(ids):
        rows += [(2 * i + k, m) for k, mid in ((0, r.x), (1, r.y)) for m in (0, mid, 1 << 40)]
    found = components.key_groups(spark.createDataFrame(rows, "key long, id long"))
    assert {r.id for r in found.ids().collect()} == {m for _, m in rows}
    assert found.members.select("grp").distinct().count() == len({k for k, _ in rows})


def test_groups_are_given_once_and_pairs_apart(spark, monkeypatch):
    rows = [(1, 10), (1, 11), (2, 11), (2, 10), (3, 10), (4, 10), (4, 10)] + [(k, i) for k in (7, 8) for i in range(20, 25)] * 2 + [(9, i) for i in range(20, 24)]
    rows += [(6, 10), (6, 10), (6, 11)]
    for bound in (common.BROADCAST_BYTES, -1):
        monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
        found = components.key_groups(spark.createDataFrame(rows, "key long, id long"))
        assert [tuple(r) for r in found.pairs.collect()] == [(10, 11)]
        groups = {}
        for r in found.members.collect():
            groups.setdefault(r.grp, set()).add(r.id)
        assert sorted(map(sorted, groups.values())) == [[10, 11], [20, 21, 22, 23], [20, 21, 22, 23, 24]]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(k, 0) for k in range(1, 20)] + [(None, 5)], "k long, x long")
    table = rows.where("k % 2 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("m"))
    got = sorted(tuple(r) for r in common.split_join(rows, table, "k", 69, 69).select("k", "x", "m").collect())
    assert got == sorted([(0, i, 49) for i in range(50)] + [(k, 0, 0) for k in range(2, 20, 2)])
    assert common.split_join(rows, table, "k", 69, 69, how="left").count() == 70
