"""Document operators against brute force on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import common, decontaminate, langid, mixing, secrets, sharding

DOCS = "doc_id long, text string, lang string, source string, n_words string, size int"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", "clash", 1) for i, t in enumerate(texts)], DOCS)


def _contamination(texts, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(x for x in found if x is not None)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [decontaminate.INDEX_BYTES, 0])
def test_contamination_matches_brute_force_on_both_ways(spark, limit):
    rng = random.Random(1)
    words = [f"W{i}" for i in range(30)] + ["é", "x_y"]
    items = [(f"i{j}", " ".join(rng.choice(words) for _ in range(n))) for j, n in enumerate([14, 12, 10, 9, 3, 25])] + [("i0", "a b c d e f g h i j k"), (None, "q r s"), ("e", ""), ("n", None)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(8)]
    texts += ["pre " + items[0][1].upper() + " post", items[3][1], "x " + items[4][1] + ", y " + items[2][1], "z q R-s t", "", None, "no.", items[5][1] * 3]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(_docs(spark, texts), bench, index_bytes=limit).collect()}
    assert got == _contamination(texts, items) and any(v[4] for v in got.values())


def test_spans_are_removed_and_empty_tables_pass(spark):
    bench = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    docs = _docs(spark, ["é, ONE two; three! four", "one two", None])
    assert [r.text for r in decontaminate.remove_spans(docs, bench).orderBy("doc_id").collect()] == ["é, ! four", "one two", None]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [1, 2]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 3
    odd = docs.withColumn("n_words", F.lit("theirs")).withColumn("contaminated", F.lit(None).cast("boolean"))
    both = [decontaminate.decontaminate(odd, bench, index_bytes=limit) for limit in (decontaminate.INDEX_BYTES, 0)]
    assert all(x.columns == odd.columns and sorted((r.doc_id, r.n_words, r.contaminated) for r in x.collect()) == [(1, "theirs", None), (2, "theirs", None)] for x in both)
    assert decontaminate.decontaminate(odd.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_spans_are_removed_alike_on_both_ways(spark):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(12)]
    items = [(f"i{j}", " ".join(rng.choice(words) for _ in range(n))) for j, n in enumerate([14, 12, 3, 10, 5])] + [("i0", items_text := "w1 w2"), (None, items_text), ("n", None)]
    texts = [", ".join(rng.choice(words) for _ in range(80)) for _ in range(12)] + [None, "", items[0][1] + "!", "x" * 200_000 + " w1 W2"]
    docs, bench = _docs(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    one = [r.text for r in decontaminate.remove_spans(docs, bench).orderBy("doc_id").collect()]
    assert one == [r.text for r in decontaminate.remove_spans(docs, bench, index_bytes=0).orderBy("doc_id").collect()]
    assert one[12:15] == [None, "", "!"] and one[15] == "x" * 200_000 + " " and any(a != b for a, b in zip(one[:12], texts))


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "_window_hashes", lambda ids, n: ids[: len(ids) - n + 1] << np.uint64(60))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(f"i{j}", " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 9])))) for j in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) + " " + rng.choice(items)[1] for _ in range(20)]
    index = decontaminate.WindowIndex(items, 3)
    want = _contamination(texts, items, 3)
    for d, t in enumerate(texts):
        hit, found = index.scan(decontaminate.words_of(t))
        assert (int(hit.sum()), len(found)) == want[d][1:3]


def test_grams_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab ü日\u2003,") for _ in range(rng.randrange(1, 40))) for _ in range(200)] + ["", None, "   ", "a", "a" * 70_000]
    whole = [langid.gram_counts(t) for t in texts]
    assert whole[-1].max() == 70_000 and not whole[-3].any()
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_PIECE", piece)
        for t, w in zip(texts[:-1], whole):
            assert (langid.gram_counts(t) == w).all(), (piece, t)


def test_language_of_an_empty_table_and_of_clashing_columns(spark):
    model = langid.fit(spark.createDataFrame([(1, "the house", "en")], "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "the house", "x", 3)], "doc_id long, text string, score string, rejected int")
    assert langid.identify(odd.limit(0), model).count() == 0 and isinstance(langid.identify(odd, model).first().score, float)


def test_language_is_learnt_and_oddities_are_rejected(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "thing", "house", "with"], "de": ["der", "und", "haus", "schön", "nicht"], "fr": ["les", "être", "maison", "une", "où"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 80))), lang, "s", "c", 1) for i, lang in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows + [(900, None, "en", "s", "c", 1), (901, "123 !!", "en", "s", "c", 1), (902, "", None, "s", "c", 1), (903, "the house " * 300_000, None, "s", "c", 1), (904, "xqzv jjkq wwx " * 9, None, "s", "c", 1)], DOCS)
    model = langid.fit(docs.where("lang is not null"), langid.fold() != 2)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 20 and all(got[r[0]].lang_pred == r[2] for r in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and got[903].lang_pred == "en"
    assert got[904].rejected and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(180)) | {903}
    empty = langid.fit(docs.limit(0))
    assert langid.identify(docs.limit(2), empty).where("lang_pred = 'und'").count() == 2


def test_secret_spans_match_the_patterns(spark):
    rng = random.Random(8)
    parts = ["token = ", "API_KEY:'", "passwd=", "secret=secret=abcdefghijkl", "AKIA" + "Z9" * 9, "AKIA1", "0123456789abcdef", "deadbeef" * 40, "é ", "\n", "x", '"', "password: token = longlonglonglong", "Zx9+/kQ7pLm2Vb8Rt5Wn3Hj6", "the_user_name_of_the_account_table", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["", None, "0123456789abcdef " * 700]
    docs = _docs(spark, texts)
    got = {r.doc_id: r for r in secrets.find_secrets(docs, secrets.fit(secrets.training_samples(docs))).collect()}
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    for d, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= least)
        text = ",".join(f"{n}:{a}:{e}" for a, _, e, n in spans)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(s[3] == n for s in spans) for n in ("assign", "access", "hex")]
        assert [s for s in got[d].spans.split(",") if s and not s.startswith("random")] == [x for x in text.split(",") if x]


def test_random_strings_are_told_from_identifiers(spark):
    docs = _docs(spark, ["see kJ8sQ2vX9bT4mZ7nR1wL5pY3 here", "see getDefaultUserAccountName here", "see max_connection_pool_size_limit here", "see a1B9z8Y7x6W5v4U3t2S1r0Q9 here"])
    got = [r.n_random for r in secrets.find_secrets(docs, secrets.fit(secrets.training_samples(docs))).orderBy("doc_id").collect()]
    assert got == [1, 0, 0, 1]


def test_secrets_of_empty_tables_and_clashing_columns(spark):
    table = [0.0] * (len(secrets.ALPHABET) * (len(secrets.ALPHABET) + 1))
    odd = spark.createDataFrame([(1, "token=abcdefghijklmnop", 5, "x")] * 2, "doc_id long, text string, spans int, values string")
    assert secrets.find_secrets(odd.limit(0), table).count() == 0
    assert [r.spans for r in secrets.find_secrets(odd, table).collect()] == ["assign:0:22"] * 2


def test_random_strings_are_found_with_high_precision_and_recall(spark):
    """Strings by other rules than the training samples': keys of several alphabets and lengths; names and words of code and prose."""
    rng = random.Random(99)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    random_ = ["".join(rng.choice(rng.choice(alphabets[i % 4 : i % 4 + 1])) for _ in range(rng.choice([24, 32, 40, 64]))) for i in range(200)]
    parts = "window parser remote invoice schedule network customer balance tracking gateway element surface compiler iterator document pressure velocity hospital kitchen mountain reading".split()
    names = []
    for i in range(200):
        take = [rng.choice(parts) for _ in range(rng.choice([3, 4, 5]))]
        names.append(["_".join(take), "-".join(take), "".join(x.title() for x in take), "_".join(take).upper()][i % 4])
    docs = _docs(spark, [f"see {x} here" for x in random_ + names])
    prose = _docs(spark, ["we think that this house has been standing where another river runs through the village under mountains"] * 20)
    got = [r.n_random > 0 or r.n_hex > 0 for r in secrets.find_secrets(docs, secrets.fit(secrets.training_samples(prose))).orderBy("doc_id").collect()]
    missed = [x for x, g in zip(random_, got) if not g]
    caught, wrong = sum(got[:200]), sum(got[200:])
    assert caught >= 190 and wrong <= 4, (caught, wrong, missed[:20])


def test_raking_matches_proportional_fitting_by_hand(spark):
    rng = np.random.default_rng(4)
    table = rng.integers(1, 500, (3, 4, 2)).astype(float)
    rows = [(f"a{i}", f"b{j}", f"c{k}", int(table[i, j, k])) for i in range(3) for j in range(4) for k in range(2)]
    goals = {"x": [0.2, 0.3, 0.5], "y": [0.1, 0.2, 0.3, 0.4], "z": [0.6, 0.4]}
    got = mixing.rake(spark.createDataFrame(rows, "x string, y string, z string, tokens long"), ["x", "y", "z"], {d: {f"{n}{i}": g for i, g in enumerate(v)} for (d, v), n in zip(goals.items(), "abc")}).toPandas()
    w = table / table.sum()
    for _ in range(500):
        for axis, goal in enumerate(goals.values()):
            others = tuple(a for a in range(3) if a != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * (np.array(goal) / w.sum(axis=others)).reshape(shape)
    for r in got.itertuples():
        assert r.weight == pytest.approx(w[int(r.x[1]), int(r.y[1]), int(r.z[1])], abs=1e-6)


def test_raked_margins_meet_their_targets(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 4}", f"l{j}", rng.choice(["a", None]), rng.randrange(1, 1000)) for i in range(4) for j in range(3) for _ in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    goal = {"source": {f"s{i}": i + 1.0 for i in range(4)}}
    out = mixing.rake(cells, ["source", "lang"], goal, {"lang": 0.5}).toPandas()
    assert np.allclose(out.groupby("source").weight.sum(), np.arange(1, 5) / 10, atol=1e-5)
    share = out.groupby("lang").tokens.sum() ** 0.5
    assert np.allclose(out.groupby("lang").weight.sum(), share / share.sum(), atol=1e-5)
    p = mixing.probabilities(mixing.rake(cells, ["source", "lang"], goal, {"lang": 0.5}), ["source", "lang"]).toPandas()
    assert p.probability.max() == pytest.approx(1)


def test_mixing_shuffled_agrees_with_one_partition(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", 5), ("a", "y", 7), ("b", "x", 11), ("b", "y", 1)], "source string, lang string, tokens long")
    one = {(r.source, r.lang): r.weight for r in mixing.rake(cells, ["source", "lang"], powers={"source": 0.3}).collect()}
    monkeypatch.setattr(mixing, "ONE_PARTITION_CELLS", 0)
    two = {(r.source, r.lang): r.weight for r in mixing.rake(cells, ["source", "lang"], powers={"source": 0.3}).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_mixing_keeps_shares_and_handles_nulls(spark):
    rows = [(i, "w " * 20, None if i % 7 == 0 else "en", "big" if i % 4 else "small", "c", 1) for i in range(4000)] + [(None, "w", "en", "big", "c", 1), (5, None, "en", "big", "c", 1), (6, "", None, None, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 4000, 3)] + [(None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    kept = mixing.mix_documents(docs, labels)
    assert kept.columns == docs.columns
    got = kept.toPandas()
    assert {None, 5, 6} <= {None if x != x else int(x) for x in got.doc_id}
    share = (got.source == "small").mean()
    goal = (0.25**0.7) / (0.25**0.7 + 0.75**0.7)
    assert abs(share - goal) < 0.03
    assert mixing.mix_documents(docs.limit(0), labels).count() == 0


def test_cuts_are_minimal_against_dynamic_programming():
    rng = random.Random(12)
    for _ in range(200):
        sizes = sorted((rng.randrange(1, 30) for _ in range(rng.randrange(1, 14))), reverse=True)
        shards = rng.randrange(1, 6)
        values, counts = np.unique(sizes, return_counts=True)
        low, cuts = sharding.cut_points(values[::-1].astype(np.int64), counts[::-1].astype(np.int64), shards)
        best = [[0] + [10**9] * len(sizes)] + [[10**9] * (len(sizes) + 1) for _ in range(shards)]
        for k in range(1, shards + 1):
            for j in range(len(sizes) + 1):
                best[k][j] = min(max(best[k - 1][i], sum(sizes[i:j])) for i in range(j + 1))
        edges = [0, *cuts, len(sizes)]
        assert low == best[shards][len(sizes)] and edges == sorted(edges) and max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) <= low


def test_sharding_keeps_groups_and_numbers_rows(spark):
    rng = random.Random(3)
    texts = ["é" * rng.randrange(200) for _ in range(400)] + ["copy"] * 30 + [None, "", None]
    docs = _docs(spark, texts)
    got = sharding.shard(docs, shards=7).toPandas()
    assert len(got) == len(texts) and got.groupby(got.text.fillna("")).shard.nunique().max() == 1
    assert (got["size"] == got.text.fillna("").map(lambda t: len(t.encode()) + 16)).all() and (got.text_crc32 == got.text.fillna("").map(lambda t: zlib.crc32(t.encode()))).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 7 and loads.max() - loads.min() < 1000
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_of_hot_repeated_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = [(1, "hot")] * 200 + [(2, "x" * 500_000)] + [(i, f"t{i}") for i in range(100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("old")), shards=3).toPandas()
    assert len(got) == len(rows) and got.groupby("text").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
