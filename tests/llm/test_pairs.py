"""Pair operators against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import components, embeddings, jaccard, line_dedup

DOCS = "doc_id long, text string, lang string, source string, keys string, mark int"


def _union(n, links):
    parent = {i: i for i in n}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


def _texts(rng):
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "A", "a"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))) for _ in range(30)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(rng.randrange(4)):
            w = t.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append("\t ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out + ["", "  \n", None, base[0], base[0]]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components_match_brute_force(spark, k, percent):
    texts = _texts(random.Random(k))
    rows = [(100 + i * 3, t, "en", None, "clash", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), k, percent).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = _union(sets, links)
    assert links and got == {i: (len(s), of[i]) for i, s in sets.items()}


def test_linking_pairs_share_a_first_column_and_pass_by_size_and_sketch():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, percent = int(rng.integers(1, 400)), int(rng.choice([50, 80, 90]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        most = len(a) * (100 - percent) // (100 + percent)
        b = np.unique(np.concatenate((a[int(rng.integers(0, most + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, most + 1)), dtype=np.int64).astype(np.uint64))))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= percent * (len(a) + len(b) - inter) and not np.array_equal(a, b):
            assert jaccard._sketches_allow(np.array([len(a)]), [jaccard.sketch(a)], np.array([len(b)]), [jaccard.sketch(b)], percent)[0]
            for share in (0, 0.2, 0.7, 1):
                often = np.sort(a[rng.random(len(a)) < share])
                frequent = (often, rng.permutation(len(often)))
                assert set(jaccard.prefix(a, percent, frequent)) & set(jaccard.prefix(b, percent, frequent))


def test_sparse_products_match_intersections():
    rng = np.random.default_rng(8)
    for side in (None, np.arange(40) % 2):
        pool = np.unique(rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64))
        sets = [np.sort(rng.choice(pool[i % 4 * 60 :][:80], int(rng.integers(1, 70)), replace=False)) for i in range(40)]
        for percent in (30, 50, 80):
            sizes, data = [len(x) for x in sets], [x.tobytes() for x in sets]
            links = [(i, j) for i, j in itertools.combinations(range(40), 2) if (side is None or side[i] != side[j]) and 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= percent * (sizes[i] + sizes[j] - o)]
            for found in (jaccard._set_links(sizes, data, side, percent), jaccard._sketch_links(sizes, [jaccard.sketch(x) for x in sets], side, percent)):
                got, want = _union(range(40), zip(*(x.tolist() for x in found))), _union(range(40), links)
                assert all(got[i] == got[j] for i, j in links)
            got = _union(range(40), zip(*(x.tolist() for x in jaccard._set_links(sizes, data, side, percent))))
            assert got == want


def test_jaccard_of_an_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.keep_one_of_each(empty).columns == empty.columns
    rows = [(1, "a b c", "en", "s", "k", 1)] * 2 + [(2, "a b c", "en", "s", "k", 1), (3, None, "en", "s", "k", 1), (3, None, "en", "s", "k", 1), (None, "a b c", "en", "s", "k", 1)]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 3]


def test_frequent_grams_change_no_result(spark, monkeypatch):
    rng = random.Random(31)
    line = " ".join(f"common{i}" for i in range(25))
    rows = [(i, "\n".join([line, t or "", line]), "en", "s", "k", 1) for i, t in enumerate(_texts(rng))] + [(900, line, "en", "s", "k", 1), (901, line + " x", "en", "s", "k", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    scanned = jaccard._rows(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), 3)
    assert len(jaccard.frequent_grams(scanned)[0]) >= 23
    with_grams = sorted(map(tuple, jaccard.jaccard_components(docs, 3, 80).collect()))
    monkeypatch.setattr(jaccard, "FREQUENT", 1 << 40)
    assert sorted(map(tuple, jaccard.jaccard_components(docs, 3, 80).collect())) == with_grams


@pytest.mark.parametrize("tile,size", [(4, 1 << 30), (1 << 30, 1 << 12), (3, 1 << 10)])
def test_groups_beyond_a_tile_lose_no_link(spark, monkeypatch, tile, size):
    monkeypatch.setattr(components, "TILE", tile)
    monkeypatch.setattr(components, "TILE_BYTES", size)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[30:]), "en", "s", "k", 1) for i in range(23)]
    rows += [(100 + i, " ".join(base[: 20 + i]), "en", "s", "k", 1) for i in range(40)] + [(200 + i, " ".join(base[:5] + [f"{i}y{j}" for j in range(9)]), "en", "s", "k", 1) for i in range(30)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), 1, 90).collect()}
    sets = {i: set(t.split()) for i, t, *_ in rows}
    want = _union(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    assert got == want and len({want[i] for i in range(23)}) == 1


def test_many_candidates_that_mostly_do_not_link(spark):
    """Thousands of documents share a passage, and few of them link."""
    rng = random.Random(77)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"{i // 2 if i % 50 < 2 else i}q{j}" for j in range(rng.choice([8, 20, 60]))), "en", "s", "k", 1) for i in range(6000)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(6), 3, 90).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    tail = {}
    for i, s in sets.items():
        for x in s:
            if not any(y[0] == "p" for y in x):
                tail.setdefault(x, []).append(i)
    pairs = {p for ids in tail.values() for p in itertools.combinations(ids, 2)}
    want = _union(sets, [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    assert got == want and 5000 < len(set(want.values())) < 6000


@pytest.mark.parametrize("bound", [components.ONE_TASK_EDGES, 0])
def test_connected_components_of_a_path_and_a_star(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", bound)
    assert components.connected_components(spark.createDataFrame([], "a binary, b binary")).count() == 0
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    letters = "abcde é"
    lines = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 9, 10, 11, 19, 20, 21, 40, 90]))).strip() or "x" for _ in range(40)]
    for t in list(lines):
        s = list(t)
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s)) :][:1] = []
            s.insert(rng.randrange(len(s) + 1), rng.choice(letters))
        lines.append("".join(s).strip() or "x")
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4]), "en", "s", "k", 1) for i in range(20)] + [(50, None, "en", "s", "k", 1), (51, "\n \n", "en", "s", "k", 1)]
    rows = line_dedup.line_decisions(spark.createDataFrame(docs, DOCS)).collect()
    of = {(r.doc_id, r.line_no): r for r in rows}
    text = {(i, n): x for i, t, *_ in docs if t for n, x in enumerate(line_dedup.lines_of(t)) if x}
    assert set(of) == set(text)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    keys = list(text)
    links = [(a, b) for a, b in itertools.combinations(keys, 2) if text[a] == text[b] or abs(len(text[a]) - len(text[b])) <= 2 and distance(text[a], text[b]) <= min(2, max(len(text[a]), len(text[b])) // 10)]
    want = _union(keys, links)
    assert links and {frozenset(k for k in keys if of[k].class_id == c) for c in {r.class_id for r in rows}} == {frozenset(k for k in keys if want[k] == c) for c in set(want.values())}
    held = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()
    assert sum(len([x for x in line_dedup.lines_of(r.text) if x]) for r in held) == len(set(want.values())) and len(held) == len(docs)


def test_lines_within_edits_share_a_key():
    rng = random.Random(14)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.choice([7, 8, 9, 10, 11, 12, 17, 18, 19, 20, 21, 22, 40])))
        b = list(a)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "d"])
        b = "".join(b)
        if a != b and line_dedup._linked(a, b, 2):
            assert set(line_dedup.line_keys(a)) & set(line_dedup.line_keys(b)), (a, b)


def test_blank_lines_are_those_that_strip_empties(spark):
    blanks = [chr(c) for c in range(0x10000) if c != 10 and not 0xD800 <= c < 0xE000 and not chr(c).strip()]
    texts = ["a\n" + c + "\nb" for c in blanks] + ["a\n" + c + "\nb" for c in "\u200b\ufeff\u180e"]
    rows = [(i, t + f"{i}", "en", "s", "k", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_lines for r in line_dedup.summary(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: sum(1 for x in t.split("\n") if x.strip()) for i, t, *_ in rows}


def test_line_dedup_of_empty_repeated_and_nameless_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.summary(empty).count() == 0 and line_dedup.dedup_lines(empty).columns == empty.columns
    long = "x" * 300_000
    rows = [(1, "same line here\n" + long, "en", "s", "k", 1)] * 2 + [(2, "same line here", "en", "s", "k", 1), (None, "same line here", "en", "s", "k", 1), (3, long + "y", "en", "s", "k", 1), (4, None, "en", "s", "k", 1)]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.removed_lines) for r in line_dedup.summary(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 1, 0, ""), (1, 2, 0, ""), (1, 2, 0, ""), (2, 1, 1, "0"), (3, 1, 1, "0"), (4, 0, 0, "")]


def test_edit_distance_band_against_the_matrix():
    rng = random.Random(9)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        for e in (1, 2, 3):
            assert line_dedup.within_edits(a, b, e) == (p[-1] <= e), (a, b, e)


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 30), 32)) * s for c, s in zip(centres, np.linspace(0.02, 0.4, 12))] + [centres[:2], centres[:2] * 3]).astype(np.float32)
    vectors = [(i * 2, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0, None]), (9005, []), (9006, vectors[0][1]), (9007, vectors[0][1][:5])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")).collect()}
    full = vectors + [odd[5]]
    u = np.array([v for _, v in full], np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    ids = [i for i, _ in full]
    of = _union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
    want = {i: (int(linked[k].sum()), of[i], of[i] == i) for k, i in enumerate(ids)} | {i: (0, i, True) for i, _ in odd if i != 9006}
    assert got == want


def test_embeddings_tie_repeat_and_have_no_id(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], "c"), (2, [1.0, 1.0, 1.0, 1.0], "c"), (2, [1.0, 1.0, 1.0, 1.0], "c"), (None, [2.0, 2.0, 2.0, 2.0], "c"), (None, [0.0, 0.0, -1.0, 0.0], "c"), (5, [-1.0, 1.0, -1.0, 1.0], "c"), (6, [0.0, 1.0, 0.0, 0.0], "c")]
    got = [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string"), 0.5).collect()]
    key = lambda t: tuple((x is None, x or 0) for x in t[:2])
    # by hand: 1-2 at 0.5; both rows of 2 and the third equal one; 5 at 0.5 to the nameless and to 6; 6 at 0.5 to 2
    want = [(1, 3, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (None, 1, 1, False), (5, 2, 1, False), (6, 4, 1, False)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("grid", [3, 4])
def test_embeddings_on_finer_grids(spark, monkeypatch, grid):
    monkeypatch.setattr(embeddings, "_grid_dims", lambda n: grid)
    rng = np.random.default_rng(grid)
    x = rng.standard_normal((9, 24)).repeat(7, axis=0) + rng.standard_normal((63, 24)) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(63, dtype=bool)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(linked[i].sum()) for i in range(63)} and linked.any()


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_shuffled_joins_agree_with_broadcast_ones(spark, monkeypatch):
    """Beyond the broadcast bound the same rows come out."""
    from locusframe.llm import common

    rng = random.Random(21)
    rows = [(i, t, "en", "s", "k", 1) for i, t in enumerate(_texts(rng))]
    docs = spark.createDataFrame(rows, DOCS)
    small = sorted(map(tuple, jaccard.jaccard_components(docs, 3, 80).collect()), key=repr)
    lines = sorted(map(tuple, line_dedup.summary(docs).collect()), key=repr)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, jaccard.jaccard_components(docs, 3, 80).collect()), key=repr) == small
        assert sorted(map(tuple, line_dedup.summary(docs).collect()), key=repr) == lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
