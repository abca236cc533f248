"""Near copies linked to and through rows without a doc_id."""

from locusframe.llm import jaccard

_W = [f"w{i}" for i in range(40)]


def test_rows_with_a_null_doc_id_link(spark):
    text = lambda a, b: " ".join(_W[a:b])
    # 1 and 2 link through the null row only; the last two rows link with each other and have no id
    rows = [(1, text(0, 10)), (None, text(1, 11)), (None, text(1, 11)), (2, text(2, 12)), (3, text(13, 23)), (None, text(14, 24)), (None, text(26, 36)), (None, text(27, 37)), (9, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    key = lambda t: (t[0] or 0, t[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted([(1, 1), (None, 1), (None, 1), (2, 1), (3, 3), (None, 3), (None, None), (None, None), (9, 9)], key=key)
