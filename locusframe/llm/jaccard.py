"""N-gram Jaccard join: the document by n-gram incidence matrix multiplied in blocks, cut by size bounds.

Columns are ordered, rare ones first. Sets that may link share a column among the first of each, as many as a linking set may lack and one
more, so only these columns are multiplied first; rows that meet in one are compared by their sizes and by parity sketches, which bound
their overlap from above. The sets of the pairs left are multiplied in full: sparse products of one row with the rows of its tile that may
still link, added up over blocks of columns, a pair being dropped once what is left can't reach the overlap that its sizes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_broadcast, documents, materialize, slices, split_join
from locusframe.llm.components import connected_components, key_groups, spanning_links, spread

#: N-grams are frequent if tasks saw them in more sets than this; so many of the most frequent, at most, come last in the order of columns.
FREQUENT, FREQUENT_GRAMS = 16, 1 << 18
#: A task counts so many n-grams at a time, and tells of those that it saw in two sets or more.
_COUNTED = 2_000_000
#: Blocks of columns in which overlaps are added up.
_BLOCKS = 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)  # a byte's value and one, A-Z as a-z
_LOWER[0x41:0x5B] += np.uint64(0x20)


@cache
def _weights(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _A) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of the whole text: runs without ASCII white space, A-Z in lower case; none for null.

    A word's hash is the sum of its bytes, each times a number that depends on its place in the word.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(~_BLANK[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] - at[:-1] > 1)))
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    longest = int(sizes.max())
    return _mix(np.add.reduceat(_LOWER[raw[at]] * _weights(1 << max(8, (longest - 1).bit_length()))[place], first) + sizes.astype(np.uint64))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the whole text. Fewer than k words are one shingle; no words, or null, none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : i + len(h)]) * _A
        h ^= h >> np.uint64(32)
    h = _mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def prefix(hashes: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first columns of a set: one more than a set that links with it may lack of them.

    Columns are in order of their hashes, after them the frequent ones by rank; frequent: their sorted hashes, and their ranks.
    Any two sets that link share one of these.
    """
    n = len(hashes) - -(-len(hashes) * percent // 100) + 1
    if frequent is None or not len(frequent[0]) or not len(hashes):
        return hashes[:n]
    at = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
    often = frequent[0][at] == hashes
    first = hashes[~often][:n]
    if len(first) < n:
        last = hashes[often]
        first = np.concatenate((first, last[np.argsort(frequent[1][at[often]], kind="stable")][: n - len(first)]))
    return first


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the set's members by place; a power of two of places, from 64, at least as many as members.

    Two sets differ in no fewer members than their sketches in places; a sketch folds to half its width by xor.
    """
    width = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _may_differ(x: np.ndarray | int, y: np.ndarray, percent: int) -> np.ndarray:
    """In how many members linking sets of these sizes may differ at most; negative where sizes rule a link out."""
    both = x + y
    most = both - 2 * -(-both * percent // (100 + percent))
    return np.where(np.minimum(x, y) * 100 >= np.maximum(x, y) * percent, most, -1)


def _sketch_links(sizes: list[int], data: list[bytes], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows whose sketches allow them to link."""
    size, words = np.array(sizes, np.int64), np.array([len(d) // 8 for d in data])
    if len(size) == 2:
        ok = _sketches_allow(size[:1], data[:1], size[1:], data[1:], percent)
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if ok[0] and (side is None or side[0] != side[1]) else (np.zeros(0, np.int64),) * 2
    matrix = {int(w): np.frombuffer(b"".join(data[i] for i in np.flatnonzero(words == w)), np.uint64).reshape(-1, w) for w in np.unique(words)}
    place = np.zeros(len(size), np.int64)
    for w in matrix:
        place[words == w] = np.arange((words == w).sum())
    folded: dict[tuple[int, int], np.ndarray] = {}

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        allowed = _may_differ(size[x], size[rest], percent)
        rest, allowed = rest[allowed >= 0], allowed[allowed >= 0]
        own = matrix[int(words[x])][place[x]]
        ok = np.zeros(len(rest), bool)
        for w in np.unique(words[rest]).tolist():
            at = np.flatnonzero(words[rest] == w)
            to = min(w, len(own))
            if (w, to) not in folded:
                folded[w, to] = _fold(matrix[w], to)
            differ = np.bitwise_count(folded[w, to][place[rest[at]]] ^ _fold(own, to)).sum(axis=1, dtype=np.int64)
            ok[at] = differ <= allowed[at]
        return rest[ok]

    return spread(size, side, near)


def _sketches_allow(x: np.ndarray, dx: list[bytes], y: np.ndarray, dy: list[bytes], percent: int) -> np.ndarray:
    """Which pairs, row by row, may link."""
    ok = np.zeros(len(x), bool)
    allowed = _may_differ(x, y, percent)
    for i in np.flatnonzero(allowed >= 0).tolist():
        a, b = (np.frombuffer(d, np.uint64) for d in (dx[i], dy[i]))
        words = min(len(a), len(b))
        ok[i] = int(np.bitwise_count(_fold(a, words) ^ _fold(b, words)).sum()) <= allowed[i]
    return ok


def _set_links(sizes: list[int], data: list[bytes], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all sets that link, by sparse products over blocks of columns."""
    size = np.array(sizes, np.int64)
    columns, at = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    row = np.repeat(np.arange(len(size)), size)
    # a row's entries are in order of columns: where each block begins in it
    edges = [len(columns) * k // _BLOCKS for k in range(1, _BLOCKS)]
    cuts = np.concatenate([begin[:-1, None], begin[:-1, None] + np.stack([np.bincount(row[at < e], minlength=len(size)) for e in edges], axis=1), begin[1:, None]], axis=1)
    mark = np.zeros(len(columns), np.int64)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        rest = rest[_may_differ(size[x], size[rest], percent) >= 0]
        need = -(-(size[x] + size[rest]) * percent // (100 + percent))
        overlap = np.zeros(len(rest), np.int64)
        own = at[begin[x] : begin[x + 1]]
        mark[own] = 1
        for k in range(_BLOCKS):
            start, n = cuts[rest, k], cuts[rest, k + 1] - cuts[rest, k]
            if total := int(n.sum()):
                entry = np.arange(total) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                overlap += np.bincount(np.repeat(np.arange(len(rest)), n), mark[at[entry]], len(rest)).astype(np.int64)
            may = overlap + np.minimum(begin[x + 1] - cuts[x, k + 1], begin[rest + 1] - cuts[rest, k + 1]) >= need
            rest, need, overlap = rest[may], need[may], overlap[may]
        mark[own] = 0
        return rest

    return spread(size, side, near)


def _digest(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _short(digest: bytes | None) -> int | None:
    return None if digest is None else int.from_bytes(digest[:8], "big", signed=True)


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, mark, n_shingles, node, id, sketch, gram) of docs (doc_id, mark, text); rows with a gram tell in how many sets a task saw it.

    node is a digest of the set, id a part of it.
    """
    names = ["doc_id", "mark", "n_shingles", "node", "id", "sketch", "gram"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def often(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        all_ = np.sort(np.concatenate([np.zeros(0, np.uint64), *sets.values()]))
        first = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1]))) if len(all_) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(all_)))
        seen, n = all_[first[n > 1]].view(np.int64), n[n > 1]
        none = [pa.nulls(len(n), t) for t in kinds]
        return pa.RecordBatch.from_arrays([*none[:2], pa.array(n, pa.int64()), *none[3:6], pa.array(seen)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        room = _COUNTED
        for b in slices(batches):
            sets = [shingle_hashes(t.as_py(), k) for t in b.column(2)]
            nodes = [_digest(s) for s in sets]
            for node, s in zip(nodes, sets):
                if node is not None and node not in held:
                    held[node] = s
                    room -= len(s)
                    if room <= 0:
                        yield often(held)
                        held, room = {}, _COUNTED
            columns = [b.column(0), b.column(1), [len(s) for s in sets], nodes, map(_short, nodes), [sketch(s) if len(s) else None for s in sets]]
            yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)), pa.nulls(len(sets), pa.int64())], names)
        yield often(held)

    return docs.mapInArrow(scan, "doc_id long, mark long, n_shingles long, node binary, id long, sketch binary, gram long")


def frequent_grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent n-grams, and their ranks from the rarest; a bounded list, and any list leaves the join exact."""
    seen = rows.where("gram is not null").groupBy("gram").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > FREQUENT)
    top = seen.orderBy(F.desc("n"), "gram").limit(FREQUENT_GRAMS).toPandas()
    grams, n = top["gram"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    by = np.argsort(grams)
    grams, n = grams[by], n[by]
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((grams, n))] = np.arange(len(n))
    return grams, rank


#: A task remembers so many sets whose columns it has given; it may give those of others again, which changes nothing.
_REMEMBERED = 100_000


def _keys(docs: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, id) of docs (text): the first columns of each set; recomputed where it is used twice, since it is larger than the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for b in slices(batches):
            ids, keys = [], []
            for t in b.column(0):
                s = shingle_hashes(t.as_py(), k)
                i = _short(_digest(s))
                if i is None or i in given:
                    continue
                if len(given) < _REMEMBERED:
                    given.add(i)
                ids.append(i)
                keys.append(prefix(s, percent, shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in keys]))], ["key", "id"])

    return docs.mapInArrow(scan, "key long, id long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, id, size, data) of docs (text), data the set's sorted hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [s for t in b.column(0) if len(s := shingle_hashes(t.as_py(), k))]
            nodes = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(map(_short, nodes), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "id", "size", "data"])

    return docs.mapInArrow(scan, "node binary, id long, size long, data binary")


def _band(percent: int) -> Column:
    """Sizes that link lie in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("size")) / F.log(F.lit(100 / percent * 1.001)))


def _near_sets(rows: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """(id, grp) of sets that share a key with one that, by sizes and sketches, they may link with; grp joins these."""
    found = key_groups(keys)
    ids = materialize(found.ids(), "candidates")
    sketches = rows.join(bounded_broadcast(ids, ids.count(), 16), "id", "left_semi").groupBy("id", "node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("data"))
    sketches = materialize(sketches.select("id", "size", "data"), "sketches")
    a, b = (sketches.select(F.col("id").alias(x), F.col("size").alias(f"n{x}"), F.col("data").alias(f"d{x}")) for x in "ab")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = _sketches_allow(t.column("na").to_numpy(), t.column("da").to_pylist(), t.column("nb").to_numpy(), t.column("db").to_pylist(), percent)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    pairs = found.pairs.join(a, "a").join(b, "b").select("a", "na", "da", "b", "nb", "db").mapInArrow(allowed, "a long, b long")
    members = found.members.join(sketches, "id").select("grp", F.col("id").alias("node"), "size", "data")
    links = spanning_links(members, _band(percent), lambda sizes, data, side: _sketch_links(sizes, data, side, percent), "long")
    return materialize(connected_components(pairs.union(links)).select(F.col("node").alias("id"), F.col("component").alias("grp")), "near")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) for every row of docs (doc_id, text, others), mark a hash of its text.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct k-word shingles, percent from 1.
    component_id is the smallest doc_id reachable by links, the document's own included. Null, empty or blank texts have
    no shingles and link with nothing; a null doc_id is no component's smallest, and without other members its
    component_id is null; links through such rows hold. Repeated rows link with each other. An empty table gives an empty one, whole texts
    count however long, and other columns of docs are ignored. Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"), "text")
    scanned = materialize(_rows(docs, k), "shingled")
    rows = scanned.where("gram is null")
    near = _near_sets(rows.where("node is not null"), _keys(docs.select("text"), k, percent, frequent_grams(scanned)), percent)
    n = near.count()
    sets = rows.where("node is not null").select("node", "id", "doc_id", "mark")
    near = bounded_broadcast(near, n, 32)
    # one row of each set tells where its text is
    wanted = sets.join(near, "id").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at")).select("at.*").distinct()
    wanted = materialize(wanted, "wanted")
    texts = docs.join(bounded_broadcast(wanted, wanted.count(), 32), docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["mark"] == wanted["mark"]), "left_semi").select("text")
    members = _sets(texts, k).join(near, "id").groupBy("node").agg(F.first("grp").alias("grp"), F.first("size").alias("size"), F.first("data").alias("data"))
    linked = connected_components(spanning_links(members, _band(percent), lambda sizes, data, side: _set_links(sizes, data, side, percent), "binary"))
    linked = materialize(linked, "linked")
    m = linked.count()
    of = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).join(bounded_broadcast(linked, m, 64), "node", "left").select("node", "doc_id", "n", F.coalesce("component", "node").alias("component"))
    of = materialize(of, "sets")
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    n_sets, n_rows = of.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    of = split_join(of.withColumnRenamed("n", "rows"), least, "component", n_sets, n_sets, 64).select("node", "component_id", F.col("rows").alias("n"))
    out = split_join(rows.select("doc_id", "mark", "n_shingles", "node"), of, "node", n_rows, n_sets, 64, how="left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of linked ones, that with the smallest doc_id, in docs' own columns.

    Of rows with the same doc_id and text one stays. Rows without words, or with a null doc_id, stay.
    """
    found = materialize(jaccard_components(docs, k, percent), "found").where("n_shingles > 0 and doc_id is not null")
    dropped = found.where("doc_id <> component_id").select("doc_id", "mark").distinct()
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__mark": F.coalesce(F.xxhash64("text"), F.lit(0))})
    on = ["__id", "__mark"]
    gone = materialize(dropped.toDF(*on), "dropped")
    kept = marked.join(bounded_broadcast(gone, gone.count(), 24), on, "left_anti")
    again = materialize(found.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark").toDF(*on), "repeated")
    if not again.isEmpty():
        again = bounded_broadcast(again, again.count(), 24)
        one = kept.join(again, on, "left_semi").withColumn("__row", F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(1)))).where("__row = 1").drop("__row")
        kept = kept.join(again, on, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard_components(docs, k=3, percent=90).drop("mark")


QUERIES = {"op9_jaccard": op9_jaccard}
ORACLES: dict[str, str] = {}
