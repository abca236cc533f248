"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors are rotated and split into blocks of coordinates. Two vectors within a squared distance e differ by at most their
share of e in one block at least, a block's share being that of its dimensions. So each block is range-joined under its own
budget, on a grid over its first coordinates, and the pairs found in any block are verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_broadcast, documents, materialize, partitions_for, slices, split_join
from locusframe.llm.components import connected_components, smallest_reachable

THRESHOLD = 0.95
BLOCK_DIMS = 16
#: A join tile compares at most so many vectors with as many; a cell of more is cut into chunks.
TILE = 8192
#: One call compares tiles of about so many rows.
CALL_ROWS = 20_000
_STEP = 512
_SLACK = 1e-9


@cache
def _rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int) -> list[slice]:
    n = max(1, round(dims / BLOCK_DIMS))
    edges = [dims * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _budgets(dims: int, threshold: float) -> list[float]:
    return [2 * (1 - threshold) * (b.stop - b.start) / dims + _SLACK for b in _blocks(dims)]


def _cells(u: np.ndarray, dims: int, threshold: float, grid: int) -> list[np.ndarray]:
    """Grid cells of rotated rows u in each block; a cell is as wide as the block's radius."""
    return [np.floor(u[:, b][:, :grid] / max(np.sqrt(budget), 1e-3)).astype(np.int64) for b, budget in zip(_blocks(dims), _budgets(dims, threshold))]


def _codes(cells: np.ndarray) -> np.ndarray:
    """A number for each row of cells. They lie within the unit ball and are 0.001 wide at least, so a coordinate is far below 2**14; four fit."""
    out = np.zeros(len(cells), np.int64)
    for x in cells.T:
        out = (out << 15) | (x + (1 << 14))
    return out


def _grid_dims(n: int) -> int:
    """A coordinate more for every factor of 25 in rows, as cells are about so many times as many with it."""
    return min(4, 2 + sum(n > 200_000 * 25**i for i in range(2)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding, others) as (vec_id, n_links, component_id, kept), a row for each.

    Vectors link when their cosine, in double precision, is at least threshold. Null and zero vectors, empty ones and those with null or
    non-finite components link with nothing, and vectors of different lengths never link. n_links counts all other linked rows,
    exact copies included, each row of a repeated vec_id by itself; component_id is the smallest vec_id reachable. A null vec_id links
    but is no component's smallest, and is kept only by no one. An empty table gives an empty one; other columns are ignored. Equal vectors are told by
    128-bit hashes.
    """
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            out = []
            for v in b.column(1):
                v = v.as_py()
                a = None if not v or any(x is None for x in v) else np.asarray(v, kind)
                out.append(None if a is None or not np.isfinite(a).all() or not a.any() else (a + kind(0)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in out], pa.binary())], ["vec_id", "raw", "cid"])

    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(encode, "vec_id long, raw binary, cid binary"), "vectors")
    classes = materialize(rows.where("cid is not null").groupBy("cid").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id")), "distinct")
    n_classes, n_rows = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    grid = _grid_dims(n_classes)
    size = np.dtype(kind).itemsize
    # a cell's own vectors meet each other and those of one half of its neighbours, which visit it
    moves = [(0,) * grid, *(o for o in product((-1, 0, 1), repeat=grid) if o > (0,) * grid)]

    def unit(raw: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def places(raw: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(dims, block, visitors, rows, cells) of the rows and moves."""
        lengths = np.array([len(r) for r in raw], np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            u = unit([raw[i] for i in at]) @ _rotation(n // size)
            for k, c in enumerate(_cells(u, n // size, threshold, grid)):
                for move in moves:
                    yield n // size, k, int(any(move)), at, _codes(c - np.array(move))

    def occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            for dims, block, side, _, cells in places(b.column(0).to_pylist()):
                found, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dims, np.int32)), pa.array(np.full(len(n), block, np.int32)), pa.array(found), pa.array(n if not side else n * 0), pa.array(n * side)], ["dims", "block", "cell", "own", "visitors"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            for dims, block, side, at, cells in places(b.column(0).to_pylist()):
                fixed = [pa.array(np.full(len(at), x, np.int32)) for x in (dims, block, side)]
                yield pa.RecordBatch.from_arrays([*fixed[:2], pa.array(cells), fixed[2], *(b.column(i).take(pa.array(at)) for i in (1, 2, 0))], ["dims", "block", "cell", "side", "cid", "copies", "raw"])

    spot = ["dims", "block", "cell"]
    counts = classes.select("raw").mapInArrow(occupied, "dims int, block int, cell long, own long, visitors long").groupBy(*spot).agg(F.sum("own").alias("own"), F.sum("visitors").alias("visitors"))
    counts = materialize(counts.where("own > 0"), "cells")
    chunks = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    large = counts.where(F.col("own") + F.col("visitors") > TILE).select(*spot, chunks("own").alias("n_own"), chunks("visitors").alias("n_visitors"))
    n_large, dealt_rows = large.count(), counts.agg(F.coalesce(F.sum(F.col("own") + F.col("visitors")), F.lit(0))).first()[0]
    dealt = classes.select("raw", "cid", "copies").mapInArrow(deal, "dims int, block int, cell long, side int, cid binary, copies long, raw binary")
    tile = lambda kind_, i, j, side: F.struct(F.lit(kind_).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    zero = F.lit(0)
    if n_large:
        chunk = F.pmod(F.xxhash64("cid"), F.when(F.col("side") == 0, F.col("n_own")).otherwise(F.col("n_visitors"))).cast("int")
        upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
        own = F.concat(F.transform(upto(F.col("n_own")), lambda x: F.when(x >= chunk, tile(1, chunk, x, 0)).otherwise(tile(1, x, chunk, 1))), F.transform(upto(F.col("n_visitors")), lambda x: tile(2, chunk, x, 0)))
        visiting = F.transform(upto(F.col("n_own")), lambda x: tile(2, x, chunk, 1))
        small = F.array(F.when(F.col("side") == 0, tile(0, zero, zero, 0)).otherwise(tile(0, zero, zero, 1)))
        meet = F.when(F.col("n_own").isNull(), small).when(F.col("side") == 0, own).otherwise(visiting)
        dealt = dealt.join(bounded_broadcast(large, n_large, 32), spot, "left").select(*spot, "cid", "copies", "raw", F.explode(meet).alias("t")).select(*spot, "t.*", "cid", "copies", "raw")
    else:
        dealt = dealt.select(*spot, zero.alias("kind"), zero.alias("i"), zero.alias("j"), "side", "cid", "copies", "raw")
    calls = max(partitions_for(spark), dealt_rows // CALL_ROWS)
    names = [*spot, "kind", "i", "j"]
    dealt = dealt.withColumn("call", F.pmod(F.xxhash64(*names), F.lit(calls)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*names, "side", "cid")])
        where = np.array([table.column(c).to_numpy() for c in names])
        edges = np.flatnonzero(np.concatenate(([True], (where[:, 1:] != where[:, :-1]).any(axis=0), [True])))
        ids, copies, raw = table.column("cid").combine_chunks(), table.column("copies").to_numpy(), table.column("raw").to_pylist()
        visiting = table.column("side").to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
            dims, block, _, kind_, i, j = where[:, p].tolist()
            own = q - p - int(visiting[p:q].sum())
            u = unit(raw[p : p + own]) if own else np.zeros((0, dims))
            sides = [(u, p, True)] if kind_ == 0 or kind_ == 1 and i == j else []
            if own and own < q - p:
                sides.append((unit(raw[p + own : q]), p + own, False))
            for v, begin, same in sides:
                a, b = _near(u, v, same, dims, block, threshold)
                found.append((a + p, b + begin))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        at, where_ = np.unique(np.concatenate((a, b)), return_inverse=True)
        a_, b_ = where_[: len(a)], where_[len(a) :]
        links = np.bincount(a_, copies[b], len(at)) + np.bincount(b_, copies[a], len(at))
        label = smallest_reachable(len(at), a_, b_)
        return pa.table([ids.take(pa.array(at)), pa.array(links.astype(np.int64)), ids.take(pa.array(at[label]))], ["cid", "links", "near"])

    found = materialize(dealt.groupBy("call").applyInArrow(compare, "cid binary, links long, near binary"), "links", free=True)
    linked = connected_components(found.select(F.col("cid").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "cid")
    of = classes.select("cid", "copies", "vec_id").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    of = materialize(of, "components")
    least = of.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = split_join(of, least, "component", n_classes, n_classes, 64)
    of = of.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").select("cid", "component_id", F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = split_join(rows.select("vec_id", "cid"), of, "cid", n_rows, n_classes, 64, how="left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _near(u: np.ndarray, v: np.ndarray, same: bool, dims: int, block: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linking pairs that this block is the first to find; of a side with itself each pair once."""
    own, budgets, rotation = _blocks(dims), _budgets(dims, threshold), _rotation(dims)
    ru, rv = u @ rotation, v @ rotation
    bu, bv = ru[:, own[block]].astype(np.float32), rv[:, own[block]].astype(np.float32)
    nu, nv = (bu * bu).sum(axis=1), (bv * bv).sum(axis=1)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(u), _STEP):
        from_ = a if same else 0
        reach = bu[a : a + _STEP] @ bv[from_:].T
        reach -= nv[from_:] / 2
        i, j = np.nonzero(reach >= ((nu[a : a + _STEP] - np.float32(budgets[block] + 1e-5)) / 2)[:, None])
        i, j = i + a, j + from_
        keep = i < j if same else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        for p in range(0, len(i), 65536):
            x, y = i[p : p + 65536], j[p : p + 65536]
            close = np.einsum("ij,ij->i", u[x], v[y]) >= threshold
            x, y = x[close], y[close]
            gap = (ru[x] - rv[y]) ** 2
            first = np.argmax(np.array([gap[:, o].sum(axis=1) <= limit for o, limit in zip(own, budgets)]), axis=0) if len(x) else x
            found_i.append(x[first == block])
            found_j.append(y[first == block])
    return np.concatenate(found_i), np.concatenate(found_j)


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLES: dict[str, str] = {}
