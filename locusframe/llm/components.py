"""Connected components, and links among rows that share candidate keys, without pairs of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_broadcast, drop_table, materialize, partitions_for, split_join

#: A tile holds at most so many rows on a side, of so many bytes in all; larger groups are cut into chunks that meet in pairs.
TILE, TILE_BYTES = 2048, 16 << 20
#: So many links, of 32 bytes or so each, are joined in one task; more by rounds over written tables.
ONE_TASK_EDGES = 200_000
#: One call compares tiles of about so many rows and bytes.
CALL_ROWS, CALL_BYTES = 10_000, 12 << 20


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b) of any ordered type: the smallest node reachable.

    Up to ONE_TASK_EDGES links are joined in one task. More are joined by large-star and small-star steps in turn on written tables: each step is a
    grouped minimum, combined before its shuffle, and a join that spreads the rows of hot nodes; no neighbour list is ever gathered. Both
    ways give the same rows. An empty table gives an empty table; self-links, repeated links and links with a null end change nothing.
    """
    star = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    if star.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        node = star.schema["u"].dataType.simpleString()
        return star.coalesce(1).mapInArrow(_joined, f"node {node}, component {node}")
    seen = None
    for _ in range(max_rounds):
        mark = star.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if mark == seen:
            break
        seen, n = mark, mark["n"]
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = split_join(both, low, "u", 2 * n, 2 * n).where("v > u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        met = split_join(large, least, "v", n, n)
        small = met.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("u <> v").distinct()
        old, star = star, materialize(small, "star", free=True)
        drop_table(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = star.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("v").alias("node"), F.col("u").alias("component")).union(ends)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (v, u)."""
    tables = [pa.table(b.columns, ["v", "u"]) for b in batches if b.num_rows]
    if not tables:
        return
    ends = pa.concat_tables(tables)
    nodes = pc.unique(pa.chunked_array([*ends["v"].chunks, *ends["u"].chunks]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    label = smallest_reachable(len(nodes), *(pc.index_in(ends[c], nodes).to_numpy().astype(np.int64) for c in "vu"))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], ["node", "component"])


@dataclass
class KeyGroups:
    """Rows that share a key: as pairs (a, b) where a key has just two, else as members (grp, id) of the key."""

    pairs: DataFrame
    members: DataFrame

    def ids(self) -> DataFrame:
        ends = self.pairs.select(F.explode(F.array("a", "b")).alias("id"))
        return ends.union(self.members.select("id")).distinct()


def key_groups(keys: DataFrame) -> KeyGroups:
    """The groups of keys (key, id), which may repeat rows; keys of a single id are left out, keys with the same ids are given once.

    A first pass combines each key's count and ends, so most keys go before anything else is done; only the rows of keys with
    three or more ids are shuffled again.
    """
    found = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi"), "keys", free=True)
    pairs = found.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    many = found.where("n > 2").select("key", "n")
    keyed, size = many.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not keyed:
        return KeyGroups(pairs, pairs.select(F.col("a").alias("grp"), F.col("a").alias("id")).where("false"))
    members = materialize(split_join(keys, many, "key", size, keyed).select("key", "id").distinct(), "members", free=True)
    # two hashes of 64 bits tell sets of ids apart, added up in halves so that no sum overflows
    h, g = F.xxhash64("id"), F.xxhash64(F.lit(1), "id")
    halves = [x for y in (h, g) for x in (y.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(y, 32))]
    signed = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(halves)])
    once = signed.groupBy("n", "s0", "s1", "s2", "s3").agg(F.min("key").alias("key")).where("n > 1").select("key", "n")
    return KeyGroups(pairs, materialize(split_join(members, once, "key", size, keyed).select(F.col("key").alias("grp"), "id"), "groups"))


#: Rows on the left and, for pairs across two chunks, on the right, as (size, bytes); gives positions of links, enough to join all that link.
Linker = Callable[[list[int], list[bytes], "np.ndarray | None"], tuple[np.ndarray, np.ndarray]]


def spanning_links(members: DataFrame, band: Column, link: Linker, node: str) -> DataFrame:
    """Links (a, b), enough to join all rows of a group that link, among members (grp, node, size, data); node is the type of nodes.

    Rows link only within a band or with the next one. A group is one tile, or, if it has more than TILE rows or TILE_BYTES bytes,
    chunks by band, of which those that can link meet in pairs. link gets sizes, data and sides of a tile (no sides: all with all).
    """
    spark = members.sparkSession
    rows = members.select("grp", "node", F.col("size").cast("long").alias("size"), "data", band.cast("int").alias("band"))
    weight = (F.octet_length("data") + 32).cast("long")
    sums = materialize(rows.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes")), "bands")
    whole = sums.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    over = (F.col("n") > TILE) | (F.col("bytes") > TILE_BYTES)
    total = whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(over).alias("large")).first()
    large = whole.where(over).select("grp")
    none = [F.lit(None).cast("int").alias(c) for c in ("band_i", "i", "band_j", "j")]
    if total["large"]:
        chunks = F.ceil(F.greatest(F.col("n") / TILE, F.col("bytes") / TILE_BYTES)).cast("int")
        cut = materialize(sums.join(bounded_broadcast(large, total["large"], 16), "grp").select("grp", "band", chunks.alias("chunks")), "chunks")
        n_cut = cut.count()
        near = cut
        for name, step in (("before", -1), ("after", 1)):
            other = cut.select(F.col("grp").alias(f"g_{name}"), (F.col("band") - step).alias(f"b_{name}"), F.col("chunks").alias(name))
            near = near.join(other, (F.col("grp") == F.col(f"g_{name}")) & (F.col("band") == F.col(f"b_{name}")), "left").drop(f"g_{name}", f"b_{name}")
        near = materialize(near, "near")
        big = rows.join(bounded_broadcast(near, n_cut, 48), ["grp", "band"])
        mine = F.pmod(F.xxhash64("node"), "chunks").cast("int")
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        spot = lambda a, i, b, j, side: F.struct(a.alias("band_i"), i.alias("i"), b.alias("band_j"), j.alias("j"), F.lit(side).alias("side"))
        band_, chunk = F.col("band"), F.col("__chunk")
        meet = F.concat(
            F.transform(upto(F.col("chunks")), lambda x: F.when(x >= chunk, spot(band_, chunk, band_, x, 0)).otherwise(spot(band_, x, band_, chunk, 1))),
            F.transform(upto(F.coalesce("after", F.lit(0))), lambda x: spot(band_, chunk, band_ + 1, x, 0)),
            F.transform(upto(F.coalesce("before", F.lit(0))), lambda x: spot(band_ - 1, x, band_, chunk, 1)),
        )
        big = big.withColumn("__chunk", mine).withColumn("spot", F.explode(meet)).select("grp", "node", "size", "data", "spot.*")
        small = rows.join(bounded_broadcast(large, total["large"], 16), "grp", "left_anti").select("grp", "node", "size", "data", *none, F.lit(0).alias("side"))
        rows = small.unionByName(big)
    else:
        rows = rows.select("grp", "node", "size", "data", *none, F.lit(0).alias("side"))
    calls = max(partitions_for(spark), total["n"] // CALL_ROWS, total["bytes"] // CALL_BYTES)
    rows = rows.withColumn("call", F.pmod(F.xxhash64("grp", "band_i", "i", "band_j", "j"), F.lit(calls)))
    names = ["grp", "band_i", "i", "band_j", "j"]

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in (*names, "size")])
        where = np.array([table.column(c).fill_null(-(1 << 30)).to_numpy() for c in names])
        edge = np.flatnonzero(np.concatenate(([True], (where[:, 1:] != where[:, :-1]).any(axis=0), [True]))) if len(table) else np.zeros(1, np.int64)
        a, b = [], []
        for p, q in zip(edge[:-1].tolist(), edge[1:].tolist()):
            tile = table.slice(p, q - p)
            side = None if where[2, p] == where[4, p] and where[1, p] == where[3, p] else tile.column("side").to_numpy()
            x, y = link(tile.column("size").to_pylist(), tile.column("data").to_pylist(), side)
            a.append(x + p)
            b.append(y + p)
        nodes = table.column("node").combine_chunks()
        ends = [nodes.take(pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (a, b)]
        return pa.table(ends, ["a", "b"])

    return rows.groupBy("call").applyInArrow(compare, f"a {node}, b {node}")


def spread(size: np.ndarray, side: np.ndarray | None, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows that link, found from row to row: a row is compared only with rows that none has joined yet.

    near gives those of the given rows that link with a row. A group of rows that all link costs one comparison each.
    """
    left = np.ones(len(size), bool)
    a, b = [], []
    for seed in range(len(size)):
        front = [seed] if left[seed] else []
        left[seed] = False
        while front:
            x = front.pop()
            rest = np.flatnonzero(left if side is None else left & (side != side[x]))
            if not len(rest):
                continue
            found = near(x, rest)
            left[found] = False
            front += found.tolist()
            a.append(np.full(len(found), x))
            b.append(found)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 joined by edges a, b: the smallest node that each reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        least = label.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        np.minimum.at(least, label[a], low)
        np.minimum.at(least, label[b], low)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label
