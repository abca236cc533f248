"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import documents, materialize, partitions_for, split_join

SHARDS = 40
#: Bytes that each row takes besides its text.
ROW_BYTES = 16


class _Order:
    """Groups in order of falling size, as runs of equal size: prefix sums at any position, positions at any sum."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.sizes = sizes
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.before = np.concatenate(([0], np.cumsum(sizes * counts)))
        self.n, self.total = int(self.first[-1]), int(self.before[-1])

    def sum_at(self, pos: int) -> int:
        if pos >= self.n:
            return self.total
        run = int(np.searchsorted(self.first, pos, "right")) - 1
        return int(self.before[run]) + (pos - int(self.first[run])) * int(self.sizes[run])

    def last_within(self, most: int) -> int:
        """The largest position with at most so many bytes before it."""
        if most >= self.total:
            return self.n
        run = int(np.searchsorted(self.before, most, "right")) - 1
        return int(self.first[run]) + (most - int(self.before[run])) // int(self.sizes[run])


def cut_points(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, positions of the shards - 1 cuts) for groups in falling order of size.

    The capacity is found by binary search, each checked greedily. Within it the cuts stand as near to equal shares as
    can be, while what follows still fits.
    """
    order = _Order(sizes, counts)
    low, high = max(-(-order.total // shards), int(sizes[0]) if len(sizes) else 0), order.total
    while low < high:
        capacity, pos = (low + high) // 2, 0
        for _ in range(shards):
            pos = order.last_within(order.sum_at(pos) + capacity)
        low, high = (low, capacity) if pos >= order.n else (capacity + 1, high)
    latest = [order.n]  # where the last shards must begin at the earliest for the rest to fit
    for _ in range(shards - 1):
        pos = order.last_within(max(0, order.sum_at(latest[-1]) - low))
        latest.append(pos + (order.sum_at(latest[-1]) - order.sum_at(pos) > low))
    cuts, pos = [], 0
    for k in range(1, shards):
        here = order.sum_at(pos)
        goal = here + (order.total - here) // (shards - k + 1)
        near = order.last_within(goal)
        if near < order.n and order.sum_at(near + 1) - goal < goal - order.sum_at(near):
            near += 1
        pos = min(max(near, latest[shards - k], pos), order.last_within(here + low))
        cuts.append(pos)
    return low, cuts


def shard(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, others) with size, text_crc32, law, shard, slot and grown_shard.

    The law is `bytes`: with equal texts kept in one shard, the largest shard is as small as any cut of the groups, in order of
    falling size, allows. Null text has only row_bytes and goes with the empty text. Repeated rows each get a slot. A shard
    may be empty if there are fewer groups than shards; an empty table gives an empty table. slot counts a shard's rows
    from 0. Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*(c for c in own if keep_text or c != "text"), (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("__key"))
    groups = rows.groupBy("__key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    order = [F.desc("bytes"), F.col("__key")]
    ranged = groups.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("__key", "bytes", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "groups")
    # distinct sizes number at most the square root of twice the bytes; parts are as many as partitions
    runs = ranged.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("bytes")).toPandas()
    _, cuts = cut_points(runs["bytes"].to_numpy(np.int64), runs["groups"].to_numpy(np.int64), shards)
    offset, starts, n_rows = 0, {}, 0
    for part, n, held in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.count(F.lit(1)), F.sum("n")).collect()):
        starts[part], offset, n_rows = offset, offset + n, n_rows + held
    begin = F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv])[F.col("part")]
    at = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<int>")
    placed = ranged.withColumn("pos", begin + F.col("at")).select("__key", "n", F.size(F.filter(at, lambda c: c <= F.col("pos"))).alias("shard"))
    joined = split_join(rows, placed, "__key", n_rows, offset, 96).drop("__key")
    shard_at = joined.columns.index("shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            to = b.column(shard_at).to_numpy(zero_copy_only=False).astype(np.int64)
            by = np.argsort(to, kind="stable")
            counts = np.bincount(to, minlength=shards)
            slot = np.empty(len(to), np.int64)
            slot[by] = np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot += used[to]
            used += counts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot), pa.array(np.full(len(to), task, np.int64))], [*b.schema.names, "__slot", "__task"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema), "__slot long, __task long"])
    numbered = materialize(joined.mapInArrow(number, schema), "numbered")
    used = numbered.groupBy("shard", "__task").count().collect()  # tasks times shards
    ahead, offsets = [0] * shards, []
    for task, to, n in sorted((r["__task"], r["shard"], r["count"]) for r in used):
        offsets.append((task, to, ahead[to]))
        ahead[to] += n
    offsets = spark.createDataFrame(offsets, "__task long, shard int, __ahead long")
    return numbered.join(F.broadcast(offsets), ["__task", "shard"]).select(
        *(c for c in own if keep_text or c != "text"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__slot") + F.col("__ahead")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
