"""Benchmark decontamination: windows of benchmark words looked up in documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import documents, slices

#: Benchmark texts of up to so many bytes in all are broadcast as window sets; larger ones are joined by shuffle. An index takes about ten times the texts'
#: bytes, at most some 200 MB.
INDEX_BYTES = 16 << 20
NONE = hashlib.sha256(b"").hexdigest()

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() and not 0x41 <= c <= 0x5A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: The same words, for the engine's regular expressions.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, A-Z in lower case, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out *= _MIX
        out += ids[i : i + len(out)]
    return (out ^ (out >> np.uint64(29))) * _MIX


class _Windows:
    """The windows of one length: sorted hashes, where each stands in the stream of all items' words, and the items that hold it.

    A table of bits rules most document positions out. A window is found by its hash and then compared word by word, so a hit is exact.
    """

    def __init__(self, stream: np.ndarray, n: int, at: np.ndarray, item: np.ndarray):
        self.stream, self.n = stream, n
        h = _window_hashes(stream.astype(np.uint64), n)[at]
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        lead = np.repeat(at[first], np.diff(np.append(first, len(h))))
        same = np.concatenate([self._equal(at[p : p + 100_000], stream, lead[p : p + 100_000]) for p in range(0, len(at), 100_000)])
        self.odd: dict[tuple[int, ...], set[int]] = {}  # windows whose hash is another's
        for p in np.flatnonzero(~same).tolist():
            self.odd.setdefault(tuple(stream[at[p] : at[p] + n].tolist()), set()).add(int(item[p]))
        h, at, item = h[same], at[same], item[same]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        fresh = new | np.concatenate(([True], item[1:] != item[:-1]))  # an item that repeats a window counts once
        self.hashes, self.at = h[new], at[new]
        self.items, self.first = item[fresh], np.append(np.flatnonzero(new[fresh]), int(fresh.sum()))
        bits = max(16, (16 * len(self.hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.hashes >> self.shift).astype(np.int64)] = True

    def _equal(self, at: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
        step = np.arange(self.n)
        return (self.stream[at[:, None] + step] == other[there[:, None] + step]).all(axis=1)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Positions of windows in ids, and the items that hold them."""
        h = _window_hashes(ids, self.n)
        spot = np.flatnonzero(self.filter[(h >> self.shift).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[spot]), len(self.hashes) - 1)
        near = self.hashes[k] == h[spot]
        spot, k = spot[near], k[near]
        hit = self._equal(self.at[k], ids, spot)
        items = {x for w in np.unique(k[hit]).tolist() for x in self.items[self.first[w] : self.first[w + 1]].tolist()}
        for i in spot[~hit].tolist() if self.odd else ():
            if held := self.odd.get(tuple(ids[i : i + self.n].tolist())):
                hit[np.searchsorted(spot, i)] = True
                items |= held
        return spot[hit], items


class WindowIndex:
    """Windows of all items by length. Words of the benchmark get numbers from 1; any other word is 0."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        streams, held, begin = [], defaultdict(list), 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            streams.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.uint32, len(words)))
            n = min(size, len(words))
            at = begin + np.arange(len(words) - n + 1)
            held[n].append((at, np.full(len(at), names.setdefault(item, len(names)), np.int32)))
            begin += len(words)
        stream = np.concatenate([np.zeros(0, np.uint32), *streams])
        self.names = list(names)
        self.windows = [_Windows(stream, n, *(np.concatenate(x) for x in zip(*parts))) for n, parts in sorted(held.items())]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the ids of the items found."""
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))
        edges, items = np.zeros(len(words) + 1, np.int64), set()
        for w in self.windows:
            if len(ids) >= w.n:
                spot, found = w.find(ids)
                np.add.at(edges, spot, 1)
                np.add.at(edges, spot + w.n, -1)
                items |= found
        return np.cumsum(edges[:-1]) > 0, {self.names[i] for i in items}


def _small_index(benchmark: DataFrame, size: int, limit: int) -> WindowIndex | None:
    """None if the benchmark's texts exceed limit bytes."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return WindowIndex([tuple(r) for r in benchmark.select("item_id", "text").toLocalIterator()], size) if total <= limit else None


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (any columns, text among them) with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window is size consecutive words of an item, or a shorter item as a whole. A document word inside any
    occurrence of a window is hit. Null or wordless texts have no words and no hits; an item without words has
    no windows; repeated items count once; an item without an id hits words but is not counted or named.
    Columns of docs that clash with the results are replaced. An empty benchmark leaves every document clean.
    The window set is broadcast while the benchmark is within index_bytes; a larger one is joined by shuffle.
    """
    kept = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    index = _small_index(benchmark, size, index_bytes)
    if index is None:
        return _contamination_by_join(kept, benchmark, size)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    text_at = kept.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            rows = []
            for text in batch.column(text_at):
                words = words_of(text.as_py())
                hit, items = index.scan(words)
                names = sorted(x for x in items if x is not None)
                n = int(hit.sum())
                rows.append((len(words), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest() if names else NONE, n > 0))
            n_words, n_hit, n_items, sha, bad = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())], [*batch.schema.names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"])
    return kept.mapInArrow(scan, schema)


def _found_by_join(texts: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(sha, at, n, item_id) of windows in texts (sha, w), for a benchmark of any size: windows of both sides meet by hash and are compared as text."""

    def windows(words: str, n: str) -> str:
        return f"transform(sequence(1, size({words}) - {n} + 1), i -> named_struct('at', i - 1, 'n', {n}, 'win', array_join(slice({words}, i, {n}), ' ')))"

    items = benchmark.select("item_id", _words("text").alias("w")).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(size)))
    items = items.select("item_id", F.explode(F.expr(windows("w", "n"))).alias("x")).select("item_id", "x.n", "x.win").distinct()
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # size values at most
    hashed = items.select("item_id", "n", "win", F.xxhash64("win").alias("h"))
    found = texts.select("sha", F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("item_id")).where("false")
    for n in lengths:
        spot = texts.where(F.size("w") >= n).select("sha", F.explode(F.expr(windows("w", str(n)))).alias("x"))
        found = found.union(spot.select("sha", "x.at", "x.n", "x.win", F.xxhash64("x.win").alias("h")).join(hashed, ["h", "n", "win"]).select("sha", "at", "n", "item_id"))
    return found


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _contamination_by_join(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Results depend on the text alone, so documents are joined to them by a digest of the text."""
    texts = docs.select("text").where("text is not null").distinct().select(F.sha2("text", 256).alias("sha"), _words("text").alias("w"))
    found = _found_by_join(texts, benchmark, size)
    hit = found.select("sha", F.explode(F.expr("sequence(at, at + n - 1)")).alias("p")).distinct().groupBy("sha").agg(F.count("p").alias("n_hit"))
    names = found.where("item_id is not null").select("sha", "item_id").distinct().groupBy("sha").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    words = texts.select("sha", F.size("w").cast("long").alias("n_words"))
    return (
        docs.withColumn("sha", F.sha2("text", 256)).join(words, "sha", "left").join(hit, "sha", "left").join(names, "sha", "left")
        .select(*docs.columns, F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (text, others) without contaminated documents, in docs' own columns. Null and wordless texts stay; an empty benchmark drops nothing.

    The window set is broadcast while the benchmark is within index_bytes; a larger one is joined by shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    index = _small_index(items, size, index_bytes)
    if index is None:
        found = _contamination_by_join(docs.select(F.struct(*docs.columns).alias("__in"), "text"), items, size)
        return found.where("not contaminated").select("__in.*")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([not shared.value.scan(words_of(t.as_py()))[0].any() for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with every hit run of words, and what stands between them, cut from the text; a text left wordless is empty, a null text stays null.

    The window set is broadcast while the benchmark is within index_bytes; a larger one is joined by shuffle.
    """
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    index = _small_index(benchmark, size, index_bytes)
    at, names = docs.columns.index("text"), docs.columns
    if index is not None:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = pa.array([_cut(t.as_py(), lambda words: shared.value.scan(words)[0]) for t in batch.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], names)

        return docs.mapInArrow(cut, docs.schema)
    texts = docs.select("text").where("text is not null").distinct().select(F.sha2("text", 256).alias("sha"), _words("text").alias("w"))
    spans = _found_by_join(texts, benchmark, size).groupBy("sha").agg(F.collect_set(F.struct("at", "n")).alias("__spans")).withColumnRenamed("sha", "__sha")
    joined = docs.withColumn("__sha", F.sha2("text", 256)).join(spans, "__sha", "left").select(*names, "__spans")

    def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column(len(names)).to_pylist()
            out = [t.as_py() if s is None else _cut(t.as_py(), lambda words, s=s: _covered(len(words), s)) for t, s in zip(batch.column(at), found)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])], names)

    return joined.mapInArrow(cut_spans, docs.schema)


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    hit = np.zeros(n, bool)
    for s in spans:
        hit[s["at"] : s["at"] + s["n"]] = True
    return hit


def _cut(text: str | None, hits: Callable[[list[bytes]], np.ndarray]) -> str | None:
    words = words_of(text)
    hit = hits(words)
    if not hit.any():
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat, pos, where = raw.translate(_TO_WORDS), 0, []
    for w in words:
        pos = flat.index(w, pos)
        where.append((pos, pos := pos + len(w)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    out, last = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(raw[last : where[a][0]])
        last = where[b - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return contamination(docs, documents(spark, sf_dir, "benchmark")).drop("text")


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as win from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)),
dw as (select rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select rid, i, dw.n, item_id from dw join bw using (n, win)),
hw as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as p from h) group by rid),
hi as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from h where item_id is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (rid) left join hi using (rid)
"""
QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": ORACLE_SQL}
