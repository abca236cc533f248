"""Line dedup: segment-partition edit join.

A line within t edits of another contains one of the other's t + 1 segments, shifted by no more than the edits allow. So each
line is cut into t + 1 segments, and for each length up to t below its own it is probed with the substrings that may equal a segment of a line
of that length. Lines that share a (length, edits, segment, substring) key are candidates; a banded bit-parallel edit distance verifies them.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm import common
from locusframe.llm.common import bounded_broadcast, documents, materialize, slices, split_join
from locusframe.llm.components import connected_components, key_groups, spanning_links, spread

EDITS = 2
#: An edit is allowed for every so many code points of the longer line, up to EDITS of them.
EDIT_CHARS = 10
#: The engine's expression for a line that isn't blank; the characters that Python's strip() removes.
NOT_BLANK = r"[^\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: A task remembers so many lines whose keys it has given; it may give those of others again, which changes nothing.
_REMEMBERED = 200_000


def lines_of(text: str | None) -> list[str]:
    """The lines of a text, apart at \\n, without white space at their ends; null has none."""
    return [x.strip() for x in text.split("\n")] if text is not None else []


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line, the longer ones last."""
    k, long = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = k + (i > edits - long)
        out.append((at, n))
        at += n
    return out


def edits_for(length: int, edits: int = EDITS) -> int:
    """Edits allowed between a line of so many code points and one that is no longer."""
    return min(edits, length // EDIT_CHARS)


@lru_cache(100_000)
def _places(n: int, edits: int) -> list[tuple[int, int, int]]:
    """(start, end, seed) of the substrings under which a line of n code points is stored or sought; the seed tells length, edits and segment."""
    out = set()
    own = edits_for(n, edits)
    for less in range(own + 1 if own else 0):
        for i, (start, size) in enumerate(segments(n - less, own)):
            low = max(0, start - i, start + less - (own - i))
            high = min(n - size, start + i, start + less + (own - i))
            out |= {(at, at + size, ((n - less) * (edits + 1) + own) * (edits + 1) + i) for at in range(low, high + 1)}
    for more in range(1, edits + 1):  # what a longer line, to which more edits are allowed, seeks
        if own < (t := edits_for(n + more, edits)) >= more:
            out |= {(at, at + size, (n * (edits + 1) + t) * (edits + 1) + i) for i, (at, size) in enumerate(segments(n, t))}
    return list(out)


def line_keys(line: str, edits: int = EDITS) -> list[int]:
    """Unsigned hashes of (length, edits, segment, substring) under which the line is stored or sought."""
    raw = line.encode("utf-8", "surrogatepass")
    if len(raw) == len(line):
        return [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b, seed in _places(len(line), edits)]
    return [xxhash.xxh3_64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in _places(len(line), edits)]


def _digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _short(line_id: bytes) -> int:
    return int.from_bytes(line_id[:8], "big", signed=True)


def within_edits(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance, by code points, is at most edits.

    Common ends are trimmed. Then bits of a band of 2 * edits + 1 diagonals hold the vertical differences of the distance
    matrix; the score runs down the band's last diagonal and is given up once it can't come back under the threshold.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    n = len(os.path.commonprefix((a, b)))
    a, b = a[n:], b[n:]
    n = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or len(b) <= edits:
        return len(b) <= edits
    return _band(a, b, edits)  # a is the shorter one


def _band(short: str, long: str, edits: int) -> bool:
    """Bit-parallel edit distance by columns of the shorter string, on a band of rows that moves down with them.

    Bit k of a word stands for row column + k + 1 + edits - width. Words hold where the distance rises or falls from one row to
    the next; from them follow the diagonals without a step and the rises and falls from one column to the next.
    """
    width = 2 * edits + 2
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    rows: dict[str, int] = {}
    for i, c in enumerate(long):
        rows[c] = rows.get(c, 0) | 1 << (i + width - edits - 1)
    rise, fall = mask ^ ((1 << (width - edits - 1)) - 1), 0
    score, beyond, turn = edits, 2 * edits + len(short) - len(long), len(long) - edits
    level = bottom >> 1
    for j, c in enumerate(short):
        same = (rows.get(c, 0) >> j) & mask
        flat = ((((same & rise) + rise) ^ rise) | same | fall) & mask
        right_rise, right_fall = (fall | ~(flat | rise)) & mask, flat & rise
        if j < turn:  # down the band's last diagonal
            score += not flat & bottom
        else:  # along the last row, which moves up the band
            score += bool(right_rise & level) - bool(right_fall & level)
            level >>= 1
        if score > beyond:
            return False
        flat >>= 1
        rise, fall = (right_fall | ~(flat | right_rise)) & mask, flat & right_rise
    return score <= edits


def line_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, line_id, id): one row for each line that isn't blank; line_id is a digest of the line, id a part of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, numbers, lines = [], [], []
            for i, text in enumerate(b.column(2)):
                for no, line in enumerate(lines_of(text.as_py())):
                    if line:
                        at.append(i)
                        numbers.append(no)
                        lines.append(_digest(line))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(lines, pa.binary()), pa.array(map(_short, lines), pa.int64())], ["doc_id", "mark", "line_no", "line_id", "id"])

    return docs.mapInArrow(scan, "doc_id long, mark long, line_no int, line_id binary, id long")


def _keys(docs: DataFrame, edits: int) -> DataFrame:
    """(key, id) of the lines of docs (text); recomputed where it is used twice, since it is larger than the texts."""

    def table(ids: list[int], counts: list[int], keys: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), counts))], ["key", "id"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for b in slices(batches):
            ids: list[int] = []
            counts: list[int] = []
            keys: list[int] = []
            for text in b.column(0):
                for line in lines_of(text.as_py()):
                    if len(line) + edits < EDIT_CHARS or (h := _digest(line)) in given:
                        continue
                    if len(given) < _REMEMBERED:
                        given.add(h)
                    found = line_keys(line, edits)
                    keys += found
                    ids.append(_short(h))
                    counts.append(len(found))
                if len(keys) > 200_000:
                    yield table(ids, counts, keys)
                    ids, counts, keys = [], [], []
            yield table(ids, counts, keys)

    return docs.mapInArrow(scan, "key long, id long")


def _line_texts(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lines = list({x for t in b.column(0) for x in lines_of(t.as_py()) if x})
            marks = [_digest(x) for x in lines]
            raw = [x.encode("utf-8", "surrogatepass") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(map(_short, marks), pa.int64()), pa.array(map(len, lines), pa.int64()), pa.array(raw, pa.binary())], ["line_id", "id", "size", "data"])

    return docs.mapInArrow(scan, "line_id binary, id long, size long, data binary")


def _linked(a: str, b: str, edits: int) -> bool:
    return within_edits(a, b, edits_for(max(len(a), len(b)), edits))


def _links(sizes: list[int], data: list[bytes], side: np.ndarray | None, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all lines of a tile that link."""
    lines, size = [d.decode("utf-8", "surrogatepass") for d in data], np.array(sizes, np.int64)

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        rest = rest[np.abs(size[rest] - size[x]) <= edits]
        return rest[np.array([_linked(lines[x], lines[y], edits) for y in rest.tolist()], bool)]

    return spread(size, side, near)


def line_decisions(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, mark, line_no, line_id, class_id, kept) for every line of docs (doc_id, text, others) that isn't blank, mark a hash of the text.

    Lines are compared without white space at their ends, however long. Two lines link if their edit distance is within edits_for() the longer one;
    class_id is the smallest line_id reachable. The first line of a class in order of (doc_id, mark, line_no) is kept, in
    each row of a repeated document. Null texts and rows with a null doc_id give no lines; an empty table gives an empty one; other columns of
    docs are ignored. Lines are told apart by 128-bit hashes.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    lines = materialize(line_occurrences(docs), "lines")
    found = key_groups(_keys(docs.select("text"), edits))
    ids = materialize(found.ids(), "candidates")
    n_ids = ids.count()
    ids = bounded_broadcast(ids, n_ids, 16)
    wanted = lines.join(ids, "id", "left_semi").groupBy("line_id").agg(F.min(F.struct("doc_id", "mark")).alias("at")).select("at.*").distinct()
    texts = docs.join(bounded_broadcast(materialize(wanted, "wanted"), n_ids, 32), ["doc_id", "mark"], "left_semi").select("text")
    data = materialize(_line_texts(texts).join(ids, "id", "left_semi").groupBy("line_id").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.first("data").alias("data")), "texts")
    a, b = (data.select(F.col("id").alias(x), F.col("line_id").alias(f"l{x}"), F.col("data").alias(f"d{x}")) for x in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = ([d.decode("utf-8", "surrogatepass") for d in t.column(c).to_pylist()] for c in ("da", "db"))
            ok = pa.array([_linked(p, q, edits) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("la").filter(ok), t.column("lb").filter(ok)], ["a", "b"])

    pairs = found.pairs.join(a, "a").join(b, "b").select("la", "da", "lb", "db").mapInArrow(near, "a binary, b binary")
    members = found.members.join(data, "id").select("grp", F.col("line_id").alias("node"), "size", "data")
    links = spanning_links(members, F.floor(F.col("size") / (8 * (edits + 1))), lambda sizes, data, side: _links(sizes, data, side, edits), "binary")
    of = connected_components(pairs.union(links)).where("node <> component").select(F.col("node").alias("line_id"), F.col("component").alias("class_id"))
    of = materialize(of, "classes")
    n_of = of.count()
    # counts of rows are needed only where the table is too large to be broadcast
    of = of.withColumn("n", F.lit(1)) if n_of * 64 <= common.BROADCAST_BYTES else of.join(lines.groupBy("line_id").agg(F.count(F.lit(1)).alias("n")), "line_id")
    n_lines = lines.count()
    classed = split_join(lines.drop("id"), of, "line_id", n_lines, n_of, 64, how="left").withColumn("class_id", F.coalesce("class_id", "line_id"))
    first = classed.groupBy("class_id").agg(F.min(F.struct("doc_id", "mark", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    several = materialize(first.where("n > 1"), "several")
    out = split_join(classed, several, "class_id", n_lines, several.count(), 64, how="left")
    return out.select("doc_id", "mark", "line_no", "line_id", "class_id", F.coalesce(F.struct("doc_id", "mark", "line_no") == F.col("first"), F.lit(True)).alias("kept"))


def summary(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines) for every row of docs (doc_id, text, others): counts of lines that aren't blank, and the numbers,
    from 0, of the removed ones, joined by commas. A null text has no lines; of a row with a null doc_id lines are counted and none is removed.
    Repeated rows give repeated results.
    """
    dropped = line_decisions(docs, edits).where("not kept")
    removed = dropped.select("doc_id", "mark", "line_no").distinct().groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))), F.lit(0)).cast("long").alias("n_lines"))
    return counted.join(removed, ["doc_id", "mark"], "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"))


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs (doc_id, text, others) without the lines that line_decisions removes, in docs' own columns; rows with a null doc_id or text stay as they are."""
    dropped = line_decisions(docs, edits).where("not kept").select("doc_id", "mark", "line_no").distinct()
    removed = dropped.groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("__gone")).toDF("__id", "__mark", "__gone")
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__mark": F.xxhash64("text")}).join(removed, ["__id", "__mark"], "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return marked.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return summary(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES: dict[str, str] = {}
