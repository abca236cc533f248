"""Clipping: reads with bases cut off, masked or marked as clipped, and cigars to match."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators import cigar as cg

WRITE_NS, WRITE_Q0S, WRITE_NS_Q0S, SOFTCLIP, HARDCLIP, REVERT_SOFT = "WRITE_NS", "WRITE_Q0S", "WRITE_NS_Q0S", "SOFTCLIP_BASES", "HARDCLIP_BASES", "REVERT_SOFTCLIPPED_BASES"
_ELEMENT = re.compile(r"([0-9]+)([MIDNSHP=X])")
Elements = list[tuple[int, str]]


def parse(cigar: str) -> Elements:
    return [(int(n), op) for n, op in _ELEMENT.findall(cigar or "")]


def text(elements: Elements) -> str:
    return "".join(f"{n}{op}" for n, op in elements) or "*"


def build(elements: Elements, remove_edge_deletions: bool = True) -> Elements:
    """Without empty elements, equal neighbours merged, a deletion moved before the insertion beside it, and no deletions at the ends.

    Raises ValueError where clips are not outside everything, hard ones outermost.
    """
    out: Elements = []
    for n, op in elements:
        if not n:
            continue
        if remove_edge_deletions and op == "D" and all(o in "SH" for _, o in out):
            continue
        if out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        elif op == "D" and out and out[-1][1] == "I":
            if len(out) > 1 and out[-2][1] == "D":
                out[-2] = (out[-2][0] + n, "D")
            else:
                out.insert(-1, (n, op))
        else:
            out.append((n, op))
    if remove_edge_deletions:
        last = next((i for i in range(len(out) - 1, -1, -1) if out[i][1] not in "SH"), None)
        while last is not None and last >= 0 and out[last][1] == "D":
            del out[last]
            last -= 1
    ops = "".join(op for _, op in out)
    if not re.fullmatch(r"H?S?[MIDNP=X]*S?H?", ops):
        raise ValueError(f"clips within {text(out)}")
    return out


def clip(elements: Elements, start: int, end: int, op: str) -> Elements:
    """The cigar with the read bases start to end (end exclusive, at one end of the read) turned into op; deletions within them vanish, and a hard
    clip takes the soft clips outside it along.
    """
    length = sum(n for n, o in elements if o in "MIS=X")
    left = start == 0
    out: Elements = []
    at, cut = 0, 0
    for n, o in elements:
        if o == "H":
            out.append((n, o))
            continue
        used = n if o in "MIS=X" else 0
        inside = max(0, min(at + used, end) - max(at, start)) if used else (n if (start < at < end or (left and at == 0 and end) or (not left and at == length and start < length)) and o in "DNP" else 0)
        if used:
            before = max(0, min(used, start - at))
            after = used - before - inside
            out += [(before, o), (inside, op), (after, o)]
            cut += inside
        elif not inside:
            out.append((n, o))
        at += used
    merged: Elements = []
    for n, o in out:
        if n and merged and merged[-1][1] == o:
            merged[-1] = (merged[-1][0] + n, o)
        elif n:
            merged.append((n, o))
    return build(merged)


def start_shift(elements: Elements, clipped: int) -> int:
    """Reference bases that lie before what is left once so many read bases are clipped from the front."""
    seen = shift = 0
    for n, op in elements:
        if op in "MIS=X":
            take = min(n, clipped - seen)
            if take <= 0:
                break
            seen += take
            shift += take if op in "M=X" else 0
            if seen == clipped and take < n:
                break
        elif op in "DN" and seen:
            shift += n
    return shift


def _rewrite(reads: DataFrame, bounds: Callable[[pd.DataFrame], list[tuple[int, int] | None]], how: str) -> DataFrame:
    """Applies one clip a read: bounds gives the read bases to clip, start and end exclusive, or None."""
    schema = reads.schema

    def run(batches):
        for pdf in batches:
            rows = []
            for row, span in zip(pdf.to_dict("records"), bounds(pdf)):
                row = {**row, "tags": dict(_pairs(row["tags"]))}
                rows.append(row if span is None or span[0] >= span[1] else _apply(row, *span, how))
            yield pd.DataFrame(rows, columns=pdf.columns)

    return reads.mapInPandas(run, schema)


def _apply(row: dict, start: int, end: int, how: str) -> dict:
    bases, quals = row["bases"], list(row["quals"])
    n = len(bases)
    if how in (WRITE_NS, WRITE_NS_Q0S):
        bases = bases[:start] + "N" * (end - start) + bases[end:]
    if how in (WRITE_Q0S, WRITE_NS_Q0S):
        quals[start:end] = [0] * (end - start)
    if how in (WRITE_NS, WRITE_Q0S, WRITE_NS_Q0S):
        return {**row, "bases": bases, "quals": quals}
    if start > 0 and end < n:
        raise ValueError("only an end of a read can be clipped")
    elements = parse(row["cigar"])
    if how == SOFTCLIP:
        if n <= 2:
            return row
        if start == 0 and end >= n - 1:  # the last two bases stay
            end = min(end, n - 2)
        elif end == n and start <= 1:
            start = max(start, 2)
        new, shift = clip(elements, start, end, "S"), start_shift(elements, end) if start == 0 else 0
        return {**row, "cigar": text(new), "start": row["start"] + shift}
    if start == 0 and end >= n:
        return {**row, "bases": "", "quals": [], "cigar": "*", "start": 0, "ref_idx": -1, "contig": None, "mapq": 0, "flags": int(row["flags"]) | 4, "tags": {k: v for k, v in _pairs(row["tags"]) if k == "RG"}}
    new, shift = clip(elements, start, end, "H"), start_shift(elements, end) if start == 0 else 0
    return {**row, "bases": bases[:start] + bases[end:], "quals": quals[:start] + quals[end:], "cigar": text(new), "start": row["start"] + shift}


def _pairs(tags) -> list:
    return list(tags.items()) if isinstance(tags, dict) else list(tags or [])


def low_quality_ends(reads: DataFrame, threshold: int = 2, how: str = HARDCLIP) -> DataFrame:
    """Both ends clipped up to the first and after the last base above the threshold; a read without one ends empty."""

    def right(pdf: pd.DataFrame):
        return [(next((i + 1 for i in range(len(q) - 1, -1, -1) if q[i] > threshold), 0), len(q)) for q in pdf["quals"]]

    def left(pdf: pd.DataFrame):
        return [(0, next((i for i, x in enumerate(q) if x > threshold), len(q))) for q in pdf["quals"]]

    return _rewrite(_rewrite(reads, right, how), left, how)


def by_read_coordinates(reads: DataFrame, start: int, end: int, how: str = HARDCLIP) -> DataFrame:
    """The bases start to end, both included, from 0."""
    return _rewrite(reads, lambda pdf: [(start, min(end + 1, len(b))) for b in pdf["bases"]], how)


def offset_of(elements: Elements, start: int, position: int) -> int | None:
    """Read offset of the first base at or after a reference position; None beyond the read."""
    at, offset = start, 0
    for n, op in elements:
        if op in "M=X":
            if position < at + n:
                return offset + max(0, position - at)
            at, offset = at + n, offset + n
        elif op in "DN":
            at += n
        elif op in "IS":
            offset += n
    return None


def to_region(reads: DataFrame, start: int, end: int, how: str = HARDCLIP) -> DataFrame:
    """What lies outside the reference span start to end clipped from both ends; a read wholly outside ends empty."""

    def tail(pdf: pd.DataFrame):
        out = []
        for cigar, at, bases in zip(pdf["cigar"], pdf["start"], pdf["bases"]):
            k = offset_of(parse(cigar), at, end + 1)
            out.append(None if k is None else (k, len(bases)))
        return out

    def head(pdf: pd.DataFrame):
        out = []
        for cigar, at, bases in zip(pdf["cigar"], pdf["start"], pdf["bases"]):
            k = offset_of(parse(cigar), at, start)
            out.append((0, len(bases) if k is None else k) if at < start and bases else None)
        return out

    return _rewrite(_rewrite(reads, tail, how), head, how)


def soft_clipped_bases(reads: DataFrame) -> DataFrame:
    """Soft clips cut off."""

    def right(pdf: pd.DataFrame):
        return [(len(b) - (parse(c)[-1][0] if parse(c) and parse(c)[-1][1] == "S" else 0), len(b)) for c, b in zip(pdf["cigar"].str.replace(r"[0-9]+H$", "", regex=True), pdf["bases"])]

    def left(pdf: pd.DataFrame):
        return [(0, parse(c)[0][0] if parse(c) and parse(c)[0][1] == "S" else 0) for c in pdf["cigar"].str.replace(r"^[0-9]+H", "", regex=True)]

    return _rewrite(_rewrite(reads, right, HARDCLIP), left, HARDCLIP)


def revert_soft_clips(reads: DataFrame) -> DataFrame:
    """Soft clips counted as aligned, the start moved back, but not before the contig: bases that would hang over are cut off."""
    lead = F.coalesce(F.regexp_extract("cigar", r"^(?:[0-9]+H)?([0-9]+)S", 1).try_cast("int"), F.lit(0))
    aligned = F.transform(cg.elements(), lambda e: F.struct(e["len"].alias("len"), F.when(e["op"] == "S", "M").otherwise(e["op"]).alias("op")))

    def joined(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        same = (F.size(done) > 0) & (last["op"] == e["op"])
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct((last["len"] + e["len"]).alias("len"), e["op"].alias("op"))))
        return F.when(same, longer).otherwise(F.concat(done, F.array(e)))

    new = F.array_join(F.transform(F.aggregate(aligned, F.array().cast("array<struct<len:int,op:string>>"), joined), lambda e: F.concat(e["len"].cast("string"), e["op"])), "")
    moved = reads.withColumns({"start": F.col("start") - lead, "cigar": F.when(F.col("cigar").contains("S"), new).otherwise(F.col("cigar"))})
    over = F.col("start") < 1
    return moved.where(~over).unionByName(_rewrite(moved.where(over), lambda pdf: [(0, 1 - s) for s in pdf["start"]], HARDCLIP))


def adaptor(reads: DataFrame) -> DataFrame:
    """Bases within the adaptor cut off: from the boundary on for forward reads, up to it for reverse ones."""
    from locusframe.operators import reads as rd

    marked = reads.withColumns({"__b": rd.adaptor_boundary(), "__r": rd.is_reverse()})

    def span(pdf: pd.DataFrame):
        out = []
        for cigar, at, bases, b, r in zip(pdf["cigar"], pdf["start"], pdf["bases"], pdf["__b"], pdf["__r"]):
            if pd.isna(b):
                out.append(None)
            elif r:
                k = offset_of(parse(cigar), at, int(b) + 1)
                out.append((0, len(bases) if k is None else k) if b >= at else None)
            else:
                k = offset_of(parse(cigar), at, int(b))
                out.append(None if k is None else (k, len(bases)))
        return out

    return _rewrite(marked, span, HARDCLIP).drop("__b", "__r")


def keep_from_quality(quals: Column, threshold: int) -> tuple[Column, Column]:
    """First and last place, from 0, of a quality above the threshold; null if there is none."""
    good = F.transform(quals, lambda q, i: F.when(q > threshold, i))
    held = F.filter(good, lambda i: i.isNotNull())
    return F.get(held, F.lit(0)), F.when(F.size(held) > 0, F.element_at(held, -1))
