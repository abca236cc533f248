"""Cigar text as columns: elements, lengths, validity, and the walk along the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operators of a cigar, and which of them take read bases or reference positions.
READ_OPS = "MIS=X"
REFERENCE_OPS = "MDN=X"
_ELEMENT = r"([0-9]+)([MIDNSHP=X])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elements(cigar: Column | str = "cigar") -> Column:
    """array<struct<len:int,op:string>>; empty for `*`."""
    text = _col(cigar)
    return F.zip_with(F.regexp_extract_all(text, F.lit(_ELEMENT), F.lit(1)), F.regexp_extract_all(text, F.lit(_ELEMENT), F.lit(2)), lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))


def operators(cigar: Column | str = "cigar") -> Column:
    """The operators alone, as text."""
    return F.regexp_replace(F.regexp_replace(_col(cigar), r"[0-9]+", ""), r"\*", "")


def length_of(ops: str, cigar: Column | str = "cigar") -> Column:
    """Total length of the elements with one of ops."""
    numbers = F.regexp_extract_all(_col(cigar), F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(numbers, F.lit(0), lambda total, n: total + n.cast("int"))


def read_length(cigar: Column | str = "cigar") -> Column:
    return length_of(READ_OPS, cigar)


def reference_length(cigar: Column | str = "cigar") -> Column:
    return length_of(REFERENCE_OPS, cigar)


def total_length(cigar: Column | str = "cigar") -> Column:
    return length_of("MIDNSHP=X", cigar)


def is_valid(cigar: Column | str = "cigar") -> Column:
    """No structural error; an empty cigar is valid.

    No element is empty; hard clips stand at the ends, soft clips at the ends or within hard ones; two insertions or two deletions
    have an aligned, skipped or padded stretch between them; padding stands between real operators unless first; something is real.
    """
    ops = operators(cigar)
    bad = (
        _col(cigar).rlike(r"(^|[^0-9])0+[MIDNSHP=X]")
        | ops.rlike(r"^.+H.+$")
        | (ops.rlike(r"^[^H]S.") & ~ops.rlike(r"^.SH$"))
        | ops.rlike(r"^..+S([^H]|H.)")
        | ops.rlike(r"I[DSH]*I|D[ISH]*D")
        | ops.rlike(r"[^MIDN=X]P|.P([^MIDN=X]|$)")
        | ~ops.rlike(r"[MIDN=X]")
    )
    return (ops == "") | ~bad


def is_good(cigar: Column | str = "cigar") -> Column:
    """Valid, without neighbouring indels, and without a deletion at either end once clips are set aside."""
    ops = operators(cigar)
    return is_valid(cigar) & ~ops.rlike(r"[ID][ID]|^[SH]*D|D[SH]*$")


def soft_clip_blocks(cigar: Column | str = "cigar") -> Column:
    """Runs of neighbouring soft clips."""
    return F.size(F.regexp_extract_all(operators(cigar), F.lit(r"S+"), F.lit(0)))


def leading(ops: str, cigar: Column | str = "cigar") -> Column:
    """Total length of the elements before the first whose operator is not one of ops."""
    return length_of(ops, F.regexp_extract(_col(cigar), f"^([0-9]+[{ops}])*", 0))


def trailing(ops: str, cigar: Column | str = "cigar") -> Column:
    return length_of(ops, F.regexp_extract(_col(cigar), f"([0-9]+[{ops}])*$", 0))


def walk(cigar: Column | str = "cigar") -> Column:
    """array<struct<op, len, index, ref, offset>>: each element with the reference bases and read bases before it."""
    steps = elements(cigar)
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("offset"), F.array().cast("array<struct<op:string,len:int,index:int,ref:int,offset:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        here = F.struct(e["op"].alias("op"), e["len"].alias("len"), F.size(s["out"]).alias("index"), s["ref"].alias("ref"), s["offset"].alias("offset"))
        return F.struct(
            (s["ref"] + F.when(e["op"].isin(*REFERENCE_OPS), e["len"]).otherwise(0)).alias("ref"),
            (s["offset"] + F.when(e["op"].isin(*READ_OPS), e["len"]).otherwise(0)).alias("offset"),
            F.concat(s["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(steps, start, step, lambda s: s["out"])
