"""Columns derived from a read record, each defined once.

A read has name, flags, ref_idx, contig, start, mapq, cigar, mate_ref, mate_start, isize, bases, quals (array<int>) and tags
(map<string, struct<type:string, text:string>>). Positions count from 1 and are closed; 0, -1 and 255 stand for no start, no
reference and no mapping quality.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusframe.operators import cigar as cg

# Flag bits and sentinels of the record format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST, SECOND, SECONDARY, VENDOR_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
NO_START, NO_REFERENCE, NO_MAPQ = 0, -1, 255

SCHEMA = "name string, flags int, ref_idx int, contig string, start int, mapq int, cigar string, mate_ref int, mate_start int, isize int, bases string, quals array<int>, tags map<string,struct<type:string,text:string>>"


def flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def is_paired() -> Column:
    return flag(PAIRED)


def is_unmapped() -> Column:
    return flag(UNMAPPED) | (F.col("ref_idx") == NO_REFERENCE) | (F.col("start") == NO_START)


def mate_is_unmapped() -> Column:
    return flag(MATE_UNMAPPED) | (F.col("mate_ref") == NO_REFERENCE) | (F.col("mate_start") == NO_START)


def is_reverse() -> Column:
    return flag(REVERSE)


def read_length() -> Column:
    return F.length("bases")


def end() -> Column:
    """Last reference position; one before the start for an empty cigar."""
    return F.col("start") + cg.reference_length() - 1


def soft_start() -> Column:
    """The start, moved left by the soft clips before the first aligned base."""
    return F.col("start") - cg.length_of("S", F.regexp_extract("cigar", r"^([0-9]+[SH])*", 0))


def soft_end() -> Column:
    return end() + cg.length_of("S", F.regexp_extract("cigar", r"([0-9]+[SH])*$", 0))


def unclipped_start() -> Column:
    return F.col("start") - cg.leading("SH")


def unclipped_end() -> Column:
    return end() + cg.trailing("SH")


def has_well_defined_fragment(last: Column | None = None) -> Column:
    """Paired, both mapped, on opposite strands, a fragment length, and pointing at each other. last: end(), where it is known."""
    facing = F.when(is_reverse(), (end() if last is None else last) > F.col("mate_start")).otherwise(F.col("start") <= F.col("mate_start") + F.col("isize"))
    return (F.col("isize") != 0) & is_paired() & ~is_unmapped() & ~mate_is_unmapped() & (is_reverse() != flag(MATE_REVERSE)) & facing


def adaptor_boundary(last: Column | None = None) -> Column:
    """First position within the adaptor; null if the fragment isn't well defined."""
    return F.when(has_well_defined_fragment(last), F.when(is_reverse(), F.col("mate_start") - 1).otherwise(F.col("start") + F.abs("isize")))


def inside_adaptor(position: Column, boundary: Column | None = None) -> Column:
    """boundary: adaptor_boundary() as a column, where many positions of a read are asked."""
    boundary = adaptor_boundary() if boundary is None else boundary
    return F.coalesce((F.col("isize") <= 100) & F.when(is_reverse(), position <= boundary).otherwise(position >= boundary), F.lit(False))


def tag(name: str) -> Column:
    """Text of a tag, null if absent."""
    return F.col("tags")[name]["text"]


def tag_type(name: str) -> Column:
    return F.col("tags")[name]["type"]


def byte_tag(name: str) -> Column:
    """array<int> of a byte-array tag (comma list) or of a text tag's characters; null if absent or of another type."""
    text, kind = tag(name), tag_type(name)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("int"))
    return F.when(kind == "B", F.when(text == "", F.array().cast("array<int>")).otherwise(F.split(text, ",").cast("array<int>"))).when(kind == "Z", codes)


def insertion_qualities(name: str = "BI") -> Column:
    """Indel qualities of a tag (characters from `!`), or 45 for every base where it is absent."""
    codes = F.transform(F.filter(F.split(tag(name), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("int") - 33)
    return F.coalesce(codes, F.array_repeat(F.lit(45), F.length("bases")))


def offset_at(position: Column) -> Column:
    """Offset in the read, from 0, of the base at a reference position; soft clips count as aligned from the soft start. Null outside
    the read and within deletions and skips.
    """
    steps = F.filter(cg.walk(), lambda e: ~e["op"].isin("H", "P", "I"))
    lead = cg.length_of("S", F.regexp_extract("cigar", r"^([0-9]+[SH])*", 0))

    def first(e: Column) -> Column:
        clip = e["op"] == "S"
        return F.col("start") + F.when(clip & (e["ref"] == 0), -lead + e["offset"]).otherwise(e["ref"])

    covers = F.filter(steps, lambda e: (first(e) <= position) & (position < first(e) + e["len"]))
    hit = F.get(covers, F.lit(0))
    return F.when(hit["op"].isin("D", "N"), F.lit(None)).otherwise(hit["offset"] + position - first(hit))


def base_at(position: Column) -> Column:
    return F.substr("bases", offset_at(position) + 1, F.lit(1))


def quality_at(position: Column) -> Column:
    return F.get("quals", offset_at(position))


def rebuilt_flags() -> Column:
    """Flags from the derived columns: what an unpaired read cannot carry is cleared, and unmapped follows from all three criteria."""
    pair_only = PROPER | MATE_UNMAPPED | MATE_REVERSE | FIRST | SECOND
    kept = F.when(is_paired(), F.col("flags")).otherwise(F.col("flags").bitwiseAND(~pair_only & 0xFFFF))
    return F.when(is_unmapped(), kept.bitwiseOR(UNMAPPED)).otherwise(kept)


def complement(bases: Column | str) -> Column:
    return F.translate(bases, "ACGTacgt", "TGCAtgca")


def reverse_complement(bases: Column | str) -> Column:
    return F.reverse(complement(bases))
