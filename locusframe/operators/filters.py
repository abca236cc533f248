"""Named row predicates over reads, and counts of what each rejects.

A predicate is a boolean column: true keeps the read, false drops it, null is a refusal (the decision can't be made, as for a missing
read group). `strict` turns refusals into errors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators import cigar as cg
from locusframe.operators import reads as rd


@dataclass(frozen=True)
class Header:
    """Contigs in order with lengths, and read groups with their attributes; small, so they become literals of the plan."""

    contigs: tuple[tuple[str, int], ...] = ()
    read_groups: dict[str, dict[str, str]] = field(default_factory=dict)

    def attribute(self, key: str) -> Column:
        """An attribute of the read's group; null if there is no tag, no such group or no such attribute."""
        pairs = [F.lit(x) for group, attrs in self.read_groups.items() if key in attrs for x in (group, attrs[key])]
        return F.create_map(*pairs)[rd.tag("RG")] if pairs else F.lit(None).cast("string")

    def declares_group(self) -> Column:
        return F.coalesce(rd.tag("RG").isin(*self.read_groups), F.lit(False)) if self.read_groups else F.lit(False)


Filter = Callable[..., Column]
REGISTRY: dict[str, Filter] = {}


def register(f: Filter) -> Filter:
    REGISTRY["".join(p.capitalize() for p in f.__name__.split("_"))] = f
    return f


def _within(value: Column, low: int | None, high: int | None) -> Column:
    tests = [value >= low] if low is not None else []
    return reduce(Column.__and__, tests + ([value <= high] if high is not None else []), F.lit(True))


@register
def allow_all_reads() -> Column:
    return F.lit(True)


@register
def mapped() -> Column:
    return ~rd.is_unmapped()


@register
def mapping_quality_available() -> Column:
    return F.col("mapq") != rd.NO_MAPQ


@register
def mapping_quality_not_zero() -> Column:
    return F.col("mapq") != 0


@register
def not_duplicate() -> Column:
    return ~rd.flag(rd.DUPLICATE)


@register
def not_secondary_alignment() -> Column:
    return ~rd.flag(rd.SECONDARY)


@register
def not_supplementary_alignment() -> Column:
    return ~rd.flag(rd.SUPPLEMENTARY)


@register
def passes_vendor_quality_check() -> Column:
    return ~rd.flag(rd.VENDOR_FAIL)


@register
def paired() -> Column:
    return rd.is_paired()


@register
def not_properly_paired() -> Column:
    """Paired and not proper; not the negation of ProperlyPaired."""
    return rd.is_paired() & ~rd.flag(rd.PROPER)


@register
def properly_paired() -> Column:
    return rd.is_paired() & rd.flag(rd.PROPER)


@register
def first_of_pair() -> Column:
    return rd.is_paired() & rd.flag(rd.FIRST)


@register
def second_of_pair() -> Column:
    return rd.is_paired() & rd.flag(rd.SECOND)


@register
def non_zero_fragment_length() -> Column:
    return F.col("isize") != 0


@register
def matching_bases_and_quals() -> Column:
    return F.length("bases") == F.size("quals")


@register
def has_read_group() -> Column:
    """The tag is there, whether or not the header declares the group."""
    return rd.tag("RG").isNotNull()


@register
def mate_different_strand() -> Column:
    return rd.is_paired() & ~rd.is_unmapped() & ~rd.mate_is_unmapped() & (rd.is_reverse() != rd.flag(rd.MATE_REVERSE))


@register
def mate_on_same_contig_or_no_mapped_mate() -> Column:
    return ~rd.is_paired() | rd.mate_is_unmapped() | (~rd.is_unmapped() & (F.col("ref_idx") == F.col("mate_ref")))


@register
def cigar_contains_no_n_operator() -> Column:
    return ~F.col("cigar").contains("N")


@register
def good_cigar() -> Column:
    return cg.is_good()


@register
def non_zero_reference_length_alignment() -> Column:
    return F.col("cigar").rlike(r"(^|[A-Z=])0*[1-9][0-9]*[MDN=X]")


@register
def primary_line() -> Column:
    return ~rd.flag(rd.SECONDARY) & ~rd.flag(rd.SUPPLEMENTARY)


@register
def read_length_equals_cigar_length() -> Column:
    return rd.is_unmapped() | (rd.read_length() == cg.read_length())


@register
def seq_is_stored() -> Column:
    return rd.read_length() > 0


@register
def valid_alignment_start() -> Column:
    return rd.is_unmapped() | (F.col("start") > 0)


@register
def valid_alignment_end() -> Column:
    return rd.is_unmapped() | (rd.end() - F.col("start") + 1 >= 0)


@register
def mate_unmapped_and_unmapped() -> Column:
    """Keeps reads that are mapped and have no unmapped mate."""
    return ~(rd.is_unmapped() | (rd.is_paired() & rd.mate_is_unmapped()))


@register
def non_chimeric_original_alignment() -> Column:
    """The original contig equals the mate's original contig; kept if either tag is missing."""
    return F.coalesce(F.split(rd.tag("OA"), ",")[0] == rd.tag("XM"), F.lit(True))


@register
def mapping_quality(minimum: int = 10, maximum: int | None = None) -> Column:
    return _within(F.col("mapq"), minimum, maximum)


@register
def read_length(minimum: int = 1, maximum: int = 2**31 - 1) -> Column:
    return _within(rd.read_length(), minimum, maximum)


@register
def fragment_length(minimum: int = 0, maximum: int = 1_000_000) -> Column:
    """Unpaired reads are kept."""
    return ~rd.is_paired() | _within(F.abs("isize"), minimum, maximum)


@register
def mate_distant(threshold: int = 1000) -> Column:
    far = (F.abs(F.col("start") - F.col("mate_start")) >= threshold) | (F.col("ref_idx") != F.col("mate_ref"))
    return rd.is_paired() & ~rd.is_unmapped() & ~rd.mate_is_unmapped() & far


@register
def read_name(names: Sequence[str] = ()) -> Column:
    """For small sets; semi-join a table of names otherwise."""
    return F.col("name").isin(*names) if names else F.lit(False)


@register
def read_strand(keep_reverse: bool = False) -> Column:
    return rd.is_reverse() == F.lit(keep_reverse)


@register
def ambiguous_base(max_bases: int | None = None, max_fraction: float = 0.05) -> Column:
    """At most max_bases bases that are none of ACGTacgt*, or by default that share of the length, truncated."""
    odd = F.length(F.regexp_replace("bases", "[ACGTacgt*]", ""))
    return odd <= (F.lit(max_bases) if max_bases is not None else (rd.read_length() * F.lit(float(max_fraction))).cast("int"))


@register
def soft_clipped(ratio: float | None = None, leading_trailing: float | None = None) -> Column:
    """Soft clips at most such a share of all cigar lengths; or those at the ends alone. One of the two must be given."""
    if (ratio is None) == (leading_trailing is None):
        raise ValueError("one of ratio and leading_trailing must be given")
    total = cg.total_length()
    if ratio is not None:
        soft = cg.length_of("S")
    else:
        first = cg.length_of("S", F.regexp_extract("cigar", r"^[0-9]+S", 0))
        last = F.when(F.col("cigar").rlike(r"^[0-9]+[A-Z=]$"), 0).otherwise(cg.length_of("S", F.regexp_extract("cigar", r"[0-9]+S$", 0)))
        soft = first + last
    share = F.when(total != 0, soft / total).otherwise(F.lit(0.0))
    return share <= F.lit(float(ratio if ratio is not None else leading_trailing))


@register
def overclipped(min_aligned: int = 30, dont_require_both_ends: bool = False) -> Column:
    """Enough aligned bases, or fewer runs of soft clips than count as clipped."""
    return (cg.length_of("MI=X") >= min_aligned) | (cg.soft_clip_blocks() < (1 if dont_require_both_ends else 2))


@register
def excessive_end_clipped(max_clipped: int = 1000) -> Column:
    """Soft and hard clips of each end by itself."""
    return (cg.leading("SH") <= max_clipped) & (cg.trailing("SH") <= max_clipped)


@register
def read_group(keep: str = "") -> Column:
    """Refused without a read group."""
    return rd.tag("RG") == F.lit(keep)


@register
def not_optical_duplicate() -> Column:
    """Refused if the tag is no integer."""
    od = rd.tag("OD")
    return F.when(od.isNull(), F.lit(True)).otherwise(od.try_cast("int") == 0)


@register
def metrics(pf_reads_only: bool = False, aligned_reads_only: bool = False) -> Column:
    keep = ~rd.flag(rd.SECONDARY) & ~rd.flag(rd.SUPPLEMENTARY)
    if pf_reads_only:
        keep = keep & ~rd.flag(rd.VENDOR_FAIL)
    return keep & ~rd.is_unmapped() if aligned_reads_only else keep


@register
def read_tag_value(tag: str = "NM", operator: str = "EQUAL", value: float = 0.0) -> Column:
    """Compares a tag as a 32-bit float. Equality is by canonical bits: NaN equals NaN, and 0.0 does not equal -0.0. Absent tags are dropped,
    text that is no number is refused.
    """
    text = rd.tag(tag)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan|NaN|Infinity)$"), text.try_cast("float"))
    other = F.lit(float(value)).cast("float")
    same = number.cast("string") == other.cast("string")
    plain = ~F.isnan(number) & ~F.isnan(other)
    tests = {"LESS": plain & (number < other), "LESS_OR_EQUAL": plain & (number <= other), "GREATER": plain & (number > other), "GREATER_OR_EQUAL": plain & (number >= other), "EQUAL": same, "NOT_EQUAL": ~same}
    return F.when(text.isNull(), F.lit(False)).when(number.isNull(), F.lit(None).cast("boolean")).otherwise(tests[operator])


def _by_homopolymer(values: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
    """test(values, offset, length) of every run of one base but those at hard-clipped ends; false without values, refused for an
    empty cigar or where values end too soon.
    """
    runs = F.regexp_extract_all("bases", F.lit(r"((.)\2*)"), F.lit(1))
    begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("state"))
    total = F.length("bases")
    hard_start, hard_end = F.col("cigar").rlike(r"^[0-9]+H"), F.col("cigar").rlike(r"H$")

    def step(s: Column, run: Column) -> Column:
        n = F.length(run)
        exempt = ((s["at"] == 0) & hard_start) | ((s["at"] + n >= total) & hard_end)
        verdict = F.when(exempt, 1).when(s["at"] + n > F.size(values), -1).when(test(values, s["at"], n), 1).otherwise(0)
        return F.struct((s["at"] + n).alias("at"), F.when(s["state"] != 1, s["state"]).otherwise(verdict).alias("state"))

    state = F.aggregate(runs, begin, step, lambda s: s["state"])
    return F.when(values.isNull(), F.lit(False)).when(~F.col("cigar").rlike("[0-9]"), F.lit(None).cast("boolean")).otherwise(F.when(state >= 0, state == 1))


def _palindrome(values: Column, at: Column, n: Column) -> Column:
    part = F.slice(values, at + 1, n)
    return part == F.reverse(part)


@register
def hmer_quality_symmetric() -> Column:
    return _by_homopolymer(F.col("quals"), _palindrome)


@register
def flow_based_tp_attribute_symmetric() -> Column:
    bad = rd.tag("tp").isNotNull() & ~rd.tag_type("tp").isin("B", "Z")
    return F.when(bad, F.lit(None).cast("boolean")).otherwise(_by_homopolymer(rd.byte_tag("tp"), _palindrome))


@register
def flow_based_tp_attribute_valid(max_hmer: int = 12) -> Column:
    def in_range(values: Column, at: Column, n: Column) -> Column:
        return F.forall(F.slice(values, at + 1, n), lambda v: (v + n >= 0) & (v + n <= max_hmer))

    bad = rd.tag("tp").isNotNull() & ~rd.tag_type("tp").isin("B", "Z")
    return F.when(bad, F.lit(None).cast("boolean")).otherwise(_by_homopolymer(rd.byte_tag("tp"), in_range))


@register
def library(header: Header, keep: Sequence[str] = ()) -> Column:
    return F.coalesce(header.attribute("LB").isin(*keep), F.lit(False))


@register
def sample(header: Header, keep: Sequence[str] = ()) -> Column:
    return F.coalesce(header.attribute("SM").isin(*keep), F.lit(False))


@register
def platform(header: Header, names: Sequence[str] = ()) -> Column:
    """A name is contained in the group's platform, in whatever case."""
    own = F.upper(header.attribute("PL"))
    return F.coalesce(reduce(Column.__or__, [own.contains(n.upper()) for n in names], F.lit(False)), F.lit(False))


@register
def platform_unit(header: Header, blacklist: Sequence[str] = ()) -> Column:
    """The read's own unit wins over its group's; kept where neither is known."""
    return F.coalesce(~F.coalesce(rd.tag("PU"), header.attribute("PU")).isin(*blacklist), F.lit(True)) if blacklist else F.lit(True)


@register
def read_group_black_list(header: Header, entries: Sequence[str] = ()) -> Column:
    """Entries are KEY:value of the declared group; undeclared groups are kept."""
    keep = F.lit(True)
    for key, _, value in (e.partition(":") for e in entries):
        own = rd.tag("RG") if key in ("ID", "RG") else header.attribute(key)
        keep = keep & F.coalesce(own != value, F.lit(True))
    return ~header.declares_group() | keep


@register
def alignment_agrees_with_header(header: Header) -> Column:
    lengths = F.array(*[F.lit(n) for _, n in header.contigs]) if header.contigs else F.array().cast("array<int>")
    return rd.is_unmapped() | F.coalesce(F.col("start") <= F.get(lengths, F.col("ref_idx")), F.lit(False))


@register
def interval_overlap(intervals: Sequence[tuple[str, int, int]] = ()) -> Column:
    """For a few merged intervals given as literals; semi-join a table otherwise. Unmapped reads are dropped."""
    hits = [(F.col("contig") == c) & (F.col("start") <= e) & (rd.end() >= s) for c, s, e in intervals]
    return ~rd.is_unmapped() & reduce(Column.__or__, hits, F.lit(False))


@register
def read_group_has_flow_order(header: Header) -> Column:
    return header.attribute("FO").isNotNull()


def _wellformed_chain(header: Header) -> list[tuple[str, Column]]:
    return [
        ("ValidAlignmentStart", valid_alignment_start()),
        ("ValidAlignmentEnd", valid_alignment_end()),
        ("AlignmentAgreesWithHeader", alignment_agrees_with_header(header)),
        ("HasReadGroup", has_read_group()),
        ("MatchingBasesAndQuals", matching_bases_and_quals()),
        ("ReadLengthEqualsCigarLength", read_length_equals_cigar_length()),
        ("SeqIsStored", seq_is_stored()),
        ("CigarContainsNoNOperator", cigar_contains_no_n_operator()),
    ]


@register
def wellformed(header: Header) -> Column:
    return all_of(*[c for _, c in _wellformed_chain(header)])


@register
def wellformed_flow_based(header: Header) -> Column:
    """Each test is reached only if those before it pass, so a refusal of a later one doesn't show on a read that fails earlier."""
    return all_of(wellformed(header), read_group_has_flow_order(header), hmer_quality_symmetric(), flow_based_tp_attribute_valid(12), flow_based_tp_attribute_symmetric())


@register
def jexl_expression_read_tag_value(expressions: Sequence[str] = ()) -> Column:
    """All expressions over tags are true; null results are refused, others than booleans dropped."""
    from locusframe.functions.expression import compile_predicate

    return all_of(*[compile_predicate(e) for e in expressions]) if expressions else F.lit(True)


def all_of(*tests: Column) -> Column:
    """Short-circuit conjunction: the first test that isn't true decides."""
    out = F.lit(True)
    for t in reversed(tests):
        out = F.when(t.isNull(), F.lit(None).cast("boolean")).when(~t, F.lit(False)).otherwise(out)
    return out


def any_of(*tests: Column) -> Column:
    """Short-circuit disjunction."""
    out = F.lit(False)
    for t in reversed(tests):
        out = F.when(t.isNull(), F.lit(None).cast("boolean")).when(t, F.lit(True)).otherwise(out)
    return out


def negate(test: Column) -> Column:
    return ~test


def strict(test: Column, name: str) -> Column:
    """test, with an error where it refuses."""
    return F.when(test.isNull(), F.raise_error(F.lit(f"{name} can't decide on a read")).cast("boolean")).otherwise(test)


def first_failed(tests: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first test that doesn't keep the read; null if all do."""
    out = F.lit(None).cast("string")
    for name, t in reversed(tests):
        out = F.when(F.coalesce(~t, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def rejection_counts(reads: DataFrame, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """(filter, n_rejected): each rejected read counts for the first test it fails, and a null filter counts the reads kept."""
    return reads.groupBy(first_failed(tests).alias("filter")).agg(F.count(F.lit(1)).alias("n_rejected"))


def summary(reads: DataFrame, tests: Sequence[tuple[str, Column]]) -> str:
    """The counts as text, one line for each test that rejected reads; as many rows reach the driver as there are tests."""
    counts = {r["filter"]: r["n_rejected"] for r in rejection_counts(reads, tests).collect()}
    lost = sum(n for k, n in counts.items() if k)
    lines = [f"{counts[n]} read(s) filtered by: {n}" for n, _ in tests if counts.get(n)]
    return "\n".join([*lines, f"{lost} total reads filtered out of {sum(counts.values())} reads processed"]) if lines else "No reads filtered"
