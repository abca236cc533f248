"""Numeric and text functions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)


def fast_round(x: Column) -> Column:
    """Half up."""
    return F.floor(x + 0.5)


def qual_to_prob(q: Column) -> Column:
    """Probability that a base of this phred quality is right."""
    return 1 - F.pow(F.lit(10.0), -q / 10.0)


def qual_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def phred(p: Column, floor: float = 1e-320) -> Column:
    return F.lit(-10.0) * F.log10(F.greatest(p, F.lit(floor)))


def log10_sum_log10(values: Column) -> Column:
    """log10 of the sum of 10 ** x over an array; minus infinity for an empty one."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - top))
    return F.when(F.size(values) == 0, F.lit(float("-inf"))).when(top == float("-inf"), top).otherwise(top + F.log10(total))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return F.when(F.size(values) == 0, F.lit(float("-inf"))).when(top == float("-inf"), top).otherwise(top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def normalize_log10(values: Column) -> Column:
    """10 ** x, scaled to the sum 1."""
    total = log10_sum_log10(values)
    return F.transform(values, lambda x: F.pow(F.lit(10.0), x - total))


def normalize_log(values: Column) -> Column:
    total = log_sum_exp(values)
    return F.transform(values, lambda x: F.exp(x - total))


def posteriors(log_priors: Column, log_likelihoods: Column) -> Column:
    return normalize_log(F.zip_with(log_priors, log_likelihoods, lambda p, l: p + l))


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x < 0, by whichever form keeps its digits."""
    return F.when(x > 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).when(x > -math.log(2), F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def max_index(values: Column) -> Column:
    """Index, from 0, of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def nan_min(a: Column, b: Column) -> Column:
    """NaN if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def nan_max(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.greatest(a, b))


def string_hash(text: Column) -> Column:
    """The 32-bit hash that multiplies by 31 at each character (of the basic plane)."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(0xFFFFFFFF))
    return F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped).cast("int")


def parse_doubles(text: Column) -> Column:
    """array<double> of a comma list; `.` and what is no number are -1."""
    return F.transform(F.split(text, ","), lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(-1.0)))


def tumor_log_odds(tlod: Column) -> Column:
    """Natural-log odds of a comma list of log10 odds."""
    return F.transform(parse_doubles(tlod), lambda x: x * LN10)


def pl_index(a: Column, b: Column) -> Column:
    """Place of the genotype of alleles a <= b among the likelihoods."""
    return (b * (b + 1) / 2).cast("int") + a


def repeat_unit(bases: Column) -> Column:
    """The shortest prefix that tiles the text."""
    return F.regexp_extract(bases, r"^(.+?)\1*$", 1)


def flatten_bases(bases: Column) -> Column:
    """Upper case, with ambiguity codes as N."""
    return F.regexp_replace(F.upper(bases), "[RYKMSWBDHV]", "N")
