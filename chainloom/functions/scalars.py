"""Scalar functions of the domain, as column expressions evaluated inside the JVM."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CATEGORY_LABELS = {"FSM": "full-splice_match", "ISM": "incomplete-splice_match", "NIC": "novel_in_catalog", "NNC": "novel_not_in_catalog", "genic_intron": "genic_intron", "genic_genomic": "genic_genomic", "intergenic": "intergenic", "ambiguous": "ambiguous"}
EXPRESSION_LABELS = {"TPM": "TPM", "FPKM": "FPKM", "RPKM": "RPKM", "COUNTS": "counts", "CPM": "CPM"}


def is_main_chromosome(c: Column) -> Column:
    """1 to 22 without leading zero, X, Y, M or MT, with or without ``chr``."""
    return c.rlike("^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$")


def chromosome_order(c: Column) -> Column:
    """Sort key: numbers by value, then X, Y, M, then all others by name."""
    bare = F.regexp_replace(c, "^chr", "")
    number = F.when(bare.rlike("^[0-9]{1,9}$"), bare.cast("int"))
    special = F.when(bare == "X", 1_000_000_001).when(bare == "Y", 1_000_000_002).when(bare.isin("M", "MT"), 1_000_000_003).otherwise(1_000_000_004)
    return F.coalesce(number, special)


def format_coordinate(seqid: Column, strand: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%s:%d-%d", seqid, strand, start, end)


def structure_key(seqid: Column, strand: Column, chain: Column) -> Column:
    """``seqid:strand:s-e,s-e`` in genomic order."""
    parts = F.transform(chain, lambda x: F.concat_ws("-", x["start_pos"], x["end_pos"]))
    return F.concat_ws(":", seqid, strand, F.array_join(parts, ","))


def junctions(chain: Column) -> Column:
    """(donor, acceptor) between neighbours of an ascending chain: end of one exon, start of the next."""
    left = F.slice(chain, F.lit(1), F.size(chain) - 1)
    right = F.slice(chain, F.lit(2), F.size(chain) - 1)
    return F.when(F.size(chain) > 1, F.zip_with(left, right, lambda a, b: F.struct(a["end_pos"].alias("donor"), b["start_pos"].alias("acceptor")))).otherwise(F.expr("cast(array() as array<struct<donor:bigint,acceptor:bigint>>)"))


def exons_of_junctions(start: Column, end: Column, introns: Column) -> Column:
    """[start, d0], [a0, d1], ... [a_last, end]."""
    lefts = F.concat(F.array(start), F.transform(introns, lambda j: j["acceptor"]))
    rights = F.concat(F.transform(introns, lambda j: j["donor"]), F.array(end))
    return F.zip_with(lefts, rights, lambda s, e: F.struct(s.alias("start_pos"), e.alias("end_pos")))


def splice_signature(strand: Column, introns: Column, bin_size: int) -> Column:
    """Junctions rounded down to bins, as text."""
    parts = F.transform(introns, lambda j: F.concat_ws("-", F.floor(j["donor"] / bin_size) * bin_size, F.floor(j["acceptor"] / bin_size) * bin_size))
    return F.concat_ws(":", strand, F.when(F.size(introns) == 0, F.lit("SINGLE")).otherwise(F.array_join(parts, ",")))


def exon_number(c: Column) -> Column:
    """Whole number of an attribute; -1 where it is none."""
    return F.coalesce(F.expr("null").cast("int") if c is None else F.try_to_number(F.regexp_extract(F.trim(c), r"^[0-9]{1,9}$", 0), F.lit("999999999")).cast("int"), F.lit(-1))


def expression_value(c: Column) -> Column:
    """Leading number of a text; null where it starts with none."""
    return F.nullif(F.regexp_extract(c, r"^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)", 1), F.lit("")).cast("double")


def conserved_threshold(n_samples: Column, fraction: float) -> Column:
    """At least 1: the number of samples that a fraction of all samples makes, rounded up."""
    if not 0 < fraction <= 1:
        raise ValueError("the conserved fraction must be above 0 and at most 1")
    return F.greatest(F.lit(1), F.ceil(n_samples * F.lit(fraction))).cast("long")


def parse_region(text: str) -> tuple[str, int, int]:
    """``chr:start-end`` with start < end; names are not normalised."""
    seqid, _, span = text.rpartition(":")
    start, _, end = span.partition("-")
    if not seqid or not start.isdigit() or not end.isdigit() or int(start) >= int(end):
        raise ValueError(f"not a region: {text!r}")
    return seqid, int(start), int(end)


def parse_contrast(text: str) -> tuple[str, str]:
    a, colon, b = text.partition(":")
    if not colon or not a or not b:
        raise ValueError(f"not a contrast: {text!r}")
    return a, b


def within(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= tolerance


def same_junction(a: Column, b: Column, tolerance: int) -> Column:
    return within(a["donor"], b["donor"], tolerance) & within(a["acceptor"], b["acceptor"], tolerance)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap, the one rule for all joins: spans that merely touch do not overlap."""
    return (a_start < b_end) & (a_end > b_start)


def wilson_hilferty_z(chi2: Column, k: Column) -> Column:
    return (F.pow(chi2 / k, F.lit(1.0 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))


def erfc_polynomial(x: Column) -> Column:
    """Complementary error function by the five-term rational approximation of Abramowitz and Stegun, 7.1.26."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    near = series * F.exp(-a * a)
    return F.when(x >= 0, near).otherwise(2 - near)


def erfc(c: Column) -> Column:
    """Exact complementary error function, in Arrow batches (the JVM has none built in)."""

    def values(x: pd.Series) -> pd.Series:
        return x.map(math.erfc, na_action="ignore")

    return F.pandas_udf(values, "double")(c)


def chi2_p_value(chi2: Column, k: Column, exact: bool = False) -> Column:
    half = wilson_hilferty_z(chi2, k) / math.sqrt(2)
    return F.greatest(0.5 * (erfc(half) if exact else erfc_polynomial(half)), F.lit(1e-300))


def entropy_term(p: Column) -> Column:
    """-p log2 p, 0 at 0; summed it gives Shannon's entropy."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def joined_or_dot(c: Column) -> Column:
    """Array as text with ``;``, a dot where it is empty or null."""
    return F.coalesce(F.nullif(F.array_join(c, ";"), F.lit("")), F.lit("."))
