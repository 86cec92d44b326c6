"""Normalised grouping keys: gene ids without version, sequence names in one style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks of a key.
BLANKS = " \t\r\n\u00a0"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def gene_key(c: Column) -> Column:
    """``gene_id`` without outer blanks and without a final ``.digits``; null where nothing is left."""
    return F.nullif(F.regexp_replace(trimmed(c), r"\.[0-9]+$", ""), F.lit(""))


def normalize_chromosome(c: Column) -> Column:
    """``chr`` names stay, MT becomes chrM, bare numbers and X, Y, M get the prefix, anything else stays."""
    return (
        F.when(c.startswith("chr"), c)
        .when(c == "MT", F.lit("chrM"))
        .when(c.rlike("^([0-9]+|X|Y|M)$"), F.concat(F.lit("chr"), c))
        .otherwise(c)
    )


def sequence_key(c: Column) -> Column:
    """Normalised sequence name of a trimmed ``seqid``; null where it is null or blank."""
    return F.nullif(normalize_chromosome(trimmed(c)), F.lit(""))


def normalize_name(name: str) -> str:
    """``sequence_key`` of one name on the driver."""
    bare = name.strip(BLANKS)
    if bare.startswith("chr"):
        return bare
    return "chrM" if bare == "MT" else f"chr{bare}" if bare in ("X", "Y", "M") or (bare.isascii() and bare.isdigit()) else bare
