"""Spellings: contig names, alleles and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contig_key(name: Column | str) -> Column:
    """Key under which all spellings of one contig agree.

    Letter case, outer blanks and one leading ``chr`` don't count. Null stays null.
    """
    return F.regexp_replace(F.lower(F.trim(name)), "^chr", "")


def missing_as_null(value: Column | str) -> Column:
    """``.`` stands for a missing value in VCF columns."""
    return F.nullif(F.col(value) if isinstance(value, str) else value, F.lit("."))
