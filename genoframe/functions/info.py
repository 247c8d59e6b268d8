"""Column functions on INFO, FORMAT and allele counts of variant rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genoframe.operators.packed_fields import FORMATS, packed_values


def info_value(info: Column, tag: str) -> Column:
    """The text after ``TAG=``, of its first entry; null if the tag is missing."""
    return F.when(info.rlike(f"(?:^|;){tag}="), F.regexp_extract(info, f"(?:^|;){tag}=([^;]*)", 1))


def info_counts(info: Column, tag: str = "AC") -> Column:
    """Comma-separated whole numbers of a tag; null unless all of them are."""
    value = info_value(info, tag)
    return F.when(value.rlike("^[0-9]+(,[0-9]+)*$"), F.transform(F.split(value, ","), lambda x: x.cast("bigint")))


def info_number(info: Column, tag: str = "AN") -> Column:
    value = info_value(info, tag)
    return F.when(value.rlike("^[0-9]+$"), value.cast("bigint"))


def with_reference_count(alt_counts: Column, total: Column) -> Column:
    """Counts of all alleles, the reference's (total less the others) first."""
    return F.concat(F.array(total - F.aggregate(alt_counts, F.lit(0).cast("bigint"), lambda a, x: a + x)), alt_counts)


def format_value(layout: Column, genotype: Column, tag: str) -> Column:
    """The value of a FORMAT key in a colon-separated genotype; null if it has none.

    The layout's keys are those of problem 3: any of its separators, quotes taken off,
    empty pieces not counted."""
    at = F.array_position(packed_values(layout, FORMATS), F.lit(tag)).cast("int")
    return F.when(at > 0, F.get(F.split(genotype, ":"), at - 1))


def alternative_frequency(counts: Column, ref_id: Column) -> Column:
    """Share of all counts that isn't the reference's."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return 1 - F.get(counts, ref_id) / total
