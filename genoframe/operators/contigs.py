"""The sequence dictionary: absolute indices, positions, and ranges given by name.

Indices are 0-based over all contigs laid end to end; positions are 1-based. The dictionary
is fixed per reference genome (some hundred contigs, the same for any number of reads), so
it is the one side that is broadcast without a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genoframe.functions.names import contig_key

#: Width of the slices into which contigs are cut for index lookups.
_SLICE = 1 << 24


def dictionary(contigs: DataFrame) -> DataFrame:
    """(contig_key, contig_name, contig_id, start_idx, contig_length); one row per key."""
    rows = contigs.select(contig_key("contig_name").alias("contig_key"), "contig_name", "contig_id", "start_idx", "contig_length")
    return rows.filter("contig_key is not null").dropDuplicates(["contig_key"])


def cumulative_starts(lengths: DataFrame) -> DataFrame:
    """Adds ``start_idx``, the sum of the lengths before, to (contig_id, contig_length).

    The dictionary is a short list; its one window holds all of it."""
    before = W.orderBy("contig_id").rowsBetween(W.unboundedPreceding, -1)
    return lengths.withColumn("start_idx", F.coalesce(F.sum("contig_length").over(before), F.lit(0)))


def with_index(df: DataFrame, contigs: DataFrame, name: str, pos: str, how: str = "inner") -> DataFrame:
    """Adds contig_key, contig_name and ``idx`` of a 1-based position on a named contig.

    Unknown or null names are dropped, or kept without an index if ``how`` is ``left``."""
    known = dictionary(contigs).select("contig_key", F.col("contig_name").alias("_name"), F.col("start_idx").alias("_start"))
    keyed = df.drop("contig_key", "contig_name", "idx").withColumn("contig_key", contig_key(name))
    joined = keyed.join(F.broadcast(known), "contig_key", how)
    return joined.withColumn("contig_name", F.col("_name")).withColumn("idx", F.col("_start") + F.col(pos) - 1).drop("_name", "_start")


def with_position(df: DataFrame, contigs: DataFrame, idx: str = "idx") -> DataFrame:
    """Adds contig_name and 1-based ``ref_pos`` of an index; indices past the end are dropped."""
    slices = dictionary(contigs).select(
        F.col("contig_name").alias("_name"),
        F.col("start_idx").alias("_start"),
        (F.col("start_idx") + F.col("contig_length")).alias("_end"),
        F.explode(F.sequence(F.expr(f"start_idx div {_SLICE}"), F.expr(f"(start_idx + contig_length - 1) div {_SLICE}"))).alias("_slice"),
    )
    sliced = df.withColumn("_slice", F.expr(f"{idx} div {_SLICE}"))
    found = sliced.join(F.broadcast(slices), "_slice").filter(F.col(idx).between(F.col("_start"), F.col("_end") - 1))
    return found.select(*df.columns, F.col("_name").alias("contig_name"), (F.col(idx) - F.col("_start") + 1).alias("ref_pos"))


def parse_range(text: str) -> tuple[str | None, int | None, str | None, int | None]:
    """``name``, ``name:from``, ``name:from:to`` or ``name:from:name:to``, 1-based."""
    parts = text.split(":")
    if len(parts) > 4 or not parts[0]:
        raise ValueError(f"not a range: {text}")
    numbers = [int(p) for p in (parts[1:2] + parts[-1:] if len(parts) > 2 else parts[1:])]
    if any(n < 1 for n in numbers):
        raise ValueError(f"positions begin at 1: {text}")
    last = parts[2] if len(parts) == 4 else parts[0]
    return parts[0], numbers[0] if numbers else None, last if len(parts) > 2 else None, numbers[1] if len(numbers) > 1 else None


def resolve_range(contigs: DataFrame, start_name: str | None, start_pos: int | None, end_name: str | None, end_pos: int | None) -> tuple[int, int]:
    """First and last index (both within) of a range; ends left open mean the contig's or
    the dictionary's. A position without its name is an error, as is an unknown name."""
    if (start_pos is not None and start_name is None) or (end_pos is not None and end_name is None):
        raise ValueError("a position needs its contig's name")
    known = {r.contig_key: r for r in dictionary(contigs).collect()}  # the dictionary: a short list
    key = lambda name: name.strip().lower().removeprefix("chr")
    for name in (start_name, end_name):
        if name is not None and key(name) not in known:
            raise ValueError(f"unknown contig: {name}")
    first = min(r.start_idx for r in known.values())
    last = max(r.start_idx + r.contig_length - 1 for r in known.values())
    if start_name is not None:
        row = known[key(start_name)]
        first = row.start_idx + (start_pos or 1) - 1
    if end_name is not None:
        row = known[key(end_name)]
        last = row.start_idx + (end_pos or row.contig_length) - 1
    if last < first:
        raise ValueError("the range ends before it begins")
    return first, last


def narrow_range(wanted: tuple[int, int] | None, given: tuple[int, int]) -> tuple[int, int]:
    """The wanted range, which must lie within the given one; without one, the given."""
    if wanted is None:
        return given
    if wanted[0] < given[0] or wanted[1] > given[1]:
        raise ValueError("the range isn't within the one that may be read")
    return wanted


def within(idx: Column, bounds: tuple[int, int]) -> Column:
    return idx.between(*bounds)


def contig_id(contigs: DataFrame, name: str) -> int:
    """The number of a contig, in any spelling; an unknown one raises."""
    row = dictionary(contigs).filter(F.col("contig_key") == contig_key(F.lit(name))).first()
    if row is None:
        raise ValueError(f"unknown contig: {name}")
    return row.contig_id


def contig_name(contigs: DataFrame, number: int) -> str:
    """The name of a contig's number; an unknown one raises."""
    row = dictionary(contigs).filter(F.col("contig_id") == number).first()
    if row is None:
        raise ValueError(f"unknown contig: {number}")
    return row.contig_name


def resolve_position(contigs: DataFrame, idx: int) -> tuple[str, int]:
    """Contig and 1-based position of an index; one past the end raises."""
    row = dictionary(contigs).filter((F.col("start_idx") <= idx) & (F.col("start_idx") + F.col("contig_length") > idx)).first()
    if row is None:
        raise ValueError(f"no contig holds index {idx}")
    return row.contig_name, idx - row.start_idx + 1
