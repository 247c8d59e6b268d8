"""Join of intervals (reads) with the points (variants) that they cover.

Both sides are cut into bins of the index, so the join is an equality and a residual
comparison. A point lies in one bin, so no pair comes twice. Intervals of more than
``MAX_BINS`` bins use wide bins instead, so that long skips don't multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.operators.joins import join_checked

#: Indices in a narrow bin, bins that an interval may take, and narrow bins in a wide one.
BIN, MAX_BINS, WIDE = 256, 64, 8192


def _binned_intervals(reads: DataFrame, width: int) -> DataFrame:
    wide = F.expr(f"(end_idx div {width}) - (start_idx div {width}) >= {MAX_BINS}")
    span = F.when(wide, F.lit(width * WIDE)).otherwise(F.lit(width)).cast("bigint")
    placed = reads.filter("start_idx is not null and end_idx >= start_idx").withColumn("_span", span)
    return placed.withColumn("_bin", F.explode(F.sequence(F.expr("start_idx div _span"), F.expr("end_idx div _span"))))


def _binned_points(points: DataFrame, width: int) -> DataFrame:
    spans = F.array(F.lit(width).cast("bigint"), F.lit(width * WIDE).cast("bigint"))
    return points.filter("idx is not null").withColumn("_span", F.explode(spans)).withColumn("_bin", F.expr("idx div _span"))


def covering_pairs(reads: DataFrame, points: DataFrame, width: int = BIN) -> DataFrame:
    """All columns of both for each read (start_idx, end_idx) and point (idx) within it.

    Columns must not clash. Points are broadcast after a count, or else spread with salts,
    since reads pile up on few bins."""
    joined = join_checked(_binned_intervals(reads, width), _binned_points(points, width), ["_span", "_bin"], "inner")
    return joined.filter("idx between start_idx and end_idx").select(*reads.columns, *points.columns)


def covering_reads(reads: DataFrame, points: DataFrame, key: str = "ord") -> DataFrame:
    """Keys of the reads that cover a point at least, each once."""
    return covering_pairs(reads.select(key, "start_idx", "end_idx"), points.select("idx")).select(key).distinct()
