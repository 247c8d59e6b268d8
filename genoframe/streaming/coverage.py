"""Reads as a stream: counts per contig and time window, with late reads cut off by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.functions.names import contig_key


def windowed_coverage(reads: DataFrame, lateness: str = "30 days", window: str = "1 day") -> DataFrame:
    """(window_start, contig_key, n_reads, n_bases) of a stream, or table, of alignments.

    Reads without a time are left out. State is one row per contig and open window."""
    timed = reads.select(F.col("sequenced_at").cast("timestamp").alias("at"), contig_key("reference_name").alias("contig_key"), F.length("seq").alias("n")).filter("at is not null")
    counted = timed.withWatermark("at", lateness).groupBy(F.window("at", window), "contig_key").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("n").alias("n_bases"))
    return counted.select(F.col("window.start").alias("window_start"), "contig_key", "n_reads", "n_bases")
