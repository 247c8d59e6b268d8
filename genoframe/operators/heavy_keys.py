"""Per-key results where a few keys hold most rows (problem 6).

Rows are compressed to (key, value, record) frequencies first: the shuffle is by key,
value and record together, so a heavy key is spread over all tasks, and repeats collapse
before they move. Only sums of compressed rows are then gathered per key. The median is
read from weighted values in two steps that never put a key in one task: weights per
slice of values (at most ``SLICES`` per key) find the slice that holds the median, and
only that slice's values are ordered.

Cases:

* rows with a null key form the group of the null key; a null value counts among the
  rows and records, not in range and median, which are null if no value is left.
* repeated rows count once in ``distinct_records`` and each in ``rows`` and the median;
  rows are told apart by 128 bits of hash over all columns (two rows of 10**12 agree by
  chance with a probability below 10**-14).
* of an even number of values the lower middle one is the median.
* an empty table gives no rows. Extra columns only take part in telling records apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of a key's value range in the first step of the median.
SLICES = 4096


def key_summary(df: DataFrame, key: Column, value: str, value_bound: int) -> DataFrame:
    """One row per key: rows, distinct_records, first_value, last_value, median_value.

    ``value_bound`` is the largest value that can occur; it fixes the slices' width.
    """
    width = max(1, value_bound // SLICES + 1)
    rows = df.select(
        key.alias("_key"),
        F.col(value).cast("bigint").alias("_value"),
        F.xxhash64(F.lit("a"), *[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]).alias("_h1"),
        F.xxhash64(F.lit("b"), *[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]).alias("_h2"),
    )
    records = rows.groupBy("_key", "_value", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    slices = (
        records.withColumn("_slice", F.expr(f"_value div {width}"))
        .groupBy("_key", "_slice")
        .agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_records"), F.min("_value").alias("_min"), F.max("_value").alias("_max"))
    )
    in_order = W.partitionBy("_key").orderBy(F.col("_slice").asc_nulls_first())
    slices = slices.select(
        "*",
        F.sum(F.when(F.col("_slice").isNotNull(), F.col("_n"))).over(in_order).alias("_upto"),
        F.sum(F.when(F.col("_slice").isNotNull(), F.col("_n"))).over(W.partitionBy("_key")).alias("_all"),
    )
    middle = F.expr("(_all + 1) div 2")
    # One row per key with the slice that holds its median.
    keys = slices.groupBy("_key").agg(
        F.sum("_n").alias("rows"),
        F.sum("_records").alias("distinct_records"),
        F.min("_min").alias("first_value"),
        F.max("_max").alias("last_value"),
        F.max(F.when((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_n") < middle) & F.col("_slice").isNotNull(), F.struct("_slice", (middle - F.col("_upto") + F.col("_n")).alias("_need")))).alias("_at"),
    )
    wanted = keys.select("_key", F.col("_at._slice").alias("_slice"), F.col("_at._need").alias("_need")).filter("_slice is not null")
    valued = df.select(key.alias("_key"), F.col(value).cast("bigint").alias("_value")).withColumn("_slice", F.expr(f"_value div {width}"))
    hit = (
        valued.alias("v")
        .join(wanted.alias("w"), F.col("v._key").eqNullSafe(F.col("w._key")) & (F.col("v._slice") == F.col("w._slice")))
        .groupBy(F.col("v._key").alias("_key"), F.col("v._value").alias("_value"), F.col("w._need").alias("_need"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(W.partitionBy("_key").orderBy("_value")))
        .filter("_upto >= _need and _upto - _n < _need")
        .select(F.col("_key").alias("_mkey"), F.col("_value").alias("median_value"))
    )
    return keys.join(hit, F.col("_key").eqNullSafe(F.col("_mkey")), "left").select(
        F.col("_key").alias("key"), "rows", "distinct_records", "first_value", "last_value", "median_value"
    )
