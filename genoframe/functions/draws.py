"""Random draws that depend on keys alone, so any partitioning gives the same ones.

The hash is md5, which SQL engines share; draws that must stay secret need a secret seed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) for the keys, which are joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def weighted_index(weights: Column, draw: Column) -> Column:
    """0-based place of the first running sum above draw * total. One weight gives 0; if
    all are 0, every place is equally likely."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    state = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, w: Column) -> Column:
        upto = acc["upto"] + w
        return F.struct(upto.alias("upto"), (acc["at"] + 1).alias("at"), F.coalesce(acc["found"], F.when(upto > draw * total, acc["at"])).alias("found"))

    drawn = F.aggregate(weights, state, step, lambda acc: acc["found"])
    return F.when(total > 0, drawn).otherwise(F.least(F.floor(draw * F.size(weights)), F.size(weights) - 1).cast("int"))
