"""Joins against a side that is small on most data but isn't bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from genoframe.tables import ensure_checkpoint_dir

#: Bytes up to which a side is broadcast, by its values and ``ROW_BYTES`` for each row; hashed
#: in an executor it takes some times as much.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 16
#: Where the small side is beyond that: parts into which a key of the large side is cut, the rows
#: from which on it is, and how many keys at most, the heaviest. What is still uneven then is left
#: to adaptive execution, which splits large partitions.
SALTS, HEAVY_ROWS, HEAVY_KEYS = 16, 10_000, 4096


def _on(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"big.{k}").eqNullSafe(F.col(f"small.{k}")) for k in keys])


def _bytes(df: DataFrame) -> Column:
    """How many bytes a row's values take; elements of arrays count as their texts or as 8."""

    def one(value: Column, kind) -> Column:
        if isinstance(kind, StructType):
            return sum((F.coalesce(one(value[f.name], f.dataType), F.lit(0)) for f in kind), F.lit(0))
        if isinstance(kind, (StringType, BinaryType)):
            return F.octet_length(value)
        if isinstance(kind, ArrayType):
            return F.aggregate(value, F.lit(0), lambda n, x: n + F.coalesce(one(x, kind.elementType), F.lit(0)))
        return F.lit(8)

    return sum((F.coalesce(one(F.col(f.name), f.dataType), F.lit(0)) for f in df.schema), F.lit(ROW_BYTES)).cast("bigint")


def fits_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together take at most ``limit`` bytes. Runs the side once."""
    return small.agg(F.coalesce(F.sum(_bytes(small)), F.lit(0))).first()[0] <= limit


def _heavy_keys(big: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold most rows, if more than ``HEAVY_ROWS``: a short list, marked ``_heavy``."""
    ensure_checkpoint_dir(big.sparkSession)
    counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HEAVY_ROWS)
    # Both sides look it up; the rows are counted once.
    return counted.orderBy(F.desc("_n")).limit(HEAVY_KEYS).select(*keys, F.lit(True).alias("_heavy")).checkpoint()


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Null-safe join that keeps ``big`` where it lies if ``small`` is small.

    ``small`` is measured first. Up to ``limit`` bytes it is broadcast; beyond, heavy keys of
    ``big`` are salted and their rows of ``small`` repeated per salt, so that a key holding a
    third of ``big`` is spread over ``SALTS`` tasks. Columns of ``small`` beside the keys must
    not be in ``big``.
    The planner would guess the repeated side from its files, without its repeats, and might
    gather it on the driver after all; a merge join is asked for by name.
    """
    rest = [c for c in small.columns if c not in keys]
    picked = [F.col(f"big.{c}") for c in big.columns] + ([] if how in ("left_semi", "left_anti") else [F.col(f"small.{c}") for c in rest])
    if fits_broadcast(small, limit):
        return big.alias("big").join(F.broadcast(small).alias("small"), _on(keys), how).select(*picked)
    heavy = F.broadcast(_heavy_keys(big, keys)).alias("small")
    marked = [df.alias("big").join(heavy, _on(keys), "left").select("big.*", "_heavy") for df in (big, small)]
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted, spread = marked[0].withColumn("_salt", salt), marked[1].withColumn("_salt", F.explode(salts))
    return salted.alias("big").join(spread.hint("merge").alias("small"), _on([*keys, "_salt"]), how).select(*picked)


def rows_once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key of a table in which few rows are repeated.

    Keys alone are shuffled to find the repeated ones; if these are few, only their rows are
    shuffled too, and all others stay where they lie. Else all rows are."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    if not fits_broadcast(repeated):
        return df.dropDuplicates([key])
    marked = repeated.withColumn("_again", F.lit(True))
    flagged = df.alias("big").join(F.broadcast(marked).alias("small"), _on([key]), "left").select("big.*", "_again")
    return flagged.filter("_again is null").drop("_again").unionByName(flagged.filter("_again").drop("_again").dropDuplicates([key]))


def person_keys(df: DataFrame) -> list[str]:
    """What tells results apart: the index, and the person's sample where it is known. A
    null sample is a group of its own, so joins on these keys are null-safe."""
    return ["sample_id", "idx"] if "sample_id" in df.columns else ["idx"]


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; all columns of ``left``, then the rest of ``right``."""
    picked = [F.col(f"big.{c}") for c in left.columns] + [F.col(f"small.{c}") for c in right.columns if c not in keys]
    return left.alias("big").join(right.alias("small"), _on(keys), how).select(*picked)


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One row with all columns of tables of one row each, which share no column."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for part in parts for c in part.columns])
