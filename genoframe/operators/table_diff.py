"""Differences between two copies of a keyed table (problem 1).

Each copy is folded into a checksum matrix: one row per bucket of keys, one additive
80-bit sum per column in two 40-bit lanes. Two copies agree in a bucket and column if the
sums agree. Only rows of unequal buckets are read again, and of those only the values of
the bucket's unequal columns go into the shuffle, where they are joined and compared field
by field.

There is a bucket for some ``BUCKET_ROWS`` rows, up to ``MAX_BUCKETS``, so that a difference
costs the rereading of few records, and the list of unequal cells can be broadcast: a number
and a short text each. A lane holds 2**23 keys a bucket, so 2**41 keys in all.

Cases:

* several rows per key: the one with the latest version stands; among rows of one
  version the greatest by a hash of its fields does, so repeats and ties give one defined
  row, and equal rows on both sides give the same. A null version is the oldest.
* a null key is a key like any other; it meets the null key of the other side.
* two nulls are equal, null against a value is a difference; NaN equals NaN.
* an empty side: each record of the other is missing there.
* columns that aren't compared are never read, so extra ones can't clash.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANE_BITS = 40
#: Rows to a bucket, and the most buckets, whose unequal ones are broadcast (some 40 bytes each).
BUCKET_ROWS, MAX_BUCKETS = 8, 1 << 18


@dataclass(frozen=True)
class Field:
    """How a column is compared: ``canonical`` gives the value whose equality proves
    two fields equal; ``tolerance`` lets unequal numbers pass as equal."""

    canonical: Column
    tolerance: float | None = None


def bucket_count(rows: int, partitions: int) -> int:
    """A multiple of the shuffle's partitions: then all keys of a bucket are folded in one
    partition, and its row of the matrix leaves one task only."""
    wanted = min(MAX_BUCKETS, max(1, rows // BUCKET_ROWS))
    return -(-wanted // partitions) * partitions


def _bucket(key: str, buckets: int) -> Column:
    # The hash by which the shuffle on the key spreads rows.
    return F.pmod(F.hash(F.col(key)), F.lit(buckets)).cast("int")


def _lanes(key: str, column: str) -> list[Column]:
    # Nulls are skipped by the hash, so presence is hashed beside the value.
    value = F.col(column)
    return [
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), value.isNull(), value), 64 - _LANE_BITS)
        for seed in ("lane-a", "lane-b")
    ]


def _versioned(df: DataFrame, key: str, version: str, fields: Mapping[str, Field]) -> DataFrame:
    """Key, version, canonical fields, and the hash that settles ties."""
    rows = df.select(F.col(key), F.col(version).alias("_version"), *[f.canonical.alias(name) for name, f in fields.items()])
    return rows.withColumn("_tie", F.xxhash64(*[x for name in fields for x in (F.col(name).isNull(), F.col(name))]))


def _standing(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    best = rows.groupBy(key).agg(F.max(F.struct("_version", "_tie", *names)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{name}").alias(name) for name in names])


def current_rows(df: DataFrame, key: str, version: str, fields: Mapping[str, Field]) -> DataFrame:
    """The standing row of each key, with canonical fields."""
    return _standing(_versioned(df, key, version, fields), key, list(fields))


def checksum_matrix(rows: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """One row per bucket: two lane sums per column and for the keys themselves."""
    sums = [F.sum(lane).alias(f"{name}_{k}") for name in columns for k, lane in enumerate(_lanes(key, name))]
    keys = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).isNull(), F.col(key)), 64 - _LANE_BITS)).alias(f"_key_{k}") for k, seed in enumerate(("key-a", "key-b"))]
    return rows.groupBy(_bucket(key, buckets).alias("_bucket")).agg(*keys, *sums)


def unequal_cells(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(_bucket, _cells) of buckets in which the matrices differ: a text with a 1 for each
    column that does, and a 0 for each that doesn't. Where keys alone differ all are 0 but
    for the columns that missing records made unequal."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col("a._bucket") == F.col("b._bucket"), "full_outer")

    def differs(name: str) -> Column:
        return ~(F.col(f"a.{name}_0").eqNullSafe(F.col(f"b.{name}_0")) & F.col(f"a.{name}_1").eqNullSafe(F.col(f"b.{name}_1")))

    cells = F.concat(*[F.when(differs(name), "1").otherwise("0") for name in columns])
    found = joined.select(F.coalesce("a._bucket", "b._bucket").alias("_bucket"), cells.alias("_cells"), differs("_key").alias("_keys"))
    return found.filter(F.col("_keys") | F.contains("_cells", F.lit("1"))).drop("_keys")


def table_diff(
    left: DataFrame,
    right: DataFrame,
    key: str,
    version: str,
    fields: Mapping[str, Field],
    missing_left: str,
    missing_right: str,
    buckets: int | None = None,
) -> DataFrame:
    """Rows (key, field_name): records that one side lacks, and each unequal field.

    The number of ``buckets`` comes from the tables' rows unless it is given."""
    names = list(fields)
    if buckets is None:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = bucket_count(max(left.count(), right.count()), partitions)
    cells = unequal_cells(*[checksum_matrix(current_rows(df, key, version, fields), key, names, buckets) for df in (left, right)], names)
    cells = F.broadcast(cells)

    def reread(df: DataFrame) -> DataFrame:
        hit = _versioned(df, key, version, fields).withColumn("_bucket", _bucket(key, buckets)).join(cells, "_bucket")
        # Values of equal cells stay behind before the shuffle, on both sides alike.
        unequal = [F.when(F.substring("_cells", i + 1, 1) == "1", F.col(n)).alias(n) for i, n in enumerate(names)]
        return _standing(hit.select(key, "_version", "_tie", *unequal), key, names).withColumn("_side", F.lit(1))

    a, b = reread(left).alias("a"), reread(right).alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")

    def differs(name: str, field: Field) -> Column:
        x, y = F.col(f"a.{name}"), F.col(f"b.{name}")
        unequal = ~x.eqNullSafe(y)
        if field.tolerance is not None:
            # The slack covers decimal steps that doubles can't hold exactly.
            unequal &= ~F.coalesce(F.abs(x - y) <= F.lit(field.tolerance + 1e-9), F.lit(False))
        return unequal

    found = (
        F.when(F.col("a._side").isNull(), F.array(F.lit(missing_left)))
        .when(F.col("b._side").isNull(), F.array(F.lit(missing_right)))
        .otherwise(F.array_compact(F.array(*[F.when(differs(n, f), F.lit(n)) for n, f in fields.items()])))
    )
    record = F.when(F.col("a._side").isNull(), F.col(f"b.{key}")).otherwise(F.col(f"a.{key}"))
    return both.select(record.alias(key), F.explode(found).alias("field_name"))
