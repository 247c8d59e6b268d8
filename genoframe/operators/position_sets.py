"""Set algebra and histograms over positions of population, personal and masked variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.operators.joins import join_null_safe

# What a position is, by membership in population, personal and masked set.
CLASSES = {
    (True, True, False): "masked",
    (True, True, True): "not_masked",
    (True, False, True): "introduced",
    (False, True, True): "not_covered",
    (True, False, False): "not_found",
    (False, True, False): "hidden",
    (False, False, True): "revealed",
}


def membership(population: DataFrame, personal: DataFrame, masked: DataFrame, key: str = "idx") -> DataFrame:
    """(key, in_population, in_personal, in_masked, class): one row per position of any set.

    One pass instead of a join per set: flags are or-ed before the shuffle. Nulls are no
    positions; repeats count once."""
    names = ("in_population", "in_personal", "in_masked")
    parts = [df.select(key, *[F.lit(name == n).alias(name) for name in names]) for n, df in zip(names, (population, personal, masked))]
    flags = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col(key).isNotNull())
    rows = flags.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in names])
    label = F.coalesce(*[F.when(F.expr(" and ".join(n if x else f"not {n}" for n, x in zip(names, flag))), F.lit(c)) for flag, c in CLASSES.items()])
    return rows.withColumn("class", label)


def set_sizes(members: DataFrame) -> DataFrame:
    """(name, n, percent): sizes of the sets, their pairs and classes, and of the union."""
    a, b, c = F.col("in_population"), F.col("in_personal"), F.col("in_masked")
    sizes = {"union": F.lit(True), "population": a, "personal": b, "masked_set": c, "population_personal": a & b, "personal_masked": b & c, "population_masked": a & c}
    sizes |= {name: F.col("class") == name for name in CLASSES.values()}
    counted = members.agg(*[F.count_if(cond).alias(name) for name, cond in sizes.items()])
    rows = counted.select(F.col("union").alias("_all"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in sizes])).alias("_s"))
    return rows.select("_s.name", "_s.n", (F.col("_s.n") * 100.0 / F.nullif(F.col("_all"), F.lit(0))).alias("percent"))


def tenth(value: Column) -> Column:
    """Which of ten bins of [0, 1] a value falls in: half-open, the last one closed. Null
    outside. Edges are k / 10 as doubles, so that no rounding moves a value on an edge."""
    inside = (value >= 0) & (value <= 1)
    bins = sum((F.when(value >= F.lit(k / 10.0), 1).otherwise(0) for k in range(1, 10)), F.lit(0))
    return F.when(inside, bins)


def histogram(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by..., bin, n) of values in [0, 1]."""
    return df.select(*by, tenth(value).alias("bin")).filter("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def bin_shares(bins: DataFrame, part: str, whole: list[str], by: str) -> DataFrame:
    """(bin, n_part, n_whole, share): how much of each bin's rows has ``by`` = ``part``, of
    those with one of ``whole``; null where there are none."""
    n_part = F.coalesce(F.sum(F.when(F.col(by) == part, F.col("n"))), F.lit(0))
    n_whole = F.coalesce(F.sum(F.when(F.col(by).isin(whole), F.col("n"))), F.lit(0))
    return bins.groupBy("bin").agg(n_part.alias("n_part"), n_whole.alias("n_whole"), F.try_divide(n_part, n_whole).alias("share"))


def altered(personal: DataFrame, masked: DataFrame, key: str | list[str] = "idx") -> DataFrame:
    """(key, alt_personal, alt_masked, freq_personal, freq_masked, altered): positions that
    both have; altered means another allele, or the same at another frequency. Null keys meet."""
    keys = [key] if isinstance(key, str) else key
    a = personal.select(*keys, F.col("alt").alias("alt_personal"), F.col("freq").alias("freq_personal"))
    b = masked.select(*keys, F.col("alt").alias("alt_masked"), F.col("freq").alias("freq_masked"))
    same = F.col("alt_personal").eqNullSafe(F.col("alt_masked")) & F.col("freq_personal").eqNullSafe(F.col("freq_masked"))
    return join_null_safe(a, b, keys).withColumn("altered", ~same)


def altered_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, n_altered, n_same, percent_altered) of ``altered``."""
    n, changed = F.count(F.lit(1)), F.count_if("altered")
    return rows.groupBy(*by).agg(n.alias("n"), changed.alias("n_altered"), (n - changed).alias("n_same"), (changed * 100.0 / n).alias("percent_altered"))
