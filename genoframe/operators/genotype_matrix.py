"""Genotypes of many samples: sites, dosages and principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples up to which a matrix of samples by samples is built (it goes to the driver).
MAX_SAMPLES = 4000


def split_alternatives(rows: DataFrame) -> DataFrame:
    """One row per alternative of ``alts``, with ``alt``, ``alt_no`` (from 1) and ``site_id``
    (contig:position:ref:alt)."""
    split = rows.select("*", F.posexplode("alts").alias("_at", "alt")).withColumn("alt_no", F.col("_at") + 1).drop("_at", "alts")
    return split.withColumn("site_id", F.concat_ws(":", "contig_name", F.col("vcf_pos").cast("string"), "ref", "alt"))


def dosages(rows: DataFrame) -> DataFrame:
    """(site_id, sample_id, dosage): how often the called genotype has the alternative.

    Needs ``gt`` (0/1, 1|1 ...). A genotype with a missing part has the reference there, and
    a sample listed twice at a site its greatest dosage."""
    calls = F.regexp_extract_all(F.col("gt"), F.lit("([0-9]+)"), F.lit(1))
    n = F.size(F.filter(calls, lambda c: c.cast("int") == F.col("alt_no")))
    return rows.select("site_id", "sample_id", n.alias("dosage")).filter("sample_id is not null").groupBy("site_id", "sample_id").agg(F.max("dosage").alias("dosage"))


def _samples(rows: DataFrame) -> list[str]:
    """Names of all samples, in order: the columns of a cohort's matrix."""
    names = [r[0] for r in rows.filter("sample_id is not null").select("sample_id").distinct().orderBy("sample_id").limit(MAX_SAMPLES + 1).collect()]
    if len(names) > MAX_SAMPLES:
        raise ValueError(f"a matrix of more than {MAX_SAMPLES} samples")
    return names


def cohort(rows: DataFrame, missing: str = "0/0") -> DataFrame:
    """(site_id, genotypes): each site's genotypes of all samples, in the order of their names;
    ``missing`` where a sample isn't listed. Of several genotypes of one the greatest stands."""
    once = rows.filter("sample_id is not null").groupBy("site_id", "sample_id").agg(F.max("gt").alias("gt"))
    site = once.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "gt"))).alias("_g"))
    names = F.array(*[F.lit(s) for s in _samples(rows)]).cast("array<string>")
    return site.select("site_id", F.transform(names, lambda s: F.coalesce(F.try_element_at("_g", s), F.lit(missing))).alias("genotypes"))


def principal_components(long: DataFrame, k: int) -> DataFrame:
    """(sample_id, component, weight, explained): the first ``k`` components of the samples.

    Each site is a row vector over the samples, 0 where a sample isn't listed, centred by
    the decomposition; sites stay distributed and only samples by samples is gathered."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    spark = long.sparkSession
    samples = _samples(long)
    names = F.array(*[F.lit(s) for s in samples])
    site = long.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", "dosage"))).alias("_d"))
    vector = F.transform(names, lambda s: F.coalesce(F.try_element_at("_d", s), F.lit(0)).cast("double"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(site.select(array_to_vector(vector).alias("x")))
    weights, share = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(s, c + 1, float(weights[i, c]), float(share[c])) for i, s in enumerate(samples) for c in range(k)]
    return spark.createDataFrame(rows, "sample_id string, component int, weight double, explained double")


def masked_pairs(points: DataFrame, suffix: str = "_masked") -> DataFrame:
    """(sample_id, component, weight, masked_weight): samples beside their masked twins."""
    twins = points.filter(F.col("sample_id").endswith(suffix)).select(F.regexp_replace("sample_id", f"{suffix}$", "").alias("sample_id"), "component", F.col("weight").alias("masked_weight"))
    return points.select("sample_id", "component", "weight").join(twins, ["sample_id", "component"])
