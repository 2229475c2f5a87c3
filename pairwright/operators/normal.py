"""Normalisation of rows: moments, and normal scores of ranks (supernormalisation)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.special import normal_quantile, normal_quantile_column
from pairwright.operators.elementwise import fluctuate, uniform
from pairwright.operators.pairwise import SHAKE_BELOW


def normalize_row(m: DataFrame, value: str = "value", out: str = "x") -> DataFrame:
    """(gene, sample, x): mean 0 and population variance 1 per gene; a constant gene becomes 0."""
    w = Window.partitionBy("gene")
    sd = F.stddev_pop(value).over(w)
    return m.select("gene", "sample", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0).alias(out))


def argsort_rows(m: DataFrame) -> DataFrame:
    """(gene, sample, value, rank): position from 1 in the ascending order of a gene; ties by sample."""
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy("value", "sample")))


def score_deviation(ns: int) -> float:
    """Population standard deviation of the normal quantiles of 1 / (ns + 1) ... ns / (ns + 1)."""
    z = normal_quantile([(i + 1) / (ns + 1) for i in range(ns)])
    return math.sqrt(float((z * z).mean()))


def supernormalize(m: DataFrame, ns: int) -> DataFrame:
    """(gene, sample, z): normal scores of ranks with variance 1, without jitter.

    One sort per gene; as ranks have no ties, all genes have the same scores, so their deviation is one literal.
    """
    z = normal_quantile_column(F.col("rank") / F.lit(float(ns + 1)))
    return argsort_rows(m).select("gene", "sample", (z / F.lit(score_deviation(ns))).alias("z"))


def supernormalize_shaken(m: DataFrame, ns: int, by: float, seed: int = 0) -> DataFrame:
    """Scores with relative jitter `by` drawn by gene and the sample's place in order, normalised again."""
    place = F.row_number().over(Window.partitionBy("gene").orderBy("sample")) - 1
    z = supernormalize(m, ns).withColumn("place", place).withColumn("z", fluctuate(F.col("z"), by, seed, F.col("gene"), F.col("place")))
    return normalize_row(z, "z", "z")


def supernormalize_auto(m: DataFrame, ns: int, seed: int = 0) -> DataFrame:
    """Jitter of 2 / ns^2 below 30 samples, none from there on."""
    return supernormalize(m, ns) if ns >= SHAKE_BELOW else supernormalize_shaken(m, ns, 2 / ns**2, seed)


def supernormalize_random(m: DataFrame, seed: int = 0) -> DataFrame:
    """Sorted random normal draws, by seed and cell, instead of fixed quantiles, normalised again."""
    draws = m.select("gene", normal_quantile_column(uniform(seed, F.col("gene"), F.col("sample"))).alias("z")).withColumn("rank", F.row_number().over(Window.partitionBy("gene").orderBy("z")))
    return normalize_row(argsort_rows(m).join(draws, ["gene", "rank"]).select("gene", "sample", "z"), "z", "z")
