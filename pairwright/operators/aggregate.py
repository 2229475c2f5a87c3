"""Aggregates over long matrices: covariances, class statistics, extremes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.operators.elementwise import INF, bound_both
from pairwright.operators.pairwise import Pairs


def _bounded(out: DataFrame, bounded: bool) -> DataFrame:
    return out.withColumn("c", bound_both(F.col("c"), -1.0, 1.0)) if bounded else out


def cov2(x: DataFrame, y: DataFrame, ns: int, bounded: bool = False) -> DataFrame:
    """(a, b, c): mean products of all pairs of dense normalised rows (gene, sample, z).

    Rows are packed to arrays and multiplied, so no table of pairs times samples is made.
    """
    out = Pairs.plain(x, y).run("sum").withColumn("c", F.col("c") / F.lit(float(ns)))
    return _bounded(out, bounded)


def cov1(x: DataFrame, ns: int, bounded: bool = False) -> DataFrame:
    """The same of rows with each other."""
    return cov2(x, x, ns, bounded)


def cov2_sparse(x: DataFrame, y: DataFrame, ns: int, bounded: bool = False) -> DataFrame:
    """`cov2` of rows with gaps, which count as zero: a join by sample.  For small or very sparse input."""
    a = x.select(F.col("gene").alias("a"), "sample", F.col("z").alias("za"))
    b = y.select(F.col("gene").alias("b"), "sample", F.col("z").alias("zb"))
    return _bounded(a.join(b, "sample").groupBy("a", "b").agg((F.sum(F.col("za") * F.col("zb")) / F.lit(float(ns))).alias("c")), bounded)


def cov2_1v1(x: DataFrame, y: DataFrame, ns: int, bounded: bool = False) -> DataFrame:
    """(gene, c): row i of x with row i of y."""
    j = x.join(y.withColumnRenamed("z", "zb"), ["gene", "sample"]).groupBy("gene").agg((F.sum(F.col("z") * F.col("zb")) / F.lit(float(ns))).alias("c"))
    return j.withColumn("c", bound_both(F.col("c"), -1.0, 1.0)) if bounded else j


def class_stats(g: DataFrame, za: DataFrame, zb: DataFrame, ns: int) -> DataFrame:
    """(a, geno, b, f, mu_a, mu_b): share and means of every genotype class of an anchor, of dense rows."""
    return Pairs.plain(za, zb, g).run("stats")


def class_stats_sparse(g: DataFrame, za: DataFrame, zb: DataFrame, ns: int) -> DataFrame:
    """`class_stats` by joins, for rows with gaps: means are over the cells that are there."""
    a = g.select(F.col("gene").alias("a"), "sample", "geno").join(za.select(F.col("gene").alias("a"), "sample", F.col("z").alias("za")), ["a", "sample"])
    b = zb.select(F.col("gene").alias("b"), "sample", F.col("z").alias("zb"))
    grouped = a.join(b, "sample").groupBy("a", "geno", "b")
    return grouped.agg((F.count(F.lit(1)) / F.lit(float(ns))).alias("f"), F.avg("za").alias("mu_a"), F.avg("zb").alias("mu_b"))


def class_sums(stats: DataFrame) -> DataFrame:
    """(a, b, s1, s2, s12): class sums of squared means, weighted by share."""
    f = F.col("f")
    return stats.groupBy("a", "b").agg(F.sum(f * F.col("mu_a") ** 2).alias("s1"), F.sum(f * F.col("mu_b") ** 2).alias("s2"), F.sum(f * F.col("mu_a") * F.col("mu_b")).alias("s12"))


def distinct_per_row(g: DataFrame) -> DataFrame:
    """(gene, kv): exact number of different genotypes."""
    return g.groupBy("gene").agg(F.countDistinct("geno").alias("kv"))


def count_ratio(g: DataFrame) -> DataFrame:
    """(gene, geno, ratio): share of each genotype."""
    n = F.sum("n").over(Window.partitionBy("gene"))
    return g.groupBy("gene", "geno").agg(F.count(F.lit(1)).alias("n")).select("gene", "geno", (F.col("n") / n).alias("ratio"))


def minmax_nodiag(pairs: DataFrame, value: str, shift: int = 0) -> DataFrame:
    """(dmin, dmax) over pairs off the diagonal b = a + shift."""
    return pairs.filter(F.col("b") != F.col("a") + shift).agg(F.min(value).alias("dmin"), F.max(value).alias("dmax"))


def finite_max(pairs: DataFrame, value: str, nodiag: bool = False) -> DataFrame:
    """(dmax, n_nan, n_negative): largest finite value, and what makes the others invalid."""
    rows = pairs.filter("a <> b") if nodiag else pairs
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (v != INF), v)
    return rows.agg(F.max(finite).alias("dmax"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(v < 0).alias("n_negative"))


def repair_infinite(pairs: DataFrame, value: str, dmax: Column) -> DataFrame:
    return pairs.withColumn(value, F.when(F.col(value) == INF, dmax).otherwise(F.col(value)))


def cumsum(m: DataFrame) -> DataFrame:
    """(gene, sample, x): running sums along samples."""
    w = Window.partitionBy("gene").orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("gene", "sample", F.sum("value").over(w).alias("x"))


def diff(m: DataFrame) -> DataFrame:
    """(gene, sample, x): differences to the sample before; the first has none and is left out."""
    w = Window.partitionBy("gene").orderBy("sample")
    return m.select("gene", "sample", (F.col("value") - F.lag("value").over(w)).alias("x")).filter("x is not null")


def sorted_distinct(m: DataFrame) -> DataFrame:
    """(gene, position, x): a gene's different values in order."""
    w = Window.partitionBy("gene").orderBy("x")
    return m.select("gene", F.col("value").alias("x")).distinct().select("gene", F.row_number().over(w).alias("position"), "x")


def real_histogram(pairs: DataFrame, value: str, edges: list[float], n: int) -> DataFrame:
    """(a, bin, cnt, dens) of the values of every a; values outside the edges count in n only."""
    bins = F.array(*[F.lit(float(e)) for e in edges])
    at = F.size(F.filter(bins, lambda e: e <= F.col(value))) - 1
    width = F.get(bins, F.col("bin") + 1) - F.get(bins, F.col("bin"))
    counts = pairs.select("a", at.alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1)).groupBy("a", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("a", "bin", "cnt", (F.col("cnt") / (F.lit(float(n)) * width)).alias("dens"))
