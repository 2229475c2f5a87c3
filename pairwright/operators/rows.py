"""Selecting, scattering and reshaping rows of long matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.operators.elementwise import uniform


def rows_save(m: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows whose gene is in `mask` (gene)."""
    return m.join(mask.select("gene"), "gene", "left_semi")


def rows_save_nodiag(pairs: DataFrame, mask: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of the masked variables, without those of a variable with itself."""
    return pairs.filter("a <> b").join(mask.select(F.col("gene").alias("a")), "a", "left_semi")


def rows_load(m: DataFrame, new: DataFrame) -> DataFrame:
    """(gene, sample, value) with the values of `new` where it has any."""
    n = new.select("gene", "sample", F.col("value").alias("new"))
    return m.join(n, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("new", "value").alias("value"))


def rows_load_nodiag(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, value) with the values of `new` off the diagonal."""
    n = new.select("a", "b", F.col("value").alias("new"))
    take = F.when(F.col("a") != F.col("b"), F.coalesce("new", "value")).otherwise(F.col("value"))
    return pairs.join(n, ["a", "b"], "left").select("a", "b", take.alias("value"))


def first_nan(m: DataFrame) -> DataFrame:
    """The first NaN by (gene, sample): one row or none."""
    return m.filter(F.isnan("value")).orderBy("gene", "sample").limit(1).select("gene", "sample")


def strip_diagonal(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b")


def route_by_class(pairs: DataFrame, kv: DataFrame) -> DataFrame:
    """Pairs with the number of genotypes kv of their anchor (gene, kv)."""
    return pairs.join(kv.withColumnRenamed("gene", "a"), "a")


def flatten(packed: DataFrame) -> DataFrame:
    """(gene, position, value), positions from 0, of rows packed as (gene, vals)."""
    return packed.select("gene", F.posexplode("vals").alias("position", "value"))


def flatten_nodiag(packed: DataFrame) -> DataFrame:
    """Square matrix without its diagonal: (gene, position, value), positions counted without it."""
    p = F.col("position")
    return flatten(packed).filter("gene <> position").select("gene", F.when(p > F.col("gene"), p - 1).otherwise(p).alias("position"), "value")


def wrap(cells: DataFrame) -> DataFrame:
    """(gene, vals) from (gene, position, value)."""
    return cells.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("r")).select("gene", F.col("r.value").alias("vals"))


def wrap_nodiag(cells: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """Back from `flatten_nodiag`, with `diagonal` on the diagonal."""
    p = F.col("position")
    moved = cells.select("gene", F.when(p >= F.col("gene"), p + 1).otherwise(p).alias("position"), "value")
    return wrap(moved.unionByName(cells.select("gene").distinct().select("gene", F.col("gene").alias("position"), F.lit(diagonal).alias("value"))))


def pair_of_flat(index: Column, n: int) -> tuple[Column, Column]:
    """(src, dst) of an index into the off-diagonal elements of an n x n matrix."""
    src, dst = F.floor(index / F.lit(n - 1)), F.pmod(index, F.lit(n - 1))
    return src, F.when(dst >= src, dst + 1).otherwise(dst)


def categorize(m: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where `test` holds, the others; null is among the others)."""
    t = F.coalesce(test, F.lit(False))
    return m.filter(t), m.filter(~t)


def permute_rows(m: DataFrame, order: DataFrame) -> DataFrame:
    """Genes renamed by `order` (gene, to): row `gene` becomes row `to`."""
    return m.join(order, "gene").select(F.col("to").alias("gene"), "sample", "value")


def permute_columns(m: DataFrame, order: DataFrame) -> DataFrame:
    """The same for samples; `order`: (sample, to)."""
    return m.join(order, "sample").select("gene", F.col("to").alias("sample"), "value")


def shuffle_rows(m: DataFrame, seed: int) -> DataFrame:
    """Genes permuted at random: (gene, to) for `permute_rows`.  One row per gene is ordered, not the matrix."""
    genes = m.select("gene").distinct()
    at = genes.withColumn("k", F.row_number().over(Window.orderBy("gene")))
    to = genes.withColumn("k", F.row_number().over(Window.orderBy(uniform(seed, F.col("gene")), "gene"))).withColumnRenamed("gene", "to")
    return at.join(to, "k").select("gene", "to")


def chunks(m: DataFrame, parts: int) -> DataFrame:
    """Contiguous balanced blocks of genes: (gene, ..., chunk)."""
    order = Window.orderBy("gene")
    ids = m.select("gene").distinct().withColumn("chunk", F.ntile(parts).over(order) - 1)
    return m.join(ids, "gene")
