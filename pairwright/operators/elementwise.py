"""Element-wise maps over long matrices: Column to Column, inside whole-stage codegen.

Comparisons follow C where Spark differs: NaN is neither below nor above anything, so it
passes through every bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def bound_below(c: Column, lo: float) -> Column:
    return F.when(c < lo, F.lit(float(lo))).otherwise(c)


def bound_above(c: Column, hi: float) -> Column:
    return F.when(~F.isnan(c) & (c > hi), F.lit(float(hi))).otherwise(c)


def bound_both(c: Column, lo: float, hi: float) -> Column:
    return F.when(c < lo, F.lit(float(lo))).when(~F.isnan(c) & (c > hi), F.lit(float(hi))).otherwise(c)


def set_cond(c: Column, test: Callable[[Column], Column], value: float) -> Column:
    """`value` where `test` holds."""
    return F.when(test(c), F.lit(value)).otherwise(c)


def set_inf(c: Column, value: float) -> Column:
    """`value` instead of either infinity."""
    return set_cond(c, lambda x: F.abs(x) == INF, value)


def set_nan(c: Column, value: float) -> Column:
    return F.nanvl(c, F.lit(value))


def set_value(c: Column, old: float, new: float) -> Column:
    return set_cond(c, lambda x: x == old, new)


def eq(c: Column, value: float) -> Column:
    """1 where equal, else 0."""
    return F.when(F.isnan(c), 0).otherwise((c == value).cast("int"))


def complement(p: Column) -> Column:
    return F.lit(1.0) - p


def uniform(seed: int, *key: Column) -> Column:
    """A uniform number in (0, 1) from a hash of seed and key: the same whatever the partitioning, and after a lost task."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def uniform_sql(seed: int, *key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def uniform_draw(seed: int, *key: int) -> float:
    """The same number for one key in Python."""
    return (int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def integers(seed: int, n: int, *key: Column) -> Column:
    """A draw from 0 to n - 1, by key."""
    return F.floor(uniform(seed, *key) * F.lit(float(n))).cast("long")


def fluctuate(c: Column, by: float, seed: int, *key: Column) -> Column:
    """Relative jitter: c (1 + (2u - 1) by) with u uniform by seed and key."""
    return c * (F.lit(1.0) + (F.lit(2.0) * uniform(seed, *key) - 1.0) * by)


def scale_row(m: DataFrame, factors: DataFrame) -> DataFrame:
    """(gene, sample, value) times the factor of its gene; `factors`: (gene, factor)."""
    return m.join(factors, "gene").select("gene", "sample", (F.col("value") * F.col("factor")).alias("value"))


def scale_column(m: DataFrame, factors: DataFrame) -> DataFrame:
    """The same by sample; `factors`: (sample, factor)."""
    return m.join(factors, "sample").select("gene", "sample", (F.col("value") * F.col("factor")).alias("value"))


def scale_row_by(m: DataFrame, factors: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """`scale_row` by a function of the factor."""
    return scale_row(m, factors.select("gene", f(F.col("factor")).alias("factor")))


def scale_column_by(m: DataFrame, factors: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return scale_column(m, factors.select("sample", f(F.col("factor")).alias("factor")))


def zero_diagonal(pairs: DataFrame, *columns: str) -> DataFrame:
    """0 where a pair is a variable with itself."""
    return pairs.withColumns({c: F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col(c)) for c in columns})
