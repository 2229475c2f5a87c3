"""Registered queries over the fixtures, and the same in DuckDB's SQL.

Reals are rounded to six places on both sides; adding 0 turns a negative zero positive.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import special
from pairwright.operators import aggregate as agg
from pairwright.operators import elementwise as el
from pairwright.operators import histogram, normal, rows
from pairwright.operators.dag import adjacency
from pairwright.operators.pairwise import Pairs, mismatched_rows, pack
from pairwright.plans import api
from pairwright.plans import fixtures as fx
from pairwright.plans.posterior_sql import five_ctes, histogram_rows, largest_cte, null_ctes, posterior_ctes
from pairwright.plans.session import shared_folder
from pairwright.sources import matrix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def q6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def samples(m: DataFrame) -> int:
    return m.select("sample").distinct().count()


# Normal scores: z of table x as CTE text.
def _scores(x: str) -> str:
    q = special.normal_quantile_sql("p")
    return (
        f"SELECT gene, sample, q / sqrt(avg(q * q) OVER (PARTITION BY gene)) AS z FROM (SELECT gene, sample, {q} AS q FROM "
        f"(SELECT gene, sample, row_number() OVER (PARTITION BY gene ORDER BY value, sample)::DOUBLE / (1.0 + count(*) OVER (PARTITION BY gene)) AS p FROM {x}))"
    )


_RHO = "SELECT x.gene AS a, y.gene AS b, greatest(-1.0, least(1.0, sum(x.z * y.z) / count(*))) AS rho FROM {0} x JOIN {1} y ON x.sample = y.sample GROUP BY 1, 2"
_INF = "'Infinity'::DOUBLE"


def _hl(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN -0.5 * ln({x}) ELSE {_INF} END)"


_V = "greatest((1 - s1) * (1 - s2) - (rho - s12) * (rho - s12), 1.17549435e-38)"
_L = {
    "l1": f"greatest(0.0, {_hl('(1 - s1)')})",
    "l2": f"greatest(0.0, {_hl('(1 - s2)')})",
    "l3": f"greatest(0.0, {_hl(_V)} - {_hl('(1 - s1)')} - {_hl('(1 - rho * rho)')})",
    "l4": f"greatest(0.0, {_hl(_V)} - {_hl('(1 - s1)')})",
    "l5": f"greatest(0.0, {_hl(_V)} - {_hl('(1 - s1)')} - {_hl('(1 - s2)')})",
}
_FIVE = ", ".join(f"{e} AS {k}" for k, e in _L.items())


def _continuous(g: str, t: str, t2: str) -> dict[str, str]:
    return {
        "za": _scores(t), "zb": _scores(t2), "ze": _scores(g),
        "rab": _RHO.format("za", "zb"), "reb": _RHO.format("ze", "zb"),
        "rea": "SELECT x.gene AS a, greatest(-1.0, least(1.0, sum(x.z * y.z) / count(*))) AS r FROM ze x JOIN za y ON x.sample = y.sample AND x.gene = y.gene GROUP BY 1",
        "s": "SELECT rab.a, rab.b, rab.rho, rea.r * rea.r AS s1, reb.rho * reb.rho AS s2, rea.r * reb.rho AS s12 FROM rab JOIN reb ON rab.a = reb.a AND rab.b = reb.b JOIN rea ON rea.a = rab.a",
        "l": f"SELECT a, b, {_FIVE} FROM s",
    }


def _discrete(g: str, t: str, t2: str) -> dict[str, str]:
    return {
        "za": _scores(t), "zb": _scores(t2),
        "rab": _RHO.format("za", "zb"),
        "cls": f"SELECT g.gene AS a, g.geno, y.gene AS b, count(*)::DOUBLE / (SELECT count(DISTINCT sample) FROM {t}) AS f, avg(x.z) AS ma, avg(y.z) AS mb FROM {g} g JOIN za x ON x.gene = g.gene AND x.sample = g.sample JOIN zb y ON y.sample = g.sample GROUP BY 1, 2, 3",
        "cs": "SELECT a, b, sum(f * ma * ma) AS s1, sum(f * mb * mb) AS s2, sum(f * ma * mb) AS s12 FROM cls GROUP BY a, b",
        "s": "SELECT rab.a, rab.b, rab.rho, s1, s2, s12 FROM rab JOIN cs ON rab.a = cs.a AND rab.b = cs.b",
        "l": f"SELECT a, b, {_FIVE} FROM s",
    }


#: p-values are compared twice, as they are and by their logarithm, which shows the tail.
_LEAST = 1e-300


def tails(df: DataFrame) -> DataFrame:
    return df.withColumns({"t" + c[1:]: F.log10(F.greatest(F.col(c), F.lit(_LEAST))) for c in df.columns if c[0] == "p"})


def _pv(columns: dict[str, str], source: str) -> str:
    """p-values by name, with the logarithm of each, from expressions over `source` (a, b, ...)."""
    both = ", ".join(f"{q6(p, p)}, {q6(f'log10(greatest({p}, {_LEAST!r}::DOUBLE))', 't' + p[1:])}" for p in columns)
    return f"SELECT a, b, {both} FROM (SELECT a, b, {', '.join(f'{x} AS {p}' for p, x in columns.items())} FROM {source} WHERE a <> b)"


def _five_pv(freedom: dict[int, tuple[int, int]]) -> str:
    return _pv({f"p{t}": special.null_sf_sql(f"l{t}", *d) for t, d in freedom.items()}, "l")


def _rank_pv(ns: int) -> str:
    return _pv({"p": special.null_sf_sql("llr", 1, ns - 2)}, f"(SELECT a, b, greatest(0.0, {_hl('(1 - rho * rho)')}) AS llr FROM r)")


def _kv_freedom(ns: int, kv: int) -> dict[int, tuple[int, int]]:
    return {1: (kv - 1, ns - kv), 2: (kv - 1, ns - kv), 3: (kv - 1, ns - kv - 1), 4: (kv, ns - kv - 1), 5: (1, ns - kv - 1)}


#: Samples of the embedding fixture at the scales that oracles are compared on, and months of the supplier fixture.
NS, MONTHS = 500, 83

# --- rows and elements -------------------------------------------------------------------


@query("normalize_row", fx.with_ctes(f"SELECT gene, sample, {q6('(value - avg(value) OVER w) / stddev_pop(value) OVER w', 'x')} FROM e WINDOW w AS (PARTITION BY gene)", "e"))
def _(spark, d):
    return normal.normalize_row(fx.emb_expr(spark, d))


@query("supernormalize", fx.with_ctes(f"SELECT gene, sample, {q6('z', 'z')} FROM z", "e", z=_scores("e")))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return normal.supernormalize_auto(e, samples(e))


@query("argsort_rows", fx.with_ctes(f"SELECT gene, sample, {q6('value', 'value')}, row_number() OVER (PARTITION BY gene ORDER BY value, sample)::INT AS rank FROM e", "e"))
def _(spark, d):
    return normal.argsort_rows(fx.emb_expr(spark, d))


def _again(z: str, x: str) -> str:
    """Mean 0 and variance 1 per gene."""
    return f"SELECT gene, sample, ({z} - avg({z}) OVER w) / stddev_pop({z}) OVER w AS z FROM ({x}) WINDOW w AS (PARTITION BY gene)"


def _shaken(by: str, seed: int, z: str = "z") -> str:
    """Jitter of scores z, drawn by gene and the sample's place, normalised again."""
    u = el.uniform_sql(seed, "gene", "place")
    return _again("y", f"SELECT gene, sample, z * (1 + (2 * {u} - 1) * {by}) AS y FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY sample) - 1 AS place FROM {z})")


@query("row_jitter", fx.with_ctes(f"SELECT gene, sample, {q6('z', 'z')} FROM j", "e", z=_scores("e"), j=_shaken("1e-3", 7)))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return normal.supernormalize_shaken(e, samples(e), 1e-3, 7)


_DRAWS = f"SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY z) AS rank, z FROM (SELECT gene, {special.normal_quantile_sql('u')} AS z FROM (SELECT gene, {el.uniform_sql(7, 'gene', 'sample')} AS u FROM e))"
_BY_RANK = "SELECT gene, sample, row_number() OVER (PARTITION BY gene ORDER BY value, sample) AS rank FROM e"


@query("supernormalize_random", fx.with_ctes(f"SELECT gene, sample, {q6('z', 'z')} FROM n", "e", d=_DRAWS, r=_BY_RANK, n=_again("z", "SELECT r.gene, r.sample, d.z FROM r JOIN d ON d.gene = r.gene AND d.rank = r.rank")))
def _(spark, d):
    return normal.supernormalize_random(fx.emb_expr(spark, d), 7)


_ELEMENTS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "bound_below": (lambda c: el.bound_below(c, -0.1), "greatest(value, -0.1::DOUBLE)"),
    "bound_above": (lambda c: el.bound_above(c, 0.1), "least(value, 0.1::DOUBLE)"),
    "bound_both": (lambda c: el.bound_both(c, -0.1, 0.1), "greatest(least(value, 0.1::DOUBLE), -0.1::DOUBLE)"),
    "set_cond": (lambda c: el.set_cond(c, lambda x: x * x > 0.04, 9.0), "CASE WHEN value * value > 0.04 THEN 9.0 ELSE value END"),
    "set_inf": (lambda c: el.set_inf(F.when(c > 0.2, el.INF).otherwise(c), 5.0), "CASE WHEN value > 0.2 THEN 5.0 ELSE value END"),
    "set_nan": (lambda c: el.set_nan(F.when(c > 0.2, float("nan")).otherwise(c), 5.0), "CASE WHEN value > 0.2 THEN 5.0 ELSE value END"),
    "set_value": (lambda c: el.set_value(el.bound_below(c, 0.0), 0.0, -3.0), "CASE WHEN value <= 0 THEN -3.0 ELSE value END"),
    "eq": (lambda c: el.eq(el.bound_below(c, 0.0), 0.0).cast("double"), "(value <= 0)::INT::DOUBLE"),
    "complement": (el.complement, "1.0 - value"),
    "log1p": (lambda c: F.log1p(F.abs(c)), "ln(1 + abs(value))"),
}
for _name, (_f, _sql) in _ELEMENTS.items():
    query(_name, fx.with_ctes(f"SELECT gene, sample, {q6(_sql, 'x')} FROM e", "e"))(lambda spark, d, f=_f: fx.emb_expr(spark, d).select("gene", "sample", f(F.col("value")).alias("x")))


@query("integer_draws", fx.with_ctes(f"SELECT gene, sample, floor({el.uniform_sql(3, 'gene', 'sample')} * 10)::BIGINT AS x FROM e", "e"))
def _(spark, d):
    return fx.emb_expr(spark, d).select("gene", "sample", el.integers(3, 10, F.col("gene"), F.col("sample")).alias("x"))


@query("scale_row", fx.with_ctes(f"SELECT gene, sample, {q6('value * sqrt(gene + 1)', 'value')} FROM e", "e"))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return el.scale_row_by(e, e.select("gene").distinct().withColumn("factor", F.col("gene") + 1.0), F.sqrt)


@query("scale_column", fx.with_ctes(f"SELECT gene, sample, {q6('value * (sample % 7)', 'value')} FROM e", "e"))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return el.scale_column(e, e.select("sample").distinct().withColumn("factor", (F.col("sample") % 7).cast("double")))


@query("rows_save", fx.with_ctes(f"SELECT gene, sample, {q6('value', 'value')} FROM e WHERE gene IN (SELECT gene FROM e GROUP BY gene HAVING avg(value) > 0)", "e"))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return rows.rows_save(e, e.groupBy("gene").agg(F.avg("value").alias("m")).filter("m > 0"))


@query("rows_load", fx.with_ctes(f"SELECT gene, sample, {q6('CASE WHEN gene < 8 THEN value + 1 ELSE value END', 'value')} FROM e", "e"))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return rows.rows_load(e, e.filter("gene < 8").withColumn("value", F.col("value") + 1))


_SQUARE = "SELECT x.gene AS a, y.gene AS b, sum(x.value * y.value) AS value FROM ea x JOIN ea y ON x.sample = y.sample GROUP BY 1, 2"


def _square(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, value) of the 8 x 8 products of sources."""
    z = fx.emb_a(spark, d).withColumnRenamed("value", "z")
    return agg.cov2(z, z, 1).withColumnRenamed("c", "value")


@query("rows_save_nodiag", fx.with_ctes(f"SELECT a, b, {q6('value', 'value')} FROM m WHERE a <> b AND a < 4", "ea", m=_SQUARE))
def _(spark, d):
    m = _square(spark, d)
    return rows.rows_save_nodiag(m, m.select(F.col("a").alias("gene")).distinct().filter("gene < 4"))


@query("rows_load_nodiag", fx.with_ctes(f"SELECT a, b, {q6('CASE WHEN a <> b AND a < 4 THEN -value ELSE value END', 'value')} FROM m", "ea", m=_SQUARE))
def _(spark, d):
    m = _square(spark, d)
    return rows.rows_load_nodiag(m, m.filter("a < 4").withColumn("value", -F.col("value")))


@query("strip_diagonal", fx.with_ctes(f"SELECT a, b, {q6('value', 'value')} FROM m WHERE a <> b", "ea", m=_SQUARE))
def _(spark, d):
    return rows.strip_diagonal(_square(spark, d))


@query("zero_diagonal", fx.with_ctes(f"SELECT a, b, {q6('CASE WHEN a = b THEN 0 ELSE value END', 'value')} FROM m", "ea", m=_SQUARE))
def _(spark, d):
    return el.zero_diagonal(_square(spark, d), "value")


def _packed_square(spark: SparkSession, d: str) -> DataFrame:
    return rows.wrap(_square(spark, d).select(F.col("a").alias("gene"), F.col("b").alias("position"), "value"))


@query("flatten", fx.with_ctes(f"SELECT a AS gene, b AS position, {q6('value', 'value')} FROM m", "ea", m=_SQUARE))
def _(spark, d):
    return rows.flatten(_packed_square(spark, d))


@query("flatten_nodiag", fx.with_ctes(f"SELECT a AS gene, CASE WHEN b > a THEN b - 1 ELSE b END AS position, {q6('value', 'value')} FROM m WHERE a <> b", "ea", m=_SQUARE))
def _(spark, d):
    return rows.flatten_nodiag(_packed_square(spark, d))


@query("wrap_nodiag", fx.with_ctes(f"SELECT a AS gene, b AS position, {q6('CASE WHEN a = b THEN 0 ELSE value END', 'value')} FROM m", "ea", m=_SQUARE))
def _(spark, d):
    return rows.flatten(rows.wrap_nodiag(rows.flatten_nodiag(_packed_square(spark, d))))


@query("pair_of_flat", "SELECT i::BIGINT AS i, (i // 24)::BIGINT AS src, (CASE WHEN i % 24 >= i // 24 THEN i % 24 + 1 ELSE i % 24 END)::BIGINT AS dst FROM range(600) t(i)")
def _(spark, d):
    src, dst = rows.pair_of_flat(F.col("id"), 25)
    return spark.range(600).select(F.col("id").alias("i"), src.cast("long").alias("src"), dst.cast("long").alias("dst"))


@query("categorize", fx.with_ctes("SELECT gene, (count(*) FILTER (value > 0))::BIGINT AS yes, (count(*) FILTER (NOT value > 0))::BIGINT AS no FROM e GROUP BY gene", "e"))
def _(spark, d):
    yes, no = rows.categorize(fx.emb_expr(spark, d), F.col("value") > 0)
    return yes.groupBy("gene").agg(F.count(F.lit(1)).alias("yes")).join(no.groupBy("gene").agg(F.count(F.lit(1)).alias("no")), "gene")


@query("permute_rows", fx.with_ctes(f"SELECT 63 - gene AS gene, sample, {q6('value', 'value')} FROM e", "e"))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return rows.permute_rows(e, e.select("gene").distinct().withColumn("to", F.lit(63) - F.col("gene")))


@query("permute_columns", fx.with_ctes(f"SELECT gene, (SELECT max(sample) FROM e) - sample AS sample, {q6('value', 'value')} FROM e", "e"))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    top = e.agg(F.max("sample")).first()[0]
    return rows.permute_columns(e, e.select("sample").distinct().withColumn("to", F.lit(top) - F.col("sample")))


_SHUFFLED = f"SELECT x.gene, y.gene AS dst FROM (SELECT gene, row_number() OVER (ORDER BY gene) AS k FROM (SELECT DISTINCT gene FROM e)) x JOIN (SELECT gene, row_number() OVER (ORDER BY {el.uniform_sql(5, 'gene')}, gene) AS k FROM (SELECT DISTINCT gene FROM e)) y USING (k)"


@query("shuffle_rows", fx.with_ctes(f"SELECT dst AS gene, sample, {q6('value', 'value')} FROM e JOIN s USING (gene)", "e", s=_SHUFFLED))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return rows.permute_rows(e, rows.shuffle_rows(e, 5))


@query("chunks", fx.with_ctes("SELECT gene, (ntile(5) OVER (ORDER BY gene) - 1)::INT AS chunk FROM (SELECT DISTINCT gene FROM e)", "e"))
def _(spark, d):
    return rows.chunks(fx.emb_expr(spark, d).select("gene").distinct(), 5)


@query("first_nan", fx.with_ctes("SELECT gene, sample FROM e WHERE value > 0.2 ORDER BY gene, sample LIMIT 1", "e"))
def _(spark, d):
    return rows.first_nan(fx.emb_expr(spark, d).withColumn("value", F.when(F.col("value") > 0.2, float("nan")).otherwise(F.col("value"))))


@query("cumsum", fx.with_ctes(f"SELECT gene, sample, {q6('sum(value) OVER (PARTITION BY gene ORDER BY sample)', 'x')} FROM e", "e"))
def _(spark, d):
    return agg.cumsum(fx.emb_expr(spark, d))


@query("diff", fx.with_ctes(f"SELECT gene, sample, {q6('x', 'x')} FROM (SELECT gene, sample, value - lag(value) OVER (PARTITION BY gene ORDER BY sample) AS x FROM e) WHERE x IS NOT NULL", "e"))
def _(spark, d):
    return agg.diff(fx.emb_expr(spark, d))


@query("sorted_distinct", fx.with_ctes(f"SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY value)::INT AS position, {q6('value', 'x')} FROM (SELECT DISTINCT gene, value FROM sg)", "sg"))
def _(spark, d):
    return agg.sorted_distinct(fx.sup_expr(spark, d))


# --- aggregates --------------------------------------------------------------------------


@query("cov1", fx.with_ctes(f"SELECT a, b, {q6('rho', 'c')} FROM r", "e", z=_scores("e"), r=_RHO.format("z", "z")))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    ns = samples(e)
    return agg.cov1(normal.supernormalize(e, ns), ns, bounded=True)


@query("cov2", fx.with_ctes(f"SELECT x.gene AS a, y.gene AS b, {q6('sum(x.z * y.z) / count(*)', 'c')} FROM za x JOIN zb y ON x.sample = y.sample GROUP BY 1, 2", "ea", "eb", za=_scores("ea"), zb=_scores("eb")))
def _(spark, d):
    ns = samples(fx.emb_a(spark, d))
    return agg.cov2(normal.supernormalize(fx.emb_a(spark, d), ns), normal.supernormalize(fx.emb_b(spark, d), ns), ns)


@query("cov2_bounded", fx.with_ctes(f"SELECT a, b, {q6('rho', 'c')} FROM r", "ea", "eb", za=_scores("ea"), zb=_scores("eb"), r=_RHO.format("za", "zb")))
def _(spark, d):
    ns = samples(fx.emb_a(spark, d))
    return agg.cov2(normal.supernormalize(fx.emb_a(spark, d), ns), normal.supernormalize(fx.emb_b(spark, d), ns), ns, bounded=True)


@query("cov2_1v1", fx.with_ctes(f"SELECT x.gene, {q6('sum(x.z * y.z) / count(*)', 'c')} FROM za x JOIN ze y ON x.sample = y.sample AND x.gene = y.gene GROUP BY 1", "ea", "ec", za=_scores("ea"), ze=_scores("ec")))
def _(spark, d):
    ns = samples(fx.emb_a(spark, d))
    return agg.cov2_1v1(normal.supernormalize(fx.emb_a(spark, d), ns), normal.supernormalize(fx.emb_anchor_c(spark, d), ns), ns, bounded=True)


def _normal_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    ns = samples(fx.emb_a(spark, d))
    return normal.supernormalize(fx.emb_a(spark, d), ns), normal.supernormalize(fx.emb_b(spark, d), ns), ns


@query("geno_class_stats", fx.with_ctes(f"SELECT a, geno, b, {q6('f', 'f')}, {q6('ma', 'mu_a')}, {q6('mb', 'mu_b')} FROM cls", "ea", "eb", "ed", **{k: v for k, v in _discrete("ed", "ea", "eb").items() if k in ("za", "zb", "cls")}))
def _(spark, d):
    za, zb, ns = _normal_pair(spark, d)
    return agg.class_stats(fx.emb_anchor_d(spark, d), za, zb, ns)


@query("geno_class_sums", fx.with_ctes(f"SELECT a, b, {q6('s1', 's1')}, {q6('s2', 's2')}, {q6('s12', 's12')} FROM cs", "ea", "eb", "ed", **{k: v for k, v in _discrete("ed", "ea", "eb").items() if k in ("za", "zb", "cls", "cs")}))
def _(spark, d):
    za, zb, ns = _normal_pair(spark, d)
    return agg.class_sums(agg.class_stats(fx.emb_anchor_d(spark, d), za, zb, ns))


@query("geno_kv", fx.with_ctes("SELECT gene, count(DISTINCT geno)::BIGINT AS kv FROM el GROUP BY gene", "el"))
def _(spark, d):
    return agg.distinct_per_row(fx.emb_anchor_label(spark, d))


@query("geno_count_ratio", fx.with_ctes(f"SELECT gene, geno, {q6('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY gene)', 'ratio')} FROM el GROUP BY gene, geno", "el"))
def _(spark, d):
    return agg.count_ratio(fx.emb_anchor_label(spark, d))


@query("route_by_class", fx.with_ctes("SELECT kv, count(*)::BIGINT AS n FROM (SELECT gene AS a, count(DISTINCT geno)::BIGINT AS kv FROM el GROUP BY gene) k JOIN (SELECT x.gene AS a FROM (SELECT DISTINCT gene FROM ea) x CROSS JOIN (SELECT DISTINCT gene FROM eb) y) p ON p.a = k.a GROUP BY kv", "ea", "eb", "el"))
def _(spark, d):
    za, zb, ns = _normal_pair(spark, d)
    return rows.route_by_class(agg.cov2(za, zb, ns), agg.distinct_per_row(fx.emb_anchor_label(spark, d))).groupBy("kv").agg(F.count(F.lit(1)).alias("n"))


@query("minmax_nodiag", fx.with_ctes(f"SELECT {q6('min(rho)', 'dmin')}, {q6('max(rho)', 'dmax')} FROM r WHERE a <> b", "ea", "eb", za=_scores("ea"), zb=_scores("eb"), r=_RHO.format("za", "zb")))
def _(spark, d):
    za, zb, ns = _normal_pair(spark, d)
    return agg.minmax_nodiag(agg.cov2(za, zb, ns, bounded=True), "c")


_RANK = {"z": _scores("e"), "r": _RHO.format("z", "z")}


#: Ratios with some made invalid: infinite from gene 40 on, NaN with gene 5, negative with gene 7.
_BROKEN = f"SELECT a, b, CASE WHEN a >= 40 THEN {_INF} WHEN b = 5 THEN 'NaN'::DOUBLE WHEN b = 7 THEN -1.0 - x ELSE x END AS x FROM (SELECT a, b, greatest(0.0, {_hl('(1 - rho * rho)')}) AS x FROM r) WHERE a <> b"


@query("llr_max", fx.with_ctes(f"SELECT {q6('max(x) FILTER (isfinite(x))', 'dmax')}, (count(*) FILTER (isnan(x)))::BIGINT AS n_nan, (count(*) FILTER (x < 0))::BIGINT AS n_negative FROM m", "e", **_RANK, m=_BROKEN))
def _(spark, d):
    e, x = fx.emb_expr(spark, d), F.col("llr")
    broken = F.when(F.col("a") >= 40, el.INF).when(F.col("b") == 5, float("nan")).when(F.col("b") == 7, F.lit(-1.0) - x).otherwise(x)
    return agg.finite_max(api.rank_llr(e, e).withColumn("llr", broken), "llr", nodiag=True)


@query("cmprow", fx.with_ctes("SELECT gene::INT AS a, (gene + 100)::INT AS b FROM (SELECT DISTINCT gene FROM ea)", "ea"))
def _(spark, d):
    a = fx.emb_a(spark, d)
    return mismatched_rows(pack(a), pack(fx.emb_b(spark, d).withColumn("gene", F.col("gene") + 100)), False)


# --- ratios, p-values --------------------------------------------------------------------


@query("rank_llr", fx.with_ctes(f"SELECT a, b, {q6('greatest(0.0, ' + _hl('(1 - rho * rho)') + ')', 'llr')} FROM r WHERE a <> b", "e", **_RANK))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return api.rank_llr(e, e).filter("a <> b")


@query("rank_pv", fx.with_ctes(_rank_pv(NS), "e", **_RANK))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return tails(api.rank_pv(e, e).filter("a <> b"))


#: Fewer than 30 samples: scores are shaken.
_FEW = {"zs": _scores("yg"), "z": _shaken("2.0 / ((SELECT count(DISTINCT sample) FROM yg) ** 2)", 0, "zs")}


@query("few_supernormalize", fx.with_ctes(f"SELECT gene, sample, {q6('z', 'z')} FROM z", "yg", **_FEW))
def _(spark, d):
    y = fx.year_expr(spark, d)
    return normal.supernormalize_auto(y, samples(y))


@query("few_rank_llr", fx.with_ctes(f"SELECT a, b, {q6('greatest(0.0, ' + _hl('(1 - rho * rho)') + ')', 'llr')} FROM r WHERE a <> b", "yg", **_FEW, r=_RHO.format("z", "z")))
def _(spark, d):
    y = fx.year_expr(spark, d)
    return api.rank_llr(y, y).filter("a <> b")


_C = ("ea", "eb", "ec")
_D = ("ea", "eb", "ed")
_FIVE_L = "SELECT a, b, " + ", ".join(q6(k, k) for k in _L) + " FROM l"


@query("cassist_llr", fx.with_ctes(_FIVE_L + " WHERE a <> b", *_C, **_continuous("ec", "ea", "eb")))
def _(spark, d):
    return api.cassist_llr(fx.emb_anchor_c(spark, d), fx.emb_a(spark, d), fx.emb_b(spark, d)).filter("a <> b")


@query("cassist_pv", fx.with_ctes(_five_pv({1: (1, NS - 2), 2: (1, NS - 2), 3: (1, NS - 3), 4: (2, NS - 3), 5: (1, NS - 3)}), *_C, **_continuous("ec", "ea", "eb")))
def _(spark, d):
    return tails(api.cassist_pv(fx.emb_anchor_c(spark, d), fx.emb_a(spark, d), fx.emb_b(spark, d)).filter("a <> b"))


@query("gassist_llr", fx.with_ctes(_FIVE_L + " WHERE a <> b", *_D, **_discrete("ed", "ea", "eb")))
def _(spark, d):
    return api.gassist_llr(fx.emb_anchor_d(spark, d), fx.emb_a(spark, d), fx.emb_b(spark, d)).filter("a <> b")


@query("gassist_pv", fx.with_ctes(_five_pv(_kv_freedom(NS, 3)), *_D, **_discrete("ed", "ea", "eb")))
def _(spark, d):
    return tails(api.gassist_pv(fx.emb_anchor_d(spark, d), fx.emb_a(spark, d), fx.emb_b(spark, d)).filter("a <> b"))


@query("gassist_pv_label", fx.with_ctes(_five_pv(_kv_freedom(NS, 10)), "ea", "eb", "el", **_discrete("el", "ea", "eb")))
def _(spark, d):
    return tails(api.gassist_pv(fx.emb_anchor_label(spark, d), fx.emb_a(spark, d), fx.emb_b(spark, d)).filter("a <> b"))


@query("sup_rank_pv", fx.with_ctes(_rank_pv(MONTHS), "sg", z=_scores("sg"), r=_RHO.format("z", "z")))
def _(spark, d):
    s = fx.sup_expr(spark, d)
    return tails(api.rank_pv(s, s).filter("a <> b"))


@query("sup_gassist_pv", fx.with_ctes(_five_pv(_kv_freedom(MONTHS, 3)), "sg", "sd", **_discrete("sd", "sg", "sg")))
def _(spark, d):
    s = fx.sup_expr(spark, d)
    return tails(api.gassist_pv(fx.sup_anchor_d(spark, d), s, s).filter("a <> b"))


_GRID = [(1, 498), (1, 81), (2, 9), (3, 8), (4, 11), (9, 40)]


@query("null_cdf", " UNION ALL ".join(f"SELECT {a} AS n1, {b} AS n2, {q6('x', 'x')}, {q6(special.null_sf_sql('x', a, b), 'q')} FROM (SELECT i / 50.0::DOUBLE AS x FROM range(0, 60) t(i))" for a, b in _GRID))
def _(spark, d):
    x = spark.range(60).select((F.col("id") / F.lit(50.0)).alias("x"))
    out = None
    for a, b in _GRID:
        part = x.select(F.lit(a).alias("n1"), F.lit(b).alias("n2"), "x", special.null_sf_column(F.col("x"), a, b).alias("q"))
        out = part if out is None else out.unionByName(part)
    return out


@query("null_pdf", " UNION ALL ".join(f"SELECT {a} AS n1, {b} AS n2, {q6('x', 'x')}, {q6(f'exp(({a / 2 - 1!r}) * ln(1 - exp(-2 * x)) - {b} * x + ln(2) + lgamma({(a + b) / 2!r}) - lgamma({a / 2!r}) - lgamma({b / 2!r}))', 'd')} FROM (SELECT i / 50.0::DOUBLE AS x FROM range(1, 60) t(i))" for a, b in _GRID))
def _(spark, d):
    x = np.arange(1, 60) / 50.0
    return spark.createDataFrame([(a, b, float(u), float(v)) for a, b in _GRID for u, v in zip(x, special.null_pdf(x, a, b))], "n1 int, n2 int, x double, d double")


# --- histograms, posteriors, networks ----------------------------------------------------


def _hist_rows(more: str, source: str, targets: int) -> str:
    return f"SELECT {more}bin, {q6('lo', 'lo')}, {q6('hi', 'hi')}, {q6('dens', 'dens')} FROM ({histogram_rows(source, targets)})"


def _class_hists() -> str:
    ctes, parts = dict(_discrete("ed", "ea", "eb")), []
    for t in (2, 3, 4, 5):
        ctes[f"top{t}"] = largest_cte("l", f"l{t}", True)
        for kv in (2, 3, 10):
            ctes |= null_ctes(f"n{t}_{kv}", f"top{t}", 56, _kv_freedom(NS, kv)[t])
            parts.append(_hist_rows(f"{t}::INT AS test, {kv}::INT AS kv, ", f"n{t}_{kv}", 56))
    return fx.with_ctes(" UNION ALL ".join(parts), "ea", "eb", "ed", **ctes)


_RANK_L = {"l": f"SELECT a, b, greatest(0.0, {_hl('(1 - rho * rho)')}) AS l2 FROM r", "top": largest_cte("l", "l2", True)}


@query("null_hist", fx.with_ctes(_hist_rows("", "h", 1000), "e", **_RANK, **_RANK_L, **null_ctes("h", "top", 1000, (1, NS - 2))))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    pairs = Pairs.of(e, e, nodiag=True)
    edges, dens = histogram.null_histogram(pairs.largest()[2], 1000, *pairs.plan.freedom(2, 0))
    return spark.createDataFrame([(k, float(edges[k]), float(edges[k + 1]), float(v)) for k, v in enumerate(dens)], "bin int, lo double, hi double, dens double")


@query("null_hist_classes", _class_hists())
def _(spark, d):
    pairs = Pairs.of(fx.emb_a(spark, d), fx.emb_b(spark, d), fx.emb_anchor_d(spark, d), "discrete", nodiag=True)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows_ = histogram.null_histograms(pairs.largest(), pairs.plan.nt, pairs.plan.freedom, [2, 3, 10])
    return spark.createDataFrame(rows_, "test int, kv int, bin int, lo double, hi double, dens double")


_EDGES = [0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.1]


@query("real_hist", fx.with_ctes(
    f"SELECT a, (k - 1)::INT AS bin, count(*)::BIGINT AS cnt, {q6(f'count(*) / (63.0 * (({_EDGES}::DOUBLE[])[k + 1] - ({_EDGES}::DOUBLE[])[k]))', 'dens')} FROM (SELECT a, len(list_filter({_EDGES}::DOUBLE[], lambda z: z <= x)) AS k FROM "
    f"(SELECT a, b, greatest(0.0, {_hl('(1 - rho * rho)')}) AS x FROM r WHERE a <> b)) WHERE k BETWEEN 1 AND {len(_EDGES) - 1} GROUP BY a, k", "e", **_RANK))  # fmt: skip
def _(spark, d):
    e = fx.emb_expr(spark, d)
    return agg.real_histogram(api.rank_llr(e, e).filter("a <> b"), "llr", _EDGES, 63)


_QUANTILES = {
    "v": f"SELECT greatest(0.0, {_hl('(1 - rho * rho)')}) AS x FROM r WHERE a <> b",
    "c": "SELECT count(*) AS n, list(x ORDER BY x) AS v, least(1 - 0.1 * 5 / sqrt(count(*)), 0.9995) AS split, least(floor(sqrt(sqrt(count(*))) - 0.1 * 5), 100)::INT AS n1 FROM v",
    "l": "SELECT *, floor(n * split)::INT AS last, floor(n * split) / n1 AS step FROM c",
    "t": "SELECT *, v[last + 1] AS low, v[n] AS top, greatest(1, ceil((v[n] - v[last + 1]) / (v[last + 1] - v[floor(last - step)::INT + 1])))::INT AS n2 FROM l",
    "g": "SELECT unnest([v[floor(step * k)::INT + 1] for k in range(0, n1)]) AS x FROM t UNION SELECT unnest([low + (top - low) * k / n2 for k in range(0, n2 + 1)]) FROM t",
}


@query("quantile_bins_exact", fx.with_ctes(f"SELECT bin::INT AS bin, {q6('lo', 'lo')}, {q6('hi', 'hi')} FROM (SELECT row_number() OVER (ORDER BY x) - 1 AS bin, x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM g) WHERE hi IS NOT NULL", "e", **_RANK, **_QUANTILES))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    pairs = api.rank_llr(e, e).filter("a <> b").select("llr").toArrow()  # 4,032 values of a fixed 64 x 64 problem
    edges = histogram.quantile_bins(pairs.column("llr").to_numpy(), 0.1)
    return spark.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(len(edges) - 1)], "bin int, lo double, hi double")


#: Queries that need 56 suppliers, which sf0.01 has.
MORE_SUPPLIERS = {"sup_gassist_pijs"}


def _rank_oracle(b: str, nodiag: bool) -> str:
    ratio = f"greatest(0.0, {_hl('(1 - rho * rho)')})"
    l = f"SELECT a, b, {f'CASE WHEN a = b THEN 0.0 ELSE {ratio} END' if nodiag else ratio} AS l2 FROM r"  # noqa: E741
    more = {"za": _scores("ea"), "zb": _scores(b), "r": _RHO.format("za", "zb"), "l": l} | posterior_ctes("t2", "l", "l2", 56, (1, NS - 2), nodiag)
    return fx.with_ctes(f"SELECT a, b, {q6('p', 'p')} FROM t2", "ea", "eb", **({"ex": "SELECT * FROM e WHERE gene >= 8"} | more))


_PIJS = f"SELECT a, b, {', '.join(q6(f'p{t}', f'p{t}') for t in range(1, 6))} FROM pijs"
_PIJ = f"SELECT a, b, {q6('(p2 * p5 + p4) * 0.5', 'p')} FROM pijs"
_TRAD = f"SELECT a, b, {q6('p2 * p3', 'p')} FROM pijs"


def _five_oracle(kind: str, final: str) -> str:
    if kind == "continuous":
        names, base, freedom = _C, _continuous("ec", "ea", "eb"), {2: (1, NS - 2), 3: (1, NS - 3), 4: (2, NS - 3), 5: (1, NS - 3)}
    elif kind == "discrete":
        names, base, freedom = _D, _discrete("ed", "ea", "eb"), _kv_freedom(NS, 3)
    else:
        names, base, freedom = ("sg", "sd"), _discrete("sd", "sg", "sg"), _kv_freedom(MONTHS, 3)
    return fx.with_ctes(final, *names, **base, **five_ctes(100 if kind == "supplier" else 56, freedom))


def _assist(f: Callable, anchor: Callable) -> Query:
    return lambda spark, d: f(anchor(spark, d), fx.emb_a(spark, d), fx.emb_b(spark, d), nodiag=True)


def _sup_pijs(spark: SparkSession, d: str) -> DataFrame:
    s = fx.sup_expr(spark, d)
    return api.gassist_pijs(fx.sup_anchor_d(spark, d), s, s, nodiag=True)


with warnings.catch_warnings():
    warnings.simplefilter("ignore")  # of few bins: the fixtures have few targets on purpose
    query("rank_pij", _rank_oracle("eb", True))(lambda spark, d: api.rank(fx.emb_a(spark, d), fx.emb_b(spark, d), nodiag=True))
    query("rank_pij_disjoint", _rank_oracle("ex", False))(lambda spark, d: api.rank(fx.emb_a(spark, d), fx.emb_expr(spark, d).filter("gene >= 8")))
    for _kind, _anchor, _family in (("continuous", fx.emb_anchor_c, (api.cassist_pijs, api.cassist, api.cassist_trad)), ("discrete", fx.emb_anchor_d, (api.gassist_pijs, api.gassist, api.gassist_trad))):
        for _name, _f, _final in zip(("pijs", "pij", "pij_trad"), _family, (_PIJS, _PIJ, _TRAD)):
            query(f"{_kind[0].replace('d', 'g')}assist_{_name}", _five_oracle(_kind, _final))(_assist(_f, _anchor))
    query("sup_gassist_pijs", _five_oracle("supplier", _PIJS))(_sup_pijs)


_EDGES_SQL = (
    "SELECT row_number() OVER (ORDER BY w DESC, src, dst) AS k, src, dst, w / max(w) OVER () AS p FROM (SELECT c_nationkey::INT AS src, s_nationkey::INT AS dst, sum(l_extendedprice * (1 - l_discount)) AS w "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"
)


def _dag_oracle(final: str, most: int, nimax: int = 99, nomax: int = 99) -> str:
    """The sequential rule as recursion over edges in order: reach[v] is the set of nodes after v, as bits."""
    zeros = "[0::BIGINT for i in range(25)]"
    take = f"(reach[dst + 1] & (1::BIGINT << src)) = 0 AND nin[dst + 1] < {nimax} AND nout[src + 1] < {nomax}"
    grown = "[CASE WHEN take AND (v - 1 = src OR (reach[v] & (1::BIGINT << src)) <> 0) THEN reach[v] | reach[dst + 1] | (1::BIGINT << dst) ELSE reach[v] END for v in range(1, 26)]"
    more = "[{0}[v] + (CASE WHEN take AND v - 1 = {1} THEN 1 ELSE 0 END) for v in range(1, 26)]"
    step = f"SELECT k, {grown}, {more.format('nin', 'dst')}, {more.format('nout', 'src')}, taken + take::INT, take FROM (SELECT e.k, src, dst, reach, nin, nout, taken, {take} AS take FROM run JOIN e ON e.k = run.k + 1 WHERE taken < {most})"
    return f"WITH RECURSIVE e AS ({_EDGES_SQL}), run(k, reach, nin, nout, taken, ok) AS (SELECT 0::BIGINT, {zeros}, {zeros}, {zeros}, 0, false UNION ALL {step}) {final}"


_ACCEPTED = f"SELECT src, dst, {q6('p', 'p')} FROM run JOIN e USING (k) WHERE ok"


@query("greedy_dag", _dag_oracle(_ACCEPTED, 300))
def _(spark, d):
    return api.greedy_dag(fx.nation_edges(spark, d))


@query("greedy_dag_limits", _dag_oracle(_ACCEPTED, 100, 5, 6))
def _(spark, d):
    return api.greedy_dag(fx.nation_edges(spark, d), nam=100, nimax=5, nomax=6)


@query("greedy_dag_info", _dag_oracle("SELECT src, dst, (CASE WHEN ok IS NULL THEN 0 WHEN ok THEN e.k ELSE -e.k END)::BIGINT AS attempt FROM e LEFT JOIN run ON e.k = run.k", 100, 5, 6))
def _(spark, d):
    return api.greedy_dag_info(fx.nation_edges(spark, d), nam=100, nimax=5, nomax=6).drop("seconds")


# --- sources, sinks, bins ----------------------------------------------------------------


def _nation_matrix(spark: SparkSession, d: str) -> list[list[float]]:
    """Key and region of the nations, a matrix held by the caller: 25 rows at every scale."""
    rows_ = fx.table(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    return [[float(x) for x in r] for r in rows_]


_NATIONS = "SELECT gene, sample, value + 0.0::DOUBLE AS value FROM (SELECT (dense_rank() OVER (ORDER BY n_nationkey) - 1)::INT AS gene, s::INT AS sample, (CASE WHEN s = 0 THEN n_nationkey ELSE n_regionkey END)::DOUBLE AS value FROM nation, range(2) t(s))"


@query("source_array", _NATIONS)
def _(spark, d):
    m = _nation_matrix(spark, d)
    return matrix.from_dense(spark, m, len(m), 2)


def _file_query(bits: int) -> Query:
    def run(spark, d):
        m, path = _nation_matrix(spark, d), shared_folder(spark, "matrix")
        matrix.to_dense_file(spark, m, path, bits)
        return matrix.from_dense_file(spark, path, len(m), 2, bits)

    return run


query("source_file", _NATIONS)(_file_query(64))
query("source_file_single", _NATIONS)(_file_query(32))


@query("sink_pairs", ORACLES["rank_llr"])
def _(spark, d):
    e, path = fx.emb_expr(spark, d), shared_folder(spark, "pairs")
    matrix.write_pairs(api.rank_llr(e, e), path)
    return spark.read.parquet(path).filter("a <> b")


@query("sink_network", ORACLES["greedy_dag"])
def _(spark, d):
    path = shared_folder(spark, "edges")
    matrix.write_network(api.greedy_dag(fx.nation_edges(spark, d)), path)
    return spark.read.parquet(path)


@query("network_matrix", _dag_oracle("SELECT s.i::INT AS src, t.i::INT AS dst, (count(x.src))::INT AS edge FROM range(25) s(i) CROSS JOIN range(25) t(i) LEFT JOIN (SELECT src, dst FROM run JOIN e USING (k) WHERE ok) x ON x.src = s.i AND x.dst = t.i GROUP BY 1, 2", 300))
def _(spark, d):
    wide = adjacency(api.greedy_dag(fx.nation_edges(spark, d)), list(range(25)))
    return wide.unpivot("src", [str(k) for k in range(25)], "dst", "edge").select("src", F.col("dst").cast("int"), F.col("edge").cast("int"))


def _edge_rows(spark: SparkSession, edges) -> DataFrame:
    return spark.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(len(edges) - 1)], "bin int, lo double, hi double")


def _edge_sql(x: str, n: int) -> str:
    """Bins between consecutive values of `x`, an expression of k."""
    return f"SELECT k::INT AS bin, {q6(x, 'lo')}, {q6(x.replace('k', '(k + 1)'), 'hi')} FROM range({n}) t(k)"


@query("uniform_bins", _edge_sql("0.5 + 2.25::DOUBLE * k / 9", 9))
def _(spark, d):
    return _edge_rows(spark, histogram.uniform_bins(0.5, 2.75, 9))


@query("finer_bins", _edge_sql("[0.0, 0.5, 2.0, 2.25, 7.0][k // 8 + 1] + ([0.0, 0.5, 2.0, 2.25, 7.0, 7.0][k // 8 + 2] - [0.0, 0.5, 2.0, 2.25, 7.0][k // 8 + 1]) * (k % 8) / 8.0::DOUBLE", 32))
def _(spark, d):
    return _edge_rows(spark, histogram.finer_edges(np.array([0.0, 0.5, 2.0, 2.25, 7.0]), 8))


# The null law with two and 40 degrees of freedom has a CDF whose quantiles are closed.
@query("equal_mass_bins_cdf", _edge_sql("-ln(1 - (1 - 3.3546262790251185e-4) * k / 12.0::DOUBLE) / 40", 12))
def _(spark, d):
    return _edge_rows(spark, histogram.equal_mass_bins_cdf(0.0, 0.2, 12, lambda x: 1.0 - float(special.null_sf(np.array([x]), 2, 40)[0]), 1e-12))


@query("cdf_quantiles", f"SELECT k::INT AS k, {q6('-ln(1 - (0.05 + 0.1 * k)) / 40.0::DOUBLE', 'x')} FROM range(9) t(k)")
def _(spark, d):
    at = special.quantiles_of_cdf(lambda x: 1.0 - float(special.null_sf(np.array([x]), 2, 40)[0]), 0.05, 0.1, 9, 0.0, 1.0, 1e-12)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(at)], "k int, x double")


_EXPONENTIAL = {
    "v": _QUANTILES["v"],
    "c": "SELECT count(*) AS n, max(x) AS top, least(1 - 0.1 * 5 / sqrt(count(*)), 0.9995) AS split, least(floor(sqrt(sqrt(count(*))) - 0.1 * 5), 100)::INT AS n1 FROM v",
    # Grid of exponential quantiles, carried on with the last width.
    "f": f"SELECT i, -ln(1 - i * split / (100 * n1 + 1)) / {NS} AS x FROM c, range(0, 100 * 100 + 1) t(i) WHERE i < 100 * n1 + 1",
    "h": "SELECT max(x) AS x, max(x) - (SELECT max(x) FROM f WHERE i < (SELECT max(i) FROM f)) AS w, max(i) AS i FROM f",
    "g": "SELECT i, x FROM f UNION ALL SELECT h.i + k, h.x + h.w * k FROM h, c, range(1, 5001) t(k) WHERE k <= 50 * n1",
    "b": "SELECT i, x AS lo, coalesce(lead(x) OVER (ORDER BY i), 'Infinity'::DOUBLE) AS hi FROM g",
    "q": "SELECT b.i, b.lo, b.hi, coalesce(z.n, 0) AS n FROM b LEFT JOIN (SELECT y.lo, count(*)::DOUBLE AS n FROM v ASOF JOIN b y ON v.x >= y.lo GROUP BY 1) z ON z.lo = b.lo",
    "s": "SELECT *, sum(n) OVER (ORDER BY i) AS total, sum(n) OVER (ORDER BY i) - n AS before FROM q",
    "e1": "SELECT k, s.lo + (k * floor(c.n * c.split / c.n1) - s.before) / s.n * (s.hi - s.lo) AS x FROM c, range(1, 101) t(k) JOIN s ON s.total >= k * (SELECT floor(n * split / n1) FROM c) AND s.before < k * (SELECT floor(n * split / n1) FROM c) WHERE k <= c.n1",
    "e2": "SELECT 0 AS k, 0.0::DOUBLE AS x UNION ALL SELECT * FROM e1",
    "e3": "SELECT max(x) AS x, max(x) - (SELECT max(x) FROM e2 WHERE k < (SELECT max(k) FROM e2)) AS w FROM e2",
    "e4": "SELECT x FROM e2 UNION ALL SELECT e3.x + w * k FROM e3, c, range(1, 100001) t(k) WHERE k <= ceil((top - e3.x) / w)",
}


@query("exponential_bins", fx.with_ctes(f"SELECT bin::INT AS bin, {q6('lo', 'lo')}, {q6('hi', 'hi')} FROM (SELECT row_number() OVER (ORDER BY x) - 1 AS bin, x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM e4) WHERE hi IS NOT NULL", "e", **_RANK, **_EXPONENTIAL))
def _(spark, d):
    e = fx.emb_expr(spark, d)
    pairs = api.rank_llr(e, e).filter("a <> b").select("llr").toArrow()  # 4,032 values of a fixed 64 x 64 problem
    return _edge_rows(spark, histogram.exponential_bins(pairs.column("llr").to_numpy(), NS, 0.1))
