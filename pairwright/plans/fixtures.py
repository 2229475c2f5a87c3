"""Long matrices derived from the shared tables, as DataFrames and as the same SQL for DuckDB.

Dimensions of the embeddings are genes and vectors are samples: genes 0 to 55 are targets,
0 to 7 of them also sources, and 56 to 63 their anchors.  Suppliers are genes over months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, sample, value) of 64 dimensions over all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("sample"), F.posexplode("embedding").alias("gene", "value"))
    return e.select("gene", "sample", F.col("value").cast("double").alias("value"))


def emb_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_expr(spark, sf_dir).filter("gene < 56")


def emb_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_expr(spark, sf_dir).filter("gene < 8")


def emb_anchor_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_expr(spark, sf_dir).filter("gene >= 56").select((F.col("gene") - 56).alias("gene"), "sample", "value")


def thirds(m: DataFrame, value: str = "value") -> DataFrame:
    """(gene, sample, geno): thirds of every gene by (value, sample), 0 to 2."""
    return m.select("gene", "sample", (F.ntile(3).over(Window.partitionBy("gene").orderBy(value, "sample")) - 1).cast("short").alias("geno"))


def emb_anchor_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thirds(emb_anchor_c(spark, sf_dir))


def emb_anchor_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("gene"), F.col("vec_id").cast("int").alias("sample"), F.col("label").cast("short").alias("geno"))
    return rows


def sup_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, sample, value, quantity): revenue and quantity of each supplier in each month, 0 where there was none."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"))
    months = line.select("month").distinct().withColumn("sample", F.dense_rank().over(Window.orderBy("month")).cast("int"))
    cells = line.groupBy(F.col("l_suppkey").cast("int").alias("gene"), "month").agg(F.sum(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("v"), F.sum("l_quantity").alias("q"))
    grid = cells.select("gene").distinct().crossJoin(F.broadcast(months))  # a row per calendar month, whatever the table's size
    return grid.join(cells, ["gene", "month"], "left").select("gene", "sample", F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


def sup_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sup_cells(spark, sf_dir).select("gene", "sample", "value")


def sup_anchor_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thirds(sup_cells(spark, sf_dir), "quantity")


def year_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, sample, value): revenue of the suppliers of each nation in each calendar year; fewer samples than ranks are told apart by."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("gene"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("v"), F.year("l_shipdate").alias("year"))
    cells = line.join(s, line["l_suppkey"] == s["s_suppkey"]).groupBy("gene", "year").agg(F.sum("v").alias("v"))
    years = cells.select("year").distinct().withColumn("sample", F.dense_rank().over(Window.orderBy("year")).cast("int"))
    grid = cells.select("gene").distinct().crossJoin(F.broadcast(years))  # a row per calendar year
    return grid.join(cells, ["gene", "year"], "left").select("gene", "sample", F.coalesce("v", F.lit(0.0)).alias("value"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, p): revenue from customers of one nation to suppliers of another, over the largest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("dst"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    rows = line.join(o, line["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).filter("src <> dst")
    w = rows.groupBy("src", "dst").agg(F.sum(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("w"))
    top = w.agg(F.max("w").alias("top"))
    return w.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("w") / F.col("top")).alias("p"))  # one row


_E = "SELECT (unnest(range(len(embedding))))::INT AS gene, vec_id::INT AS sample, unnest(embedding)::DOUBLE AS value FROM embeddings"
_S_LINE = "SELECT l_suppkey::INT AS gene, date_trunc('month', l_shipdate) AS month, l_extendedprice * (1 - l_discount) AS v, l_quantity AS q FROM lineitem"

#: Named queries, each usable after those before it.
CTES: dict[str, str] = {
    "e": _E,
    "eb": "SELECT * FROM e WHERE gene < 56",
    "ea": "SELECT * FROM e WHERE gene < 8",
    "ec": "SELECT gene - 56 AS gene, sample, value FROM e WHERE gene >= 56",
    "ed": "SELECT gene, sample, (ntile(3) OVER (PARTITION BY gene ORDER BY value, sample) - 1)::SMALLINT AS geno FROM ec",
    "el": "SELECT unnest(range(8))::INT AS gene, vec_id::INT AS sample, label::SMALLINT AS geno FROM embeddings",
    "sl": _S_LINE,
    "sm": "SELECT month, dense_rank() OVER (ORDER BY month)::INT AS sample FROM (SELECT DISTINCT month FROM sl)",
    "sc": "SELECT gene, month, sum(v) AS v, sum(q) AS q FROM sl GROUP BY gene, month",
    "sg": "SELECT g.gene, sm.sample, coalesce(v, 0)::DOUBLE AS value, coalesce(q, 0)::DOUBLE AS quantity FROM (SELECT DISTINCT gene FROM sc) g CROSS JOIN sm LEFT JOIN sc ON sc.gene = g.gene AND sc.month = sm.month",
    "yc": "SELECT s_nationkey::INT AS gene, year(l_shipdate) AS year, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "yy": "SELECT year, dense_rank() OVER (ORDER BY year)::INT AS sample FROM (SELECT DISTINCT year FROM yc)",
    "yg": "SELECT g.gene, yy.sample, coalesce(v, 0)::DOUBLE AS value FROM (SELECT DISTINCT gene FROM yc) g CROSS JOIN yy LEFT JOIN yc ON yc.gene = g.gene AND yc.year = yy.year",
    "sd": "SELECT gene, sample, (ntile(3) OVER (PARTITION BY gene ORDER BY quantity, sample) - 1)::SMALLINT AS geno FROM sg",
}


def with_ctes(sql: str, *names: str, **more: str) -> str:
    """`sql` after the named queries (with those they need, in order) and `more`; one that names its columns is recursive."""
    need = set(names)
    deps = {"eb": "e", "ea": "e", "ec": "e", "ed": "ec", "sm": "sl", "sc": "sl", "sg": "sm sc", "sd": "sg", "yy": "yc", "yg": "yy"}
    todo = list(need)
    while todo:
        for d in deps.get(todo.pop(), "").split():
            if d not in need:
                need.add(d)
                todo.append(d)
    parts = [f"{k} AS ({v})" for k, v in CTES.items() if k in need] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql
