"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.scratch import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from a hash of `key`: 52 bits of MD5, the same on every engine and run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): `share` of all sizes divided by weight under a ceiling.

    Sources by code point, null last, take `weights` in turn.  A target stops at `most`
    times its source's size and the excess goes to the others by weight until none is
    above; that fixed point is found in closed form, as the water level of sources ordered
    by ceiling per weight.  Works on one row per source only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("w", w).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    fill = Window.orderBy((F.col("ceiling") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    per = per.withColumn("held", F.sum("ceiling").over(fill.rowsBetween(Window.unboundedPreceding, -1))).withColumn("open_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # The level if exactly the sources before this one were at their ceilings.  It rises until that is so and falls after.
    level = (F.col("total") - F.coalesce("held", F.lit(0.0))) / F.col("open_w")
    per = per.withColumn("level", F.max(level).over(everything))
    return per.select("source", "source_size", F.least(F.col("ceiling"), F.col("level") * F.col("w")).alias("target"))


def _with_copies(rows: DataFrame, sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, most: float, seed: str, few_sources: int) -> DataFrame:
    """`rows` (with doc_id and source) and __size, __target of their source and __copies."""
    per = source_targets(sizes, weights, share, most)
    per = scratch.table(per.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target")), "sources")
    few = per.limit(few_sources + 1).count() <= few_sources
    joined = rows.join(F.broadcast(per) if few else per, rows["source"].eqNullSafe(per["__source"]), "left")
    rate = F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)
    return joined.withColumn("__copies", (F.floor(rate) + F.when(unit_draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1:", few_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of `docs`.

    The repetition rate of a source is target / source size.  A document is taken
    floor(rate) times, and once more where a draw seeded by the hash of its id is below
    the fraction; the rate never exceeds `most`, so no document is taken more often.

    Sizes are counted once and kept in a durable table.  The join with the sources is a
    broadcast only after their number has been counted; beyond `few_sources`, a
    shuffle join whose hot keys adaptive execution splits.  Null texts have size 0, and
    an all-empty source has rate 0.  A null source is a source of its own; a null
    doc_id draws by the text "null".  Rows that repeat an id draw alike.  Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = _with_copies(sizes, sizes, scratch, weights, share, most, seed, few_sources)
    return rows.select("doc_id", "source", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1:", few_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix itself: each row of `docs` as many times as `mix` takes it, same columns; texts aren't shuffled.

    Column names beginning with two underscores are this operator's own.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rows = _with_copies(docs, sizes, scratch, weights, share, most, seed, few_sources).filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)
