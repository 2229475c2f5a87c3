"""Exact duplicates of whole texts, by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.scratch import Scratch

SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, salts: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Three combining stages, each grouping by digest *and* full normalised text, so a digest
    collision never merges different texts: the map side of the first aggregate
    deduplicates within a task; its reduce side merges `salts` groups per text, so a text
    held by a third of all rows reaches `salts` tasks and from each task once; the second
    aggregate combines the at most `salts` winners of a text.  Rows are then labelled
    through a table with groups of two or more only.  That join has an exchange on
    either side and nothing above it, so adaptive execution splits a hot group.  It is the one
    place where a text isn't compared in full: rows find their group by SHA-256, a second 64-bit hash and the length.

    Null texts and empty texts are one group.  A null doc_id never wins over another id;
    rows that repeat an id with the same text get the same result each (`kept` on all of
    them).  Other columns of `docs` are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    norm = normalised(F.col("text"))
    base = docs.select(F.col("doc_id"), norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    local = base.groupBy("digest", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = local.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # The label of a group in the narrow join: digest, a second hash and the length.
    label = [F.col("digest"), F.xxhash64("norm").alias("second"), F.length("norm").alias("chars")]
    groups = scratch.table(groups.filter("group_size > 1").select(*label, "keep_id", "group_size"), "groups")
    rows = base.select("doc_id", *label)
    found = rows.join(groups, ["digest", "second", "chars"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts: the one with the smallest doc_id; all columns stay.

    Null and empty texts are one group, of which a null doc_id stays only if there is no
    other.  Rows that repeat an id with the same text are one document, of which one row
    stays, any of them if other columns differ.  Rows that repeat an id with different texts go or stay by their own text.
    An empty table stays empty.  Column names that begin with `__exact_` are this operator's own.
    """
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__exact_id"), F.col("text_sha256").alias("__exact_kept")).distinct()
    tagged = docs.withColumn("__exact_sha", F.sha2(normalised(F.col("text")), 256))
    rows = tagged.join(kept, tagged["doc_id"].eqNullSafe(kept["__exact_id"]) & (tagged["__exact_sha"] == kept["__exact_kept"]), "left_semi")
    one = Window.partitionBy("doc_id", "__exact_sha").orderBy(F.lit(1))
    return rows.withColumn("__exact_n", F.row_number().over(one)).filter("__exact_n = 1").select(docs.columns)
