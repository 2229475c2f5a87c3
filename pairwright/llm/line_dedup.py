"""Repeated passages of lines, by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.scratch import Scratch


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """(doc_id, at, key): every run of `lines` consecutive lines, with a 256-bit key."""
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls")).filter(F.size("ls") >= lines)
    at = split.select("doc_id", "ls", F.explode(F.sequence(F.lit(1), F.size("ls") - (lines - 1))).alias("at"))
    return at.select("doc_id", "at", F.unhex(F.sha2(F.array_join(F.slice("ls", F.col("at"), lines), "\n"), 256)).alias("key"))


def dedup_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text), one row per row of `docs`.

    Windows of `lines` consecutive lines are hashed and the hashes counted over all
    documents, with the first occurrence (smallest doc_id, then line) in the same
    combining aggregate, so a passage held by a third of all documents leaves each task
    once.  Every later occurrence is removed: the lines that any removed window covers,
    overlapping windows merged.  The lookup of repeated windows joins two exchanges with
    nothing above that needs a key together, so that adaptive execution splits hot keys.

    Texts of fewer lines than a window, null texts (as empty, one empty line) included,
    stay as they are.  Null ids sort last as first occurrence and lose no line themselves;
    rows that repeat an id count as one document for the windows.  Other columns are
    ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    win = _windows(docs.filter("doc_id is not null"), lines)
    first = win.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = scratch.table(first, "repeated")
    later = win.join(first, "key").filter(F.struct("doc_id", "at") > F.col("first"))
    later = scratch.table(later.select("doc_id", "at"), "later")
    # Merge join at every size: what the texts are joined with grows with the corpus.
    covered = later.groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    covered = covered.select(F.col("doc_id").alias("__id"), F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (lines - 1))))).alias("covered"))
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls")).join(covered.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    left = F.array_except(F.sequence(F.lit(1), F.size("ls")), F.col("covered"))
    kept = F.when(F.col("covered").isNull(), F.col("ls")).otherwise(F.transform(left, lambda p: F.element_at(F.col("ls"), p)))
    return rows.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))
