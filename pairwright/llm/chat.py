"""Chat formatting of reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.scratch import Scratch

#: The template: every turn is OPEN role CLOSE_ROLE text END.
OPEN, CLOSE_ROLE, END = "<s>[", "]", "</s>"
#: Escapes, in this order; undone in reverse.  No character of a control string survives in an escaped text.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;")]


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def best_paths(nodes: DataFrame, scratch: Scratch, paths: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, depth, node_id): the nodes of each tree's best root-to-leaf paths.

    `nodes` has tree_id, node_id, parent_id, score.  Iterated self-joins double the
    distance to an ancestor every round: each node keeps a pointer, the number of steps and
    the sum of scores so far, hence constant state per node and log2(depth) rounds.  Leaves
    are ranked by the mean score of their path, then by node id; the nodes of the chosen
    paths are marked by following the same pointers from far to near.

    A parent that is null, absent or the node itself makes a root.  Rows that repeat
    (tree_id, node_id) count once, the one with the smallest parent.  Nodes on a cycle
    reach no root and are on no path.  Null scores count as 0.
    """
    one = nodes.groupBy("tree_id", "node_id").agg(F.min_by(F.struct("parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), F.coalesce(F.col("parent_id"), F.col("node_id"))).alias("r")).select("tree_id", "node_id", "r.*")
    one = scratch.table(one, "nodes")
    parents = one.select(F.col("tree_id").alias("pt"), F.col("node_id").alias("pn"))
    real = one.join(parents, one["tree_id"].eqNullSafe(F.col("pt")) & (F.col("parent_id") == F.col("pn")) & (F.col("parent_id") != F.col("node_id")), "left")
    up = scratch.table(real.select("tree_id", "node_id", F.col("pn").alias("ptr"), F.when(F.col("pn").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("score").alias("total")), "up0")
    rounds, limit = 0, max(one.count(), 1).bit_length() + 1
    arrived = up.filter("ptr is null")  # nodes whose pointer has passed the root; only the others are joined again
    while rounds < limit and not up.filter("ptr is not null").isEmpty():
        far = up.filter("ptr is not null").unionByName(arrived)
        far = far.select(F.col("tree_id").alias("ft"), F.col("node_id").alias("fn"), F.col("ptr").alias("fptr"), F.col("steps").alias("fsteps"), F.col("total").alias("ftotal"))
        near = up.filter("ptr is not null")
        near = near.join(far, near["tree_id"].eqNullSafe(F.col("ft")) & (F.col("ptr") == F.col("fn")), "inner")
        rounds += 1
        up = scratch.table(near.select("tree_id", "node_id", F.col("fptr").alias("ptr"), (F.col("steps") + F.col("fsteps")).alias("steps"), (F.col("total") + F.col("ftotal")).alias("total")), f"up{rounds}")
        arrived = arrived.unionByName(up.filter("ptr is null"))
    inner = scratch.spark.read.parquet(scratch.path("up0")).filter("ptr is not null").select(F.col("tree_id").alias("it"), F.col("ptr").alias("ip")).distinct()
    leaves = arrived.join(inner, arrived["tree_id"].eqNullSafe(F.col("it")) & (F.col("node_id") == F.col("ip")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy((F.col("total") / (F.col("steps") + 1)).desc(), "node_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= paths)
    marks = scratch.table(chosen.select("tree_id", F.col("node_id").alias("leaf"), "rank", F.col("steps").alias("depth"), "node_id"), "marks")
    for k in range(rounds - 1, -1, -1):
        step = scratch.spark.read.parquet(scratch.path(f"up{k}")).filter("ptr is not null").select(F.col("tree_id").alias("st"), F.col("node_id").alias("sn"), "ptr")
        more = marks.join(step, marks["tree_id"].eqNullSafe(F.col("st")) & (F.col("node_id") == F.col("sn")), "inner")
        marks = scratch.table(marks.union(more.select("tree_id", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("ptr").alias("node_id"))), f"marks{k}")
    scratch.keep("marks0" if rounds else "marks")
    return marks


def format_trees(nodes: DataFrame, paths: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree_id, leaf, rank, formatted, loss_spans), one row per chosen path.

    `nodes`: tree_id, node_id, parent_id, role, text, score.  `loss_spans` are the
    (start, length) code-point ranges of the formatted string whose text is learnt: the
    texts of role `learn`, without any marker.  Null role and null text count as empty.
    An empty table gives no row.  The loss offsets come from a running sum in the same
    partitioning that assembles a path, so formatting costs one shuffle of the texts.
    Extra columns are ignored.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    marks = best_paths(nodes.select("tree_id", "node_id", "parent_id", "score"), scratch, paths)
    texts = nodes.groupBy("tree_id", "node_id").agg(F.min_by(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), F.coalesce(F.col("parent_id"), F.col("node_id"))).alias("r")).select(F.col("tree_id").alias("tt"), F.col("node_id").alias("tn"), "r.*")
    turns = marks.join(texts, marks["tree_id"].eqNullSafe(F.col("tt")) & marks["node_id"].eqNullSafe(F.col("tn")), "inner")
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE_ROLE))
    body = escaped(F.col("text"))
    turns = turns.select("tree_id", "leaf", "rank", "depth", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree_id", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == learn, F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    made = turns.withColumn("start", start).groupBy("tree_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", span.alias("span")))).alias("t"))
    return made.select("tree_id", "leaf", "rank", F.array_join(F.col("t.piece"), "").alias("formatted"), F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), by the markers alone."""
    turn = f"^{OPEN}([^\\]]*)\\](.*)$".replace("[", "\\[", 1)
    pieces = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)
    return F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, "(?s)" + turn, 1)).alias("role"), unescaped(F.regexp_extract(p, "(?s)" + turn, 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chain(turns: DataFrame) -> DataFrame:
    """A table of linear conversations (conv_id, turn, role, text) as reply trees: each turn replies to the one before.

    Equal turn numbers follow role and text, nulls first; repeated rows stay, one node each.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    return turns.select(F.col("conv_id").alias("tree_id"), n.alias("node_id"), F.when(n > 1, n - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
