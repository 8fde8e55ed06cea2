"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked branches, reversible markup. DataFrame functions only.

A formatted conversation is, for each turn, `<turn>` role `<turn|>` text `</turn>`. In roles and texts every `<`, then
backslashes, then `turn` or `/turn` gets one backslash more after the `<`, so that no mark can occur in them; taking one away
gives back the text. Loss falls on the texts of assistant turns and on nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajkit.llm.common import discard, durable

OPEN, MIDDLE, CLOSE = "<turn>", "<turn|>", "</turn>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def _same(a: str, b: str, key: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.node"))


def lifted(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """nodes (tree, node, parent, value) -> (sums, jumps, cyclic).

    Self-joins that double: jumps[k] (tree, node, above) holds the ancestor 2^k steps up, and while it is made, each node adds
    up value and number of the nodes on its way: sums (tree, node, total, count) has them for the whole way to the root. The
    rounds follow the logarithm of the depth. A node whose parent is missing, null or itself is a root. cyclic (tree) names
    the trees with a cycle of parents: their nodes have no root, and no sums. Trees and nodes compare null-safely.
    """
    real = nodes.select("tree", F.col("node").alias("parent")).alias("p")
    up = nodes.where("parent is not null and not parent <=> node").alias("n").join(real, F.col("n.tree").eqNullSafe(F.col("p.tree")) & (F.col("n.parent") == F.col("p.parent")), "left_semi")
    up = up.select("tree", "node", F.col("parent").alias("above"), F.lit(True).alias("has"))
    state = nodes.alias("n").join(up.alias("u"), _same("n", "u", "node"), "left")
    state = durable(state.select("n.tree", "n.node", F.when(F.col("has"), F.col("above")).alias("above"), F.col("value").alias("total"), F.lit(1).cast("long").alias("count")))
    depth = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    done, jumps = [state.where("above is null")], []
    for _ in range(depth.bit_length() + 1):
        open_ = state.where("above is not null")
        if not open_.limit(1).count():
            break
        jumps.append(open_.select("tree", "node", "above"))
        met = open_.alias("a").join(state.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.above") == F.col("b.node")), "left")
        met = met.select("a.tree", "a.node", "b.above", (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total"), (F.col("a.count") + F.coalesce("b.count", F.lit(0))).alias("count"))
        # Those at the root stay as they are: what jumps there has its whole way.
        state = durable(met.union(reduce(DataFrame.union, done)))
        done = [state.where("above is null")]
    return done[0].select("tree", "node", "total", "count"), jumps, state.where("above is not null").select("tree").distinct()


def _paths(starts: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """starts (tree, leaf, ...) -> the same with node and up, for each node on the way up, the leaf itself 0 steps above it."""
    carried = [c for c in starts.columns if c != "tree"]
    paths = starts.withColumn("node", F.col("leaf")).withColumn("up", F.lit(0).cast("long"))
    for k, jump in enumerate(jumps):
        more = paths.alias("a").join(jump.alias("j"), _same("a", "j", "node")).select("a.tree", *[F.col(f"a.{c}") for c in carried], F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths, old = durable(paths.union(more)), paths
        discard(old)
    return paths


def _leaves(nodes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(tree, leaf): nodes that no other node of the tree has as its parent, without the trees that have a cycle."""
    inner = nodes.where("parent is not null and not parent <=> node").select("tree", F.col("parent").alias("node")).distinct()
    ends = nodes.select("tree", "node").alias("n").join(inner.alias("i"), _same("n", "i", "node"), "left_anti").select("tree", F.col("node").alias("leaf")).alias("n")
    return ends.join(cyclic.alias("c"), F.col("n.tree").eqNullSafe(F.col("c.tree")), "left_anti")


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent) -> (tree, leaf, node, up): every node on the path of every leaf, up steps above it. See lifted()."""
    _, jumps, cyclic = lifted(nodes.withColumn("value", F.lit(0.0)))
    return _paths(_leaves(nodes, cyclic), jumps)


def format_trees(messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, best: int = 1) -> DataFrame:
    """messages -> one row per chosen path: tree, leaf, rank, score, formatted, mask.

    A branch's score is the mean of its messages' scores (null counts as 0; 0 without a score column); the best branches of
    each tree are chosen, ties by the lower leaf, before any path is written out. mask has one struct per turn: where the turn
    starts in formatted, where its text starts and ends, and whether loss falls on it, in code points.

    (tree, node) names a row: of rows that agree in both the least by parent, role, text and score counts. A tree with a cycle
    of parents gives no rows (lifted() names it), all others do. Nulls: a null tree is a tree of its own, null roles and texts
    count as empty. Very long texts and paths pass by rows until the last step, which must hold one formatted path as the one
    row that it is. Empty tables give empty results; other columns are not read.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), value.alias("value"))
    if rows.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = durable(rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "value")).alias("r")).select("tree", "node", "r.*"))
    nodes = rows.select("tree", "node", "parent", "value")
    sums, jumps, cyclic = lifted(nodes)
    ends = _leaves(nodes, cyclic).alias("e").join(sums.alias("s"), F.col("e.tree").eqNullSafe(F.col("s.tree")) & F.col("e.leaf").eqNullSafe(F.col("s.node"))).select("e.tree", "leaf", (F.col("total") / F.col("count")).alias("score"))
    ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))).where(F.col("rank") <= best)
    chosen = _paths(durable(ranked), jumps).alias("p")
    on = _same("p", "m", "node")
    turns = chosen.join(rows.alias("m"), on).select("p.tree", "leaf", "rank", "score", (-F.col("up")).alias("at"), escape(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    turns = turns.withColumn("piece", F.concat(F.lit(OPEN), "head", F.lit(MIDDLE), "body", F.lit(CLOSE))).withColumn("length", F.length("piece").cast("long"))
    order = Window.partitionBy("tree", "leaf", "rank", "score").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("start", F.sum("length").over(order) - F.col("length"))
    turns = turns.withColumn("from", F.col("start") + len(OPEN) + F.length("head") + len(MIDDLE)).withColumn("to", F.col("from") + F.length("body"))
    whole = turns.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "start", "from", "to", "loss"))).alias("t"))
    mask = F.transform("t", lambda t: F.struct(t["start"].alias("turn_start"), t["from"].alias("start"), t["to"].alias("end"), t["loss"].alias("loss")))
    return whole.select("tree", "leaf", "rank", "score", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    pieces = F.split(formatted, CLOSE, -1)
    cut = lambda p: F.split(F.substring(p, len(OPEN) + 1, 1 << 30), r"<turn\|>", 2)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescape(cut(p)[0]).alias("role"), unescape(cut(p)[1]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped; pieces between closing marks are cut at the mask's places."""
    pieces = F.split(formatted, CLOSE, -1)
    under = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), mask, lambda p, m: F.when(m["loss"], F.substring(p, (m["start"] - m["turn_start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return F.array_join(F.transform(F.filter(under, lambda t: t.isNotNull()), unescape), "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as chains: each row replies to the one before it in its conversation.

    Rows order by turn, a null turn first, and then, where turns repeat, by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    return conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
