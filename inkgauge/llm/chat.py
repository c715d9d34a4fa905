"""Chat formatting: root-to-leaf paths of reply trees, ranked, each chosen path one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

TURN, END = "<|turn|>", "<|end|>"


def escape(col: Column) -> Column:
    r"""Reversible: ``\`` becomes ``\\``, and the first character of a control string ``\l`` (for <) or ``\o`` (for [).

    Control strings are what marks turns in this template (``<|``) and in other common ones: <s>, </s>, [INST], [/INST].
    """
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    col = F.regexp_replace(col, r"<(?=\||/?s>)", r"\\l")
    return F.regexp_replace(col, r"\[(?=/?INST\])", r"\\o")


def unescape(col: Column) -> Column:
    """Undo :func:`escape`: every escape has two characters, so cutting at double backslashes keeps the others whole."""
    parts = F.split(col, r"\\\\")
    parts = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\o"), F.lit("[")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def _escaped_role(col: Column) -> Column:
    """A role ends at the line's end, so its own line breaks are escaped, too."""
    return F.replace(escape(col), F.lit("\n"), F.lit("\\n"))


def _lengthened(steps: DataFrame, link: DataFrame, by: int) -> DataFrame:
    """Steps that go on by a link of length ``by``: ``score`` is that of the node they lead up to.

    ``least`` is the smallest node that a link starts from or passes; it is null in the steps of paths, which start from leaves.
    """
    far = steps.alias("a").join(link.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
    least = F.when(F.col("a.least").isNotNull(), F.least("a.least", "b.least")).alias("least")
    return far.select("a.tree", "a.node", "b.up", (F.col("a.above") + by).alias("above"), "b.score", least)


def paths(nodes: DataFrame) -> DataFrame:
    """All (tree, leaf, node, above, score) of root-to-leaf paths; ``above`` counts the steps from the leaf up to the node.

    ``nodes`` has tree, node, parent and score, one row a node.  Self-joins double the length of known links (parent,
    grandparent, ...) until no link is left, and each round doubles the known part of every path: log2(depth) rounds.  One
    join a round lengthens links and paths, into one table of new rows; so the driver plans and watches one job, not two.

    A node whose parent is null, itself or missing is a root.  A loop of replies has no root of its own: its smallest node
    becomes one, as if it had no parent.
    """
    work = Workspace(nodes.sparkSession)
    known = nodes.select("tree", F.col("node").alias("up"), "score")
    first = nodes.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))).select("tree", "node", F.col("parent").alias("up"))
    first = first.join(known, ["tree", "up"]).select("tree", "node", "up", F.lit(1).cast("bigint").alias("above"), "score", F.col("node").alias("least"))
    first = work.save(first, "link0")
    most = first.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    is_path = F.col("least").isNull()
    for attempt in (0, 1):
        link, k, names = first, 0, [f"link{attempt}", f"leaves{attempt}"]
        inner = first.select("tree", F.col("up").alias("node")).distinct()
        leaves = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", "node", F.col("node").alias("up"), F.lit(0).cast("bigint").alias("above"), "score")
        work.save(leaves.withColumn("least", F.lit(None).cast("bigint")), names[-1])
        while not link.isEmpty() and 1 << k <= most:
            steps = work.read(first, *names).filter(is_path | (F.col("above") == 1 << k))
            names.append(f"steps{attempt}_{k}")
            link = work.save(_lengthened(steps, link, 1 << k), names[-1]).filter(~is_path)
            k += 1
        if link.isEmpty():
            break
        # no tree has so long a path: these links end in loops, and each node of a loop has seen all of it
        looped = link.select("tree", F.col("up").alias("node")).distinct()
        roots = link.join(looped, ["tree", "node"], "left_semi").select("tree", F.col("least").alias("node")).distinct()
        first = work.save(first.join(roots, ["tree", "node"], "left_anti"), "link1")
    return work.read(first, *names).filter(is_path).select("tree", F.col("node").alias("leaf"), F.col("up").alias("node"), "above", "score")


def best_branches(steps: DataFrame, top: int) -> DataFrame:
    """The ``top`` paths of each tree by the sum of their nodes' scores (then the smaller leaf): tree, leaf, rank."""
    branches = steps.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    by_score = [F.desc("score"), F.asc("leaf")]
    # first within parts of a tree, so that a tree with very many branches isn't ranked by one task
    part = Window.partitionBy("tree", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*by_score)
    few = branches.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*by_score))).filter(F.col("rank") <= top).drop("score")


def format_trees(nodes: DataFrame, *, top: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    r"""Format the best paths of every reply tree as conversations.

    ``nodes``: tree, node (bigint), parent (bigint), role, text, score.  A turn is ``<|turn|>role\ntext<|end|>\n`` with
    control strings inside role and text escaped (:func:`escape`).

    Returns per path: tree, leaf, rank, n_turns, formatted, loss_spans: array of (start, length), in code points from 0,
    of the escaped texts whose role is one of ``loss_roles``.

    Null role or text counts as empty, null score as 0.  Of rows with the same tree and node the first in the order of
    parent, role, text and score counts.  Rows with a null tree are one tree, whose ``tree`` is null; rows without node are
    left out, since nothing tells them apart.  Loops: see :func:`paths`.  Other columns are ignored; an empty table gives no rows.
    """
    work = Workspace(nodes.sparkSession)
    # in a struct a null tree equals itself
    nodes = nodes.filter(F.col("node").isNotNull()).select(
        F.struct(F.col("tree").cast("bigint").alias("id")).alias("tree"),
        F.col("node").cast("bigint").alias("node"),
        F.col("parent").cast("bigint").alias("parent"),
        text_or_empty(F.col("role")).alias("role"),
        text_or_empty(F.col("text")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    row = F.struct("parent", "role", "text", "score")
    nodes = work.save(nodes.groupBy("tree", "node").agg(F.min(row).alias("r")).select("tree", "node", "r.*"), "nodes")
    steps = paths(nodes)
    chosen = best_branches(steps, top)
    turns = steps.drop("score").join(chosen, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    head, body = F.concat(F.lit(TURN), _escaped_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = turns.select("tree", "leaf", "rank", "above", head.alias("head"), body.alias("body"), F.col("role").isin(*loss_roles).alias("loss"))
    length = F.char_length("head") + F.char_length("body") + len(END) + 1
    upto = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("start", F.sum(length.cast("bigint")).over(upto) - len(END) - 1 - F.char_length("body"))
    turn = F.struct((-F.col("above")).alias("place"), F.concat("head", "body", F.lit(END + "\n")).alias("shown"), "start", F.char_length("body").cast("bigint").alias("length"), "loss")
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select(
        F.col("tree.id").alias("tree"),
        "leaf",
        "rank",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1_000_000_000)
    stripped = F.transform(turns, lambda t: F.substr(t, F.lit(1), F.char_length(t) - len(END) - 1))
    return F.transform(
        stripped,
        lambda t: F.struct(
            unescape(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def threads(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Plain conversations as reply trees with one branch: each turn replies to the one before it.

    Turns are ordered by ``turn_col``; rows of one turn by role and text; null turns come first.  Rows with a null
    ``conv_col`` are one conversation.
    """
    order = Window.partitionBy(conv_col).orderBy(turn_col, "role", "text")
    numbered = rows.select(F.col(conv_col).alias("tree"), F.row_number().over(order).cast("bigint").alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.withColumn("parent", parent).withColumn("score", F.lit(0.0))
