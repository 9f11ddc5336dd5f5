"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The corpus is a tree (domain, then language, then source); integer weights say how a node's token budget is dealt to
its children. A leaf can give at most ``max_epochs`` times its tokens, and a node what its children can give together.
Top down, each node's budget is dealt by weight among its children; a child that can't take its share takes all it has
and the shortage goes to its siblings, by their weights (exact water filling: children in order of capacity / weight
are full as long as their share of what is left covers their capacity). As a child's budget never exceeds what its own
subtree can give, a shortage leaves a subtree only when every sibling below is full: siblings come before ancestors.
All of it is integer arithmetic on windows over the small table of nodes; the rounding loses at most one token per node.

A leaf's budget of b tokens is b // T whole epochs of its T tokens and a token prefix of one more epoch. An epoch's
order is the MD5 of (seed, epoch, id, MD5 of the text). The prefix is found in two steps: the leaf's rows are cut into
ranges of that hash (about ``PER_RANGE`` rows each, so a leaf with a third of all rows is many ranges), token sums per
range are pre-aggregated, and only the one range per leaf in which the budget ends is sorted by a window. The row at
the end gives part of its tokens (``take_tokens``).

Cases: null levels are nodes of their own, named ``null``; null and empty texts have no tokens and are never taken for
a prefix, but belong to whole epochs; rows that repeat are taken one by one; a node without a weight has weight 1, one
with weight 0 gets nothing; an empty table gives an empty result; columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilia.llm import common

PER_RANGE = 1024
FEW_LEAVES = 100_000  # leaf rows (about 100 bytes each) that are broadcast; more are joined by (leaf, salt)
SALTS = 64
WORDS = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    doc = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc, F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _weight(path: str, weights: Mapping[str, int]) -> Column:
    """Weight of a node by its path; the mapping is a parameter of the job, so a literal map holds it."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(path)), F.lit(1)).cast("long")


def _deal(nodes: DataFrame) -> DataFrame:
    """Add ``budget`` to nodes (parent, path, weight, cap, given): ``given``, the parent's budget, dealt by weight."""
    live = nodes.withColumn("live", (F.col("weight") > 0) & (F.col("cap") > 0))
    order = Window.partitionBy("parent", "live").orderBy(F.col("cap") / F.greatest(F.col("weight"), F.lit(1)), "path")
    behind, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    live = live.withColumn("left", F.col("given") - F.coalesce(F.sum("cap").over(behind), F.lit(0))).withColumn("share", F.sum("weight").over(ahead))
    live = live.withColumn("full", F.col("cap") * F.col("share") <= F.col("weight") * F.col("left"))
    # what is left, and the weights that share it, where the first child that isn't full stands
    rest = Window.partitionBy("parent", "live")
    stop = F.min(F.when(~F.col("full"), F.struct("place", "left", "share"))).over(rest)
    live = live.withColumn("place", F.row_number().over(order)).withColumn("stop", stop)
    part = F.expr("weight * stop.left div stop.share")
    return live.withColumn("budget", F.when(~F.col("live"), F.lit(0)).when(F.col("full"), F.col("cap")).otherwise(part)).drop(
        "live", "left", "share", "full", "place", "stop")


def leaf_budgets(leaves: DataFrame, depth: int, weights: Mapping[str, int], budget: int, max_epochs: int) -> DataFrame:
    """leaves (l1..ldepth, docs, tokens) with ``budget``; every step works on a table of tree nodes. A node's path is
    its names joined by a slash (a slash inside a name is written %2F)."""
    names = [F.replace(F.col(f"l{i + 1}"), F.lit("/"), F.lit("%2F")) for i in range(depth)]
    paths = {f"p{i + 1}": F.concat_ws("/", *names[: i + 1]) for i in range(depth)}
    tree = leaves.withColumns({"p0": F.lit(""), **paths, "cap": F.col("tokens") * max_epochs})
    given = tree.agg(F.least(F.lit(budget).cast("long"), F.coalesce(F.sum("cap"), F.lit(0))).alias("given")).select(F.lit("").alias("parent"), "given")
    for i in range(depth):
        nodes = tree.groupBy(F.col(f"p{i}").alias("parent"), F.col(f"p{i + 1}").alias("path")).agg(F.sum("cap").alias("cap"))
        nodes = _deal(nodes.withColumn("weight", _weight("path", weights)).join(given, "parent"))
        given = nodes.select(F.col("path").alias("parent"), F.col("budget").alias("given"))
    last = given.select(F.col("parent").alias(f"p{depth}"), F.col("given").alias("budget"))
    return tree.join(last, f"p{depth}").drop("cap", *[f"p{i}" for i in range(depth + 1)])


def _at_leaf(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """``rows`` with their leaf's columns. The leaf table was counted; a long one is copied once per salt and joined by
    leaf and salt, so that no task gets all rows of a leaf."""
    if few:
        return rows.join(F.broadcast(table), "leaf")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "body"), F.lit(SALTS)).cast("int")).join(salted, ["leaf", "salt"]).drop("salt")


def mix(docs: DataFrame, levels: Sequence[Column], weights: Mapping[str, int], budget_thousandths: int = 600, max_epochs: int = 3,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", per_range: int = PER_RANGE,
        few_leaves: int = FEW_LEAVES) -> DataFrame:
    """``docs`` once per selected epoch, with ``epoch``, ``n_tokens`` and ``take_tokens`` (these replace columns of the
    same name); the budget is ``budget_thousandths`` / 1000 of all tokens."""
    names = [f"l{i + 1}" for i in range(len(levels))]
    leaf = F.struct(*[F.coalesce(c.cast("string"), F.lit("null")).alias(n) for c, n in zip(levels, names, strict=True)])
    keep = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens", "take_tokens")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), leaf.alias("leaf"), n_tokens(F.col(text_col)).alias("n"),
                       F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    size = common.write_cut(rows.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")))
    sums = size.agg(F.expr(f"coalesce(sum(tokens), 0) * {int(budget_thousandths)} div 1000").alias("b"), F.count("*").alias("n")).first()
    total, few = sums["b"], sums["n"] <= few_leaves
    leaves = leaf_budgets(size.select("leaf.*", "docs", "tokens"), len(levels), weights, total, max_epochs)
    leaves = common.write_cut(leaves.select(
        F.struct(*names).alias("leaf"), F.expr("coalesce(budget div nullif(tokens, 0), 0)").alias("whole"),
        F.expr("coalesce(budget % nullif(tokens, 0), 0)").alias("part"), F.ceil(F.col("docs") / per_range).alias("ranges")))

    hashed = order_hash(seed, F.col("whole"), F.col("id"), F.col("body"))
    spot = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32))
    cut = _at_leaf(rows, leaves, few).filter("part > 0").withColumn("hash", hashed).withColumn("spot", spot)
    cut = cut.groupBy("leaf", "spot", "part").agg(F.sum("n").alias("held"))
    cut = cut.withColumn("before", F.sum("held").over(Window.partitionBy("leaf").orderBy("spot")) - F.col("held"))
    # the range in which a leaf's budget ends: those before it are taken whole, those after it not at all
    cut = cut.filter("before < part and before + held >= part").select("leaf", F.col("spot").alias("end"), "before")
    plan = common.write_cut(leaves.join(cut, "leaf", "left"))

    keyed = _at_leaf(rows, plan, few)
    whole = keyed.filter("whole > 0").select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "n", F.col("n").alias("take"))
    partial = keyed.filter("part > 0 and n > 0").withColumn("hash", hashed).withColumn("spot", spot)
    early = partial.filter("spot < end").select("row", F.col("whole").alias("epoch"), "n", F.col("n").alias("take"))
    order = Window.partitionBy("leaf").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = partial.filter("spot = end").withColumn("take", F.least("n", F.col("part") - F.col("before") - F.sum("n").over(order) + F.col("n")))
    last = last.filter("take > 0").select("row", F.col("whole").alias("epoch"), "n", "take")
    return whole.unionByName(early).unionByName(last).select("row.*", "epoch", F.col("n").alias("n_tokens"), F.col("take").alias("take_tokens"))
