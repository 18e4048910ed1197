"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources has a weight at each node. The token budget goes down the
tree by the weights; what a child can't supply (its tokens times the epochs allowed) goes to its
siblings by their weights, and only what the whole family lacks goes to the parent's siblings. A leaf
fills its budget with whole epochs and then a prefix of one more epoch, whose order is a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, small_side

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves are planned on the driver, so there are at most so many.
MAX_LEAVES = 200_000
#: Where a leaf's budget ends is found in so many steps, each among 2**SLICE_BITS slices of the slice before.
#: Only the documents of the last slice, one of 262,144, are sorted.
SLICE_BITS, STEPS = 6, 3


@dataclass
class Node:
    weight: float = 1.0
    tokens: int = 0
    children: dict = field(default_factory=dict)

    def supply(self) -> int:
        return sum(c.supply() for c in self.children.values()) if self.children else self.tokens


def share_out(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Splits ``budget`` by weight among children ``(weight, supply)``; shortages go to the others by weight.

    Whole tokens; what rounding leaves goes to the first children with supply left. Children of weight
    0 get nothing. The sum is the budget, or all the supply of the children with weight if that is less.
    """
    given = [0] * len(children)
    open_ = [i for i, (w, s) in enumerate(children) if w > 0 and s > 0]
    while open_ and budget > 0:
        total = sum(children[i][0] for i in open_)
        want = {i: int(budget * children[i][0] / total) for i in open_}
        short = [i for i in open_ if want[i] >= children[i][1] - given[i]]
        if not short:
            for i in open_:
                given[i] += want[i]
            budget -= sum(want.values())
            for i in open_:
                more = min(budget, children[i][1] - given[i])
                given[i], budget = given[i] + more, budget - more
            break
        for i in short:
            budget -= children[i][1] - given[i]
            given[i] = children[i][1]
        full = set(short)
        open_ = [i for i in open_ if i not in full]
    return given


def plan_budgets(leaves: dict[tuple, int], weights: dict[tuple, float], budget: int, max_epochs: int) -> dict[tuple, int]:
    """Budget of each leaf ``(domain, lang, source)``. ``weights`` is by path; a path that isn't there weighs 1."""
    root = Node()
    for path, tokens in sorted(leaves.items(), key=lambda x: tuple((v is not None, str(v)) for v in x[0])):
        node = root
        for k in range(len(path)):
            node = node.children.setdefault(path[k], Node(weights.get(path[: k + 1], 1.0)))
        node.tokens = tokens * max_epochs
    out: dict[tuple, int] = {}

    def down(node: Node, path: tuple, amount: int) -> None:
        if not node.children:
            out[path] = amount
            return
        given = share_out(amount, [(c.weight, c.supply() if c.weight > 0 else 0) for c in node.children.values()])
        for (name, child), x in zip(node.children.items(), given, strict=True):
            down(child, (*path, name), x)

    if leaves:
        down(root, (), budget)
    return out


def _prefix_ends(rows: DataFrame) -> DataFrame:
    """``(leaf, slice, before)``: the slice of a leaf's order in which its prefix ends, and its tokens before that.

    ``rows(leaf, n, h, rest)``. Every step sums the tokens of at most 2**SLICE_BITS slices a leaf, so that the
    ordered sums are over few rows whatever the leaf's size.
    """
    ends = None
    for step in range(1, STEPS + 1):
        here = rows.withColumn("slice", F.shiftrightunsigned("h", 64 - SLICE_BITS * step))
        if ends is None:
            here = here.withColumn("before", F.lit(0).cast("bigint"))
        else:  # at most MAX_LEAVES rows
            inside = F.broadcast(ends.select("leaf", F.col("slice").alias("within"), "before"))
            here = here.join(inside, "leaf").filter(F.shiftright("slice", SLICE_BITS) == F.col("within"))
        sums = here.groupBy("leaf", "slice").agg(F.sum("n").alias("tokens"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = F.col("start") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy("slice"))
        sums = sums.withColumn("before", upto - F.col("tokens"))
        ends = Table(sums.filter("before < rest AND before + tokens >= rest").select("leaf", "slice", "before"), "mix-ends").df
    return ends


def mix_sources(docs: DataFrame, domain: Column, weights: dict[tuple, float], fraction: float = 0.8, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mixture, one row for each time that one is taken.

    ``docs`` (with columns ``lang`` and ``source``) and the struct column ``mix``: domain, n_tokens
    (words of the whole text), epoch (from 1), and taken (tokens used: all, but for the last document
    of a leaf's prefix, which may be used in part). ``fraction`` of all tokens is the budget.

    * A null or blank text has no tokens and is never taken; null languages and sources are values of their own.
    * Repeated rows are separate documents. The order is by a hash of seed, epoch, id and whole text; rows that
      agree in these come in any order among themselves.
    * All columns come back as they were, whatever their names, but for one named ``mix``, which is replaced.
    * A budget beyond all supply takes ``max_epochs`` of everything; an empty table gives an empty result.
    """
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    tokens = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    # Texts are read and counted once. The document stays in a struct of its own, so that no column can clash with ours.
    told = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "mix")).alias("document"),
        F.struct(domain.alias("domain"), F.col("lang"), F.col("source")).alias("leaf"),
        tokens.alias("n"),
        F.xxhash64(F.col(id_col), text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    told = Table(told, "mix-documents").df
    sizes = told.groupBy("leaf").agg(F.sum("n").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(sizes) > MAX_LEAVES:
        raise ValueError(f"over {MAX_LEAVES} leaves: group the sources")
    leaves = {tuple(r["leaf"]): r["tokens"] for r in sizes}
    budgets = plan_budgets(leaves, weights, int(fraction * sum(leaves.values())), max_epochs)
    plan = [(leaf, b // leaves[leaf], b % leaves[leaf]) for leaf, b in budgets.items() if b]
    plan = F.broadcast(spark.createDataFrame(plan, f"leaf {told.schema['leaf'].dataType.simpleString()}, full bigint, rest bigint"))  # at most MAX_LEAVES rows

    # Structs are equal if their fields are, null ones too. The order of the last epoch is set by the seed and its number.
    planned = told.filter("n > 0").join(plan, "leaf").withColumn("h", F.xxhash64(F.lit(seed), F.col("full") + 1, "key"))
    ends = F.broadcast(_prefix_ends(planned.filter("rest > 0").select("leaf", "n", "h", "rest")))  # at most MAX_LEAVES rows
    planned = planned.join(ends, "leaf", "left").withColumn("at", F.shiftrightunsigned("h", 64 - SLICE_BITS * STEPS) - F.col("slice"))
    upto = F.sum("n").over(Window.partitionBy("leaf").orderBy("h", "key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.col("rest") - F.col("before") - (upto - F.col("n"))
    last = planned.filter("at = 0").select("row", F.least("n", left).alias("part")).filter("part > 0")
    planned = planned.join(small_side(Table(last, "mix-last").df), "row", "left")

    part = F.when(F.col("at") < 0, F.col("n")).otherwise(F.coalesce("part", F.lit(0)))
    each = planned.withColumn("part", part).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full") + 1)))
    each = each.withColumn("taken", F.when(F.col("epoch") <= F.col("full"), F.col("n")).otherwise(F.col("part"))).filter("taken > 0")
    mix = F.struct(F.col("leaf.domain").alias("domain"), F.col("n").alias("n_tokens"), "epoch", "taken").alias("mix")
    return each.select("document.*", mix)
