"""Mixing sources to target weights by hierarchical budgeting.

Leaves are sources below languages below domains.  A token budget flows down the tree by weight;
what a child cannot take (its tokens times ``max_epochs``) goes to its siblings, and only what
all of them cannot take to the parent's siblings.  A leaf takes whole epochs and then the
token-prefix of one more, in that epoch's seeded order.  DataFrame functions only; no row of a leaf
or document reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, salted_join

LEAF = ["d", "l", "s"]
#: A leaf's seeded order is cut at so many ranges of its keys, then one of them again, until a range
#: has few rows.
RANGE_BITS, ROWS_PER_RANGE = 10, 256


def share_out(budget: float, weights: dict[str, float], room: dict[str, float]) -> dict[str, float]:
    """Split ``budget`` by weight, none above its room; shortages go to the others by weight."""
    out, open_ = {k: 0.0 for k in room}, {k for k in room if room[k] > 0 and weights.get(k, 0) > 0}
    budget = min(budget, sum(room[k] for k in open_))
    while open_ and budget > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if budget * weights[k] / total >= room[k] - out[k]}
        if not full:
            for k in open_:
                out[k] += budget * weights[k] / total
            break
        for k in full:
            budget -= room[k] - out[k]
            out[k] = room[k]
        open_ -= full
    return out


def leaf_budgets(room: dict[tuple, float], weights: list[dict], budget: float) -> dict[tuple, float]:
    """Budgets of the leaves of a tree given by their paths, level by level (in memory)."""
    if not weights:
        return {path: min(budget, r) for path, r in room.items()}
    below: dict = {}
    for path, r in room.items():
        below.setdefault(path[0], {})[path[1:]] = r
    default = weights[0].get("*", 1.0)
    shares = share_out(budget, {k: weights[0].get(k, default) for k in below}, {k: sum(v.values()) for k, v in below.items()})
    return {(k, *p): x for k, v in below.items() for p, x in leaf_budgets(v, weights[1:], shares[k]).items()}


def budgets(leaves: DataFrame, weights: list[dict], share: float) -> DataFrame:
    """``leaves`` (d, l, s, room, t) with ``budget``: the same as ``leaf_budgets``, for any number of leaves.

    Among siblings those that need the least for their weight fill up first: in the order of room
    by weight a child is full if its part of what those before it leave is as much as its room.
    """
    total = leaves.agg(F.sum("t").alias("t")).select((F.lit(share) * F.col("t")).alias("budget"))
    parents, path = total.withColumn("_", F.lit(0)), []
    for name, own in zip(LEAF, weights):
        above, path = list(path), [*path, name]
        weight = F.lit(float(own.get("*", 1.0)))
        for key, value in own.items():
            if key != "*":
                weight = F.when(F.col(name) == key, F.lit(float(value))).otherwise(weight)
        node = leaves.groupBy(*path).agg(F.sum("room").alias("room")).withColumn("w", weight).withColumn("_", F.lit(0))
        node = node.join(parents, [*above, "_"])
        open_ = (F.col("w") > 0) & (F.col("room") > 0)
        order = Window.partitionBy(*above, "_", open_).orderBy(F.try_divide("room", "w"), name)
        before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        behind = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        node = node.withColumns({"left": F.greatest(F.col("budget") - before, F.lit(0.0)), "behind": behind})
        node = node.withColumn("full", open_ & (F.col("left") * F.col("w") >= F.col("room") * F.col("behind")))
        # What a unit of weight gets: as the first child says that is not full.
        rate = F.min_by(F.try_divide("left", "behind"), F.struct(F.try_divide("room", "w"), name)).over(Window.partitionBy(*above, "_", open_, "full"))
        got = F.when(~open_, F.lit(0.0)).when(F.col("full"), F.col("room")).otherwise(F.least("room", rate * F.col("w")))
        parents = node.select(*path, "_", got.alias("budget"))
    return leaves.join(parents.drop("_"), LEAF)


def mix(
    docs: DataFrame, domain: Column, weights: list[dict], share: float = 0.6, max_epochs: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Select documents so that tokens follow the target weights.

    ``weights``: for domains, languages and sources a dict of weights, "*" for the others.  The
    budget is ``share`` of all tokens; a document's tokens are a quarter of its UTF-8 bytes, at
    least one.  Returns the input rows chosen, all columns, plus ``_epoch``, ``_domain`` and
    ``_tokens`` (with more underscores in front where the input has such a column); a document may
    return in several epochs.  The chosen tokens never exceed a leaf's budget.  Null domain, language
    or source: the leaf "".  Null text: one token.  Repeated rows count each; equal order keys are
    ordered by id, then by text; rows without an id are ordered by where they lie.  Empty table: no rows.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tokens = F.greatest(F.ceil(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / 4), F.lit(1)).cast("long")
    place = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), name(domain).alias("d"), name(F.col(lang_col)).alias("l"), name(F.col(source_col)).alias("s"),
        tokens.alias("tokens"), F.col(id_col).alias("id"), place.alias("place"),
    )
    few = rows.select(*LEAF, "tokens", "id", "place")
    leaves = few.groupBy(*LEAF).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    leaves = materialize(leaves.withColumn("room", (F.col("t") * max_epochs).cast("double")), "mix-leaves")
    plan = budgets(leaves, weights, share).withColumn("full", F.floor(F.col("budget") / F.col("t")).cast("int"))
    # ``cut``: the range of the epoch's order that the budget ends in; ``left``: what is left for it.
    plan = materialize(plan.select(*LEAF, "n", "full", F.lit(0).cast("long").alias("cut"), (F.col("budget") - F.col("full") * F.col("t")).cast("long").alias("left")), "mix-plan")
    key = F.xxhash64(F.lit(seed), "full", "id", "tokens", "place")

    def at(level: int) -> Column:
        return F.call_function("shiftrightunsigned", key, F.lit(64 - RANGE_BITS * level)) if level else F.lit(0).cast("long")

    level, most = 0, plan.agg(F.max("n")).first()[0] or 0
    while most >> (RANGE_BITS * level) > ROWS_PER_RANGE and level < 6:
        level += 1
        inside = salted_join(few, plan, LEAF).where(at(level - 1) == F.col("cut"))
        sums = inside.groupBy(*LEAF, at(level).alias("range")).agg(F.sum("tokens").alias("t"))
        up_to = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))  # 2**RANGE_BITS rows at most
        sums = salted_join(sums.withColumn("up_to", up_to), plan.select(*LEAF, "left"), LEAF)
        over = F.col("up_to") > F.col("left")
        found = sums.groupBy(*LEAF).agg(F.min(F.when(over, F.col("range"))).alias("new"), F.max(F.when(~over, F.col("up_to"))).alias("taken"))
        # A budget that covers all ranges ends before the first range after them.
        after = (F.col("cut") + 1) * (1 << RANGE_BITS)
        plan = plan.join(found, LEAF, "left").select(
            *LEAF, "n", "full", F.coalesce("new", after).alias("cut"), (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left")
        )
        plan = materialize(plan, "mix-plan")
    placed = salted_join(rows, plan, LEAF).withColumns({"key": key, "range": at(level)})
    whole = placed.withColumn("times", F.col("full") + F.when(F.col("range") < F.col("cut"), 1).otherwise(0)).where("times > 0")
    whole = whole.select("row", "d", "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
    # Only one small range of each leaf is cut inside.
    running = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("key", "id", F.col("row").getField(text_col)).rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where(F.col("range") == F.col("cut")).withColumn("sum", running).where(F.col("sum") <= F.col("left")).select("row", "d", "tokens", F.col("full").alias("epoch"))
    names = [fresh(c, docs.columns) for c in ("_epoch", "_domain", "_tokens")]
    return whole.union(edge).select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in zip(("epoch", "d", "tokens"), names)))
