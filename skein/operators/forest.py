"""Rewrites of a containment forest. parents: set_id, parent_id (-1: a root)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import checkpointed, stored


def lifts(parents: DataFrame) -> list[DataFrame]:
    """Tables set_id, up: the ancestor that is 1, 2, 4, ... levels up, of the sets that have one. As many tables as the depth has bits."""
    out = [checkpointed(parents.filter("parent_id >= 0").select("set_id", F.col("parent_id").alias("up")))]
    while True:
        known = out[-1]
        further = checkpointed(known.join(known.select(F.col("set_id").alias("up"), F.col("up").alias("next")), "up").select("set_id", F.col("next").alias("up")))
        if further.isEmpty():
            return out
        out.append(further)


def climb(rows: DataFrame, up: list[DataFrame], goes: Callable[[int], Column], step: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """rows: set_id, at (where each has got to) and climbed (levels). From the longest lift to the shortest, a row takes it if goes(its
    levels) holds, which may use next, the set that it would get to, and what step adds to a table of set_id, up."""
    for k in reversed(range(len(up))):
        table = step(up[k]).withColumnsRenamed({"set_id": "at", "up": "next"})
        more = [c for c in table.columns if c not in ("at", "next")]
        takes = F.col("next").isNotNull() & goes(1 << k)
        moved = {"at": F.when(takes, F.col("next")).otherwise(F.col("at")), "climbed": F.col("climbed") + F.when(takes, F.lit(1 << k)).otherwise(F.lit(0))}
        rows = rows.join(table, "at", "left").withColumns(moved).drop("next", *more)
    return rows


def _standing(parents: DataFrame) -> DataFrame:
    return parents.select("set_id", "parent_id", F.col("set_id").alias("at"), F.lit(0).cast("long").alias("climbed"))


def depths(parents: DataFrame, up: list[DataFrame]) -> DataFrame:
    """set_id, parent_id, depth (a root's is 0), root."""
    return climb(_standing(parents), up, lambda levels: F.lit(True)).select("set_id", "parent_id", F.col("climbed").alias("depth"), F.col("at").alias("root"))


def tree_depths(found: DataFrame) -> DataFrame:
    """root, depth (of its deepest set) of the trees of sets.latest_in_tree with more than a root.

    Equal sets of which each hangs on the one before are a run, as long as there are copies: runs are lifted, not sets.
    """
    order = Window.partitionBy("class_id", "root").orderBy("set_id")
    rows = found.filter("root is not null").withColumns({"before": F.lag("set_id").over(order), "place": F.row_number().over(order)})
    heads = F.when(F.col("before").isNull() | (F.col("before") != F.col("ancestor")), F.struct(F.col("set_id").alias("run"), "place"))
    rows = rows.withColumn("head", F.last(heads, ignorenulls=True).over(order))
    rows = stored(rows.select("set_id", "root", "ancestor", F.col("head.run").alias("run"), (F.col("place") - F.col("head.place")).cast("long").alias("behind")), "runs")
    longest = rows.groupBy("run").agg(F.max("behind").alias("more"))
    above = rows.select(F.col("set_id").alias("ancestor"), F.col("run").alias("up"), (F.col("behind") + 1).alias("steps"))
    first = rows.filter("behind = 0").select("run", "root", "ancestor").join(above, "ancestor", "left").join(longest, "run")
    left = stored(first.select("run", "root", "more", "up", F.coalesce("steps", F.lit(1).cast("long")).alias("steps")), "lifted")  # a run below a root is one step deep
    while not left.filter("up is not null").isEmpty():
        further = left.select(F.col("run").alias("up"), F.col("up").alias("next"), F.col("steps").alias("further"))
        left = stored(left.join(further, "up", "left").select("run", "root", "more", F.col("next").alias("up"), (F.col("steps") + F.coalesce("further", F.lit(0).cast("long"))).alias("steps")), "lifted")
    return left.groupBy("root").agg(F.max(F.col("steps") + F.col("more")).alias("depth"))


def limit_top_down(parents: DataFrame, limit: int) -> DataFrame:
    """Every limit levels below the first, sets hang on their root."""
    rows = depths(parents, lifts(parents))
    moves = (F.col("depth") > 1) & ((F.col("depth") - 1) % max(limit, 1) == 0)
    return rows.select("set_id", F.when(moves, F.col("root")).otherwise(F.col("parent_id")).alias("parent_id"))


def limit_bottom_up(parents: DataFrame, limit: int) -> DataFrame:
    """Every limit + 1 levels, sets become roots."""
    rows = depths(parents, lifts(parents))
    return rows.select("set_id", F.when(F.col("depth") % (limit + 1) == 0, F.lit(-1).cast("long")).otherwise(F.col("parent_id")).alias("parent_id"))


def limit_last_node(parents: DataFrame, limit: int) -> DataFrame:
    """Sets below the limit hang on their ancestor one level above it."""
    up = lifts(parents)
    rows = checkpointed(depths(parents, up).withColumns({"at": F.col("set_id"), "climbed": F.lit(0).cast("long")}))
    far = F.col("depth") - max(limit - 1, 0)  # levels to climb
    held = climb(rows, up, lambda levels: F.col("climbed") + levels <= far)
    return held.select("set_id", F.when(F.col("depth") > limit, F.col("at")).otherwise(F.col("parent_id")).alias("parent_id"))


def contract(parents: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets hang on the farthest ancestor of at most twice their size, or stay where they are. Ancestors are larger the farther they are."""
    sizes = sets.select("set_id", "n")
    next_n = sizes.select(F.col("set_id").alias("up"), F.col("n").alias("next_n"))
    found = climb(_standing(parents).join(sizes, "set_id"), lifts(parents), lambda levels: F.col("next_n") <= 2 * F.col("n"), lambda table: table.join(next_n, "up"))
    return found.select("set_id", F.when(F.col("climbed") > 0, F.col("at")).otherwise(F.col("parent_id")).alias("parent_id"))


def grow_trees(candidates: DataFrame, accepts: Column, limit: int | None, first_depth: int) -> DataFrame:
    """set_id, parent_id, depth: sets from the smallest on take their candidate parent if accepts holds and their depth is below the limit.

    candidates: set_id, parent_id (-1: none), with the columns that accepts needs; read once. A set's depth is one more than its
    deepest child's, or first_depth. A set is decided once all that have it as a candidate are: as many rounds as the candidates'
    longest chain has sets.
    """
    left = checkpointed(candidates.select("set_id", "parent_id", ((F.col("parent_id") >= 0) & F.coalesce(accepts, F.lit(False))).alias("takes"), F.lit(first_depth).alias("depth")))
    decided = []
    while not left.isEmpty():
        waits = left.filter("parent_id >= 0").select(F.col("parent_id").alias("set_id")).distinct()
        now = left.join(waits, "set_id", "left_anti")
        takes = F.col("takes") & (F.lit(True) if limit is None else F.col("depth") + 1 <= limit)
        now = checkpointed(now.select("set_id", F.when(takes, F.col("parent_id")).otherwise(F.lit(-1).cast("long")).alias("parent_id"), "depth"))
        if now.isEmpty():
            raise ValueError("candidates go in a circle")
        decided.append(now)
        reached = now.filter("parent_id >= 0").groupBy(F.col("parent_id").alias("set_id")).agg(F.max(F.col("depth") + 1).alias("reached"))
        rest = left.join(now.select("set_id"), "set_id", "left_anti").join(reached, "set_id", "left")
        left = checkpointed(rest.withColumn("depth", F.greatest("depth", F.coalesce("reached", "depth"))).drop("reached"))
    out = candidates.select("set_id", "parent_id", F.lit(first_depth).alias("depth")).limit(0)
    for part in decided:
        out = out.unionByName(part)
    return out


def tree_report(grown: DataFrame, sets: DataFrame) -> DataFrame:
    """One row: trees, max_depth, mean_depth (over roots), root_elements."""
    rows = grown.join(sets.select("set_id", "n"), "set_id")
    root = F.col("parent_id") < 0
    return rows.agg(F.count_if(root).alias("trees"), F.max("depth").cast("long").alias("max_depth"), F.avg(F.when(root, F.col("depth"))).alias("mean_depth"), F.sum(F.when(root, F.col("n"))).alias("root_elements"))


def root_kinds(grown: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """One row: the roots that are dense (a bitmap up to their largest element is smaller than their elements of width bits) and sparse, and the bits of both."""
    rows = grown.filter("parent_id < 0").join(sets.select("set_id", "n", F.coalesce(F.array_max("elems") + 1, F.lit(0).cast("long")).alias("bits")), "set_id")
    dense, sparse = F.col("bits") < F.col("n") * width, F.col("n") * width
    return rows.agg(
        F.count_if(dense).alias("dense_roots"), F.count_if(~dense).alias("sparse_roots"),
        F.coalesce(F.sum(F.when(dense, F.col("bits"))), F.lit(0).cast("long")).alias("dense_bits"), F.coalesce(F.sum(F.when(~dense, sparse)), F.lit(0).cast("long")).alias("sparse_bits"),
    )
