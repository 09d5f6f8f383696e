"""The k nearest targets of every point, within groups, by grids whose cells double until the k-th distance fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.shared import stored

#: Groups of so many targets at most are compared with all of them.
SMALL = 64
#: Halvings of a group's extent at most.
DEEPEST = 20


def _ranked(met: DataFrame, group: str, ids: list[str], target: str, k: int, squared: bool) -> DataFrame:
    """The `k` nearest of all pairs met, as `d` and `rn`; ties go to the smaller target."""
    square = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    order = Window.partitionBy(group, *ids).orderBy("d", target)
    return met.withColumn("d", square if squared else F.sqrt(square)).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def _finest(targets: DataFrame, sizes: DataFrame, group: str, k: int) -> DataFrame:
    """`sizes` with `level`: the most halvings of the extent at which cells that aren't empty hold k targets on average."""
    deep = F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("~n") / k) / 2) + 4).cast("int")
    each = targets.select(group, "tx", "ty").join(sizes, group).where("`~extent` > 0").withColumn("~level", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), deep))))
    cell = [F.floor((F.col(c) - F.col(o)) * F.pow(F.lit(2.0), "~level") / F.col("~extent")).alias(g) for c, o, g in (("tx", "~x0", "gx"), ("ty", "~y0", "gy"))]
    cells = each.select(group, "~n", "~level", *cell).distinct().groupBy(group, "~n", "~level").agg(F.count("*").alias("~cells"))
    best = cells.where(F.col("~n") >= F.col("~cells") * k).groupBy(group).agg(F.max("~level").alias("~level"))
    return sizes.join(best, group, "left").na.fill(0, ["~level"])


def nearest_k(points: DataFrame, targets: DataFrame, k: int, group: str = "pair", ids: tuple[str, ...] = ("pt",), target: str = "m", squared: bool = False) -> DataFrame:
    """Every point's row with each of its `k` nearest targets' rows of the same group, the distance `d` (its square if `squared`) and the
    rank `rn` from 1; ties go to the smaller `target`. points: (group, *ids, x, y, ...), ids unique within the group; targets: (group, target, tx, ty, ...).

    In a group of more than SMALL targets a point looks at the cells around its own only. The cell's size is the one at which filled cells hold
    k targets on average; a point is done when its k-th distance is within one cell, else it goes into the next round, with cells of twice the
    size. Of targets in one spot only the k smallest are looked at. So where targets are spread evenly, work grows with points times k; a hot group
    is dealt out by its cells. Points without coordinates and groups without targets give no rows.
    """
    points = points.where("x IS NOT NULL AND y IS NOT NULL")
    targets = targets.where("tx IS NOT NULL AND ty IS NOT NULL")
    sizes = targets.groupBy(group).agg(F.count("*").alias("~n"), F.min("tx").alias("~x0"), F.min("ty").alias("~y0"),
                                       F.greatest(F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty")).alias("~extent"))
    small = points.join(targets.join(sizes.where(F.col("~n") <= SMALL).select(group), group), group)
    columns = list(dict.fromkeys([*points.columns, *targets.columns, "d", "rn"]))
    found = _ranked(small, group, [*ids], target, k, squared).select(columns)
    sizes = sizes.where(F.col("~n") > SMALL)
    if not sizes.limit(1).count():
        return found
    sizes = stored(_finest(targets, sizes, group, k))
    spot = Window.partitionBy(group, "tx", "ty").orderBy(target)
    targets = stored(targets.join(sizes, group).withColumn("~spot", F.row_number().over(spot)).where(F.col("~spot") <= k).drop("~spot"))
    waiting = stored(points.join(sizes, group))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    rounds = 0
    while waiting.limit(1).count():
        # The last round of a group is at level 0 or below: its targets are then all looked at.
        level = F.col("~level") - rounds
        cell = lambda c, o: F.when(level <= 0, 0).otherwise(F.floor((F.col(c) - F.col(o)) * F.pow(F.lit(2.0), level) / F.col("~extent")))  # noqa: E731,B023
        near = waiting.select(*points.columns, (F.col("~extent") / F.pow(F.lit(2.0), level)).alias("~side"), "~level", cell("x", "~x0").alias("~cx"), cell("y", "~y0").alias("~cy"))
        near = near.withColumn("~gx", F.explode(F.when(level <= 0, F.array(F.lit(0))).otherwise(F.transform(around, lambda i: i + F.col("~cx")))))
        near = near.withColumn("~gy", F.explode(F.when(level <= 0, F.array(F.lit(0))).otherwise(F.transform(around, lambda i: i + F.col("~cy")))))
        held = targets.withColumns({"~gx": cell("tx", "~x0"), "~gy": cell("ty", "~y0")}).drop("~n", "~x0", "~y0", "~extent", "~level")
        best = stored(_ranked(near.join(held, [group, "~gx", "~gy"]), group, [*ids], target, k, squared))
        reach = F.pow("~side", F.lit(2.0 if squared else 1.0)) * (1 - 1e-9)
        done = best.groupBy(group, *ids).agg(((F.max("rn") == k) & (F.max("d") <= F.first(reach)) | (F.first("~level") <= rounds)).alias("~done")).where("`~done`").drop("~done")
        done = stored(done)
        found = found.unionByName(best.join(done, [group, *ids], "left_semi").select(columns))
        waiting = stored(waiting.join(done, [group, *ids], "left_anti"))
        rounds += 1
    return found
