"""One ranking from several scores of different scale: ideal-point ranking.

Within a group each score is brought to its place in the group's distribution, winsorised at both
ends and vector-normalised; the rank order is that of the relative closeness to the ideal point
against the anti-ideal one. Without the step to places the vector norm of a heavy-tailed score lets
one outlier squeeze all other values together, and a score with a narrow spread far from zero would
count for nothing. Everything is a sketch aggregate per group and an expression per row, so that a
group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a group's distribution, accuracy of their sketch (relative error 1/accuracy), winsorised share at each end.
POINTS, ACCURACY, TAIL = 64, 10_000, 0.01


def _place(value: Column, grid: Column) -> Column:
    """Between 0 and 1: the value's place on the grid of quantiles, halfway through equal points."""
    below = F.size(F.filter(grid, lambda g: g < value))
    upto = F.size(F.filter(grid, lambda g: g <= value))
    lo, hi = F.get(grid, below - 1), F.get(grid, below)
    between = below - 1 + (value - lo) / (hi - lo)
    return F.when(upto > below, (below + upto - 1) / 2.0).when(below == 0, F.lit(0.0)).when(below > POINTS, F.lit(float(POINTS))).otherwise(between) / POINTS


def closeness(df: DataFrame, group: str, scores: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``closeness`` (0 to 1, higher is nearer to the ideal): all scores are better if higher.

    Defined cases: a missing or NaN score takes the middle place, so that it counts neither for nor
    against; of equal values all take the same place; a score with one value in the whole group, or
    none, tells nothing; a null group is a group. A column of ``df`` called ``closeness`` is replaced.
    """
    weights = list(weights or [1.0] * len(scores))
    at = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")) for s in scores]
    base = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.col(group).alias("__g"), *[c.alias(f"__s{i}") for i, c in enumerate(clean)])
    grids = base.groupBy("__g").agg(*[F.percentile_approx(f"__s{i}", at, ACCURACY).alias(f"__q{i}") for i in range(len(scores))]).withColumnRenamed("__g", "__h")
    placed = base.join(grids, F.col("__g").eqNullSafe(F.col("__h")))
    for i in range(len(scores)):
        flat = F.col(f"__q{i}").isNull() | (F.get(f"__q{i}", F.lit(0)) == F.get(f"__q{i}", F.lit(POINTS)))
        place = F.when(F.col(f"__s{i}").isNull() | flat, 0.5).otherwise(_place(F.col(f"__s{i}"), F.col(f"__q{i}")))
        placed = placed.withColumn(f"__p{i}", F.greatest(F.lit(TAIL), F.least(F.lit(1 - TAIL), place)))
    # Vector norms, ideal and anti-ideal of each group: partial aggregates only.
    shape = placed.groupBy("__g").agg(*[f(f"__p{i}").alias(f"__{k}{i}") for i in range(len(scores)) for k, f in (("hi", F.max), ("lo", F.min), ("n", lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))))])
    shape = shape.withColumnRenamed("__g", "__h2")
    out = placed.join(shape, F.col("__g").eqNullSafe(F.col("__h2")))

    def far(end: str) -> Column:
        return F.sqrt(reduce(Column.__add__, [F.pow(F.lit(w) * (F.col(f"__p{i}") - F.col(f"__{end}{i}")) / F.col(f"__n{i}"), F.lit(2.0)) for i, w in enumerate(weights)]))

    near, away = far("hi"), far("lo")
    rel = F.when(near + away > 0, away / (near + away)).otherwise(0.5)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c != "closeness"], F.round(rel, 12).alias("closeness"))


def rank_items(df: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float] | None = None, *, top: int | None = None) -> DataFrame:
    """``(group, item, closeness[, place])`` with each item of a group once, by its nearest row.

    With ``top`` only the first ones, numbered 1 to ``top`` by (closeness descending, item); the rest of
    a group is dropped before the exchange, in each task. Repeated rows count once, also in the
    distributions. Null items are no items. An empty input gives no rows.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(s).alias(f"s{k}") for k, s in enumerate(scores)]).where("i IS NOT NULL").distinct()
    best = closeness(rows, "g", [f"s{k}" for k in range(len(scores))], weights).groupBy("g", "i").agg(F.max("closeness").alias("closeness"))
    if top is None:
        return best.select(F.col("g").alias(group), F.col("i").alias(item), "closeness")
    from pyspark.sql import Window as W

    # The comparison with row_number() is pushed below the exchange (WindowGroupLimit): at most ``top`` rows of a group leave a task.
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(F.desc("closeness"), "i"))).where(F.col("place") <= top)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "closeness", "place")
