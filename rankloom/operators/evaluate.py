"""Measures of rankings, and the search for weights."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import best_per

PRECISION_AT, RECALL_AT = 10, 50


def measures(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled query: precision, recall, reciprocal rank, and the ceilings that its labels allow.

    ``ranked`` is (query_id, item, place), ``labels`` (query_id, item), each relevant once. A query without any relevant
    item is one to refuse: all of its measures are 1 if nothing came back, else 0.
    """
    relevant = labels.where("item IS NOT NULL").distinct()
    queries = labels.select("query_id").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.join(relevant, ["query_id", "item"]).groupBy("query_id").agg(F.count_if(F.col("place") <= PRECISION_AT).alias("h10"), F.count_if(F.col("place") <= RECALL_AT).alias("h50"), F.min("place").alias("first"))
    came = ranked.groupBy("query_id").agg(F.count("*").alias("n_back"))
    q = queries.join(total, "query_id", "left").join(hits, "query_id", "left").join(came, "query_id", "left").na.fill(0, ["n_relevant", "h10", "h50", "n_back"])
    empty, right = F.col("n_relevant") == 0, F.when(F.col("n_back") == 0, 1.0).otherwise(0.0)
    n = F.col("n_relevant").cast("double")
    top = lambda k: F.least(n, F.lit(float(k)))
    return q.select(
        "query_id", "n_relevant",
        F.when(empty, right).otherwise(F.col("h10") / float(PRECISION_AT)).alias("precision"),
        F.when(empty, right).otherwise(F.col("h50") / F.nullif(n, F.lit(0.0))).alias("recall"),
        F.when(empty, right).otherwise(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("reciprocal"),
        F.when(empty, 1.0).otherwise(top(PRECISION_AT) / float(PRECISION_AT)).alias("precision_ceiling"),
        F.when(empty, 1.0).otherwise(top(RECALL_AT) / F.nullif(n, F.lit(0.0))).alias("recall_ceiling"),
    )


def composite(rows: DataFrame) -> DataFrame:
    """One row: the mean of the three measures, each against its ceiling."""
    means = rows.agg(F.avg(F.col("precision") / F.col("precision_ceiling")).alias("p"), F.avg(F.col("recall") / F.col("recall_ceiling")).alias("r"), F.avg("reciprocal").alias("m"))
    return means.select(((F.col("p") + F.col("r") + F.col("m")) / 3).alias("composite"), "p", "r", "m")


def forbidden_hits(ranked: DataFrame, forbidden: DataFrame, within: int) -> DataFrame:
    """Forbidden items (query_id, item) among the first places."""
    return ranked.where(F.col("place") <= within).join(forbidden.distinct(), ["query_id", "item"], "left_semi")


def weight_grid(step: int = 5, most_best_doc: int = 80) -> list[tuple[float, float, float, float]]:
    """All weights (coverage, recency, volume, best_doc) in steps of ``step`` percent that sum to 1."""
    return [(a / 100, b / 100, c / 100, (100 - a - b - c) / 100) for a in range(0, 101, step) for b in range(0, 101 - a, step) for c in range(0, 101 - a - b, step) if 100 - a - b - c <= most_best_doc]


def tune(axes: DataFrame, labels: DataFrame, grid: Sequence[tuple[float, float, float, float]], prior: tuple[float, float, float, float]) -> DataFrame:
    """``(grid_id, composite, distance)`` of every point, best first, of equals the one nearest to the prior.

    ``axes`` (query_id, item, coverage, recency, volume, best_doc) is retrieved once and scored for each point of the grid, a list of
    a few thousand that travels as one array; only the first places of each (point, query) leave a task.
    """
    # One literal each, parsed once when the plan is made.
    listed = json.dumps([{"grid_id": i, **{f"w{k}": float(x) for k, x in enumerate(p)}} for i, p in enumerate(grid)])
    points = F.from_json(F.lit(listed), "array<struct<grid_id: int, w0: double, w1: double, w2: double, w3: double>>")
    each = axes.withColumn("g", F.explode(points))
    total = F.col("g.w0") * F.col("coverage") + F.col("g.w1") * F.col("recency") + F.col("g.w2") * F.col("volume") + F.col("g.w3") * F.col("best_doc")
    scored = each.select(F.struct(F.col("g.grid_id").alias("grid_id"), "query_id").alias("query_id"), "item", F.round(total, 9).alias("s"))
    from pyspark.sql import Window as W

    placed = best_per(scored, "query_id", F.desc("s"), F.asc("item"), n=RECALL_AT).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), F.asc("item"))))
    wide = labels.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).select(F.struct(F.col("g").alias("grid_id"), "query_id").alias("query_id"), "item")
    rows = measures(placed.select("query_id", "item", "place"), wide)
    by = rows.groupBy(F.col("query_id.grid_id").alias("grid_id")).agg(F.avg(F.col("precision") / F.col("precision_ceiling")).alias("p"), F.avg(F.col("recall") / F.col("recall_ceiling")).alias("r"), F.avg("reciprocal").alias("m"))
    off = F.element_at(F.from_json(F.lit(json.dumps([sum(abs(a - b) for a, b in zip(p, prior)) for p in grid])), "array<double>"), F.col("grid_id") + 1)
    return by.select("grid_id", F.round((F.col("p") + F.col("r") + F.col("m")) / 3, 9).alias("composite"), F.round(off, 6).alias("distance")).orderBy(F.desc("composite"), "distance", "grid_id")
