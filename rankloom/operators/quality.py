"""Profiles, integrity and completeness of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of columns that identify a person.
PERSONAL = re.compile(r"(first|last|middle|full|nick)_?name|e?mail|phone|mobile|address|birth|photo|linkedin|twitter|facebook", re.I)


def histogram(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))


def element_histogram(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return histogram(df.select(F.explode(column).alias("__e")), "__e", name)


def month_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.date_format(F.date_trunc("month", column), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def orphans(rows: DataFrame, ref: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't null and has no parent."""
    return rows.where(F.col(ref).isNotNull()).join(parents.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def integrity(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """``(check, n_rows, n_orphans)`` of each (name, rows, reference, parents, key), in one plan."""
    parts = []
    for name, rows, ref, parents, key in checks:
        known = parents.select(F.col(key).alias("k")).distinct().withColumn("hit", F.lit(True))
        joined = rows.select(F.col(ref).alias("k")).join(known, "k", "left")
        parts.append(joined.agg(F.lit(name).alias("check"), F.count("*").alias("n_rows"), F.count_if(F.col("k").isNotNull() & F.col("hit").isNull()).alias("n_orphans")))
    return reduce(DataFrame.unionByName, parts)


def completeness(df: DataFrame, table: str) -> DataFrame:
    """``(table, column, n_rows, n_filled)`` of every column, from one pass."""
    names = df.columns
    one = df.agg(F.count("*").alias("n_rows"), *[F.count(F.col(c)).alias(f"f{i}") for i, c in enumerate(names)])
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("n_filled")) for i, c in enumerate(names)]))
    return one.select(F.lit(table).alias("table"), "n_rows", stacked.alias("s")).select("table", "s.column", "n_rows", "s.n_filled")


def gate(share: Column, floor: float) -> Column:
    return F.when(share >= floor, "PASS").otherwise("FAIL")


def personal_columns(df: DataFrame) -> list[str]:
    """Columns that identify a person, and names other than those of employers and titles."""
    return [c for c in df.columns if PERSONAL.search(c) or (c.lower().endswith("name") and not re.search("employer|title", c, re.I))]


def table_counts(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables])


def polymorphic(rows: DataFrame, kind: str, ref: str, parents: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(kind, n_rows, n_found)``: references whose table is named by the row itself; rows of a kind without a table have none.

    The keys of all tables are one relation, so that each reference is looked up once, by (kind, key).
    """
    keys = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), F.col(key).cast("bigint").alias("ref")).distinct() for k, (df, key) in parents.items()]).withColumn("hit", F.lit(1))
    each = rows.select(F.col(kind).alias("kind"), F.col(ref).cast("bigint").alias("ref")).join(keys, ["kind", "ref"], "left")
    return each.groupBy("kind").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_found"))


def stale_labels(labels: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Labelled items that no longer exist; measures over them would be wrong."""
    return orphans(labels, item, items, item).select(item).distinct()


def check_labels(labels: DataFrame, items: DataFrame, item: str) -> None:
    """Raises if any label is stale, with some of them."""
    gone = [r[0] for r in stale_labels(labels, items, item).orderBy(item).limit(10).collect()]
    if gone:
        raise ValueError(f"labels name items that do not exist, among them {gone}")
