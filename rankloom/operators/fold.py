"""Folding rows of one company into one entity, and unions of its members' arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def domain_key(c: str):
    """Lower case, without scheme, path and blanks."""
    t = F.lower(F.trim(F.col(c)))
    return F.regexp_replace(F.regexp_replace(t, r"^https?://", ""), r"/.*$", "")


def fold(rows: DataFrame, *, id: str = "id", key: str = "key", tenant: str = "tenant_id") -> DataFrame:  # noqa: A002
    """``(canonical_id, key, member_ids)``: rows of one key are one entity, led by its first row without tenant, else its smallest id.

    An empty key is no key, so that such rows stay alone; null keys are no rows here, as the scan drops them.
    The partial aggregate keeps the leader; the members of an entity are collected, as they are the result.
    """
    shaped = rows.where(F.col(key).isNotNull()).select(F.col(id).alias("id"), F.col(key).alias("key"), F.col(tenant).isNotNull().alias("own"))
    group = F.when(F.col("key") == "", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(F.col("key"))
    grouped = shaped.groupBy(group.alias("g"), "key").agg(F.min(F.struct("own", "id")).alias("lead"), F.array_sort(F.collect_set("id")).alias("member_ids"))
    return grouped.select(F.col("lead.id").alias("canonical_id"), "key", "member_ids")


def fold_stats(folded: DataFrame) -> DataFrame:
    """One row: entities, rows, entities of several rows, and rows that were folded away."""
    n = F.size("member_ids")
    return folded.agg(F.count("*").alias("n_entities"), F.sum(n).cast("bigint").alias("n_rows"), F.count_if(n > 1).alias("n_multi"), F.sum(n - 1).cast("bigint").alias("n_collapsed"))


def members(canonical: DataFrame) -> DataFrame:
    """``(canonical_id, id)`` of each member, once."""
    return canonical.select("canonical_id", F.explode("member_ids").alias("id")).distinct()


def member_unions(canonical: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each array column's different elements over all members, sorted; every column is united by itself."""
    joined = members(canonical).join(rows.select("id", *columns), "id")
    united = joined.groupBy("canonical_id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in columns])
    return united.select("canonical_id", *[F.filter(c, lambda x: x.isNotNull()).alias(c) for c in columns])
