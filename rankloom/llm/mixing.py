"""Mixing sources to target weights.

Documents get a hash-random key and are range-sorted by it within their source; distributed prefix
sums of their sizes say where each source's budget ends. A budget above the source's size takes it
whole for as many epochs as fit and cuts the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_totals
from ..plans.lineage import cut


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens of each source. Shares of sources that have nothing go to the others in proportion; without ``total``
    the mix is the largest that keeps all shares within the repeats, with it no source exceeds its repeats."""
    there = {s: share for s, (share, _) in targets.items() if available.get(s, 0) > 0 and share > 0}
    whole = sum(there.values())
    if not there:
        return {}
    most = {s: available[s] * targets[s][1] for s in there}
    size = min(most[s] * whole / share for s, share in there.items()) if total is None else total
    return {s: min(most[s], round(size * share / whole)) for s, share in there.items()}


def mix(sizes: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``(id, source, n_tokens, uses)`` of every document: how often the mix takes it.

    ``sizes`` is (``id``, ``source``, ``n_tokens``), ``targets`` (``source``, ``target_share``, ``max_repeats``), a short list. A document
    is used in the last, partial epoch if its middle lies within the budget, so that each source ends
    within half a document of it. Defined cases: sources without a target, and a null source, are not
    used; targets without documents give their share to the others; null shares and repeats count
    as 0; documents without tokens are used like their neighbours; rows that repeat an id are
    documents of their own; empty tables give no rows or no uses.
    """
    sized = cut(sizes.select("id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    has = {r.source: int(r.n or 0) for r in sized.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if wanted else {}
    plan = budgets(has, wanted, total)
    keyed = sized.withColumn("key", F.xxhash64("id", F.lit(seed)))
    placed = running_totals(keyed, "source", ["key", "id"], "n_tokens", partitions=partitions)
    epochs = rest = F.lit(0).cast("bigint")
    for s, b in plan.items():
        epochs = F.when(F.col("source") == s, b // has[s]).otherwise(epochs)
        rest = F.when(F.col("source") == s, b % has[s]).otherwise(rest)
    once = (F.col("before") * 2 + F.col("n_tokens") <= rest * 2) & (rest > 0)
    return placed.select("id", "source", "n_tokens", (epochs + F.when(once, 1).otherwise(0)).cast("bigint").alias("uses"))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source, of targets without documents too.

    ``share_there`` is the target among the sources that have documents, which get the shares of those that have none.
    """
    used = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    total = used.agg(F.sum("used_tokens").alias("all_tokens"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    there = wanted.join(used.where("available_tokens > 0"), "source", "left_semi").agg(F.sum("target_share").alias("all_shares"))
    both = wanted.join(used, "source", "full").join(F.broadcast(total)).join(F.broadcast(there))  # one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    share = F.when(F.col("all_tokens") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("all_tokens")).otherwise(0.0)
    return both.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.round(F.when((F.col("available_tokens") > 0) & (F.col("all_shares") > 0), F.coalesce("target_share", F.lit(0.0)) / F.col("all_shares")).otherwise(0.0), 6).alias("share_there"), zero("n_docs"), zero("available_tokens"), zero("used_tokens"), zero("most_uses"), F.round(share, 6).alias("actual_share"))
