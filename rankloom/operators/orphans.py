"""References to records that do not exist, are deleted or arrive late.

Parents are cut into ranges of their keys; each range holds one sorted array, against which whole
batches of references are probed by binary search. Ranges that many references hit are salted: the
array of the range, whose size is bounded, is repeated for each share of its references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros, month

#: Keys in a parent range, references in one share of a range, and ranges at most; beyond that many
#: ranges the arrays get longer, not fewer rows.
RANGE_KEYS, SHARE_REFS, MOST_RANGES = 200_000, 500_000, 65_536
NO_TIME = np.iinfo(np.int64).min


def _bounds(keys: DataFrame) -> np.ndarray:
    """Lower bounds of all ranges but the first, from a quantile sketch over all keys."""
    n = keys.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_KEYS)) if n else 1
    if ranges < 2:
        return np.empty(0, np.int64)
    at = ",".join(f"{i / ranges:.8f}D" for i in range(1, ranges))
    got = keys.select(F.expr(f"percentile_approx(key, array({at}), {max(10_000, 20 * ranges)})").alias("b")).first()
    return np.unique(np.array(got.b, np.int64))


def _in_range(bounds: np.ndarray, column: str):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(range_id=np.searchsorted(bounds, b[column].to_numpy(np.int64), side="right").astype(np.int32))

    return assign


def _probe(_: tuple, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    ref = refs["ref_id"].to_numpy(np.int64)
    gone = np.unique(parents.loc[parents["deleted"], "key"].to_numpy(np.int64))
    here = parents.loc[~parents["deleted"]]
    key, made = here["key"].to_numpy(np.int64), here["made"].fillna(NO_TIME).to_numpy(np.int64)
    order = np.lexsort((made, key))  # of a repeated key the earliest row counts
    key, made = key[order], made[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key, made = key[first], made[first]

    def found(array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(array, ref)
        ok = at < len(array)
        ok[ok] = array[at[ok]] == ref[ok]
        return ok, at

    exists, at = found(key)
    deleted, _ = found(gone)
    seen = refs["seen"].to_numpy()
    known = ~pd.isna(seen)
    late = np.zeros(len(ref), bool)
    test = exists & known
    late[test] = made[at[test]] > seen[test].astype(np.int64)
    reason = np.where(~exists, np.where(deleted, "deleted", "missing"), np.where(late, "late", ""))
    miss = reason != ""
    return pd.DataFrame({"record_id": refs["record_id"].to_numpy()[miss], "ref_id": ref[miss], "reason": reason[miss], "period": refs["period"].to_numpy()[miss]})


def find_orphans(refs: DataFrame, parents: DataFrame, deletions: DataFrame | None = None, *, record: str, ref: str, seen: str, key: str, made: str, deleted_key: str = "key_id") -> DataFrame:
    """Rows ``(record_id, ref_id, reason, period)`` of the references whose parent is not there.

    ``reason`` is ``deleted`` if ``deletions`` holds the missing key, else ``missing``; ``late`` if the
    parent's ``made`` is after the record's ``seen``. ``period`` is the month of ``seen``.

    Defined cases: a null reference is none; a null ``seen`` is never late and its period is ``none``;
    a null ``made`` is never late; null parent keys are ignored; of repeated parents the earliest
    counts; a record delivered several times is reported once, by its smallest (reference, reason,
    period) among those that miss; equal times are not late; a key that is logged as deleted and
    exists again exists; empty tables give no rows or only misses. Other columns are never looked at.
    """
    child = refs.select(F.col(record).cast("bigint").alias("record_id"), F.col(ref).cast("bigint").alias("ref_id"), micros(seen).alias("seen"), month(seen).alias("period")).where("ref_id IS NOT NULL")
    live = parents.select(F.col(key).cast("bigint").alias("key"), micros(made).alias("made"), F.lit(False).alias("deleted")).where("key IS NOT NULL")
    both = live
    if deletions is not None:
        both = live.unionByName(deletions.select(F.col(deleted_key).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("made"), F.lit(True).alias("deleted")).where("key IS NOT NULL").distinct())
    bounds = _bounds(live.select("key"))
    child = child.mapInPandas(_in_range(bounds, "ref_id"), "record_id bigint, ref_id bigint, seen bigint, period string, range_id int")
    both = both.mapInPandas(_in_range(bounds, "key"), "key bigint, made bigint, deleted boolean, range_id int")
    # Counts of a bounded number of ranges decide how many shares a hot range gets.
    shares = {r.range_id: -(-r["count"] // SHARE_REFS) for r in child.groupBy("range_id").count().collect()}
    # One literal array, indexed by the range, however many ranges are hot.
    n_shares = F.lit(1)
    if any(v > 1 for v in shares.values()):
        listed = ", ".join(str(max(1, shares.get(k, 1))) for k in range(len(bounds) + 1))
        n_shares = F.expr(f"element_at(from_json('[{listed}]', 'array<int>'), range_id + 1)")
    child = child.withColumn("share", F.pmod(F.xxhash64("record_id"), n_shares).cast("int"))
    both = both.withColumn("share", F.explode(F.sequence(F.lit(0), n_shares - 1)))
    misses = child.groupBy("range_id", "share").cogroup(both.groupBy("range_id", "share")).applyInPandas(_probe, "record_id bigint, ref_id bigint, reason string, period string")
    once = misses.groupBy("record_id").agg(F.min(F.struct("ref_id", "reason", "period")).alias("m"))
    return once.select("record_id", "m.ref_id", "m.reason", "m.period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per table, month and reason."""
    return found.groupBy("src_table", "period", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_keys"))
