"""Running totals within groups over data of any size and any skew.

Rows are range-partitioned by (group, order), so that a group may span any number of partitions; each
partition sums its own pieces, and only these sums (one per partition and group it touches) meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut


def running_totals(df: DataFrame, group: str, order: Sequence[str], value: str, *, name: str = "before", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (a bigint; null adds nothing) over the rows of the group ahead of each row.

    Rows run by ``order``; rows equal in it all get a place, in no set order, so end it in a unique
    column. A null group is a group. An empty input gives no rows.
    """
    keys = [group, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    kept = cut(ranged.sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    sums = kept.groupBy(F.col(group).alias("g"), "__part").agg(F.sum(value).cast("bigint").alias("s"))
    ahead = W.partitionBy("g").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    first = {(r["__part"], r.g): int(r.o) for r in sums.withColumn("o", F.coalesce(F.sum("s").over(ahead), F.lit(0))).where("o > 0").collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = object(), 0
        for b in batches:
            if not len(b):
                continue
            g = b[group].astype(object).where(b[group].notna(), None).to_numpy()
            v = b[value].fillna(0).to_numpy(np.int64)
            out = np.empty(len(b), np.int64)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(b)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if g[s] != last:
                    last, total = g[s], first.get((int(b["__part"].iat[0]), g[s]), 0)
                out[s:e] = total + np.cumsum(v[s:e]) - v[s:e]
                total += int(v[s:e].sum())
            yield b.drop(columns="__part").assign(**{name: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name) + f", `{name}` bigint"
    return kept.mapInPandas(run, schema)
