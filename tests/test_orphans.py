from datetime import datetime

from oracle import spark_rows, sql_rows

from rankloom.operators import orphans
from rankloom.operators.orphans import find_orphans
from rankloom.plans.record_queries import QUERIES, SQL

T1, T2, T3 = datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5)
REFS = "rec long, ref long, seen timestamp_ntz, key string, record_id string"
PARENTS = "pk long, made timestamp_ntz, ref string"


def _found(spark, refs, parents, gone):
    df = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(gone, "key_id long"), record="rec", ref="ref", seen="seen", key="pk", made="made")
    return sorted(tuple(r) for r in df.collect())


def test_cases(spark):
    refs = [(1, 10, T2, "", ""), (2, 11, T1, "", ""), (3, 12, T2, "", ""), (4, 13, None, "", ""), (5, None, T1, "", ""), (6, 14, T2, "", ""), (7, 11, None, "", ""), (3, 12, T2, "", ""), (8, 15, T1, "", ""), (9, 16, T2, "", "")]
    parents = [(10, T2, ""), (11, T2, ""), (14, None, ""), (15, T3, ""), (15, T1, ""), (None, T1, ""), (16, T1, "")]
    assert _found(spark, refs, parents, [(12,), (12,), (16,), (None,)]) == [(2, 11, "late", "2024-01"), (3, 12, "deleted", "2024-02"), (4, 13, "missing", "none")]


def test_empty_tables(spark):
    assert _found(spark, [], [], []) == []
    assert _found(spark, [(1, 2, T1, "", "")], [], [(3,)]) == [(1, 2, "missing", "2024-01")]
    assert _found(spark, [], [(1, T1, "")], []) == []


def test_ranges_and_hot_ranges_change_nothing(spark, data, monkeypatch):
    plain = spark_rows(QUERIES["p5_found"](spark, data))
    monkeypatch.setattr(orphans, "RANGE_KEYS", 50)
    monkeypatch.setattr(orphans, "SHARE_REFS", 40)
    assert spark_rows(QUERIES["p5_found"](spark, data)) == plain == sql_rows(SQL["p5_found"], data)
