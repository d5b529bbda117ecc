from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.llm.survivor import claims, fuse, has_value, survivors

T = [datetime(2024, 1, d) for d in range(1, 9)]
MEMBERS = "id long, source string, updated_at timestamp_ntz, city string, entity string, field string, value string"


def _claims(spark, groups, rows):
    e = spark.createDataFrame(groups, "cid long, ids array<long>, member long")
    return claims(e, spark.createDataFrame([(*r, "x", "y", "z") for r in rows], MEMBERS), entity="cid", member_ids="ids", member="id", source="source", stamp="updated_at", fields=("city",))


def test_prescribed_order(spark):
    rows = [(1, "low", T[5], "A"), (2, "high", T[1], "B"), (3, "high", T[2], "n/a"), (4, "high", None, "C"), (5, None, T[7], "D"), (6, "low", T[6], " "), (7, "low", None, "E"), (8, "low", None, "F")]
    trust = spark.createDataFrame([("low", 1), ("high", 5), (None, 9)], "source string, trust int")
    c = _claims(spark, [(10, [1, 2, 3, 2, 99], 0), (11, [1, 5, 6], 0), (12, [3, 6], 0), (13, [7, 8], 0), (14, None, 0), (None, [1], 0)], rows)
    got = {r.entity: (r.member, r.value) for r in survivors(c, trust).collect()}
    assert got[10] == (2, "B") and got[11] == (1, "A") and 12 not in got and got[13][0] in (7, 8) and set(got) == {10, 11, 13}


def test_copied_votes_count_less(spark):
    """Two sources share false values that three others contradict; where only one other speaks, their two votes must not win."""
    groups, rows, i = [], [], 0
    for e in range(120):
        ids = []
        alone = e % 10 == 1
        wrong = e % 3 == 0 or alone
        for s in ("c1", "c2", "x") if alone else ("c1", "c2", "x", "y", "z"):
            i += 1
            rows.append((i, s, T[0], f"false {e}" if wrong and s[0] == "c" else f"true {e}"))
            ids.append(i)
        groups.append((e, ids, 0))
    c = _claims(spark, groups, rows)
    _, accuracy, depend = fuse(c, rounds=5)
    accuracy, depend = {r.s: r.a for r in accuracy.collect()}, {(r.x, r.y): r.p for r in depend.collect()}
    assert depend["c1", "c2"] > 0.9 > 0.6 > depend.get(("x", "y"), 0)
    assert accuracy["x"] > 0.9 > 0.75 > accuracy["c1"]
    got = {r.entity: r.value for r in survivors(c, rounds=5).collect()}
    assert all(got[e] == f"true {e}" for e in range(120))


def test_empty_and_extra(spark):
    c = _claims(spark, [], [])
    assert survivors(c).count() == 0
    one = _claims(spark, [(1, [1, 1], 0)], [(1, None, None, "x" * 100_000), (1, None, None, "x" * 100_000)])
    assert survivors(one).collect()[0].member == 1


@pytest.mark.parametrize("text, want", [("", False), (None, False), ("  ", False), ("N/A", False), ("--", False), ("?", False), ("Unknown", False), ("(blank)", False), ("N.A.", True), ("na", True), ("Ostmere", True)])
def test_has_value(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(has_value(F.col("v")).alias("h")).first().h is want


def test_found_equals_sql(spark, data):
    from oracle import spark_rows, sql_rows

    from rankloom.llm.queries import QUERIES, SQL

    assert spark_rows(QUERIES["p7_found"](spark, data)) == sql_rows(SQL["p7_found"], data)


def test_every_source_has_its_own_accuracy(spark):
    """More sources than any list would hold by name: the last one by name is the liar."""
    groups, rows, i = [], [], 0
    for e in range(900):
        ids = []
        for s, v in ((f"s{e % 700:04}", f"true {e}"), (f"t{e % 450:04}", f"true {e}"), (f"u{e % 300:04}", f"true {e}"), ("zz", f"false {e}")):
            i += 1
            rows.append((i, s, T[0], v))
            ids.append(i)
        groups.append((e, ids, 0))
    _, accuracy, _ = fuse(_claims(spark, groups, rows))
    a = {r.s: r.a for r in accuracy.collect()}
    assert len(a) == 1451 and a["zz"] < 0.1 and min(v for k, v in a.items() if k != "zz") > 0.9


def test_planted_truth_is_fused_back(spark):
    """Sources of known accuracy, one copier among them: the most probable values are the true ones."""
    import random

    rng = random.Random(9)
    right = {"a": 0.95, "b": 0.85, "c": 0.75, "d": 0.6}
    groups, rows, i = [], [], 0
    for e in range(400):
        ids, said = [], {}
        for s, p in right.items():
            if rng.random() < 0.8:
                said[s] = f"true {e}" if rng.random() < p else f"false {e} {rng.randrange(8)}"
        if "d" in said:
            said["copy"] = said["d"]
        for s, v in said.items():
            i += 1
            rows.append((i, s, T[0], v))
            ids.append(i)
        groups.append((e, ids, 0))
    got = {r.entity: r.value for r in survivors(_claims(spark, groups, rows)).collect()}
    many = [e for e, ids, _ in groups if len(ids) > 2]
    assert len(many) > 200 and sum(got[e] == f"true {e}" for e in many) / len(many) > 0.93
