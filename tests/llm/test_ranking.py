import pytest

from rankloom.llm.ranking import closeness, rank_items

SCHEMA = "q long, item long, a double, b double, c float, closeness string, g string"


def _df(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_no_scale_dominates(spark):
    # The huge, heavy-tailed first score alone must not decide.
    rows = [(1, i, 10.0 ** (i % 12), (i * 7 % 40) / 40, 0.9 + (i * 11 % 40) / 1000) for i in range(40)] + [(1, 100, 10.0**11, 0.99, 0.95)]
    got = [r.item for r in rank_items(_df(spark, rows), "q", "item", ("a", "b", "c"), top=3).orderBy("place").collect()]
    assert got[0] == 100
    for factor in (1e-6, 1e6):
        other = [(q, i, a * factor, b, c) for q, i, a, b, c in rows]
        assert [r.item for r in rank_items(_df(spark, other), "q", "item", ("a", "b", "c"), top=3).orderBy("place").collect()] == got


def test_cases(spark):
    rows = [(1, 1, 5.0, None, None), (1, 2, 5.0, None, 0.5), (1, 3, float("nan"), None, 0.5), (1, 2, 5.0, None, 0.5), (None, 4, 1.0, 1.0, 1.0), (1, None, 9.0, 9.0, 9.0), (2, 7, 1.0, 1.0, 1.0)]
    got = {(r.q, r.item): r.closeness for r in rank_items(_df(spark, rows), "q", "item", ("a", "b", "c")).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (None, 4), (2, 7)}
    assert got[1, 1] == got[1, 2] >= got[1, 3]  # a missing score takes the middle place, equal ones tie
    assert got[2, 7] == 0.5  # alone in its group: nothing to tell
    ties = rank_items(_df(spark, [(1, i, 1.0, 1.0, 1.0) for i in range(5)]), "q", "item", ("a", "b", "c"), top=2).orderBy("place").collect()
    assert [r.item for r in ties] == [0, 1]
    assert rank_items(_df(spark, []), "q", "item", ("a", "b", "c"), top=2).count() == 0
    assert closeness(_df(spark, rows), "q", ["a"]).columns == ["q", "item", "a", "b", "c", "g", "closeness"]


def test_against_plain_topsis_on_places(spark, data):
    import numpy as np
    import pandas as pd

    from rankloom.llm.queries import _candidates

    df = _candidates(spark, data)
    got = rank_items(df, "query_id", "company_id", ("fused", "best_doc", "confidence"), top=10).toPandas()
    pdf = df.toPandas().drop_duplicates()
    want = set()
    for q, g in pdf.groupby("query_id"):
        p = pd.DataFrame({c: (g[c].rank() - 0.5) / g[c].count() for c in ("fused", "best_doc", "confidence")}).fillna(0.5).to_numpy()
        p = p / np.sqrt((p**2).sum(0))
        near, far = np.sqrt(((p - p.max(0)) ** 2).sum(1)), np.sqrt(((p - p.min(0)) ** 2).sum(1))
        order = np.argsort(-(far / (near + far)))[:10]
        want |= {(q, c) for c in g.company_id.to_numpy()[order]}
    have = set(zip(got.query_id, got.company_id))
    assert len(have & want) >= 0.95 * len(want)


@pytest.mark.parametrize("weights", [None, (1.0, 0.0, 0.0)])
def test_weights(spark, weights):
    rows = [(1, 1, 1.0, 9.0, 9.0), (1, 2, 2.0, 1.0, 1.0), (1, 3, 1.5, 5.0, 5.0)]
    first = rank_items(_df(spark, rows), "q", "item", ("a", "b", "c"), weights, top=1).first().item
    assert first == (2 if weights else 1)
