"""Every query of the core against its SQL, and the ones without SQL against what must hold of them."""

import math

import pytest
from oracle import spark_rows, sql_rows

from rankloom.plans import engine_queries, record_queries, table_queries, upkeep_queries

SMALL = "/root/testdata/sf0.001"
ALL = {k: (f, m.SQL.get(k)) for m in (engine_queries, table_queries, record_queries, upkeep_queries) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", [k for k, (_, sql) in ALL.items() if sql])
def test_equals_sql(spark, name):
    f, sql = ALL[name]
    assert spark_rows(f(spark, SMALL)) == sql_rows(sql, SMALL)


def test_search_is_the_same_twice_and_adds_up(spark):
    from rankloom.operators.score import WEIGHTS

    rows = [r.asDict(True) for r in engine_queries.search_companies(spark, SMALL).collect()]
    assert rows == [r.asDict(True) for r in engine_queries.search_companies(spark, SMALL).collect()]
    w = WEIGHTS[engine_queries.CHIPS.intent_mode]
    assert rows and all(math.isclose(r["score"], sum(w[k] * r[k] for k in w), abs_tol=1e-5) for r in rows)
    assert [(-r["score"], r["company_id"]) for r in rows] == sorted((-r["score"], r["company_id"]) for r in rows)


def test_people_have_roles(spark, data):
    assert all(r.n_roles > 0 for r in engine_queries.search_people(spark, data).collect())


def test_weight_search_prefers_the_best(spark):
    rows = engine_queries.weight_search(spark, SMALL).collect()
    assert [(-r.composite, r.distance, r.grid_id) for r in rows] == sorted((-r.composite, r.distance, r.grid_id) for r in rows)


def test_weight_search_takes_every_weight_of_the_grid(spark):
    from rankloom.operators.evaluate import weight_grid
    from rankloom.operators.score import WEIGHTS

    grid, w = weight_grid(), WEIGHTS[engine_queries.CHIPS.intent_mode]
    rows = {r.grid_id: r.distance for r in engine_queries.weight_search(spark, SMALL).collect()}
    prior = tuple(w[k] for k in ("coverage", "recency", "volume", "best_doc"))
    at = [i for i, p in enumerate(grid) if all(math.isclose(a, b) for a, b in zip(p, prior))]
    assert len(grid) == 1751 and set(rows) == set(range(len(grid))) and len(at) == 1 and rows[at[0]] == 0
