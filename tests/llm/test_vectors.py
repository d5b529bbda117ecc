import numpy as np
import pytest

from rankloom.llm.vectors import VectorIndex, neighbour_pairs, neighbours

SCHEMA = "id long, vec array<float>, raw string, cell int, code long, a long, b long"


def _df(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, 0, 0, 0) for i, v in rows], SCHEMA)


def _clusters(seed=1, groups=150, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 5)):
            v = base + rng.standard_normal(dim) * 0.25 * rng.random()
            out.append((v * rng.choice([0.25, 1, 8])).astype(np.float32))
    return [(i, v.tolist()) for i, v in enumerate(out)]


def _brute(rows, k, least):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for r in range(len(x)):
        near = np.flatnonzero(s[r] >= np.partition(s[r], -min(k, len(x)))[-min(k, len(x))] - 2e-9)  # all that may tie with the k-th
        order = sorted(near, key=lambda c: (-round(s[r, c], 9), ids[c]))[:k]
        out |= {(int(min(ids[r], ids[c])), int(max(ids[r], ids[c]))) for c in order if s[r, c] >= least}
    return out


def test_recall_against_brute_force(spark):
    rows = _clusters()
    got = {tuple(r) for r in neighbour_pairs(neighbours(_df(spark, rows), id="id", vector="vec")).collect()}
    want = _brute(rows, 5, 0.9)
    assert len(want) > 100 and len(got & want) >= 0.97 * len(want) and got <= want


def test_copies(spark):
    rng = np.random.default_rng(2)
    v, w = rng.standard_normal(64).astype(np.float32), rng.standard_normal(64).astype(np.float32)
    rows = [(i, (v * 2.0 ** (i % 3)).tolist()) for i in range(300)] + [(1000 + i, w.tolist()) for i in range(2)] + [(2000, (w + 0.05 * v).tolist())] + [(3000 + i, rng.standard_normal(64).tolist()) for i in range(100)]
    found = neighbours(_df(spark, rows), id="id", vector="vec").collect()
    by = {}
    for r in found:
        by.setdefault(r.id_a, []).append(r.id_b)
    assert sorted(by[7]) == [0, 1, 2, 3, 4] and sorted(by[0]) == [1, 2, 3, 4, 5]
    assert sorted(by[2000]) == [1000, 1001] and sorted(by[1000]) == [1001, 2000]
    assert len(found) == 300 * 5 + 6  # the copies' links are linear in their number


def test_cases(spark):
    one = [1.0, 0.0, 0.5, 0.25]
    rows = [(1, one), (2, [2 * x for x in one]), (2, [2 * x for x in one]), (3, None), (4, [0.0] * 4), (5, [1.0]), (6, [float("nan")] * 4), (None, one), (7, []), (8, [-x for x in one])]
    assert [tuple(r)[:2] for r in neighbours(_df(spark, rows), id="id", vector="vec").orderBy("id_a").collect()] == [(1, 2), (2, 1)]
    assert neighbours(_df(spark, []), id="id", vector="vec").count() == 0
    assert neighbours(_df(spark, [(1, None), (2, [0.0])]), id="id", vector="vec").count() == 0


def test_anisotropic_code_keeps_inner_products():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = VectorIndex(x, len(x), 0.9)
    codes = index.encode(x)
    rebuilt = np.concatenate([index.books[m][codes[:, m]] for m in range(16)], 1)
    plain = np.concatenate([index.books[m][((index._split(x)[:, m][:, None] - index.books[m]) ** 2).sum(2).argmin(1)] for m in range(16)], 1)
    along = lambda r: (((x - r) * x).sum(1) ** 2).mean()
    assert along(rebuilt) < along(plain)
    t, p = index.tables(x[:5]), index.pack(codes[:7])
    scan = sum(t[:, j][:, p[:, j]] for j in range(8))
    assert np.allclose(scan, x[:5] @ rebuilt[:7].T, atol=1e-4)


@pytest.mark.parametrize("table, key, column", [("job_signal", "job_id", "embedding"), ("company_signal", "company_id", "embedding"), ("job_intent", "id", "intent_embedding")])
def test_recall_on_the_tables(spark, data, table, key, column):
    from rankloom.sources.tables import load

    df = load(spark, data, table, key, column)
    got = {tuple(r) for r in neighbour_pairs(neighbours(df, id=key, vector=column)).collect()}
    rows = {r[0]: list(r[1]) for r in df.where(f"{column} IS NOT NULL").collect() if any(r[1])}
    want = _brute(sorted(rows.items()), 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and got <= want


def test_each_length_is_a_collection_of_its_own(spark):
    short, long = _clusters(3, 20, 8), _clusters(4, 30, 64)
    rows = [(i, v) for i, v in short] + [(1000 + i, v) for i, v in long] + [(5000, [1.0, 2.0])]
    got = {tuple(r) for r in neighbour_pairs(neighbours(_df(spark, rows), id="id", vector="vec")).collect()}
    want = _brute(short, 5, 0.9) | {(a + 1000, b + 1000) for a, b in _brute(long, 5, 0.9)}
    assert len(want) > 30 and len(got & want) >= 0.97 * len(want) and got <= want


def test_cells_follow_the_rows(monkeypatch):
    from rankloom.llm import vectors as ve

    assert ve.n_cells(300) == 1 and ve.n_cells(10**6) == 3333 and ve.n_cells(1_228_800) == 4434 - 338 and ve.n_cells(10**9) > 120_000
    assert ve.sample_rows(1000) == 20_000 and ve.sample_rows(10**12) == ve.MOST_SAMPLE
    monkeypatch.setattr(ve, "FLAT_CELLS", 16)
    x = np.random.default_rng(1).standard_normal((4000, 8)).astype(np.float32)
    c = ve._centres(x, 100, np.random.default_rng(2))
    assert 90 <= len(c) <= 110 and np.isfinite(c).all()


def test_no_side_that_grows_is_broadcast(spark, data, capsys):
    from rankloom.llm.queries import p6_found

    p6_found(spark, data).explain("formatted")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_fitting_holds_little_more_than_the_sample():
    """The sample against all centres at once would be 640 MB here."""
    import tracemalloc

    x = np.random.default_rng(6).standard_normal((40_000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    index = VectorIndex(x, 1_200_000, 0.9)
    near = index.nearest_cells(x[:20_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.cells == 4000 and peak < 100e6
    s = x[:50] @ index.centres.T
    assert (near[:50] == np.argsort(-s, axis=1)[:, :4]).mean() > 0.99 and (index.shares == 1).all()
