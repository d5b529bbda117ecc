import itertools
import random

import pytest

from rankloom.llm.containers import best_fit, fill_containers, fill_report, pack


def _least(sizes, capacity):
    """The true minimum, by trying."""
    for n in range(1, len(sizes) + 1):
        def fits(i, space):
            if i == len(order):
                return True
            return any(space[b] >= order[i] and fits(i + 1, (*space[:b], space[b] - order[i], *space[b + 1 :])) for b in {s: b for b, s in enumerate(space)}.values())
        order = sorted(sizes, reverse=True)
        if fits(0, (capacity,) * n):
            return n


@pytest.mark.parametrize("seed", range(25))
def test_small_packings_are_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(10, 70) for _ in range(rng.randrange(1, 11))]
    bins = pack(sizes, 100)
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) == _least(sizes, 100) <= len(best_fit(sizes, 100))


def test_search_that_is_cut_short_still_packs_everything():
    rng = random.Random(3)
    sizes = [rng.randrange(100, 400) for _ in range(800)]
    for budget in (0, 5, 4000):
        bins = pack(sizes, 512, budget)
        assert sorted(itertools.chain(*bins)) == list(range(800)) and all(sum(sizes[i] for i in b) <= 512 for b in bins)


SPECS = "spec string, capacity_tokens int"
SIZES = "id long, n_tokens long, spec string, container string, part int"


def _fill(spark, sizes, specs):
    return fill_containers(spark.createDataFrame([(i, n, "x", "y", 9) for i, n in sizes], SIZES), spark.createDataFrame(specs, SPECS))


def test_cases(spark):
    got = _fill(spark, [(1, 250), (2, 100), (3, 0), (4, None), (5, 100), (5, 100), (None, 40), (6, 60), (7, 40)], [("s", 100), ("s", 90), (None, 7), ("bad", None), ("zero", 0), ("wide", 1000)]).collect()
    s = [r for r in got if r.spec == "s"]
    assert {r.spec for r in got} == {"s", "wide"} and {r.id for r in s} == {1, 2, 5, 6, 7}
    assert sorted((r.part, r.n_tokens) for r in s if r.id == 1) == [(0, 100), (1, 100), (2, 50)]
    used = {}
    for r in got:
        used.setdefault((r.spec, r.container), []).append(r)
    for (spec, _), rows in used.items():
        cap = 100 if spec == "s" else 1000
        assert sum(r.n_tokens for r in rows) + rows[0].free == cap and len({r.free for r in rows}) == 1
    assert len([k for k in used if k[0] == "s"]) == 6 and len([k for k in used if k[0] == "wide"]) == 1
    assert _fill(spark, [], [("s", 10)]).count() == 0 and _fill(spark, [(1, 5)], []).count() == 0


def test_many_groups_lose_nothing(spark):
    rng = random.Random(8)
    sizes = [(i, rng.randrange(20, 300)) for i in range(4500)]
    filled = _fill(spark, sizes, [("s", 512)])
    rows = filled.collect()
    assert sorted((r.id, r.n_tokens) for r in rows) == sorted(sizes)
    r = fill_report(filled).first()
    assert r.filled > 0.985 and r.free_tokens == r.n_containers * 512 - r.n_tokens


def test_documents_come_back(spark, data):
    from rankloom.llm.queries import p8_containers
    from rankloom.llm.tokens import count_tokens
    from rankloom.sources.tables import load

    texts = {r.doc_id: r.text for r in load(spark, data, "documents", "doc_id", "text").collect()}
    by = {}
    for r in p8_containers(spark, data).collect():
        by.setdefault((r.spec, r.doc_id), []).append(r.n_tokens)
    for i, t in itertools.islice(texts.items(), 200):
        assert {s: sum(by.get((s, i), [])) for s in ("short", "standard", "long")} == dict.fromkeys(("short", "standard", "long"), count_tokens(t or ""))


def test_fillings_are_undominated_and_come_by_waste():
    from rankloom.llm.containers import dominated, fillings

    rng = random.Random(1)
    for _ in range(60):
        counts = {}
        for _ in range(rng.randrange(1, 8)):
            s = rng.randrange(1, 12)
            counts[s] = counts.get(s, 0) + 1
        sizes, free = sorted(counts), rng.randrange(0, 25)
        got = list(fillings(free, sizes, counts))
        every = {tuple(sorted(c, reverse=True)) for n in range(len(counts) * 8) for c in itertools.combinations([s for s in counts for _ in range(counts[s])], n) if sum(c) <= free}
        want = {f for f in every if not dominated(f, free - sum(f), sizes, counts)}
        first = {f for f in every if sum(f) == max(map(sum, every))}
        assert [w for w, _ in got] == sorted(w for w, _ in got) and all(w == free - sum(f) for w, f in got)
        assert want <= {f for _, f in got} <= want | first and len(got) == len(set(got)) and got[0][1] in first
    assert list(fillings(10, [2, 5], {2: 1, 5: 1})) == [(3, (5, 2))]


def test_a_search_without_end_of_retries_is_exact():
    rng = random.Random(2)
    for _ in range(10):
        sizes = [rng.randrange(15, 60) for _ in range(9)]
        assert len(pack(sizes, 100, None)) == _least(sizes, 100)
