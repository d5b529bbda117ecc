import random
import re

import pytest

from rankloom.llm.nearcopies import components, similar_pairs, version_groups

SCHEMA = "id long, body string, cls string, text string, h long"


def _runs(t, k):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _brute(rows, k, least, longer=0):
    docs = {i: _runs(t, k) for i, t in rows if i is not None and t is not None and len(t) > longer}
    holders, common = {}, {}
    for i in sorted(docs):
        for r in docs[i]:
            holders.setdefault(r, []).append(i)
    for ids in holders.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    return {(a, b) for (a, b), n in common.items() if n >= least * (len(docs[a]) + len(docs[b]) - n)}


def _corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = rng.choices(vocab, k=150)
        rows.append((len(rows), " ".join(w)))
        for _ in range(i % 3):
            v = list(w)
            for _ in range(rng.randrange(1, 12)):
                at = rng.randrange(len(v))
                rng.choice((lambda: v.insert(at, "new"), lambda: v.pop(at), lambda: v.__setitem__(at, "other")))()
            rows.append((len(rows), ", ".join(v).upper()))
    return rows


def _df(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("run, least", [(3, 0.5), (5, 0.8)])
def test_pairs_equal_brute_force(spark, run, least):
    rows = _corpus()
    got = [tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=run, at_least=least).collect()]
    want = _brute(rows, run, least)
    assert len(got) == len(set(got)) and want and set(got) == want


def test_cases(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    same = "one two three four five six"
    rows = [(1, same), (2, same.upper() + "!"), (3, same), (3, same), (4, None), (None, same), (5, ""), (6, "one two"), (7, "one two"), (8, long), (9, long + " more"), (10, "!!! ???"), (11, "??? !!!")]
    got = {tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=3, at_least=0.5).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (8, 9)}
    assert similar_pairs(_df(spark, []), id="id", text="body").count() == 0
    groups = {r.id: (r.class_id, r.group_id, r.n_links) for r in version_groups(_df(spark, rows), id="id", text="body", run=3, at_least=0.5).collect()}
    assert groups[2] == (1, 1, 0) and groups[9] == (9, 8, 1) and groups[6] == groups[7] == (6, 6, 0) and len(groups) == 9


def test_many_copies_of_one_text_stay_linear(spark):
    rows = [(i, "the very same words again and again in each of these texts") for i in range(400)] + [(1000, "quite another text about something else entirely here")]
    groups = version_groups(_df(spark, rows), id="id", text="body").collect()
    assert len(groups) == 401 and {r.group_id for r in groups} == {0, 1000} and all(r.n_links == 0 for r in groups)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 61), 100, 101, 200]], "node long")
    got = {r.node: r.label for r in components(edges, nodes).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100 and got[200] == 200


def test_postings_against_brute_force(spark, data):
    from rankloom.llm.queries import p3_found
    from rankloom.sources.tables import load

    rows = [tuple(r) for r in load(spark, data, "lead_company_job", "id", "description").collect()]
    got = {tuple(r) for r in p3_found(spark, data).collect()}
    want = _brute(rows, 3, 0.5, 200)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_a_version_group_of_a_third_of_the_texts(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(20_000)]
    one = rng.choices(vocab, k=150)
    rows = []
    for i in range(300):
        w = rng.choices(vocab, k=150)
        if i % 3 == 0:
            w = list(one)
            for at in rng.sample(range(150), 7):
                w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    want = _brute(rows, 3, 0.5)
    got = [tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=3, at_least=0.5).collect()]
    assert len(want) > 3000 and len(got) == len(set(got)) and set(got) == want
    groups = {r.id: r.group_id for r in version_groups(_df(spark, rows), id="id", text="body", run=3, at_least=0.5).collect()}
    assert {groups[i] for i in range(0, 300, 3)} == {0} and len(set(groups.values())) == 201


def test_pairs_on_either_side_of_few_own_runs(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(20_000)]
    shared = rng.choices(vocab, k=122)
    own = rng.choices(vocab, k=16)
    rows = [(0, " ".join(shared + own[:15])), (1, " ".join(shared + own))]
    rows += [(i, " ".join(shared + rng.choices(vocab, k=10 + 5 * i))) for i in range(2, 12)]
    rows += [(i, " ".join(rng.choices(vocab, k=150))) for i in range(12, 72)]
    want = _brute(rows, 3, 0.5)
    got = {tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=3, at_least=0.5).collect()}
    assert (0, 1) in want and got == want


def test_texts_of_one_template(spark):
    """Every pair shares half of its runs through the template alone; nothing is left out as boilerplate."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(20_000)]
    template = rng.choices(vocab, k=90)
    rows = [(i, " ".join(template + rng.choices(vocab, k=rng.randrange(10, 60)))) for i in range(200)]
    want = _brute(rows, 3, 0.5)
    got = [tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=3, at_least=0.5).collect()]
    assert len(want) > 10_000 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.999 * len(want)


def test_large_blocks_and_copy_classes_in_tiles(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(20_000)]
    one = rng.choices(vocab, k=80)
    rows = [(i, " ".join(one[:40] + [f"n{i}"] + one[40:])) for i in range(60)] + [(i, " ".join(one)) for i in range(60, 100)]
    got = [tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=3, at_least=0.5, tile=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(100) for b in range(a + 1, 100)}


def test_no_side_that_grows_is_broadcast(spark, data, capsys):
    from rankloom.llm.queries import p3_found

    p3_found(spark, data).explain("formatted")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


def test_blocks_follow_the_size():
    import numpy as np

    from rankloom.llm.nearcopies import MISS, plan_blocks

    alone = np.full(1000, 0.08)
    for n in (100, 10**5, 10**9):
        blocks, rows = plan_blocks(n, alone, 0.5)
        assert (1 - 0.5**rows) ** blocks <= MISS
    assert plan_blocks(10**9, alone, 0.5)[1] > plan_blocks(10**4, alone, 0.5)[1]


def test_min_hashes_agree_as_often_as_runs_are_shared():
    import numpy as np

    from rankloom.llm.nearcopies import bits_of, distance, min_hashes

    rng = np.random.default_rng(0)
    for n, k in ((200, 133), (12, 8), (1, 1), (900, 300)):
        at = []
        for _ in range(20):
            runs = rng.integers(0, 2**63, 2 * n - k).astype(np.uint64)
            low = min_hashes(np.concatenate([runs[:n], runs[n - k :]]), np.array([n, n]), 512)
            at.append((low[0] == low[1]).mean())
            b = bits_of(low)
            assert np.bitwise_count((b[0] ^ b[1]).view(np.uint64)).sum() <= distance(k / (2 * n - k))
        assert abs(np.mean(at) - k / (2 * n - k)) < 0.02


@pytest.mark.parametrize("tile", [512, 7])
def test_blocks_in_passes_give_the_same_pairs_from_fewer_bytes(spark, tile, monkeypatch):
    from rankloom.llm import nearcopies

    written = []
    real = nearcopies._marked
    monkeypatch.setattr(nearcopies, "_marked", lambda run, blocks, *a: written.append(blocks) or real(run, blocks, *a))
    monkeypatch.setattr(nearcopies, "PASS_LEAST", 50_000)
    monkeypatch.setattr(nearcopies, "PASS_SHARE", 0.0)
    rows = _corpus(60)
    got = [tuple(r) for r in similar_pairs(_df(spark, rows), id="id", text="body", run=3, at_least=0.5, tile=tile).collect()]
    assert len(written) > 1 and max(written) * 8 * len(rows) <= 50_000
    assert len(got) == len(set(got)) and set(got) == _brute(rows, 3, 0.5)


def test_what_a_pass_writes_follows_the_texts_not_their_number_of_blocks():
    import numpy as np

    from rankloom.llm.nearcopies import pass_sizes, plan_blocks

    for n in (10**5, 10**7, 10**9):
        most = max(256e6, 450 * n)
        blocks, _ = plan_blocks(n, np.full(1000, 0.08), 0.5, passes=lambda b: len(pass_sizes(n, b, 12, most)))
        sizes = pass_sizes(n, blocks, 12, most)
        assert sum(sizes) == blocks and min(sizes) >= 1 and max(sizes) - min(sizes) <= 1
        assert all(n * 80 * min(12, b) * 0.6 <= most for b in sizes) and (n < 10**6) == (len(sizes) == 1)
