import pytest

from rankloom.llm.mixing import budgets, mix, mix_shares
from rankloom.llm.tokens import count_tokens, token_counts

SIZES = "id long, source string, n_tokens long, uses long, key string"
TARGETS = "source string, target_share double, max_repeats int"


def _mix(spark, rows, targets, **how):
    s = spark.createDataFrame([(i, src, n, 7, "k") for i, src, n in rows], SIZES)
    t = spark.createDataFrame(targets, TARGETS)
    out = mix(s, t, **how)
    return out, t


def test_budgets():
    assert budgets({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1)}) == {"a": 200, "b": 200}
    assert budgets({"a": 100}, {"a": (0.5, 2), "gone": (0.5, 3)}) == {"a": 200}
    assert budgets({"a": 100, "b": 1000}, {"a": (0.5, 1), "b": (0.5, 1)}, total=1000) == {"a": 100, "b": 500}
    assert budgets({}, {"a": (1.0, 1)}) == {}


@pytest.mark.parametrize("partitions", [1, 5])
def test_shares_and_repeats(spark, partitions):
    rows = [(i, "small", 10 + i % 7) for i in range(100)] + [(1000 + i, "big", 5 + i % 11) for i in range(3000)] + [(9000, "none", 5), (9001, None, 5)]
    out, t = _mix(spark, rows, [("small", 0.4, 3), ("big", 0.5, 1), ("empty", 0.1, 2), (None, 0.3, 1)], partitions=partitions)
    got = out.collect()
    assert len(got) == len(rows) and all(r.uses == 0 for r in got if r.source in ("none", None))
    assert all(r.uses <= 3 for r in got if r.source == "small") and all(r.uses <= 1 for r in got if r.source == "big")
    shares = {r.source: r for r in mix_shares(out, t.where("source IS NOT NULL")).collect()}
    assert shares["small"].actual_share == pytest.approx(0.4 / 0.9, abs=0.003) and shares["big"].actual_share == pytest.approx(0.5 / 0.9, abs=0.003)
    assert shares["empty"].used_tokens == 0 and shares["empty"].target_share == 0.1 and shares["empty"].share_there == 0
    assert shares["small"].share_there == pytest.approx(0.4 / 0.9, abs=1e-6)


def test_partitions_and_order_change_nothing(spark):
    rows = [(i, "ab"[i % 2], 3 + i % 50) for i in range(500)]
    a = {(r.id, r.uses) for r in _mix(spark, rows, [("a", 0.7, 1), ("b", 0.3, 2)], partitions=1)[0].collect()}
    b = {(r.id, r.uses) for r in _mix(spark, rows[::-1], [("a", 0.7, 1), ("b", 0.3, 2)], partitions=7)[0].collect()}
    assert a == b


def test_cases(spark):
    assert _mix(spark, [], [("a", 1.0, 1)])[0].count() == 0
    assert [r.uses for r in _mix(spark, [(1, "a", 5)], [])[0].collect()] == [0]
    got = sorted((r.id, r.uses) for r in _mix(spark, [(1, "a", 5), (1, "a", 5), (2, "a", None), (3, "a", 0)], [("a", 1.0, 2), ("b", None, None)])[0].collect())
    assert [u for i, u in got if i == 1] == [2, 2]


def test_token_counts(spark):
    rows = [(1, "Hello world", "s"), (2, "", "s"), (3, None, None), (None, "x", "s"), (4, "word " * 60_000, "s")]
    got = {r.id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "id long, text string, n_tokens string"), id="id", text="text", keep=("n_tokens",)).toDF("id", "kept", "n_tokens").collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: count_tokens("word " * 60_000)}
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for t in ("The post is based in Gokevamoor; a yearly budget.", "Straße, l'équipe — 12,5 %\n\n\tx"):
        assert count_tokens(t) == len(tok.encode(t, add_special_tokens=False).ids)
