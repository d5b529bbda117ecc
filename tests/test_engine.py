from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.functions.keys import bucket_bounds, days_since, overlap, recency, volume, whole_word
from rankloom.functions.match import cosine, hashed_column, hashed_vector, lexical_score, max_cosine, phrase_match, words
from rankloom.operators.retrieve import company_ranks, fuse, lexical_list, semantic_list, with_01
from rankloom.operators.score import Terms
from rankloom.plans.chips import Chips, Group, Value, ground, paraphrase, parse, phrases, triage
from rankloom.plans.engine import Tables, Vocabulary, compile_predicate, dimension_counts, filter_report, search, why_empty


@pytest.mark.parametrize(
    "text, low, high",
    [("1600", 1600, 1600), ("201-500 employees", 201, 500), ("501-1,000 employees", 501, 1000), ("10,001+ employees", 10001, None), ("1.5K", 1500, 1500), ("junk", None, None), (None, None, None), ("201 - 500", 201, None), ("", None, None)],
)
def test_buckets(spark, text, low, high):
    b = bucket_bounds("v")
    r = spark.createDataFrame([(text,)], "v string").select(b[0].alias("l"), b[1].alias("h")).first()
    assert (r.l, r.h) == (low, high)


def test_axes(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 10), (None, 0), (datetime(2025, 1, 1), 100)], "d timestamp_ntz, n int")
    days = days_since("d", F.lit("2024-01-02 23:00:00").cast("timestamp_ntz"))
    got = df.select(days.alias("days"), recency(days).alias("r"), volume(F.col("n")).alias("v")).collect()
    assert got[0].days == 1 and got[1].days is None and got[1].r == 0.0 and got[2].days == 0 and got[2].r == 1.0
    assert got[0].v == pytest.approx(1.0) and got[2].v > 1


def test_text_and_arrays(spark):
    df = spark.createDataFrame([("We run SAP here", ["Sapient", None]), ("a sapling", None), (None, [])], "t string, a array<string>")
    got = df.select(whole_word("t", "SAP").alias("w"), overlap("a", ["SAP"]).alias("o"), overlap("a", ["Sapient"]).alias("p")).collect()
    assert [r.w for r in got] == [True, False, False] and not any(r.o for r in got) and [r.p for r in got] == [True, False, False]


def test_lexical(spark):
    df = spark.createDataFrame([(1, "slow reports and slow audits"), (2, "reports only"), (3, "Slow! Reports."), (4, None)], "id int, t string")
    w = df.select("id", words("t").alias("w"))
    hit = w.where(phrase_match(F.col("w"), ["slow reports", ""])).select("id", lexical_score(F.col("w"), ["slow reports"]).alias("s")).collect()
    assert {r.id for r in hit} == {1, 3}
    s = {r.id: r.s for r in hit}
    assert s[1] == pytest.approx(0.1 * (1.25 + 1) / 1.64493406685 / 2) and s[3] < s[1]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, 4.0])], "id int, v array<float>")
    got = {r.id: (r.a, r.b) for r in df.select("id", cosine("v", [1.0, 0.0]).alias("a"), max_cosine("v", [[1.0, 0.0], [0.0, 2.0]]).alias("b")).collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (None, None) and got[3] == (None, None) and got[4] == pytest.approx((0.6, 0.8))
    assert hashed_vector("erp migration") == hashed_vector("ERP  migration") and sum(x * x for x in hashed_vector("a b")) == pytest.approx(1)
    with pytest.raises(ValueError):
        hashed_vector(" .")
    texts = spark.createDataFrame([("ERP migration, erp",), (" .",), (None,), ("a b c d e f g",)], "t string").select("t", hashed_column("t").alias("v")).collect()
    assert texts[0].v == pytest.approx(hashed_vector("ERP migration, erp")) and texts[1].v is texts[2].v is None and texts[3].v == pytest.approx(hashed_vector("a b c d e f g"))


def test_lists_projection_and_fusion(spark):
    docs = spark.createDataFrame([(1, 10, "x y", [1.0, 0.0]), (2, 10, "x", [0.0, 1.0]), (3, 20, "x y", [1.0, 0.1])], "doc int, company_id int, t string, v array<float>")
    lex = lexical_list(docs, "doc", "t", ["x y"])
    assert [r.doc for r in lex.collect()] == [1, 3] and lexical_list(docs, "doc", "t", []).count() == 0
    best = semantic_list(docs, "company_id", "v", [0.0, 1.0], tie="doc").collect()
    assert [(r.company_id, r.score) for r in best][0] == (10, 1.0)
    ranked = spark.createDataFrame([(10, 7), (10, 3), (20, 5)], "company_id int, rank int")
    assert [tuple(r) for r in company_ranks(ranked).orderBy("rank").collect()] == [(10, 1), (20, 2)]
    fused = {r.company_id: (r.fused, r.best_doc) for r in fuse([company_ranks(ranked), company_ranks(ranked.where("company_id = 20"))]).collect()}
    assert fused[10][0] == pytest.approx(1 / 61) and fused[20] == (pytest.approx(1 / 62 + 1 / 61), 1.0)
    flat = with_01(spark.createDataFrame([(1, 0.5), (2, 0.5)], "i int, s double"), "s", "n").collect()
    assert [r.n for r in flat] == [1.0, 1.0]


def test_terms():
    t = Terms([("SAP", []), ("SAP ECC", ["ecc"]), ("SAP S/4HANA", ["S/4 HANA", "SAP"])])
    assert t.resolve("s4 hana") == "SAP S/4HANA" and t.resolve("sap") == "SAP" and t.resolve("nothing") is None


def test_chips():
    assert Chips().is_empty() and Chips(terms=(Group((" ",)),)).is_empty() and not Chips(has_linkedin=False).is_empty()
    assert triage(Chips()).companies == () and triage(Chips(intent="ACTION", segments=("a",))) and triage(Chips(segments=("a",))) is None
    c = Chips(terms=(Group(("SAP",), "USES"), Group(("AWS", "Azure"), "HIRING"), Group(("dbt",), negate=True)), industries=(Value("Mining"), Value("Solar", True)), locations=(Value("Ohio"),))
    assert phrases(c) == ["SAP", "AWS", "Azure", "Mining"] and paraphrase(c) == "Mining company running SAP, hiring for AWS or Azure, based in Ohio." and paraphrase(Chips()) == "Company."
    p = parse("companies using SAP, not dbt, in Ohio with more than 500 employees over $2m revenue in the last 3 months", technologies=["SAP", "dbt"], industries=[], places=["Ohio"])
    assert p.terms == (Group(("SAP",), "USES"), Group(("dbt",), "USES", True)) and p.min_employees == 500 and p.min_revenue_usd == 2e6 and p.since_days == 90 and p.locations == (Value("Ohio"),)
    assert ground(Chips(terms=(Group(("SAP", "Oracle")),), locations=(Value("Texas"),)), "who uses sap") == Chips(terms=(Group(("SAP",)),))
    with pytest.raises(ValueError):
        Group(("a",), "SOMETIMES")


def test_vocabulary(spark, data):
    v = Vocabulary.read(spark, data)
    names, note = v.industry("Railway", False)
    assert len(names) > 1 and note is None and v.industry("railway research  and testing", True)[0] == ["Railway Research and Testing"]
    assert v.place("DW") == ("dunmarrow", None) and v.place("Wakanda")[1]
    p = compile_predicate(Chips(terms=(Group(("no such thing",), negate=True),), locations=(Value("Wakanda"),)), v, F.lit("2026-09-01").cast("timestamp_ntz"))
    assert len(p.notes) == 2


def test_zero_is_explained(spark, data):
    t, v, now = Tables(spark, data), Vocabulary.read(spark, data), F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")

    def report(chips):
        return [r.asDict() for r in filter_report(t, compile_predicate(chips, v, now)).orderBy("place").collect()]

    rows = report(Chips(locations=(Value("Wakanda"),), has_linkedin=True))
    assert [r["filter"] for r in rows] == ["location", "linkedin"] and rows[0]["n_alone"] == 0 < rows[0]["n_others"] and rows[0]["n_field"] is None
    assert rows[1]["n_field"] == rows[1]["n_alone"] == rows[0]["n_others"] and all(r["n_passing"] == 0 for r in rows)
    said = why_empty(rows)
    assert "location" in said and f"{rows[0]['n_others']} would be left" in said
    assert why_empty(report(Chips(has_linkedin=True))) is None and why_empty([]) is None
    assert search(t, Chips(locations=(Value("Wakanda"),)), v, hashed_vector("a"), now).count() == 0


def test_negated_and_kept_make_the_whole(spark, data):
    t, v, now = Tables(spark, data), Vocabulary.read(spark, data), F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")
    p = compile_predicate(Chips(terms=(Group(("Inkstone",), negate=True),)), v, now)
    n = dimension_counts(t, p).first()
    assert 0 < n.passing < n.universe == n.without_negation
