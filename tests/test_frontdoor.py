import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from rankloom.operators import boundary as bo
from rankloom.operators import quality as q
from rankloom.operators import vocabulary as vo
from rankloom.operators.ingest import pending_jobs, pending_roles
from rankloom.plans.chips import Chips, Group, Value
from rankloom.plans.engine import Tables, Vocabulary
from rankloom.plans.frontdoor import RESULT, answer

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ask(spark):
    t, v, now = Tables(spark, SMALL), Vocabulary.read(spark, SMALL), F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")
    return lambda x, **how: answer(t, x, v, now, **how)


def test_refused_before_anything_is_read(ask):
    for asked in ("", "delete all companies that use Inkstone", Chips(), Chips(intent="UNPARSEABLE", segments=("core",))):
        a = ask(asked)
        assert a.status == "refused" and a.reason and a.companies is None and a.removed is None


def test_answered(ask, spark):
    calls = []

    def embed(texts):
        calls.append(list(texts))
        return bo.hashed_batch(texts)

    a = ask(Chips(terms=(Group(("Nimbrel Insight",), "USES"), Group(("no such thing",), "ANY", True)), industries=(Value("Railway"),)), embed=embed)
    assert a.status in ("ok", "empty") and calls == [["Railway company running Nimbrel Insight.", "Railway"]] and len(a.notes) == 1 and set(a.seconds) >= {"parse", "embed", "plan", "search"}
    have = {f.name: f.dataType for f in a.companies.schema}
    want = _parse_datatype_string(RESULT)
    assert {f.name: have[f.name].simpleString() for f in want} == {f.name: f.dataType.simpleString() for f in want} and "industry_similarity" in have


def test_negation_shows_what_it_removed(ask):
    a = ask(Chips(terms=(Group(("Nimbrel Insight",), "USES"), Group(("Inkstone",), "ANY", True))))
    assert a.status == "ok" and a.removed is not None
    assert not {r.company_id for r in a.companies.collect()} & {r.company_id for r in a.removed.collect()}


def test_empty_has_a_reason(ask):
    a = ask(Chips(locations=(Value("Wakanda"),)))
    assert a.status == "empty" and "location" in a.reason and a.companies.count() == 0 and a.notes


def test_boundary_refuses_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "k long, t string")
    assert bo.embed(df, "k", "t", batch=2).count() == 3 and bo.embed(df.limit(0), "k", "t").count() == 0
    for bad, of in ((df.withColumn("t", F.lit(" ")), bo.hashed_batch), (df, lambda x: [[1.0]] * len(x)), (df, lambda x: [])):
        with pytest.raises(Exception, match="vector"):
            bo.embed(bad, "k", "t", of).count()
    out = bo.normalise(df.where("k IS NOT NULL"), lambda b: b.assign(n=b.t.str.len())[["k", "n"]], "k long, n long")
    assert [tuple(r) for r in out.collect()] == [(1, 3), (1, 3)]


@pytest.mark.parametrize("title, text, kind, want", [("Process Lead", "We migrate ECC to S/4HANA", "FULL_TIME", ("MIGRATION", "LEAD", "PERMANENT")), ("VP Data", "keep systems running", "temporary", ("MAINTENANCE", "EXEC", "CONTRACT")), (None, None, None, ("UNKNOWN", "UNKNOWN", "UNKNOWN")), ("Sr Architect", "upgrade our stack", "", ("MODERNIZATION", "SENIOR", "UNKNOWN"))])
def test_rules(spark, title, text, kind, want):
    df = spark.createDataFrame([(title, text, kind)], "t string, d string, k string")
    assert tuple(df.select(*[c.alias(n) for n, c in bo.rule_fields("t", "d", "k").items()]).first()) == want


def test_contradictions_are_fatal(spark):
    vocab = "term string, aliases array<string>"
    good = spark.createDataFrame([("SAP", ["s.a.p", "sap erp"]), ("Azure", None)], vocab)
    vo.check_vocabulary(good)
    bad = spark.createDataFrame([("Power BI", []), ("PowerBI", []), ("SAP", ["Azure"]), ("Azure", ["x", "!"]), ("Other", ["x"])], vocab)
    assert {(r.kind, r.key) for r in vo.contradictions(bad).collect()} == {("two terms", "powerbi"), ("term as alias", "azure"), ("two owners", "x"), ("empty", "")}
    with pytest.raises(ValueError, match="powerbi"):
        vo.check_vocabulary(bad)
    rows = spark.createDataFrame([("st. louis", "st. louis", "city", 1), ("x", "x", "city", 1)], "alias string, canonical string, kind string, priority int")
    assert {r.alias for r in vo.dotless(rows).collect()} == {"st. louis", "st louis", "x"}


def test_labels_and_batches(spark):
    items = spark.createDataFrame([(1,), (2,)], "item long")
    q.check_labels(items, items, "item")
    with pytest.raises(ValueError, match="3"):
        q.check_labels(spark.createDataFrame([(1,), (3,), (None,)], "item long"), items, "item")
    jobs = spark.createDataFrame([(i, 7, True, "x" * 300) for i in (5, 3, 4, 9)], "id long, lead_company_id long, active boolean, description string")
    firms, none = spark.createDataFrame([(7, True)], "id long, active boolean"), spark.createDataFrame([(4, "v", "m")], "job_id long, prompt_version string, model string")
    assert [r.id for r in pending_jobs(jobs, firms, none, prompt_version="v", model="m", cursor=3, batch=1).collect()] == [5]
    roles = spark.createDataFrame([(1, 7, True, "A", None, None), (2, 7, True, " ", "", None), (3, 7, None, "B", None, None), (4, 7, True, None, "d", "x")], "id long, lead_company_id long, active boolean, title string, department string, seniority string")
    assert [r.id for r in pending_roles(roles, spark.createDataFrame([(1,)], "contact_id long"), batch=9).collect()] == [4]
