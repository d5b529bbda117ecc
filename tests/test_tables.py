import pytest
from pyspark.sql import functions as F

from rankloom.operators import ingest as ing
from rankloom.operators.evaluate import composite, measures
from rankloom.operators.fold import fold
from rankloom.operators.quality import personal_columns
from rankloom.operators.roles import function_of, history_of, seniority_of
from rankloom.operators.vocabulary import collisions, nearest_term, resolve
from rankloom.sources.sinks import rebuild
from rankloom.streaming.events import ingest_stream, windowed_counts


@pytest.mark.parametrize(
    "title, role, level",
    [("Chief Financial Officer", "FINANCE", "C_LEVEL"), ("Vice President", "EXECUTIVE", "VP"), ("VP Internal audit", "FINANCE", "VP"), ("Head of Purchasing", "PROCUREMENT", "DIRECTOR"), ("Über-Engineer", "IT", "IC"), (None, "HR", "MANAGER"), ("", "HR", "MANAGER")],
)
def test_roles(spark, title, role, level):
    df = spark.createDataFrame([(title, "master_human_resources", "manager")], "t string, d string, s string")
    got = df.select(function_of(F.col("t"), F.lit(None).cast("string") if title else F.col("d")).alias("r"), seniority_of(F.col("t"), F.col("s")).alias("l")).first()
    assert (got.r, got.l) == (role, level)


@pytest.mark.parametrize(
    "data, former, landed",
    [('{"employment_history": [{"organization_name": "KPMG", "current": false}, {"organization_name": "X", "current": true}, {"organization_name": "Y", "current": true, "start_date": "2020-02-01T00"}]}', "KPMG", "2020-02-01"), ("{bad", None, None), (None, None, None), ('{"employment_history": [{"organization_name": "EY", "current": true, "start_date": "soon"}]}', None, None)],
)
def test_history(spark, data, former, landed):
    a, b = history_of(F.col("d"))
    r = spark.createDataFrame([(data,)], "d string").select(a.alias("a"), b.cast("string").alias("b")).first()
    assert (r.a, r.b) == (former, landed)


def test_fold_prefers_shared_rows(spark):
    df = spark.createDataFrame([(5, "a", 1), (9, "a", None), (7, "", None), (8, "", None), (3, None, None), (1476, "b", None), (1477, "b", None)], "id int, key string, tenant_id int")
    assert {(r.canonical_id, tuple(r.member_ids)) for r in fold(df).collect()} == {(9, (5, 9)), (7, (7,)), (8, (8,)), (1476, (1476, 1477))}


def test_ladder_with_vectors(spark):
    vocab = spark.createDataFrame([("SAP", ["s a p"]), ("Azure", [])], "term string, aliases array<string>")
    values = spark.createDataFrame([("sap",), ("S-A-P",), ("near",), ("far",), (None,)], "raw string")
    vecs = spark.createDataFrame([("near", [1.0, 0.1]), ("far", [0.0, 1.0])], "raw string, vec array<float>")
    terms = spark.createDataFrame([("SAP", [1.0, 0.0]), ("Azure", [0.7, -0.7])], "term string, vec array<float>")
    got = {r.raw: (r.term, r.step) for r in resolve(values, vocab, vecs, terms).collect()}
    assert got == {"sap": ("SAP", 1), "S-A-P": ("SAP", 1), "near": ("SAP", 3), "far": (None, 4)}
    assert collisions(vocab).count() == 0 and nearest_term(vecs, terms).count() == 2


def test_ingest_is_repeatable(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (2, "b")], "id int, v string")
    once = ing.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ing.upsert(once, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    batch = spark.createDataFrame([(1,), (9,)], "id int")
    assert [tuple(r) for r in ing.replace_sets(old, new.limit(0), batch, ["id"]).collect()] == [(2, "b")]
    assert ing.pending(new, once, ["id"]).count() == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rebuild(spark.range(5), path, roots=[str(tmp_path)])
    rebuild(spark.read.parquet(path).where("id > 2"), path, roots=[str(tmp_path)])
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(PermissionError):
        rebuild(spark.range(1), "/root/testdata/x", roots=[str(tmp_path)])


def test_streams_equal_batches(spark, data, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.read.parquet(f"{data}/events.parquet").limit(3000)
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r)[:3] for r in windowed_counts(spark.read.parquet(src)).collect()}
    assert {tuple(r)[:3] for r in spark.sql("select * from w").collect()} == want
    out = str(tmp_path / "out")
    for turn in ("a", "b"):
        ingest_stream(spark.readStream.schema(rows.schema).parquet(src), out, str(tmp_path / turn), ["event_id"]).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3000


def test_measures_of_refusals(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (3, 9, 1)], "query_id int, item int, place int")
    labels = spark.createDataFrame([(1, 6), (2, None), (3, None)], "query_id int, item int")
    m = {r.query_id: r for r in measures(ranked, labels).collect()}
    assert m[1].precision == 0.1 == m[1].precision_ceiling and m[1].reciprocal == 0.5 and m[2].recall == 1.0 and m[3].recall == 0.0
    assert composite(measures(ranked, labels)).first().composite == pytest.approx((2 / 3 + 2 / 3 + 1.5 / 3) / 3)


def test_personal_columns(spark):
    df = spark.createDataFrame([], "id int, first_name string, email string, employer_name string, name string, title string")
    assert personal_columns(df) == ["first_name", "email", "name"]


def test_nearest_company_is_the_nearest_of_all(spark, data):
    import numpy as np

    from rankloom.operators import vocabulary as vo
    from rankloom.plans.table_queries import nearest_companies
    from rankloom.sources.tables import load

    read = lambda t, k: [(r[0], np.array(r[1], float)) for r in load(spark, data, t, k, "embedding").collect() if r[1] and any(r[1])]
    firms, jobs = sorted((str(k), v) for k, v in read("company_signal", "company_id")), read("job_signal", "job_id")
    unit = lambda rows: np.stack([v / np.sqrt(v @ v) for _, v in rows])
    cos = np.round(unit(jobs) @ unit(firms).T, 9)
    want = sorted((j, firms[a][0], round(float(c), 6)) for (j, _), a, c in zip(jobs, cos.argmax(1), cos.max(1)))
    got = sorted((r.raw, r.term, r.similarity) for r in nearest_companies(spark, data).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
    assert len({t for _, t, _ in got}) > 40
    vecs = lambda t, k, name: load(spark, data, t, k, "embedding").toDF(name, "vec")
    small = vo.nearest_of_many(vecs("job_signal", "job_id", "raw"), vecs("company_signal", "company_id", "term").selectExpr("string(term) term", "vec"), block=50)
    assert sorted((r.raw, r.term) for r in small.collect()) == [w[:2] for w in want]


def test_sentences_name_the_size(spark, tmp_path):
    from rankloom.plans.table_queries import sized_sentences

    sizes = [("51-200", "x"), ("?", "501-1,000 employees"), (None, "1001-5000"), ("10,001+", "1-10"), (None, None), ("700", "1-10")]
    rows = [(i, "Rail", None, None, None, ["Inkstone"], a, b) for i, (a, b) in enumerate(sizes)]
    spark.createDataFrame(rows, "id long, industry string, hq_city string, hq_state string, hq_country string, technologies array<string>, employee_count string, employee_range string").write.parquet(str(tmp_path / "lead_company.parquet"))
    got = {r.id: r.paraphrase for r in sized_sentences(spark, str(tmp_path)).collect()}
    words = ["Small ", "Mid-size ", "Large ", "Enterprise ", "", "Mid-size "]
    assert got == {i: f"{w}Rail company running Inkstone." for i, w in enumerate(words)}
