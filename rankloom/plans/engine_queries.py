"""Queries of the search engine over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket_bounds, days_since, overlap, recency, volume, whole_word
from ..functions.match import cosine, hashed_vector, max_cosine
from ..operators.evaluate import composite, forbidden_hits, measures, tune, weight_grid
from ..operators.roles import DEPARTMENTS, FUNCTION_WORDS, FUNCTIONS, HINTS, SEAT_NAMES, SENIORITIES, SENIORITY_WORDS
from ..operators.score import WEIGHTS
from ..sources.tables import load
from .chips import Chips, Group, Value, phrases, role_phrases
from .engine import Tables, Vocabulary, compile_predicate, coverage_of_fields, details, dimension_counts, excluded, filter_report, flagged, fused, lists, ranked, search

#: The moment that all queries take for now, and the company whose vector asks.
NOW, ASKING = "2026-09-01 00:00:00", 901
CHIPS = Chips(terms=(Group(("Nimbrel Insight",), "USES"), Group(("Quorvex Warehouse", "slow reports"), "ANY"), Group(("partner files",), "HIRING"), Group(("Inkstone",), "ANY", True)), max_revenue_usd=5_000_000_000.0, intent_mode="EITHER")
PEOPLE = Chips(terms=(Group(("finance operations", "internal audit"), "ANY"),), result_mode="PEOPLE", limit=50)
FILTERS = Chips(terms=(Group(("Garnetto Scheduler",), "ANY", True),), industries=(Value("Railway"), Value("Solar Research and Testing", True)), locations=(Value("Ravensend"), Value("dw"), Value("Kohistead", True)), segments=("core", "growth"), has_linkedin=True, min_employees=10, min_revenue_usd=1_000_000.0, since_days=900, function="ERP", seniority="SENIOR")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def asking(spark: SparkSession, d: str, company: int = ASKING) -> list[float]:
    """One stored vector as the query's; without that company the first one with a vector."""
    rows = load(spark, d, "company_signal", "company_id", "embedding").where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    r = rows.orderBy(F.col("company_id") != company, "company_id").select("embedding").first()
    return [float(x) for x in r.embedding] if r else [1.0]


def _t(spark: SparkSession, d: str) -> Tables:
    return Tables(spark, d)


def _parts(spark: SparkSession, d: str, chips: Chips = CHIPS):
    t, v = _t(spark, d), Vocabulary.read(spark, d)
    return t, v, compile_predicate(chips, v, now()), asking(spark, d)


def search_companies(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: ranked companies with their axes and evidence."""
    t, v = _t(spark, d), Vocabulary.read(spark, d)
    out = search(t, CHIPS, v, asking(spark, d), now())
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("company_id", r("score"), r("coverage"), r("recency"), r("volume"), r("best_doc"), F.col("distinct_roles").cast("bigint").alias("distinct_roles"), F.transform("evidence", lambda e: e["job_id"]).alias("evidence_jobs"))


def search_people(spark: SparkSession, d: str) -> DataFrame:
    """Companies with roles that match, and the number of these roles."""
    t, v = _t(spark, d), Vocabulary.read(spark, d)
    return search(t, PEOPLE, v, asking(spark, d), now()).select("company_id", F.round("score", 6).alias("score"), "n_roles")


def search_excluded(spark: SparkSession, d: str) -> DataFrame:
    """What the negation removed, with the place it would have had."""
    t, v = _t(spark, d), Vocabulary.read(spark, d)
    return excluded(t, CHIPS, v, asking(spark, d), now()).select("company_id", F.round("score", 6).alias("score"), F.col("would_rank").cast("bigint").alias("would_rank"), "excluded_by")


def _list(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        t, _, p, q = _parts(spark, d)
        found = lists(t, p, phrases(CHIPS), q)[name]
        return found.select(*found.columns[:-1], F.round("score", 6).alias("score"))

    return query


def fused_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates with their fused reciprocal ranks."""
    t, _, p, q = _parts(spark, d)
    return fused(lists(t, p, phrases(CHIPS), q)).select("company_id", F.round("fused", 9).alias("fused"), F.round("best_doc", 6).alias("best_doc"))


def filter_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every company with each filter's verdict."""
    t, _, p, _ = _parts(spark, d, FILTERS)
    return flagged(t, p)


def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Companies that pass each dimension alone, and all but it."""
    t, _, p, _ = _parts(spark, d, FILTERS)
    return dimension_counts(t, p)


def empty_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Of a query that nothing passes, what each of its filters lets through, alone and with all others."""
    chips = Chips(locations=(Value("Wakanda"),), has_linkedin=True, segments=("core",), min_revenue_usd=1_000_000.0)
    t, _, p, _ = _parts(spark, d, chips)
    return filter_report(t, p)


def job_filters(spark: SparkSession, d: str) -> DataFrame:
    """Postings within the asked days, function and seniority."""
    t, _, p, _ = _parts(spark, d, FILTERS)
    return t.jobs.where(p.job).select("job_id", "company_id")


def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage_of_fields(_t(spark, d))


def employee_buckets(spark: SparkSession, d: str) -> DataFrame:
    low, high = bucket_bounds("employee_range")
    return load(spark, d, "lead_company", "id", "employee_range").select("id", low.alias("emp_low"), high.alias("emp_high"))


def axes(spark: SparkSession, d: str) -> DataFrame:
    """Recency and volume of every company from all of its postings."""
    jobs = load(spark, d, "job_signal", "company_id", "posted_date", "title_norm")
    by = jobs.groupBy("company_id").agg(F.max("posted_date").alias("latest"), F.countDistinct(F.when(F.trim("title_norm") != "", F.trim("title_norm"))).alias("n_roles"))
    days = days_since("latest", now())
    return by.select("company_id", days.cast("bigint").alias("days"), F.round(recency(days), 6).alias("recency"), F.round(volume(F.col("n_roles")), 6).alias("volume"), F.col("n_roles").cast("bigint").alias("n_roles"))


def prose_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whole-word matches of a text that is no listed term."""
    rows = load(spark, d, "job_signal", "job_id", "paraphrase")
    return rows.where(whole_word("paraphrase", "slow reports") | whole_word("paraphrase", "port")).select("job_id")


def look_alikes(spark: SparkSession, d: str) -> DataFrame:
    """Companies that a substring test would remove and the exact test keeps."""
    rows = load(spark, d, "company_signal", "company_id", "technologies")
    return rows.where(F.exists(F.coalesce("technologies", F.array().cast("array<string>")), lambda t: t.ilike("%quorvex ware%")) & ~overlap("technologies", ["Quorvex Warehouse"])).select("company_id")


def best_vector(spark: SparkSession, d: str) -> DataFrame:
    """The better cosine over two asked vectors."""
    q = [asking(spark, d), asking(spark, d, 1002)]
    rows = load(spark, d, "company_signal", "company_id", "embedding")
    return rows.select("company_id", F.round(max_cosine("embedding", q), 6).alias("similarity"), F.round(cosine("embedding", q[0]), 6).alias("first"))


def _ranking(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    rows = load(spark, d, "retrieval", "query_id", "company_id", "fused").groupBy("query_id", "company_id").agg(F.max("fused").alias("fused"))
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("fused"), "company_id")))
    signals = load(spark, d, "company_signal", "company_id", "industry_canonical").where("industry_canonical LIKE 'Railway%'").select("company_id")
    relevant = rows.join(signals, "company_id", "left_semi").select("query_id", F.col("company_id").alias("item"))
    every = rows.select("query_id").distinct().select("query_id", F.lit(None).cast("bigint").alias("item"))
    return placed.select("query_id", F.col("company_id").alias("item"), "place"), relevant.unionByName(every)


def ranking_measures(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and reciprocal rank of each query, with their ceilings."""
    m = measures(*_ranking(spark, d))
    return m.select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def ranking_composite(spark: SparkSession, d: str) -> DataFrame:
    return composite(measures(*_ranking(spark, d))).select(*[F.round(c, 6).alias(c) for c in ("composite", "p", "r", "m")])


def ranking_forbidden(spark: SparkSession, d: str) -> DataFrame:
    """Companies of a forbidden industry among the first ten."""
    placed, _ = _ranking(spark, d)
    bad = load(spark, d, "company_signal", "company_id", "industry_canonical").where("industry_canonical LIKE 'Solar%'").select(F.col("company_id").alias("item"))
    forbidden = placed.select("query_id", "item").join(bad, "item", "left_semi")
    return forbidden_hits(placed, forbidden, 10)


def weight_search(spark: SparkSession, d: str) -> DataFrame:
    """All weights in steps of .05, best first, over axes that are retrieved once."""
    t, v, p, q = _parts(spark, d)
    rows = ranked(t, CHIPS, p, v, q, now(), people=False).select(F.lit(1).alias("query_id"), F.col("company_id").alias("item"), "coverage", "recency", "volume", "best_doc")
    labels = details(t).where("industry_canonical LIKE 'Railway%'").select(F.lit(1).alias("query_id"), F.col("company_id").alias("item"))
    prior = WEIGHTS["EITHER"]
    return tune(rows, labels, weight_grid(), (prior["coverage"], prior["recency"], prior["volume"], prior["best_doc"]))


# ---- SQL -------------------------------------------------------------------------------------------

def _stored(company: int = ASKING) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM company_signal WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY company_id <> {company}, company_id LIMIT 1)"


#: Names of the queries' terms that are listed technologies; any other text is looked for in the prose.
_LISTED = frozenset(["nimbrel insight", "quorvex warehouse", "inkstone"])


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _match(c: str, asked: list[str]) -> str:
    return "(" + " OR ".join(f"list_has_all({_tokens(c)}, {sorted(set(p.lower().split()))})" for p in asked) + ")"


def _lex(c: str, asked: list[str]) -> str:
    said = sorted({w for p in asked for w in p.lower().split()})
    one = " + ".join(f"0.1 * coalesce(list_sum(list_transform(range(1, len(list_filter({_tokens(c)}, lambda t: t = '{w}')) + 1), lambda j: 1.0::DOUBLE / (j * j))), 0) / 1.64493406685::DOUBLE" for w in said)
    return f"round(({one}) / {len(said)}, 9)"


def _cos(c: str, q: str | None = None) -> str:
    zero = f"len(list_filter({c}, lambda x: x <> 0)) = 0"
    return f"round(CASE WHEN {zero} THEN NULL ELSE list_cosine_similarity({c}::DOUBLE[], {q or _stored()}) END, 9)"


def _hashed(c: str) -> str:
    """``hashed_column`` of a text; null without words."""
    h = f"list_transform({_tokens(c)}, lambda w: struct_pack(slot := ('0x' || substr(md5(w), 1, 4))::INT % 64, sign := CASE WHEN ('0x' || substr(md5(w), 5, 1))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END))"
    return f"list_transform([{h}], lambda h: list_transform(range(64), lambda i: coalesce(list_sum(list_transform(list_filter(h, lambda x: x.slot = i), lambda x: x.sign)), 0)))[1]"


_NEG_USES = "SELECT company_id FROM company_signal WHERE list_contains(technologies, 'Inkstone')"
_NEG_HIRES = "SELECT company_id FROM job_signal WHERE list_contains(technologies, 'Inkstone')"
_FIRMS = "SELECT c.canonical_id AS company_id, l.* FROM company_canonical c JOIN lead_company l ON l.id = c.canonical_id"
_NEGATED = f"company_id NOT IN ({_NEG_USES}) AND company_id NOT IN (SELECT company_id FROM ({_NEG_HIRES}) WHERE company_id IS NOT NULL)"
_ALLOWED = f"SELECT company_id FROM ({_FIRMS}) WHERE revenue_usd <= 5000000000 AND {_NEGATED}"
_SHADOW = f"SELECT company_id FROM ({_FIRMS}) WHERE revenue_usd <= 5000000000"


def _case(c: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){x}') THEN '{n}'" for n, x in rules) + f" ELSE {otherwise} END"


_ROLE_SQL = "SELECT *, " + _case("concat_ws(' ', title, department)", FUNCTIONS, "CASE " + " ".join(f"WHEN contains(lower(coalesce(department, '')), '{k}') THEN '{v}'" for k, v in DEPARTMENTS) + " ELSE 'OTHER' END") + " AS role, "
_ROLE_SQL += _case("coalesce(title, '')", SENIORITIES, "CASE " + " ".join(f"WHEN lower(trim(coalesce(seniority, ''))) = '{k}' THEN '{v}'" for k, v in HINTS.items()) + " ELSE 'OTHER' END") + " AS level FROM {0}"


def role_sql(rows: str) -> str:
    """Contacts with the role and level that their titles tell."""
    return _ROLE_SQL.replace("{0}", rows)


def census_sql(former: str = "NULL") -> str:
    """Active contacts of canonical companies with the sentence they are found by."""
    named = lambda c, words: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"
    seat = named("role || ' ' || level", {f"{f} {s}": n for (f, s), n in SEAT_NAMES.items()})
    return f"""SELECT company_id, id AS contact_id, role, level, {former} IS NOT NULL AS is_alum, concat_ws(' ', 'A ' || {named('level', SENIORITY_WORDS)} || ' in ' || {named('role', FUNCTION_WORDS)} || '.', 'Role: ' || nullif(trim(title), '') || '.',
  'Also known as: ' || {seat} || '.', 'Department: ' || CASE WHEN trim(department) <> '' AND NOT starts_with(lower(trim(department)), 'master_') THEN trim(department) END || '.', 'Big Four (Big-4) alumnus, formerly at ' || {former} || '.') AS census_text
FROM ({role_sql('lead_contact')}) JOIN (SELECT DISTINCT canonical_id AS company_id, unnest(member_ids) AS lead_company_id FROM company_canonical) USING (lead_company_id)"""


def _lists_sql(chips: Chips, allowed: str | None, q: str | None = None) -> dict[str, str]:
    """The lists of a query in their order; ``q`` is its vector, by default the stored one."""
    asked, kept = phrases(chips), f"company_id IN ({allowed})" if allowed else "true"
    jobs = f"(SELECT * FROM job_signal WHERE {kept})"
    intents = f"(SELECT i.id, i.job_id, i.intent, i.intent_embedding, j.company_id FROM (SELECT DISTINCT id, job_id, intent, intent_embedding, source FROM job_intent) i JOIN {jobs} j ON j.job_id = i.job_id)"
    firms = f"(SELECT * FROM company_signal WHERE {kept})"
    top = "ORDER BY score DESC, {k} LIMIT 200"
    best = "SELECT {k}, company_id, score FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, {tie}) AS n FROM ({s})) WHERE n = 1 ORDER BY score DESC, {k} LIMIT 200"
    out = {
        "job_lexical": f"SELECT job_id, company_id, {_lex('paraphrase', asked)} AS score FROM {jobs} WHERE {_match('paraphrase', asked)} " + top.format(k="job_id"),
        "job_semantic": f"SELECT * FROM (SELECT job_id, company_id, {_cos('embedding', q)} AS score FROM {jobs} WHERE embedding IS NOT NULL) WHERE score IS NOT NULL " + top.format(k="job_id"),
        "company_lexical": f"SELECT company_id, {_lex('paraphrase', asked)} AS score FROM {firms} WHERE {_match('paraphrase', asked)} " + top.format(k="company_id"),
        "company_semantic": f"SELECT * FROM (SELECT company_id, {_cos('embedding', q)} AS score FROM {firms} WHERE embedding IS NOT NULL) WHERE score IS NOT NULL " + top.format(k="company_id"),
        "intent_lexical": best.format(k="job_id", tie="id", s=f"SELECT id, job_id, company_id, {_lex('intent', asked)} AS score FROM {intents} WHERE {_match('intent', asked)}"),
        "intent_semantic": best.format(k="job_id", tie="id", s=f"SELECT * FROM (SELECT id, job_id, company_id, {_cos('intent_embedding', q)} AS score FROM {intents} WHERE intent_embedding IS NOT NULL) WHERE score IS NOT NULL"),
    }
    if chips.result_mode == "PEOPLE":
        roles = role_phrases(chips)
        census = f"(SELECT * FROM ({census_sql()}) WHERE {kept} AND contact_id IN (SELECT id FROM lead_contact WHERE active))"
        vector = str(hashed_vector(" ".join(roles))) + "::DOUBLE[]"
        firm = lambda sql: f"SELECT company_id, score FROM ({sql})"
        out["role_lexical"] = best.format(k="company_id", tie="contact_id", s=f"SELECT company_id, contact_id, {_lex('census_text', roles)} AS score FROM {census} WHERE {_match('census_text', roles)}").replace("SELECT company_id, company_id, score", "SELECT company_id, score")
        out["role_semantic"] = best.format(k="company_id", tie="contact_id", s=f"SELECT company_id, contact_id, round(list_cosine_similarity({_hashed('census_text')}, {vector}), 9) AS score FROM {census} WHERE len({_tokens('census_text')}) > 0").replace("SELECT company_id, company_id, score", "SELECT company_id, score")
    return out


def _fused_sql(found: dict[str, str]) -> str:
    parts = []
    for name, sql in found.items():
        key = "job_id" if name.startswith(("job", "intent")) else "company_id"
        placed = f"SELECT company_id, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM ({sql})"
        if key == "job_id":
            placed = f"SELECT company_id, row_number() OVER (ORDER BY best, company_id) AS rank FROM (SELECT company_id, min(rank) AS best FROM ({placed}) GROUP BY 1)"
        parts.append(f"SELECT company_id, '{name}' AS list, rank FROM ({placed})")
    wide = ", ".join(f"min(rank) FILTER (list = '{n}') AS {n}" for n in found)
    total = " + ".join(f"coalesce(1.0::DOUBLE / (60 + {n}), 0)" for n in found)
    return f"""SELECT company_id, fused, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (fused - lo) / (hi - lo) END AS best_doc FROM (
  SELECT company_id, fused, min(fused) OVER () AS lo, max(fused) OVER () AS hi FROM (
    SELECT company_id, {total} AS fused FROM (SELECT company_id, {wide} FROM ({' UNION ALL '.join(parts)}) GROUP BY 1)))"""


_WORD = lambda c, w: f"coalesce(regexp_matches(lower({c}), '(^|[^a-z0-9]){w}([^a-z0-9]|$)'), false)"
_HAS = lambda c, t: f"coalesce(list_contains(list_transform({c}, lambda x: lower(x)), '{t.lower()}'), false)"


def _scored_sql(chips: Chips, allowed: str | None, q: str | None = None) -> str:
    """All candidates of a query with their axes, unordered."""
    groups, w = chips.positive_groups(), WEIGHTS[chips.intent_mode]
    hit = lambda g, at: "(" + " OR ".join(_HAS(f"{at}technologies", a) if a.lower() in _LISTED else _WORD(f"{at}paraphrase", a.lower()) for a in g.any_of) + ")"
    on_job = {i: hit(g, "") if g.source != "USES" else "false" for i, g in enumerate(groups)}
    counts = " OR ".join(f"g{i}" for i, g in enumerate(groups) if g.source != "USES") or "true"
    side = {"USES": "{c}", "HIRING": "coalesce(j{i}, false)", "ANY": "(coalesce(j{i}, false) OR {c})"}
    covered = " + ".join("(" + side[g.source].format(i=i, c=hit(g, "d.")) + ")::INT" for i, g in enumerate(groups))
    people = chips.result_mode == "PEOPLE"
    roles = f", r AS (SELECT company_id, count(*) AS n_roles FROM ({census_sql()}) WHERE contact_id IN (SELECT id FROM lead_contact WHERE active) AND {_match('census_text', role_phrases(chips))} GROUP BY 1)" if people else ""
    return f"""
WITH f AS ({_fused_sql(_lists_sql(chips, allowed, q))}),
d AS (SELECT s.* FROM company_signal s JOIN ({_FIRMS}) l USING (company_id)),
j AS (SELECT job_id, company_id, trim(coalesce(title_norm, '')) AS title, posted_date, {', '.join(f'{c} AS g{i}' for i, c in on_job.items())} FROM job_signal WHERE company_id IN (SELECT company_id FROM f)),
a AS (SELECT company_id, max(posted_date) FILTER ({counts}) AS latest, count(DISTINCT title) FILTER (({counts}) AND title <> '') AS roles, {', '.join(f'bool_or(g{i}) AS j{i}' for i in on_job)}, count(*) FILTER ({counts}) AS n FROM j GROUP BY 1),
e AS (SELECT company_id, list(job_id ORDER BY k) AS evidence_jobs FROM (SELECT j.company_id, job_id, row_number() OVER (PARTITION BY j.company_id ORDER BY posted_date DESC NULLS LAST, job_id) AS k FROM j JOIN a ON a.company_id = j.company_id WHERE {counts} OR a.n = 0) WHERE k <= 3 GROUP BY 1){roles},
x AS (SELECT f.company_id, best_doc, coalesce(roles, 0) AS distinct_roles, evidence_jobs, ({covered}) / {float(len(groups))}::DOUBLE AS coverage,
  coalesce(exp(-CASE WHEN latest IS NOT NULL THEN greatest(0, date_sub('day', latest, TIMESTAMP '{NOW}')) END / 60.0::DOUBLE), 0) AS recency, ln(1 + coalesce(roles, 0)) / ln(11) AS volume{', n_roles' if people else ''}
  FROM f JOIN d USING (company_id) LEFT JOIN a USING (company_id) LEFT JOIN e USING (company_id){' JOIN r USING (company_id)' if people else ''})
SELECT *, round({w['coverage']}::DOUBLE * coverage + {w['recency']}::DOUBLE * recency + {w['volume']}::DOUBLE * volume + {w['best_doc']}::DOUBLE * best_doc, 9) AS score FROM x"""


_RELEVANT = f"SELECT s.company_id FROM company_signal s JOIN ({_FIRMS}) l USING (company_id) WHERE s.industry_canonical LIKE 'Railway%'"
_GRID = "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS grid_id, a / 100.0::DOUBLE AS a, b / 100.0::DOUBLE AS b, c / 100.0::DOUBLE AS c, (100 - a - b - c) / 100.0::DOUBLE AS d FROM (SELECT unnest(range(0, 101, 5)) AS a), (SELECT unnest(range(0, 101, 5)) AS b), (SELECT unnest(range(0, 101, 5)) AS c) WHERE a + b + c BETWEEN 20 AND 100"
_TUNED = f"""WITH x AS ({_scored_sql(CHIPS, _ALLOWED)}), g AS ({_GRID}), n AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT company_id FROM ({_RELEVANT}))),
p AS (SELECT grid_id, company_id, row_number() OVER (PARTITION BY grid_id ORDER BY round(a * coverage + b * recency + c * volume + d * best_doc, 9) DESC, company_id) AS place FROM g, x),
h AS (SELECT grid_id, count(*) FILTER (place <= 10) AS h10, count(*) FILTER (place <= 50) AS h50, min(place) FILTER (place <= 50) AS first FROM p WHERE company_id IN ({_RELEVANT}) GROUP BY 1)
SELECT grid_id, round(((coalesce(h10, 0) / 10.0) / (least(n, 10) / 10.0) + (coalesce(h50, 0) / n) / (least(n, 50) / n) + coalesce(1.0 / first, 0)) / 3, 9) AS composite,
  round(abs(a - 0.45) + abs(b - 0.2) + abs(c - 0.05) + abs(d - 0.3), 6) AS distance FROM g LEFT JOIN h USING (grid_id), n"""

_FLAGS_SQL = f"""
SELECT l.company_id,
  list_has_any(coalesce(segments, []), ['core', 'growth']) AS d_segment,
  coalesce(s.industry_canonical LIKE 'Railway %', false) AND coalesce(s.industry_canonical <> 'Solar Research and Testing', true) AS d_industry,
  (coalesce(lower(hq_state), '') IN ('ravensend', 'dunmarrow') OR coalesce(lower(hq_city), '') IN ('ravensend', 'dunmarrow') OR coalesce(lower(hq_country), '') IN ('ravensend', 'dunmarrow'))
    AND NOT (coalesce(lower(hq_state), '') = 'kohistead' OR coalesce(lower(hq_city), '') = 'kohistead' OR coalesce(lower(hq_country), '') = 'kohistead') AS d_location,
  linkedin_url IS NOT NULL AS d_linkedin,
  coalesce(CASE WHEN regexp_matches(t, '^\\d+(\\.\\d+)?k') THEN round(1000 * CAST(regexp_extract(t, '^(\\d+(?:\\.\\d+)?)k', 1) AS DOUBLE)) WHEN regexp_matches(t, '^\\d+($|\\s*-|\\+)') THEN CAST(regexp_extract(t, '^(\\d+)', 1) AS DOUBLE) END >= 10, false) AS d_employees,
  coalesce(revenue_usd >= 1000000, false) AS d_revenue,
  NOT (coalesce(list_contains(s.technologies, 'Garnetto Scheduler'), false) OR l.company_id IN (SELECT company_id FROM job_signal WHERE list_contains(technologies, 'Garnetto Scheduler'))) AS d_negation
FROM (SELECT *, trim(replace(lower(coalesce(employee_count, employee_range)), ',', '')) AS t FROM ({_FIRMS})) l LEFT JOIN company_signal s USING (company_id)"""
_DIMS = ("segment", "industry", "location", "linkedin", "employees", "revenue", "negation")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("score", "coverage", "recency", "volume", "best_doc"))
_PLACED = "SELECT query_id, company_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY max(fused) DESC, company_id) AS place FROM retrieval GROUP BY 1, 2"
_MEASURES = f"""
WITH p AS ({_PLACED}), r AS (SELECT query_id, item FROM p WHERE item IN (SELECT company_id FROM company_signal WHERE industry_canonical LIKE 'Railway%')),
h AS (SELECT query_id, count(*) AS n_relevant, count(*) FILTER (place <= 10) AS h10, count(*) FILTER (place <= 50) AS h50, min(place) AS first FROM p JOIN r USING (query_id, item) GROUP BY 1),
q AS (SELECT query_id, coalesce(n_relevant, 0) AS n_relevant, coalesce(h10, 0) AS h10, coalesce(h50, 0) AS h50, first FROM (SELECT DISTINCT query_id FROM p) LEFT JOIN h USING (query_id))
SELECT query_id, n_relevant, CASE WHEN n_relevant = 0 THEN 0.0 ELSE h10 / 10.0 END::DOUBLE AS precision, CASE WHEN n_relevant = 0 THEN 0.0 ELSE h50 / n_relevant END::DOUBLE AS recall,
  CASE WHEN n_relevant = 0 THEN 0.0 ELSE coalesce(1.0 / first, 0) END::DOUBLE AS reciprocal, CASE WHEN n_relevant = 0 THEN 1.0 ELSE least(n_relevant, 10) / 10.0 END::DOUBLE AS precision_ceiling, CASE WHEN n_relevant = 0 THEN 1.0 ELSE least(n_relevant, 50) / n_relevant END::DOUBLE AS recall_ceiling FROM q"""

QUERIES = {
    "search_companies": search_companies, "search_people": search_people, "search_excluded": search_excluded,
    **{f"list_{n}": _list(n) for n in ("job_lexical", "job_semantic", "intent_lexical", "intent_semantic", "company_lexical", "company_semantic")},
    "fused_candidates": fused_candidates, "filter_flags": filter_flags, "filter_counts": filter_counts, "empty_reasons": empty_reasons, "job_filters": job_filters, "field_coverage": field_coverage,
    "employee_buckets": employee_buckets, "axes": axes, "prose_matches": prose_matches, "look_alikes": look_alikes, "best_vector": best_vector,
    "ranking_measures": ranking_measures, "ranking_composite": ranking_composite, "ranking_forbidden": ranking_forbidden, "weight_search": weight_search,
}

SQL = {
    "search_companies": f"SELECT company_id, {_ROUNDED}, distinct_roles, evidence_jobs FROM ({_scored_sql(CHIPS, _ALLOWED)}) ORDER BY score DESC, company_id LIMIT 20",
    "search_excluded": f"""SELECT company_id, round(score, 6) AS score, would_rank, excluded_by FROM (SELECT company_id, score, row_number() OVER (ORDER BY score DESC, company_id) AS would_rank FROM ({_scored_sql(CHIPS, _SHADOW)}))
JOIN (SELECT company_id, ['Inkstone'] AS excluded_by FROM ({_NEG_USES} UNION {_NEG_HIRES})) USING (company_id) ORDER BY would_rank LIMIT 20""",
    **{f"list_{n}": f"SELECT * REPLACE (round(score, 6) AS score) FROM ({s})" for n, s in _lists_sql(CHIPS, _ALLOWED).items()},
    "fused_candidates": f"SELECT company_id, round(fused, 9) AS fused, round(best_doc, 6) AS best_doc FROM ({_fused_sql(_lists_sql(CHIPS, _ALLOWED))})",
    "search_people": f"SELECT company_id, round(score, 6) AS score, n_roles FROM ({_scored_sql(PEOPLE, None)}) ORDER BY score DESC, company_id LIMIT 50",
    "weight_search": _TUNED,
    "empty_reasons": f"""WITH c AS (SELECT 'wakanda' IN (coalesce(lower(hq_state), ''), coalesce(lower(hq_city), ''), coalesce(lower(hq_country), '')) AS l, list_contains(coalesce(segments, []), 'core') AS s, linkedin_url IS NOT NULL AS k, coalesce(revenue_usd >= 1000000, false) AS r, coalesce(len(segments) > 0, false) AS fs, revenue_usd IS NOT NULL AS fr FROM ({_FIRMS})),
t AS (SELECT count(*) AS n_all, count(*) FILTER (l AND s AND k AND r) AS n_passing FROM c)
SELECT x.*, n_all, n_passing FROM (
  SELECT 1 AS place, 'location' AS filter, count(*) FILTER (l) AS n_alone, count(*) FILTER (s AND k AND r) AS n_others, NULL::BIGINT AS n_field FROM c
  UNION ALL SELECT 2, 'segment', count(*) FILTER (s), count(*) FILTER (l AND k AND r), count(*) FILTER (fs) FROM c
  UNION ALL SELECT 3, 'linkedin', count(*) FILTER (k), count(*) FILTER (l AND s AND r), count(*) FILTER (k) FROM c
  UNION ALL SELECT 4, 'revenue', count(*) FILTER (r), count(*) FILTER (l AND s AND k), count(*) FILTER (fr) FROM c) x, t""",
    "filter_flags": _FLAGS_SQL,
    "filter_counts": f"SELECT count(*) AS universe, count(*) FILTER ({' AND '.join(f'd_{k}' for k in _DIMS)}) AS passing, " + ", ".join(f"count(*) FILTER (d_{k}) AS only_{k}, count(*) FILTER ({' AND '.join(f'd_{o}' for o in _DIMS if o != k)}) AS without_{k}" for k in _DIMS) + f" FROM ({_FLAGS_SQL})",
    "job_filters": f"SELECT job_id, company_id FROM job_signal WHERE posted_date >= TIMESTAMP '{NOW}' - INTERVAL 900 DAY AND function = 'ERP' AND seniority = 'SENIOR'",
    "field_coverage": f"SELECT count(*) AS universe, count(*) FILTER (len(naics_codes) > 0) AS naics, count(*) FILTER (len(sic_codes) > 0) AS sic, count(*) FILTER (len(segments) > 0) AS segment, count(linkedin_url) AS linkedin, count(revenue_usd) AS revenue FROM ({_FIRMS})",
    "employee_buckets": """SELECT id, CASE WHEN k THEN kv WHEN bare OR ranged OR plus THEN CAST(regexp_extract(t, '^(\\d+)', 1) AS BIGINT) END AS emp_low,
  CASE WHEN k THEN kv WHEN bare THEN CAST(t AS BIGINT) WHEN ranged THEN try_cast(regexp_extract(t, '^\\d+\\s*-(\\d+)', 1) AS BIGINT) END AS emp_high
FROM (SELECT id, t, regexp_matches(t, '^\\d+(\\.\\d+)?k') AS k, regexp_matches(t, '^\\d+$') AS bare, regexp_matches(t, '^\\d+\\s*-') AS ranged, regexp_matches(t, '^\\d+\\+') AS plus,
  CAST(round(1000 * try_cast(regexp_extract(t, '^(\\d+(?:\\.\\d+)?)k', 1) AS DOUBLE)) AS BIGINT) AS kv FROM (SELECT id, trim(replace(lower(employee_range), ',', '')) AS t FROM lead_company))""",
    "axes": f"""SELECT company_id, days, round(coalesce(exp(-days / 60.0), 0), 6) AS recency, round(ln(1 + n_roles) / ln(11), 6) AS volume, n_roles FROM (
  SELECT company_id, CASE WHEN max(posted_date) IS NOT NULL THEN greatest(0, date_sub('day', max(posted_date), TIMESTAMP '{NOW}')) END AS days, count(DISTINCT trim(title_norm)) FILTER (trim(title_norm) <> '') AS n_roles FROM job_signal GROUP BY 1)""",
    "prose_matches": f"SELECT job_id FROM job_signal WHERE {_WORD('paraphrase', 'slow reports')} OR {_WORD('paraphrase', 'port')}",
    "look_alikes": "SELECT company_id FROM company_signal WHERE len(list_filter(technologies, lambda t: t ILIKE '%quorvex ware%')) > 0 AND NOT coalesce(list_contains(technologies, 'Quorvex Warehouse'), false)",
    "best_vector": f"SELECT company_id, greatest({_cos('embedding').replace(', 9)', ', 6)')}, {_cos('embedding', _stored(1002)).replace(', 9)', ', 6)')}) AS similarity, {_cos('embedding').replace(', 9)', ', 6)')} AS first FROM company_signal",
    "ranking_measures": f"SELECT query_id, n_relevant, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal, 6) AS reciprocal, round(precision_ceiling, 6) AS precision_ceiling, round(recall_ceiling, 6) AS recall_ceiling FROM ({_MEASURES})",
    "ranking_composite": f"SELECT round((p + r + m) / 3, 6) AS composite, round(p, 6) AS p, round(r, 6) AS r, round(m, 6) AS m FROM (SELECT avg(precision / precision_ceiling) AS p, avg(recall / recall_ceiling) AS r, avg(reciprocal) AS m FROM ({_MEASURES}))",
    "ranking_forbidden": f"SELECT * FROM ({_PLACED}) WHERE place <= 10 AND item IN (SELECT company_id FROM company_signal WHERE industry_canonical LIKE 'Solar%')",
}
