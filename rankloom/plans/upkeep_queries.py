"""Queries of the vocabularies' upkeep, the scans that find what is left to do, the model boundary and further checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import place_key, query_key, term_tokens
from ..operators import boundary as bo
from ..operators import ingest as ing
from ..operators import quality as q
from ..operators import vocabulary as vo
from ..sources.tables import load
from .chips import Chips, Group
from .engine import Tables, Vocabulary
from .engine_queries import _hashed, _scored_sql, _tokens, asking, now
from .frontdoor import answer
from .table_queries import _PLACE, KEY, TECH, _tech

QUERIES: dict = {}
SQL: dict[str, str] = {}
INDUSTRY = "(SELECT * FROM canonical_term WHERE kind = 'industry')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def keys_sql(terms: str) -> str:
    """Keys of the terms and aliases of a list, each with the term it stands for."""
    return f"""SELECT key, arg_min(term, step::VARCHAR || term) AS term, min(step) AS step FROM (SELECT {KEY.format('term')} AS key, term, 1 AS step FROM {terms}
UNION ALL SELECT {KEY.format('a')} AS key, term, 2 AS step FROM (SELECT term, unnest(aliases) AS a FROM {terms})) WHERE key <> '' GROUP BY 1"""


# ---- what is left to do ----------------------------------------------------------------------------


@query("""SELECT id, lead_company_id, title, department, seniority FROM lead_contact c WHERE active AND (coalesce(trim(title), '') <> '' OR coalesce(trim(department), '') <> '')
AND NOT EXISTS (SELECT 1 FROM apollo_contact_data d WHERE d.lead_contact_id = c.id)""")
def pending_roles(spark, d):
    """Contacts that no blob was fetched for."""
    done = load(spark, d, "apollo_contact_data", F.col("lead_contact_id").alias("contact_id"))
    return ing.pending_roles(load(spark, d, "lead_contact", "id", "active", "lead_company_id", "title", "department", "seniority"), done)


@query("SELECT DISTINCT trim(term) AS value FROM canonical_term WHERE kind = 'industry' AND trim(term) <> ''")
def declared_industries(spark, d):
    """The declared list of industries."""
    return load(spark, d, "canonical_term", "kind", "term").where("kind = 'industry' AND trim(term) <> ''").select(F.trim("term").alias("value")).distinct()


_DEAD = "SELECT id AS source_id, max('not an object') AS error, max(substr(data, 1, 8000)) AS raw_response FROM {0} WHERE data IS NOT NULL AND NOT json_valid(data) GROUP BY 1"


@query(f"""SELECT * FROM ({_DEAD.format('apollo_company_data')}) UNION ALL
SELECT * FROM ({_DEAD.format('apollo_contact_data')}) WHERE source_id NOT IN (SELECT source_id FROM ({_DEAD.format('apollo_company_data')})) AND source_id NOT IN (SELECT id FROM apollo_company_data WHERE data IS NOT NULL AND json_valid(data))""")
def settled_letters(spark, d):
    """The letters of one run after those of the next: replaced by source, cleared where the source went well."""
    def run(table: str) -> tuple[DataFrame, DataFrame]:
        rows = load(spark, d, table, "id", "data").where("data IS NOT NULL")
        return ing.split_failures(rows, F.when(F.expr("try_parse_json(data)").isNull(), F.lit("not an object")), F.col("data"), "id")

    _, old = run("apollo_contact_data")
    good, dead = run("apollo_company_data")
    first = old.groupBy("source_id").agg(F.max("error").alias("error"), F.max("raw_response").alias("raw_response"))
    failed = dead.select("source_id").distinct()
    return ing.settle_letters(first, dead, good.select(F.col("id").alias("source_id")).join(failed, "source_id", "left_anti"))


# ---- vocabularies ----------------------------------------------------------------------------------

_SEED = f"(SELECT term, aliases FROM {TECH} UNION ALL SELECT 'Ink Stone', ['nimbrel-insight', 'xy'] UNION ALL SELECT 'Wide', ['x.y', '--'])"


@query(f"""WITH e AS (SELECT term, {KEY.format('term')} AS key, true AS own FROM {_SEED} UNION ALL SELECT term, {KEY.format('a')} AS key, false FROM (SELECT term, unnest(aliases) AS a FROM {_SEED})),
g AS (SELECT key, coalesce(list(DISTINCT term) FILTER (own), []) AS o, coalesce(list(DISTINCT term) FILTER (NOT own), []) AS a FROM e GROUP BY 1),
k AS (SELECT CASE WHEN key = '' THEN 'empty' WHEN len(o) > 1 THEN 'two terms' WHEN len(o) > 0 AND len(list_filter(a, lambda x: NOT list_contains(o, x))) > 0 THEN 'term as alias' WHEN len(o) = 0 AND len(a) > 1 THEN 'two owners' END AS kind, key, list_sort(list_distinct(list_concat(o, a))) AS terms FROM g)
SELECT * FROM k WHERE kind IS NOT NULL""")
def seed_contradictions(spark, d):
    """What a vocabulary with two bad entries contradicts."""
    bad = spark.createDataFrame([("Ink Stone", ["nimbrel-insight", "xy"]), ("Wide", ["x.y", "--"])], "term string, aliases array<string>")
    return vo.contradictions(_tech(spark, d).unionByName(bad))


@query(f"""WITH v AS (SELECT DISTINCT trim(industry_raw) AS raw FROM company_signal WHERE trim(industry_raw) <> ''), f AS (SELECT raw, k.term, k.step FROM v LEFT JOIN ({keys_sql(INDUSTRY)}) k ON k.key = {KEY.format('raw')}),
r AS (SELECT raw, {_hashed('raw')} AS h FROM f WHERE term IS NULL AND len({_tokens('raw')}) > 0), t AS (SELECT term, {_hashed('term')} AS h FROM {INDUSTRY}),
n AS (SELECT raw, t.term, round(list_cosine_similarity(r.h, t.h), 9) AS s, row_number() OVER (PARTITION BY raw ORDER BY round(list_cosine_similarity(r.h, t.h), 9) DESC, t.term) AS k FROM r, t)
SELECT f.raw, coalesce(f.term, n.term) AS term, coalesce(f.step, CASE WHEN n.term IS NOT NULL THEN 3 ELSE 4 END) AS step FROM f LEFT JOIN (SELECT * FROM n WHERE k = 1 AND s > 0.82) n ON n.raw = f.raw""")
def industry_resolution(spark, d):
    """Each different industry as typed: by key, by alias, by the nearest name, or not at all."""
    values = load(spark, d, "company_signal", F.col("industry_raw").alias("raw"))
    return vo.resolve_industries(values, load(spark, d, "canonical_term").where("kind = 'industry'").select("term", "aliases")).select("raw", "term", "step")


@query(f"""SELECT family, list_sort(list(DISTINCT v)) AS spellings, count(*) AS n FROM (SELECT v, regexp_replace({KEY.format('v')}, '([a-z])[0-9]+$', '\\1') AS family FROM (SELECT unnest(technologies) AS v FROM company_signal) WHERE v IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT v) > 1 AND family <> ''""")
def spelling_splits(spark, d):
    """Technologies in use that are spelt in several ways."""
    return vo.spelling_splits(load(spark, d, "company_signal", "technologies"), "technologies")


_CORPUS = " UNION ALL ".join(f"SELECT DISTINCT {_PLACE.format('hq_' + k)} AS alias, {_PLACE.format('hq_' + k)} AS canonical, '{k}' AS kind, {n} AS priority FROM lead_company WHERE active AND trim(hq_{k}) <> ''" for n, k in enumerate(("country", "city", "state"), 1))
_NAMES = "SELECT term AS a, term FROM canonical_term WHERE kind = 'state' UNION ALL SELECT unnest(aliases) AS a, term FROM canonical_term WHERE kind = 'state'"


@query(f"""SELECT alias, canonical, kind FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY priority, canonical) AS n FROM ({_CORPUS}
UNION ALL SELECT {_PLACE.format('a')} AS alias, {_PLACE.format('term')} AS canonical, 'state' AS kind, 4 AS priority FROM ({_NAMES}) WHERE trim(a) <> ''
UNION ALL SELECT {_PLACE.format("replace(a, '.', '')")}, {_PLACE.format('term')}, 'state', 4 FROM ({_NAMES}) WHERE contains(a, '.') AND trim(replace(a, '.', '')) <> '')) WHERE n = 1""")
def place_vocabulary(spark, d):
    """Spellings of places with and without full stops; what the rows themselves hold always stands for itself."""
    rows, states = load(spark, d, "lead_company", "active", "hq_country", "hq_city", "hq_state").where("active"), load(spark, d, "canonical_term").where("kind = 'state'")
    names = states.select(F.col("term").alias("alias"), "term").unionByName(states.select(F.explode("aliases").alias("alias"), "term"))
    part = lambda df, a, c, kind, n: df.select(place_key(a).alias("alias"), place_key(c).alias("canonical"), F.lit(kind).alias("kind"), F.lit(n).alias("priority")).where("alias <> ''")
    every = part(vo.dotless(names), "alias", "term", "state", 4)
    for n, kind in enumerate(("country", "city", "state"), 1):
        every = every.unionByName(part(rows.select(f"hq_{kind}").distinct(), f"hq_{kind}", f"hq_{kind}", kind, n))
    return vo.priority_aliases(every.distinct())


_RAW = "list_concat(list_concat(coalesce(technologies, []), coalesce(scraped_technologies, [])), coalesce(scraped_tools, []))"


@query(f"""SELECT s.id, coalesce(l.technologies, []) AS technologies FROM lead_company s LEFT JOIN (SELECT id, list(term ORDER BY place) AS technologies FROM (
  SELECT id, term, min(place) AS place FROM (SELECT id, unnest({_RAW}) AS raw, generate_subscripts({_RAW}, 1) AS place FROM lead_company) e JOIN ({keys_sql(TECH)}) k ON k.key = {KEY.format('raw')} GROUP BY 1, 2) GROUP BY 1) l USING (id)""")
def template_technologies(spark, d):
    """The technologies of a company's own sentence: its curated ones, then those that were found, as canonical terms; services are none."""
    rows = load(spark, d, "lead_company", "id", "technologies", "scraped_technologies", "scraped_tools")
    none = F.array().cast("array<string>")
    united = rows.select("id", F.concat(*[F.coalesce(c, none) for c in ("technologies", "scraped_technologies", "scraped_tools")]).alias("technologies"))
    return vo.canonical_arrays(united, "id", "technologies", _tech(spark, d))


# ---- the model boundary ----------------------------------------------------------------------------


@query(f"SELECT term_id, list_transform(h, lambda x: round(x / CASE WHEN list_sum(list_transform(h, lambda y: y * y)) > 0 THEN sqrt(list_sum(list_transform(h, lambda y: y * y))) ELSE 1 END, 9)) AS vec FROM (SELECT term_id, {_hashed('term')} AS h FROM canonical_term)")
def embedded_terms(spark, d):
    """Vectors of the vocabulary, in batches."""
    return bo.embed(load(spark, d, "canonical_term", "term_id", "term"), "term_id", "term").select("term_id", F.transform("vec", lambda x: F.round(x, 9)).alias("vec"))


_RULES = lambda c, rules: "CASE " + " ".join(f"WHEN regexp_matches(coalesce({c}, ''), '(?is){x}') THEN '{n}'" for n, x in rules) + " ELSE 'UNKNOWN' END"


@query(f"SELECT id, {_RULES('description', bo.INITIATIVES).replace('(?is)', '(?i)')} AS initiative, {_RULES('title', bo.TITLE_LEVELS)} AS seniority, CASE upper(coalesce(type, '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bo.ENGAGEMENTS.items()) + " ELSE 'UNKNOWN' END AS engagement_type FROM lead_company_job")
def rule_fields(spark, d):
    """Fields of every posting by rules alone."""
    rows = load(spark, d, "lead_company_job", "id", "title", "description", "type")
    return rows.select("id", *[c.alias(n) for n, c in bo.rule_fields("title", "description", "type").items()])


# ---- texts and checks ------------------------------------------------------------------------------


@query("SELECT id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9+#./-]*'))) AS tokens, regexp_replace(lower(trim(coalesce(title, ''))), '\\s+', ' ', 'g') AS query_key FROM lead_company_job")
def title_tokens(spark, d):
    """Tokens as technologies are written, and the key by which retyped queries are the same."""
    return load(spark, d, "lead_company_job", "id", "title").select("id", F.array_sort(term_tokens("title")).alias("tokens"), query_key("title").alias("query_key"))


_PARENTS = {"lead_company": "id", "lead_contact": "id", "company_canonical": "canonical_id", "lead_company_job": "id", "job_signal": "job_id", "documents": "doc_id"}


@query("SELECT table_name AS kind, count(*) AS n_rows, count(k) AS n_found FROM deletion_log LEFT JOIN (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, {k} AS k FROM {t}" for t, k in _PARENTS.items()) + ") ON t = table_name AND k = key_id GROUP BY 1")
def polymorphic_references(spark, d):
    """References whose table the row itself names: logged deletions whose key exists again."""
    return q.polymorphic(load(spark, d, "deletion_log", "table_name", "key_id"), "table_name", "key_id", {t: (load(spark, d, t, k), k) for t, k in _PARENTS.items()})


@query("SELECT DISTINCT job_id FROM retrieval WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT job_id FROM job_signal)")
def stale_labels(spark, d):
    """Judged postings that exist no more."""
    return q.stale_labels(load(spark, d, "retrieval", "job_id"), load(spark, d, "job_signal", "job_id"), "job_id")


_TABLES = {"lead_company": ("id", "domain", "industry", "hq_city", "hq_state", "employee_count", "revenue_usd", "source", "updated_at"), "company_signal": ("company_id", "paraphrase", "industry_raw", "industry_canonical", "embedding"), "job_signal": ("job_id", "company_id", "confidence", "title_norm", "embedding", "posted_date"), "lead_contact": ("id", "title", "department", "seniority"), "documents": ("doc_id", "text", "lang", "company_domain", "kind")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_filled FROM {t}" for t, cols in _TABLES.items() for c in cols))
def completeness_of_tables(spark, d):
    """Filled values of the columns that matter, one pass over each table."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [q.completeness(load(spark, d, t, *cols), t) for t, cols in _TABLES.items()])


@query("""SELECT canonical_id, len(list_distinct(member_ids)) AS n_members, n_shared FROM (SELECT c.canonical_id, c.member_ids, count(DISTINCT l.id) FILTER (l.tenant_id IS NULL) AS n_shared FROM company_canonical c LEFT JOIN lead_company l ON list_contains(c.member_ids, l.id) GROUP BY ALL) ORDER BY n_members DESC, canonical_id LIMIT 5""")
def largest_entities(spark, d):
    """Report: the five entities of most members, and how many of these are shared rows."""
    rows = load(spark, d, "lead_company", "id", "tenant_id").where("tenant_id IS NULL").select("id", F.lit(1).alias("shared")).distinct()
    each = load(spark, d, "company_canonical", "canonical_id", "member_ids").select("canonical_id", F.explode("member_ids").alias("id")).distinct().join(rows, "id", "left")
    by = each.groupBy("canonical_id").agg(F.count("*").alias("n_members"), F.count("shared").alias("n_shared"))
    return by.orderBy(F.desc("n_members"), "canonical_id").limit(5)


@query("SELECT id, strftime(posted_date AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin', '%Y-%m-%d %H:%M') AS shown FROM lead_company_job")
def local_times(spark, d):
    """Times are kept in UTC and shown in a reader's zone."""
    return load(spark, d, "lead_company_job", "id", "posted_date").select("id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Berlin"), "posted_date"), "yyyy-MM-dd HH:mm").alias("shown"))


# ---- the front door --------------------------------------------------------------------------------

ASKED = "Companies using Nimbrel Insight, hiring for Quorvex Warehouse, not Inkstone, under $5bn revenue"
_PARSED = Chips(terms=(Group(("Quorvex Warehouse",), "HIRING"), Group(("Nimbrel Insight",), "USES"), Group(("Inkstone",), "HIRING", True)), max_revenue_usd=5_000_000_000.0)
_KEPT = "SELECT c.canonical_id AS company_id FROM company_canonical c JOIN lead_company l ON l.id = c.canonical_id WHERE revenue_usd <= 5000000000 AND c.canonical_id NOT IN (SELECT company_id FROM job_signal WHERE list_contains(technologies, 'Inkstone') AND company_id IS NOT NULL)"


@query(f"SELECT company_id, round(score, 6) AS score, round(coverage, 6) AS coverage FROM ({_scored_sql(_PARSED, _KEPT)}) ORDER BY score DESC, company_id LIMIT 20")
def ask_companies(spark: SparkSession, d: str) -> DataFrame:
    """A question in words, from parsing to the ranked companies."""
    found = answer(Tables(spark, d), ASKED, Vocabulary.read(spark, d), now(), vector=asking(spark, d))
    return found.companies.select("company_id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))
