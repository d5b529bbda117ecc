"""Queries of the table operators: scans, sinks, joins, aggregates, vocabularies, roles and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket_bounds, contains_all, overlap, place_key, term_key, title_norm
from ..operators import fold as fo
from ..operators import ingest as ing
from ..operators import quality as q
from ..operators import roles as ro
from ..operators import vocabulary as vo
from ..operators.retrieve import best_per
from ..sources.tables import load
from ..streaming.events import windowed_counts
from .engine_queries import census_sql, role_sql

VERSION, MODEL = "job-v4", "extract-a"
TECH = "(SELECT * FROM canonical_term WHERE kind = 'technology')"
KEY = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"
DOMAIN = "regexp_replace(regexp_replace(lower(trim(domain)), '^https?://', ''), '/.*$', '')"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tech(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "canonical_term", "term", "aliases", "kind").where("kind = 'technology'").select("term", "aliases")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lead_company", "id", "active", "tenant_id", "domain").where(F.col("active") & ~F.col("domain").like("%.example"))
    return rows.select("id", "tenant_id", fo.domain_key("domain").alias("key"))


_FOLD = f"""SELECT coalesce(min(id) FILTER (tenant_id IS NULL), min(id)) AS canonical_id, key, list_sort(list(DISTINCT id)) AS member_ids
FROM (SELECT id, tenant_id, {DOMAIN} AS key FROM lead_company WHERE active AND domain NOT LIKE '%.example') GROUP BY key, CASE WHEN key = '' THEN id END"""


@query(_FOLD)
def fold_companies(spark, d):
    """Rows of one domain as one entity."""
    return fo.fold(_keyed(spark, d))


@query(f"SELECT count(*) AS n_entities, sum(len(member_ids))::BIGINT AS n_rows, count(*) FILTER (len(member_ids) > 1) AS n_multi, sum(len(member_ids) - 1)::BIGINT AS n_collapsed FROM ({_FOLD})")
def fold_statistics(spark, d):
    return fo.fold_stats(fo.fold(_keyed(spark, d)))


@query("SELECT DISTINCT canonical_id, unnest(member_ids) AS id FROM company_canonical")
def member_map(spark, d):
    return fo.members(load(spark, d, "company_canonical", "canonical_id", "member_ids"))


@query("""WITH m AS (SELECT DISTINCT canonical_id, unnest(member_ids) AS id FROM company_canonical), r AS (SELECT m.canonical_id, l.* FROM m JOIN lead_company l USING (id))
SELECT canonical_id, coalesce(list_sort(list_distinct(flatten(list(technologies)))), []) AS technologies, coalesce(list_sort(list_distinct(flatten(list(scraped_tools)))), []) AS scraped_tools FROM r GROUP BY 1""")
def member_array_unions(spark, d):
    """Each array of all members of an entity, united."""
    out = fo.member_unions(load(spark, d, "company_canonical", "canonical_id", "member_ids"), load(spark, d, "lead_company", "id", "technologies", "scraped_tools"), ("technologies", "scraped_tools"))
    return out.select("canonical_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("technologies", "scraped_tools")])


# ---- incremental scans and sinks -------------------------------------------------------------------


@query(f"""SELECT j.id FROM lead_company_job j WHERE j.active AND length(j.description) > 200 AND j.lead_company_id IN (SELECT id FROM lead_company WHERE active)
AND NOT EXISTS (SELECT 1 FROM job_signal s WHERE s.job_id = j.id AND s.prompt_version = '{VERSION}' AND s.model = '{MODEL}')""")
def pending_jobs(spark, d):
    """Postings that this version and model still have to read."""
    jobs, firms = load(spark, d, "lead_company_job", "id", "lead_company_id", "active", "description"), load(spark, d, "lead_company", "id", "active")
    return ing.pending_jobs(jobs, firms, load(spark, d, "job_signal", "job_id", "prompt_version", "model"), prompt_version=VERSION, model=MODEL).select("id")


@query("""SELECT c.canonical_id FROM company_canonical c WHERE EXISTS (SELECT 1 FROM lead_company_job j WHERE list_contains(c.member_ids, j.lead_company_id) AND j.active AND length(j.description) > 200)
AND NOT EXISTS (SELECT 1 FROM company_signal s WHERE s.company_id = c.canonical_id AND s.prompt_version = 'company-v2')""")
def pending_companies(spark, d):
    """Companies with a posting that has text, without a row of this version; membership joins by exploded ids."""
    canon = load(spark, d, "company_canonical", "canonical_id", "member_ids")
    texts = load(spark, d, "lead_company_job", "lead_company_id", "active", "description").where("active AND length(description) > 200").select(F.col("lead_company_id").alias("id"))
    bearing = fo.members(canon).join(texts, "id", "left_semi").select("canonical_id").distinct()
    done = load(spark, d, "company_signal", "company_id", "prompt_version").where("prompt_version = 'company-v2'").select(F.col("company_id").alias("canonical_id"))
    return ing.pending(bearing, done, ["canonical_id"])


@query("SELECT c.canonical_id FROM company_canonical c ANTI JOIN company_signal s ON s.company_id = c.canonical_id")
def template_scan(spark, d):
    """Companies without a signal row of any version."""
    return ing.pending(load(spark, d, "company_canonical", "canonical_id"), load(spark, d, "company_signal", F.col("company_id").alias("canonical_id")), ["canonical_id"])


@query("""SELECT id, CASE WHEN subject = '' THEN 'Company' ELSE subject || ' company' END || CASE WHEN place = '' THEN '' ELSE ' in ' || place END
  || CASE len(t) WHEN 0 THEN '' WHEN 1 THEN ' running ' || t[1] ELSE ' running ' || array_to_string(t[:-2], ', ') || ' and ' || t[-1] END || '.' AS paraphrase
FROM (SELECT id, coalesce(nullif(trim(industry), ''), '') AS subject, list_slice(list_filter(coalesce(technologies, []), lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 150) AS t,
  array_to_string(list_filter([nullif(trim(hq_city), ''), CASE WHEN lower(trim(hq_state)) IS DISTINCT FROM lower(trim(hq_city)) THEN nullif(trim(hq_state), '') END,
    CASE WHEN lower(trim(hq_country)) IS DISTINCT FROM lower(trim(hq_city)) AND lower(trim(hq_country)) IS DISTINCT FROM lower(trim(hq_state)) THEN nullif(trim(hq_country), '') END], lambda x: x IS NOT NULL), ', ') AS place FROM lead_company)""")
def template_sentences(spark, d):
    """The sentence of a company's own fields; missing ones are not mentioned."""
    c = F.col
    none = F.lit(None).cast("bigint")
    said = ing.template_paraphrase(c("industry"), none, none, c("hq_city"), c("hq_state"), c("hq_country"), c("technologies"))
    return load(spark, d, "lead_company", "id", "industry", "hq_city", "hq_state", "hq_country", "technologies").select("id", said.alias("paraphrase"))


_SIZED = "CASE WHEN regexp_matches({0}, '^\\d+(\\.\\d+)?k') THEN round(1000 * CAST(regexp_extract({0}, '^(\\d+(?:\\.\\d+)?)k', 1) AS DOUBLE))::BIGINT WHEN regexp_matches({0}, '^\\d+($|\\s*-|\\+)') THEN try_cast(regexp_extract({0}, '^(\\d+)', 1) AS BIGINT) END"
_MOST = "CASE WHEN regexp_matches({0}, '^\\d+(\\.\\d+)?k') THEN round(1000 * CAST(regexp_extract({0}, '^(\\d+(?:\\.\\d+)?)k', 1) AS DOUBLE))::BIGINT WHEN regexp_matches({0}, '^\\d+$') THEN try_cast({0} AS BIGINT) WHEN regexp_matches({0}, '^\\d+\\s*-') THEN try_cast(regexp_extract({0}, '^\\d+\\s*-(\\d+)', 1) AS BIGINT) END"
_WORDED = f"""SELECT id, CASE WHEN n IS NULL THEN '' WHEN n <= 500 THEN 'Small ' WHEN n <= 1000 THEN 'Mid-size ' WHEN n <= 10000 THEN 'Large ' ELSE 'Enterprise ' END AS size FROM (
  SELECT id, CASE WHEN {_SIZED.format('c')} IS NULL THEN coalesce({_MOST.format('r')}, {_SIZED.format('r')}) ELSE coalesce({_MOST.format('c')}, {_SIZED.format('c')}) END AS n
  FROM (SELECT id, trim(replace(lower(employee_count), ',', '')) AS c, trim(replace(lower(employee_range), ',', '')) AS r FROM lead_company))"""


@query(f"SELECT id, CASE WHEN size <> '' AND starts_with(paraphrase, 'Company') AND coalesce(trim(industry), '') = '' THEN size || 'company' || substr(paraphrase, 8) ELSE size || paraphrase END AS paraphrase FROM ({SQL['template_sentences']}) JOIN ({_WORDED}) USING (id) JOIN (SELECT id, industry FROM lead_company) USING (id)")
def sized_sentences(spark, d):
    """``template_sentences`` with the word for the company's size; the range speaks where the count states none."""
    c = F.col
    (low, high), (least, most) = bucket_bounds("employee_count"), bucket_bounds("employee_range")
    said = ing.template_paraphrase(c("industry"), F.coalesce(low, least), F.when(low.isNull(), most).otherwise(high), c("hq_city"), c("hq_state"), c("hq_country"), c("technologies"))
    return load(spark, d, "lead_company", "id", "industry", "hq_city", "hq_state", "hq_country", "technologies", "employee_count", "employee_range").select("id", said.alias("paraphrase"))


_NEW = "SELECT id + 100000 * (id % 2) AS id, lower(title) AS title, department FROM lead_contact WHERE id % 3 = 0"


def _new_contacts(spark, d):
    return load(spark, d, "lead_contact", "id", "title", "department").where("id % 3 = 0").select((F.col("id") + 100000 * (F.col("id") % 2)).alias("id"), F.lower("title").alias("title"), "department")


@query(f"SELECT id, title, department FROM lead_contact WHERE id NOT IN (SELECT id FROM ({_NEW})) UNION ALL {_NEW}")
def upsert_rows(spark, d):
    """A table after rows replaced theirs by key, and new ones came."""
    return ing.upsert(load(spark, d, "lead_contact", "id", "title", "department"), _new_contacts(spark, d), ["id"])


@query("""SELECT job_id, intent FROM job_intent WHERE job_id NOT IN (SELECT job_id FROM job_signal WHERE function = 'ERP')
UNION ALL SELECT job_id, 'new ' || paraphrase AS intent FROM job_signal WHERE function = 'ERP' AND seniority = 'SENIOR'""")
def replace_intent_sets(spark, d):
    """Sets of a batch of postings replaced; those that have nothing new become empty."""
    jobs = load(spark, d, "job_signal", "job_id", "function", "seniority", "paraphrase").where("function = 'ERP'")
    new = jobs.where("seniority = 'SENIOR'").select("job_id", F.concat(F.lit("new "), "paraphrase").alias("intent"))
    return ing.replace_sets(load(spark, d, "job_intent", "job_id", "intent"), new, jobs, ["job_id"])


@query(f"""SELECT coalesce(a.term, b.term) AS term, list_sort(list_distinct(list_concat(coalesce(a.aliases, []), coalesce(b.aliases, [])))) AS aliases
FROM {TECH} a FULL JOIN (SELECT upper(term) AS u, term, [lower(term), term] AS aliases FROM {TECH} WHERE term_id % 2 = 0 UNION ALL SELECT 'X', 'Xylo', ['xy']) b ON a.term = b.term""")
def merge_vocabulary(spark, d):
    """Terms with the union of their old and new aliases."""
    t = load(spark, d, "canonical_term").where("kind = 'technology'")
    vec = F.lit(None).cast("array<float>").alias("embedding")
    new = t.where("term_id % 2 = 0").select("term", F.array(F.lower("term"), "term").alias("aliases"), vec)
    new = new.unionByName(spark.createDataFrame([("Xylo", ["xy"])], "term string, aliases array<string>").select("*", vec))
    return ing.merge_terms(t.select("term", "aliases", vec), new).select("term", "aliases")


@query("SELECT initiative, count(*) * 2 AS n FROM job_signal GROUP BY 1")
def counted_up(spark, d):
    """A counter per key after the same rows came once more."""
    jobs = load(spark, d, "job_signal", "initiative")
    return ing.count_up(jobs.groupBy("initiative").agg(F.count("*").alias("n")), jobs, "initiative", "n")


@query("SELECT j.job_id, CASE WHEN s.id IS NOT NULL THEN s.department ELSE j.function END AS function FROM job_signal j LEFT JOIN lead_company_job s ON s.id = j.job_id AND s.active")
def update_columns(spark, d):
    new = load(spark, d, "lead_company_job", "id", "active", "department").where("active").select(F.col("id").alias("job_id"), F.col("department").alias("function"))
    return ing.update_by_key(load(spark, d, "job_signal", "job_id", "function"), new, "job_id", ["function"])


@query("SELECT id FROM lead_contact WHERE id NOT IN (SELECT key_id FROM deletion_log WHERE table_name = 'lead_contact')")
def delete_by_key(spark, d):
    gone = load(spark, d, "deletion_log").where("table_name = 'lead_contact'").select(F.col("key_id").alias("id"))
    return ing.delete_keys(load(spark, d, "lead_contact", "id"), gone, ["id"])


@query("SELECT DISTINCT id AS source_id, 'not an object' AS error, substr(data, 1, 8000) AS raw_response FROM apollo_company_data WHERE data IS NOT NULL AND NOT json_valid(data)")
def dead_letters(spark, d):
    """Rows that cannot be read go aside with their error."""
    rows = load(spark, d, "apollo_company_data", "id", "data").where("data IS NOT NULL")
    bad = F.when(F.expr("try_parse_json(data)").isNull(), F.lit("not an object"))
    return ing.split_failures(rows, bad, F.col("data"), "id")[1].distinct()


# ---- vocabularies ----------------------------------------------------------------------------------

_KEYS = f"""SELECT key, arg_min(term, step::VARCHAR || term) AS term, min(step) AS step FROM (SELECT {KEY.format('term')} AS key, term, 1 AS step FROM {TECH}
UNION ALL SELECT {KEY.format('a')} AS key, term, 2 AS step FROM (SELECT term, unnest(aliases) AS a FROM {TECH})) WHERE key <> '' GROUP BY 1"""


@query(f"SELECT raw, k.term, coalesce(k.step, 4) AS step FROM (SELECT DISTINCT unnest(technologies) AS raw FROM company_signal) v LEFT JOIN ({_KEYS}) k ON k.key = {KEY.format('raw')} WHERE raw IS NOT NULL")
def technology_ladder(spark, d):
    """Each different technology by exact key, alias, or not at all."""
    values = load(spark, d, "company_signal", "technologies").select(F.explode("technologies").alias("raw"))
    return vo.resolve(values, _tech(spark, d)).select("raw", "term", "step")


@query(f"""SELECT s.company_id, coalesce(l.technologies, []) AS technologies FROM company_signal s LEFT JOIN (SELECT company_id, list(term ORDER BY place) AS technologies FROM (
  SELECT company_id, term, min(place) AS place FROM (SELECT company_id, unnest(technologies) AS raw, generate_subscripts(technologies, 1) AS place FROM company_signal) e JOIN ({_KEYS}) k ON k.key = {KEY.format('raw')} GROUP BY 1, 2) GROUP BY 1) l USING (company_id)""")
def canonical_technologies(spark, d):
    """Stored arrays as canonical terms, in their order."""
    out = vo.canonical_arrays(load(spark, d, "company_signal", "company_id", "technologies"), "company_id", "technologies", _tech(spark, d))
    return out.withColumnRenamed("id", "company_id")


@query(f"SELECT raw AS raw_term, count(*) AS occurrences FROM (SELECT unnest(technologies) AS raw FROM company_signal) WHERE raw IS NOT NULL AND {KEY.format('raw')} NOT IN (SELECT key FROM ({_KEYS})) GROUP BY 1")
def technology_review(spark, d):
    return vo.review_queue(load(spark, d, "company_signal", "technologies"), "technologies", _tech(spark, d))


_BAD = f"(SELECT term, aliases FROM {TECH} UNION ALL SELECT 'Wide', ['ink-stone', 'wide one'])"


@query(f"SELECT t.term, o.term AS owner, o.a AS alias FROM {_BAD} t JOIN (SELECT term, unnest(aliases) AS a FROM {_BAD}) o ON {KEY.format('t.term')} = {KEY.format('o.a')} AND t.term <> o.term")
def vocabulary_collisions(spark, d):
    """Terms that are another term's alias, after a bad entry came in."""
    bad = spark.createDataFrame([("Wide", ["ink-stone", "wide one"])], "term string, aliases array<string>")
    return vo.collisions(_tech(spark, d).unionByName(bad))


@query(f"""WITH v AS {_BAD}, dcl AS (SELECT 'ink-stone' AS alias, 'Inkstone' AS term), e AS (SELECT term, unnest(aliases) AS a FROM v)
SELECT v.term, coalesce(list_sort(l.aliases), []) AS aliases FROM v LEFT JOIN (SELECT term, list(DISTINCT a) AS aliases FROM (SELECT e.term, a FROM e WHERE NOT EXISTS (SELECT 1 FROM dcl WHERE {KEY.format('dcl.alias')} = {KEY.format('e.a')} AND dcl.term <> e.term) UNION ALL SELECT term, alias FROM dcl) GROUP BY 1) l USING (term)
WHERE NOT EXISTS (SELECT 1 FROM dcl WHERE {KEY.format('dcl.alias')} = {KEY.format('v.term')} AND dcl.term <> v.term)""")
def reconciled_vocabulary(spark, d):
    """The vocabulary after a declared owner took an alias back."""
    bad = spark.createDataFrame([("Wide", ["ink-stone", "wide one"])], "term string, aliases array<string>")
    return vo.reconcile(_tech(spark, d).unionByName(bad), spark.createDataFrame([("ink-stone", "Inkstone")], "alias string, term string"))


@query(f"""WITH n AS (SELECT DISTINCT raw, {KEY.format('raw')} AS key FROM (SELECT unnest(technologies) AS raw FROM lead_company) WHERE raw IS NOT NULL)
SELECT term, aliases FROM (SELECT term, coalesce(aliases, []) AS aliases FROM {TECH} WHERE term_id % 2 = 0) UNION ALL
SELECT min(raw), [] FROM n WHERE key NOT IN (SELECT {KEY.format('term')} FROM {TECH} WHERE term_id % 2 = 0 UNION SELECT {KEY.format('a')} FROM (SELECT unnest(aliases) AS a FROM {TECH} WHERE term_id % 2 = 0)) GROUP BY key""")
def seeded_vocabulary(spark, d):
    """A hand-made half of the vocabulary and what the corpus adds to it."""
    hand = load(spark, d, "canonical_term").where("kind = 'technology' AND term_id % 2 = 0").select("term", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return vo.seed(hand, load(spark, d, "lead_company", "technologies").select(F.explode("technologies").alias("raw")))


_PLACE = r"regexp_replace(lower(trim({})), '\s+', ' ', 'g')"


@query(f"""SELECT alias, canonical, kind FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY priority, canonical) AS n FROM (
  SELECT DISTINCT {_PLACE.format('hq_city')} AS alias, {_PLACE.format('hq_city')} AS canonical, 'city' AS kind, 2 AS priority FROM lead_company WHERE hq_city IS NOT NULL
  UNION ALL SELECT {_PLACE.format('term')}, {_PLACE.format('term')}, 'state', 1 FROM canonical_term WHERE kind = 'state'
  UNION ALL SELECT {_PLACE.format('a')}, {_PLACE.format('term')}, 'state', 1 FROM (SELECT term, unnest(aliases) AS a FROM canonical_term WHERE kind = 'state')
  UNION ALL SELECT DISTINCT {_PLACE.format('hq_country')}, {_PLACE.format('hq_country')}, 'country', 3 FROM lead_company WHERE hq_country IS NOT NULL)) WHERE n = 1""")
def place_aliases(spark, d):
    """Spellings of places: states before cities before countries."""
    rows, states = load(spark, d, "lead_company", "hq_city", "hq_country"), load(spark, d, "canonical_term").where("kind = 'state'")
    part = lambda df, a, c, kind, n: df.select(place_key(a).alias("alias"), place_key(c).alias("canonical"), F.lit(kind).alias("kind"), F.lit(n).alias("priority")).where("alias IS NOT NULL")
    every = part(rows, "hq_city", "hq_city", "city", 2).unionByName(part(states, "term", "term", "state", 1)).unionByName(part(states.select("term", F.explode("aliases").alias("a")), "a", "term", "state", 1)).unionByName(part(rows, "hq_country", "hq_country", "country", 3))
    return vo.priority_aliases(every.distinct())


_USABLE = "{0}.embedding IS NOT NULL AND len(list_filter({0}.embedding, lambda x: x <> 0)) > 0"


@query(f"""SELECT raw, term, round(similarity, 6) AS similarity FROM (SELECT s.job_id AS raw, t.company_id::VARCHAR AS term, round(list_cosine_similarity(s.embedding::DOUBLE[], t.embedding::DOUBLE[]), 9) AS similarity,
  row_number() OVER (PARTITION BY s.job_id ORDER BY round(list_cosine_similarity(s.embedding::DOUBLE[], t.embedding::DOUBLE[]), 9) DESC, t.company_id::VARCHAR) AS n
FROM job_signal s, company_signal t WHERE {_USABLE.format('s')} AND {_USABLE.format('t')}) WHERE n = 1""")
def nearest_companies(spark, d):
    """The nearest of all company vectors for every posting."""
    terms = load(spark, d, "company_signal", F.col("company_id").cast("string").alias("term"), F.col("embedding").alias("vec"))
    values = load(spark, d, "job_signal", F.col("job_id").alias("raw"), F.col("embedding").alias("vec"))
    return vo.nearest_of_many(values, terms).select("raw", "term", F.round("similarity", 6).alias("similarity"))


# ---- roles -----------------------------------------------------------------------------------------


@query(f"SELECT id, role, level FROM ({role_sql('lead_contact')})")
def role_classes(spark, d):
    """Function and seniority of every contact's title."""
    return load(spark, d, "lead_contact", "id", "title", "department", "seniority").select("id", ro.function_of(F.col("title"), F.col("department")).alias("role"), ro.seniority_of(F.col("title"), F.col("seniority")).alias("level"))


@query("SELECT id, lead_contact_id FROM (SELECT *, row_number() OVER (PARTITION BY lead_contact_id ORDER BY fetched_at DESC NULLS LAST, id DESC) AS n FROM apollo_contact_data WHERE data LIKE '%employment_history%' AND lead_contact_id IS NOT NULL) WHERE n = 1")
def latest_blobs(spark, d):
    return ro.latest_history(load(spark, d, "apollo_contact_data", "id", "lead_contact_id", "fetched_at", "data"), "lead_contact_id").select("id", "lead_contact_id")


_BLOBS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_contact_id ORDER BY fetched_at DESC NULLS LAST, id DESC) AS n FROM apollo_contact_data WHERE data LIKE '%employment_history%' AND lead_contact_id IS NOT NULL) WHERE n = 1"
_HISTORY = f"""SELECT lead_contact_id, trim(list_filter(jobs, lambda j: NOT coalesce(j.current, false) AND coalesce(regexp_matches(j.organization_name, '(?i){ro.FORMER}'), false))[1].organization_name) AS prior_employer,
  list_filter(list_transform(list_filter(jobs, lambda j: coalesce(j.current, false)), lambda j: try_cast(substr(j.start_date, 1, 10) AS DATE)), lambda x: x IS NOT NULL)[1] AS landed_at
FROM (SELECT lead_contact_id, from_json(CASE WHEN json_valid(data) THEN json_extract(data, '$.employment_history') END, '[{{"organization_name": "VARCHAR", "current": "BOOLEAN", "start_date": "VARCHAR"}}]') AS jobs FROM ({_BLOBS}))"""


@query(_HISTORY)
def employment_history(spark, d):
    """Former employer of note and start of the current role."""
    former, landed = ro.history_of(F.col("data"))
    return ro.latest_history(load(spark, d, "apollo_contact_data", "id", "lead_contact_id", "fetched_at", "data"), "lead_contact_id").select("lead_contact_id", former.alias("prior_employer"), landed.alias("landed_at"))


@query(f"""SELECT company_id, contact_id, role, level, is_alum, census_text FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY list_position({list(ro.RANK)}, level), is_alum DESC, contact_id) AS n
FROM ({census_sql('prior_employer').replace("FROM (SELECT *", f"FROM (SELECT lead_contact.*, h.prior_employer", 1).replace("FROM lead_contact)", f"FROM lead_contact LEFT JOIN ({_HISTORY}) h ON h.lead_contact_id = lead_contact.id WHERE active)", 1)})) WHERE n <= 5""")
def role_census(spark, d):
    """The five first contacts of each company with their sentence."""
    rows = ro.census(load(spark, d, "lead_contact"), load(spark, d, "company_canonical", "canonical_id", "member_ids"), load(spark, d, "apollo_contact_data", "id", "lead_contact_id", "fetched_at", "data"))
    return ro.top_roles(rows).select("company_id", "contact_id", "role", "level", "is_alum", "census_text")


@query("""WITH m AS (SELECT DISTINCT canonical_id AS company_id, unnest(member_ids) AS lead_company_id FROM company_canonical)
SELECT company_id, count(*) AS n FROM lead_contact JOIN m USING (lead_company_id) WHERE active AND seniority = 'manager' GROUP BY 1""")
def role_counts(spark, d):
    m = fo.members(load(spark, d, "company_canonical", "canonical_id", "member_ids")).select(F.col("canonical_id").alias("company_id"), F.col("id").alias("lead_company_id"))
    return load(spark, d, "lead_contact", "lead_company_id", "active", "seniority").where("active AND seniority = 'manager'").join(m, "lead_company_id").groupBy("company_id").agg(F.count("*").alias("n"))


# ---- reposts ---------------------------------------------------------------------------------------


@query("""SELECT j.job_id, EXISTS (SELECT 1 FROM job_signal e WHERE e.company_id = j.company_id AND e.title_norm = j.title_norm AND e.title_norm <> '' AND e.job_id <> j.job_id AND e.posted_date < j.posted_date AND e.posted_date >= j.posted_date - INTERVAL 90 DAY
  AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0 AND len(list_filter(j.embedding, lambda x: x <> 0)) > 0 AND round(list_cosine_similarity(j.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) > 0.95) AS is_repost FROM job_signal j""")
def mark_reposts(spark, d):
    """Postings that come again within 90 days under their title."""
    return ing.reposts(load(spark, d, "job_signal", "job_id", "company_id", "title_norm", "posted_date", "embedding"))


# ---- profiles and integrity ------------------------------------------------------------------------


@query("SELECT strftime(posted_date, '%Y-%m') AS month, count(*) AS n FROM lead_company_job WHERE posted_date IS NOT NULL GROUP BY 1")
def jobs_by_month(spark, d):
    return q.month_histogram(load(spark, d, "lead_company_job", "posted_date"), "posted_date")


@query("SELECT industry_canonical AS value, count(*) AS n FROM company_signal GROUP BY 1")
def industry_histogram(spark, d):
    return q.histogram(load(spark, d, "company_signal", "industry_canonical"), "industry_canonical")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(technologies) AS value FROM job_signal) GROUP BY 1")
def technology_histogram(spark, d):
    return q.element_histogram(load(spark, d, "job_signal", "technologies"), "technologies")


@query("""SELECT count(*) AS n, count(*) FILTER (active) AS n_active, count(*) FILTER (length(description) > 200) AS n_text, count(*) FILTER (len(technologies) > 0) AS n_tech, count(posted_date) AS n_dated,
CAST(round(avg(length(description))) AS INT) AS mean_length, count(DISTINCT lead_company_id) AS n_companies FROM lead_company_job""")
def job_profile(spark, d):
    rows = load(spark, d, "lead_company_job", "active", "description", "technologies", "posted_date", "lead_company_id")
    return rows.agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"), F.count_if(F.length("description") > 200).alias("n_text"), F.count_if(F.size("technologies") > 0).alias("n_tech"), F.count("posted_date").alias("n_dated"), F.round(F.avg(F.length("description"))).cast("int").alias("mean_length"), F.countDistinct("lead_company_id").alias("n_companies"))


@query("""SELECT field, share, CASE WHEN share >= floor THEN 'PASS' ELSE 'FAIL' END AS gate FROM (SELECT unnest(['industry', 'technologies', 'revenue']) AS field, unnest([round(avg((industry IS NOT NULL)::INT), 6), round(avg(coalesce(len(technologies) > 0, false)::INT), 6), round(avg((revenue_usd IS NOT NULL)::INT), 6)]) AS share, unnest([0.5, 0.3, 0.9]) AS floor FROM lead_company)""")
def profile_gates(spark, d):
    """Shares of filled fields against their floors."""
    one = load(spark, d, "lead_company", "industry", "technologies", "revenue_usd").agg(*[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(n) for n, c in (("industry", F.col("industry").isNotNull()), ("technologies", F.size("technologies") > 0), ("revenue", F.col("revenue_usd").isNotNull()))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("share"), F.lit(f).alias("floor")) for n, f in (("industry", 0.5), ("technologies", 0.3), ("revenue", 0.9))]))
    return one.select(each.alias("g")).select("g.field", "g.share", q.gate(F.col("g.share"), F.col("g.floor")).alias("gate"))


_CHECKS = (("lead_company_job", "lead_company_id", "lead_company", "id"), ("job_signal", "job_id", "lead_company_job", "id"), ("job_signal", "company_id", "company_canonical", "canonical_id"), ("job_intent", "job_id", "job_signal", "job_id"), ("job_intent", "company_id", "company_canonical", "canonical_id"), ("lead_contact", "lead_company_id", "lead_company", "id"), ("retrieval", "job_id", "job_signal", "job_id"), ("retrieval", "company_id", "company_signal", "company_id"), ("reading_label", "doc_id", "documents", "doc_id"))


@query(" UNION ALL ".join(f"SELECT '{t}.{r}' AS \"check\", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM {t} WHERE {r} IS NOT NULL AND {r} NOT IN (SELECT {k} FROM {p})) AS n_orphans" for t, r, p, k in _CHECKS))
def reference_integrity(spark, d):
    """References of every table that name no row."""
    return q.integrity([(f"{t}.{r}", load(spark, d, t, r), r, load(spark, d, p, k), k) for t, r, p, k in _CHECKS])


_FILLED = ("id", "title", "description", "department", "type", "skills", "technologies", "posted_date")


@query(" UNION ALL ".join(f"SELECT 'lead_company_job' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_filled FROM lead_company_job" for c in _FILLED))
def completeness(spark, d):
    return q.completeness(load(spark, d, "lead_company_job", *_FILLED), "lead_company_job")


_COUNTED = ("lead_company", "company_canonical", "company_signal", "job_signal", "job_intent", "canonical_term")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _COUNTED))
def health(spark, d):
    return q.table_counts([(t, load(spark, d, t)) for t in _COUNTED])


@query("SELECT count(DISTINCT company_id) AS n_companies, count(*) AS n_jobs, max(run_at) AS latest, count(*) FILTER (embedding IS NULL) AS n_unembedded, max(len(embedding)) AS dim FROM job_signal")
def signal_report(spark, d):
    rows = load(spark, d, "job_signal", "company_id", "run_at", "embedding")
    return rows.agg(F.countDistinct("company_id").alias("n_companies"), F.count("*").alias("n_jobs"), F.max("run_at").alias("latest"), F.count_if(F.col("embedding").isNull()).alias("n_unembedded"), F.max(F.size("embedding")).cast("bigint").alias("dim"))


@query("""SELECT count(*) FILTER (s.company_id IS NULL) AS n_missing, count(*) AS n_all FROM company_canonical c LEFT JOIN company_signal s ON s.company_id = c.canonical_id""")
def template_counts(spark, d):
    """Companies that no signal row exists for, by an outer join."""
    j = load(spark, d, "company_canonical", "canonical_id").join(load(spark, d, "company_signal", F.col("company_id").alias("canonical_id"), F.lit(True).alias("hit")), "canonical_id", "left")
    return j.agg(F.count_if(F.col("hit").isNull()).alias("n_missing"), F.count("*").alias("n_all"))


@query("SELECT job_id, list_sort(list(DISTINCT intent)) AS intents, array_to_string(list_sort(list(DISTINCT intent)), '; ') AS joined FROM job_intent GROUP BY 1")
def intents_per_job(spark, d):
    """Intents of each posting, as a list and as one text."""
    by = load(spark, d, "job_intent", "job_id", "intent").groupBy("job_id").agg(F.array_sort(F.collect_set("intent")).alias("intents"))
    return by.withColumn("joined", F.array_join("intents", "; "))


@query("SELECT id FROM lead_company WHERE list_has_all(coalesce(technologies, []), ['Nimbrel Insight']) AND NOT list_has_any(coalesce(segments, []), ['core'])")
def array_predicates(spark, d):
    rows = load(spark, d, "lead_company", "id", "technologies", "segments")
    return rows.where(contains_all("technologies", ["Nimbrel Insight"]) & ~overlap("segments", ["core"])).select("id")


@query(f"SELECT id, lower(trim(coalesce(title, ''))) AS title_norm, {KEY.format('title')} AS key FROM lead_company_job")
def title_keys(spark, d):
    return load(spark, d, "lead_company_job", "id", "title").select("id", title_norm("title").alias("title_norm"), term_key("title").alias("key"))


@query("SELECT id FROM lead_company_job WHERE contains(lower(concat_ws(' ', title, description, department, location, array_to_string(skills, ' '), array_to_string(technologies, ' '))), 'nimbrel') AND contains(lower(concat_ws(' ', title, description)), 'contract')")
def keyword_search(spark, d):
    """The plain substring search over several columns, for contrast."""
    rows = load(spark, d, "lead_company_job", "id", "title", "description", "department", "location", "skills", "technologies")
    wide = F.lower(F.concat_ws(" ", "title", "description", "department", "location", F.array_join("skills", " "), F.array_join("technologies", " ")))
    return rows.where(wide.contains("nimbrel") & F.lower(F.concat_ws(" ", "title", "description")).contains("contract")).select("id")


@query("""SELECT id FROM lead_company l WHERE (tenant_id = 27) OR (tenant_id IS NULL AND NOT EXISTS (SELECT 1 FROM lead_company o WHERE o.tenant_id = 27 AND o.name = l.name))""")
def tenant_view(spark, d):
    """A tenant's own rows, and the shared ones that it has no copy of."""
    rows = load(spark, d, "lead_company", "id", "tenant_id", "name")
    own = rows.where("tenant_id = 27")
    return own.select("id").unionByName(rows.where("tenant_id IS NULL").join(own.select("name"), "name", "left_anti").select("id"))


@query("SELECT id, latest FROM (SELECT id, lead_company_id, created_at AS latest, row_number() OVER (PARTITION BY lead_company_id ORDER BY posted_date DESC NULLS LAST, id) AS n FROM lead_company_job) WHERE n <= 3")
def latest_per_company(spark, d):
    """The three latest postings of each company."""
    rows = load(spark, d, "lead_company_job", "id", "lead_company_id", "posted_date", F.col("created_at").alias("latest"))
    return best_per(rows, "lead_company_id", F.desc_nulls_last("posted_date"), F.asc("id"), n=3).select("id", "latest")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: event counts per day, by the plan that also runs as a stream."""
    out = windowed_counts(load(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
