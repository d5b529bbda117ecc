"""Queries of this package's operators, and SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import NO_VALUE
from ..sources.tables import load
from .containers import fill_containers, fill_report
from .mapping import map_fields
from .mixing import mix, mix_shares
from .nearcopies import similar_pairs, version_groups
from .ranking import rank_items
from .reading import reading_levels
from .survivor import claims, survivors
from .tokens import token_counts
from .vectors import neighbour_pairs, neighbours

# ---- 1: one ranking from several scores ------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    jobs = load(spark, d, "job_signal", "job_id", "confidence")
    return load(spark, d, "retrieval", "query_id", "company_id", "job_id", "fused", "best_doc").distinct().join(jobs, "job_id", "left")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The first ten companies of each query's ranking."""
    return rank_items(_candidates(spark, d), "query_id", "company_id", ("fused", "best_doc", "confidence"), top=10).select("query_id", "company_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All companies of each query with their closeness to the ideal point."""
    return rank_items(_candidates(spark, d), "query_id", "company_id", ("fused", "best_doc", "confidence")).withColumn("closeness", F.round("closeness", 6))


# ---- 3: near-duplicate records with small edits ----------------------------------------------------

#: The problem's own statement: three words, half of the runs, descriptions longer than 200 characters.
POSTINGS = {"id": "id", "text": "description", "run": 3, "at_least": 0.5, "longer_than": 200}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of postings that share at least half of their three-word runs."""
    pairs = similar_pairs(load(spark, d, "lead_company_job", "id", "description"), **POSTINGS)
    return pairs.select(F.col("id_a").alias("job_id_a"), F.col("id_b").alias("job_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each posting with its class of copies, its group of versions and its number of links."""
    groups = version_groups(load(spark, d, "lead_company_job", "id", "description"), **POSTINGS)
    return groups.withColumnRenamed("id", "job_id")


# ---- 4: free-entered values to a reference list ----------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each free value with the entry it names, 0 for none."""
    signals = load(spark, d, "company_signal", "company_id", "industry_raw", "technologies")
    states = load(spark, d, "lead_company", "id", "hq_state")
    fields = signals.select(F.lit("industry_raw").alias("field"), F.lit("industry").alias("kind"), F.col("company_id").alias("record_id"), F.col("industry_raw").alias("raw_value"))
    fields = fields.unionByName(signals.select(F.lit("technologies").alias("field"), F.lit("technology").alias("kind"), F.col("company_id").alias("record_id"), F.explode("technologies").alias("raw_value")))
    fields = fields.unionByName(states.select(F.lit("hq_state").alias("field"), F.lit("state").alias("kind"), F.col("id").alias("record_id"), F.col("hq_state").alias("raw_value")))
    return map_fields(fields, load(spark, d, "canonical_term"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that name no listed term, with the records that hold them."""
    return p4_found(spark, d).where("term_id = 0").groupBy("field", "raw_value").agg(F.count("*").alias("n_records"))


# ---- 6: most similar vectors for every vector -------------------------------------------------------

VECTORS = {"job_signal": ("job_id", "embedding"), "company_signal": ("company_id", "embedding"), "job_intent": ("id", "intent_embedding")}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which one is among the other's five nearest in the same column, from a cosine of 0.9."""
    parts = [neighbour_pairs(neighbours(load(spark, d, t, i, v), id=i, vector=v, k=5, at_least=0.9)).select(F.lit(t).alias("src_table"), "id_a", "id_b") for t, (i, v) in VECTORS.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- 7: best representative of each duplicate group ------------------------------------------------

FIELDS = ("industry", "hq_city", "hq_state")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lead_company", "id", "source", "updated_at", *FIELDS)
    c = claims(load(spark, d, "company_canonical", "canonical_id", "member_ids"), rows, entity="canonical_id", member_ids="member_ids", member="id", source="source", stamp="updated_at", fields=FIELDS)
    return c.where("n_members > 1")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Of each field the member whose value is kept by trust, then recency, then the posterior."""
    kept = survivors(_claims(spark, d), load(spark, d, "feed", "source", "trust"))
    return kept.select(F.col("entity").alias("canonical_id"), "field", F.col("member").alias("member_id"))


def p7_fused(spark: SparkSession, d: str) -> DataFrame:
    """Of each field the value with the highest posterior and the member that supplies its spelling."""
    kept = survivors(_claims(spark, d))
    return kept.select(F.col("entity").alias("canonical_id"), "field", F.col("member").alias("member_id"), "value", F.round("posterior", 6).alias("posterior"))


_P7_SQL = """
WITH m AS (SELECT DISTINCT c.canonical_id, l.* FROM (SELECT canonical_id, unnest(member_ids) AS id FROM company_canonical) c JOIN lead_company l ON l.id = c.id),
big AS (SELECT canonical_id FROM m GROUP BY 1 HAVING count(DISTINCT id) > 1),
v AS (SELECT canonical_id, id, updated_at, source, unnest(['industry', 'hq_city', 'hq_state']) AS field, unnest([industry, hq_city, hq_state]) AS value FROM m WHERE canonical_id IN (FROM big)),
k AS (SELECT v.*, row_number() OVER (PARTITION BY canonical_id, field ORDER BY coalesce(f.trust, 0) DESC, updated_at DESC NULLS LAST, v.id) AS n
  FROM v LEFT JOIN feed f ON f.source = v.source
  WHERE value IS NOT NULL AND regexp_matches(value, '[\\p{L}\\p{N}]') AND lower(trim(value)) NOT IN (""" + ", ".join(f"'{x}'" for x in sorted(NO_VALUE)) + """))
SELECT canonical_id, field, id AS member_id FROM k WHERE n = 1
"""

# ---- 8: filling containers -------------------------------------------------------------------------


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of each document in its container, for each capacity."""
    return fill_containers(token_counts(load(spark, d, "documents", "doc_id", "text"), id="doc_id", text="text"), load(spark, d, "container_spec")).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and space left by capacity."""
    return fill_report(p8_containers(spark, d))


# ---- 9: mixing sources -----------------------------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_counts(load(spark, d, "documents", "doc_id", "text", "source"), id="doc_id", text="text", keep=("source",))
    return mix(sizes, load(spark, d, "mix_target"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often the mix uses each document."""
    return _mixed(spark, d).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix_shares(_mixed(spark, d), load(spark, d, "mix_target"))


# ---- 10: reading level -----------------------------------------------------------------------------


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "reading_label"), id="doc_id", text="text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The band of each English document of at least 200 characters."""
    long = load(spark, d, "documents", "doc_id", "n_chars").where("n_chars >= 200").select(F.col("doc_id").alias("id"))
    return _levels(spark, d).where("lang = 'en'").join(long, "id", "left_semi").select(F.col("id").alias("doc_id"), "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, words and mean figures by language and band."""
    figures = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("unfamiliar", "sentence")]
    return _levels(spark, d).groupBy("lang", "band").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), *figures)


# ---- SQL -------------------------------------------------------------------------------------------

_PLACE = """CASE WHEN s{0} IS NULL OR q{0} IS NULL OR q{0}[1] = q{0}[65] THEN 0.5 WHEN u{0} > b{0} THEN (b{0} + u{0} - 1) / 2.0 / 64 WHEN b{0} = 0 THEN 0.0 WHEN b{0} > 64 THEN 1.0 ELSE (b{0} - 1 + (s{0} - q{0}[b{0}]) / (q{0}[b{0} + 1] - q{0}[b{0}])) / 64 END"""
_P1_CLOSE = f"""WITH r AS (SELECT DISTINCT query_id AS g, company_id AS i, fused AS s0, best_doc AS s1, confidence::DOUBLE AS s2 FROM (SELECT DISTINCT query_id, company_id, job_id, fused, best_doc FROM retrieval) LEFT JOIN (SELECT job_id, confidence FROM job_signal) USING (job_id) WHERE company_id IS NOT NULL),
q AS (SELECT g, {', '.join(f'quantile_disc(s{k}, {[i / 64 for i in range(65)]}) AS q{k}' for k in range(3))} FROM r GROUP BY 1),
c AS (SELECT r.*, {', '.join(f'q{k}, len(list_filter(q{k}, lambda x: x < s{k})) AS b{k}, len(list_filter(q{k}, lambda x: x <= s{k})) AS u{k}' for k in range(3))} FROM r JOIN q USING (g)),
p AS (SELECT g, i, {', '.join(f'greatest(0.01, least(0.99, {_PLACE.format(k)}))::DOUBLE AS p{k}' for k in range(3))} FROM c),
n AS (SELECT g, {', '.join(f'max(p{k}) AS h{k}, min(p{k}) AS l{k}, sqrt(sum(p{k} * p{k})) AS n{k}' for k in range(3))} FROM p GROUP BY 1),
d AS (SELECT g, i, sqrt({' + '.join(f'power((p{k} - h{k}) / n{k}, 2)' for k in range(3))}) AS near, sqrt({' + '.join(f'power((p{k} - l{k}) / n{k}, 2)' for k in range(3))}) AS away FROM p JOIN n USING (g)),
b AS (SELECT g, i, max(round(CASE WHEN near + away > 0 THEN away / (near + away) ELSE 0.5 END, 12)) AS c FROM d GROUP BY 1, 2)"""
_P1_SQL = f"{_P1_CLOSE} SELECT g AS query_id, i AS company_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, i) AS k FROM b) WHERE k <= 10"
_P1_RANKING = f"{_P1_CLOSE} SELECT g AS query_id, i AS company_id, round(c, 6) AS closeness FROM b"

_RUNS = """d AS (SELECT id, max(description) AS t FROM lead_company_job WHERE length(description) > 200 GROUP BY 1), w AS (SELECT id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM d),
r AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS run FROM w WHERE len(w) >= 3), n AS (SELECT id, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT x, y FROM (SELECT a.id AS x, b.id AS y, count(*) AS c FROM r a JOIN r b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2) JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE c * 2 >= a.n + b.n - c)"""
_P3_SQL = f"WITH {_RUNS} SELECT x AS job_id_a, y AS job_id_b FROM p"
_P3_GROUPS = f"""WITH RECURSIVE {_RUNS}, k AS (SELECT id, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM w),
e AS (SELECT x, y FROM p JOIN k a ON a.id = x AND a.class_id = x JOIN k b ON b.id = y AND b.class_id = y UNION ALL SELECT y, x FROM p JOIN k a ON a.id = x AND a.class_id = x JOIN k b ON b.id = y AND b.class_id = y),
s(node, seen) AS (SELECT DISTINCT class_id, class_id FROM k UNION SELECT s.node, e.y FROM s JOIN e ON e.x = s.seen)
SELECT k.id AS job_id, class_id, g.group_id, coalesce(l.n, 0) AS n_links FROM k JOIN (SELECT node, min(seen) AS group_id FROM s GROUP BY 1) g ON g.node = class_id LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY 1) l ON l.x = class_id"""

QUERIES = {"p1_found": p1_found, "p1_ranking": p1_ranking, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p6_found": p6_found, "p7_found": p7_found, "p7_fused": p7_fused, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_profile": p10_profile}
SQL = {"p1_found": _P1_SQL, "p1_ranking": _P1_RANKING, "p3_found": _P3_SQL, "p3_groups": _P3_GROUPS, "p7_found": _P7_SQL}
