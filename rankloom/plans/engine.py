"""Structured search: predicates, lists, fusion, scores, exclusions and the report of the filters.

All of it is one lazy plan over the tables; the driver only reads the vocabularies, which are lists of
a known kind, and the few rows that tell why a result is empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import bucket_bounds, overlap, place_key_of, term_key_of
from ..functions.match import hashed_column, hashed_vector, phrase_match, words
from ..operators.retrieve import DEPTH, company_ranks, fuse, lexical_list, ranks, semantic_list
from ..operators.score import Terms, best, score
from ..sources.tables import load
from .lineage import cut
from .chips import Chips, phrases, role_phrases, values

#: Dimensions in the order in which they break ties.
DIMENSIONS = ("naics", "sic", "industry", "location", "segment", "linkedin", "employees", "revenue", "negation")
#: Dimensions that look at one field, and when a company has it.
FIELDS = {"naics": "size(naics_codes) > 0", "sic": "size(sic_codes) > 0", "segment": "size(segments) > 0", "linkedin": "linkedin_url IS NOT NULL", "revenue": "revenue_usd IS NOT NULL"}


def all_of(cols: Sequence[Column]) -> Column:
    return reduce(Column.__and__, cols, F.lit(True))


@dataclass
class Vocabulary:
    """Names of technologies, places and industries with their aliases; families map one word to several industries."""

    technologies: list[tuple[str, list[str]]]
    places: list[tuple[str, list[str]]] = field(default_factory=list)
    industries: list[tuple[str, list[str]]] = field(default_factory=list)
    families: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, d: str) -> Vocabulary:
        """From the canonical terms; the first word of two or more industries is the name of their family."""
        by: dict[str, list] = {}
        for r in load(spark, d, "canonical_term").orderBy("term_id").collect():
            by.setdefault(r.kind, []).append((r.term, list(r.aliases or [])))
        families: dict[str, list[str]] = {}
        for name, _ in by.get("industry", []):
            families.setdefault(place_key_of(name).split(" ")[0], []).append(name)
        return cls(by.get("technology", []), by.get("state", []), by.get("industry", []), {k: v for k, v in families.items() if len(v) > 1})

    @cached_property
    def terms(self) -> Terms:
        return Terms(self.technologies)

    def place(self, value: str) -> tuple[str, str | None]:
        """The place's key and a note if it is unknown; unknown places are kept as they are and match nothing else."""
        key = place_key_of(value)
        for name, aliases in self.places:
            if key == place_key_of(name) or key in (place_key_of(a) for a in aliases):
                return place_key_of(name), None
        return key, f"place {value!r} is not known and is taken literally"

    def spelled(self, value: str) -> str:
        """A declared industry's own spelling, whatever the punctuation."""
        return next((n for n, _ in self.industries if term_key_of(n) == term_key_of(value)), value)

    def industry(self, value: str, strict: bool) -> tuple[list[str], str | None]:
        """All industries that a word stands for; strict keeps the one of that very name if there is one."""
        value = self.spelled(value)
        key = place_key_of(value)
        exact = [n for n, aliases in self.industries if key == place_key_of(n) or key in (place_key_of(a) for a in aliases)]
        family = self.families.get(key, [])
        same = [n for n in exact if place_key_of(n) == key]
        if strict and same:
            return same, None
        if strict and family:
            return family, f"no industry is called just {value!r}; its family is meant"
        found = list(dict.fromkeys(exact + family))
        return (found, None) if found else ([value], f"industry {value!r} is not known and is taken literally")


@dataclass
class Tables:
    """The tables of one data folder, each read with the columns that are needed."""

    spark: SparkSession
    d: str
    known: dict[str, DataFrame] = field(default_factory=dict)

    def of(self, name: str, *cols: str) -> DataFrame:
        """The table's columns; a table's files are listed once."""
        if name not in self.known:
            self.known[name] = load(self.spark, self.d, name)
        return self.known[name].select(*cols) if cols else self.known[name]

    @property
    def companies(self) -> DataFrame:
        """Canonical companies with the facts of their own row."""
        c = self.of("company_canonical", "canonical_id", "domain").withColumnRenamed("canonical_id", "company_id")
        facts = self.of("lead_company", "id", "name", "hq_city", "hq_state", "hq_country", "employee_count", "employee_range", "revenue_usd", "linkedin_url", "naics_codes", "sic_codes", "segments")
        return c.join(facts, c.company_id == facts.id).drop("id")

    @property
    def jobs(self) -> DataFrame:
        return self.of("job_signal", "job_id", "company_id", "function", "seniority", "technologies", "paraphrase", "title_norm", "posted_date")


@dataclass
class Predicate:
    """The facts and negations of a query as one boolean column per dimension."""

    dims: dict[str, Column]
    job: Column
    not_used: list[str]
    not_hired: list[str]
    notes: list[str]

    def without_negation(self) -> Predicate:
        return replace(self, dims={k: v for k, v in self.dims.items() if k != "negation"}, not_used=[], not_hired=[])


def compile_predicate(chips: Chips, vocabulary: Vocabulary, now: Column) -> Predicate:
    """Unset parts leave no condition at all; positive terms never filter."""
    notes: list[str] = []

    def noted(pair):
        if pair[1]:
            notes.append(pair[1])
        return pair[0]

    dims: dict[str, Column] = {}
    for name, column, asked in (("naics", "naics_codes", chips.naics), ("sic", "sic_codes", chips.sic), ("segment", "segments", chips.segments)):
        if asked:
            dims[name] = overlap(column, list(asked))
    canon = F.col("industry_canonical")
    inds = []
    if pos := values(chips.industries):
        inds.append(F.coalesce(canon.isin(*dict.fromkeys(n for v in pos for n in noted(vocabulary.industry(v, chips.industry_strict)))), F.lit(False)))
    if neg := values(chips.industries, True):
        inds.append(~F.coalesce(canon.isin(*dict.fromkeys(n for v in neg for n in noted(vocabulary.industry(v, False)))), F.lit(False)))
    if inds:
        dims["industry"] = all_of(inds)

    def anywhere(places: list[str]) -> Column:
        return reduce(Column.__or__, [F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*places) for c in ("hq_state", "hq_city", "hq_country")])

    locs = []
    if pos := values(chips.locations):
        locs.append(anywhere([noted(vocabulary.place(v)) for v in pos]))
    locs += [~anywhere([noted(vocabulary.place(v))]) for v in values(chips.locations, True)]
    if locs:
        dims["location"] = all_of(locs)
    if chips.has_linkedin is not None:
        dims["linkedin"] = F.col("linkedin_url").isNotNull() if chips.has_linkedin else F.col("linkedin_url").isNull()
    low, high = bucket_bounds(F.coalesce("employee_count", "employee_range"))
    size = ([low >= chips.min_employees] if chips.min_employees is not None else []) + ([high <= chips.max_employees] if chips.max_employees is not None else [])
    if size:
        dims["employees"] = F.coalesce(all_of(size), F.lit(False))
    money = F.col("revenue_usd")
    cash = ([money >= chips.min_revenue_usd] if chips.min_revenue_usd is not None else []) + ([money <= chips.max_revenue_usd] if chips.max_revenue_usd is not None else [])
    if cash:
        dims["revenue"] = F.coalesce(all_of(cash), F.lit(False))
    not_used, not_hired = [], []
    for g in chips.negated_groups():
        for a in g.any_of:
            if not a.strip():
                continue
            term = vocabulary.terms.resolve(a)
            if term is None:
                notes.append(f"{a!r} is no listed technology, so nothing is removed for it")
                term = a
            if g.source != "HIRING":
                not_used.append(term)
            if g.source != "USES":
                not_hired.append(term)
    if not_used or not_hired:
        dims["negation"] = ~F.col("negated")
    job = []
    if chips.since_days is not None:
        job.append(F.col("posted_date") >= now - F.make_dt_interval(days=F.lit(chips.since_days)))
    if chips.function:
        job.append(F.col("function") == chips.function)
    if chips.seniority:
        job.append(F.col("seniority") == chips.seniority)
    return Predicate(dims, all_of(job), not_used, not_hired, notes)


def flagged(t: Tables, p: Predicate, *, fields: bool = False) -> DataFrame:
    """Every canonical company with one boolean per active dimension; with ``fields`` another for having the field it looks at."""
    rows = t.companies
    if "industry" in p.dims or p.not_used:
        s = t.of("company_signal", "company_id", "industry_canonical", "technologies")
        rows = rows.join(s.select("company_id", "industry_canonical", overlap("technologies", p.not_used).alias("uses")), "company_id", "left")
    negated = F.coalesce(F.col("uses"), F.lit(False)) if p.not_used else F.lit(False)
    if p.not_hired:
        hired = t.of("job_signal", "company_id", "technologies").where(overlap("technologies", p.not_hired)).select("company_id", F.lit(True).alias("hires")).distinct()
        rows = rows.join(hired, "company_id", "left")
        negated = negated | F.coalesce(F.col("hires"), F.lit(False))
    rows = rows.withColumn("negated", negated)
    has = [F.coalesce(F.expr(FIELDS[k]), F.lit(False)).alias(f"f_{k}") for k in p.dims if k in FIELDS] if fields else []
    return rows.select("company_id", *[F.coalesce(c, F.lit(False)).alias(f"d_{k}") for k, c in p.dims.items()], *has)


def allowed(t: Tables, p: Predicate) -> DataFrame | None:
    """Companies that pass every dimension; None if there is none to pass."""
    if not p.dims:
        return None
    return flagged(t, p).where(all_of([F.col(f"d_{k}") for k in p.dims])).select("company_id")


def lists(t: Tables, p: Predicate, asked: list[str], query: Sequence[float], *, roles: list[str] | None = None, people: bool = False, intent_source: str | None = None, depth: int = DEPTH) -> dict[str, DataFrame]:
    """The six lists, eight for people, each restricted before it is scored; who passes is found once for all of them."""
    passing = allowed(t, p)
    passing = None if passing is None else cut(passing)

    def keep(df: DataFrame) -> DataFrame:
        return df if passing is None else df.join(passing, "company_id", "left_semi")

    jobs = keep(t.of("job_signal", "job_id", "company_id", "paraphrase", "embedding", "posted_date", "function", "seniority").where(p.job))
    intents = t.of("job_intent", "id", "job_id", "intent", "intent_embedding", "source")  # repeated rows fall away where the best row of a posting is taken
    if intent_source is not None:
        intents = intents.where(F.col("source") == intent_source)
    intents = intents.join(jobs.select("job_id", "company_id"), "job_id")
    firms = keep(t.of("company_signal", "company_id", "paraphrase", "embedding"))
    out = {
        "job_lexical": lexical_list(jobs, "job_id", "paraphrase", asked, depth=depth),
        "job_semantic": semantic_list(jobs, "job_id", "embedding", query, depth=depth),
        "company_lexical": lexical_list(firms, "company_id", "paraphrase", asked, depth=depth),
        "company_semantic": semantic_list(firms, "company_id", "embedding", query, depth=depth),
        "intent_lexical": lexical_list(intents, "job_id", "intent", asked, tie="id", depth=depth),
        "intent_semantic": semantic_list(intents, "job_id", "intent_embedding", query, tie="id", depth=depth),
    }
    if people:
        from ..operators.roles import census

        contacts = keep(census(t.of("lead_contact"), t.of("company_canonical", "canonical_id", "member_ids")))
        out["role_lexical"] = lexical_list(contacts, "company_id", "census_text", roles or [], tie="contact_id", depth=depth)
        if roles:
            # Roles have no stored vectors; the hashed vectors of their sentences make a space of their own.
            placed = contacts.select("company_id", "contact_id", hashed_column("census_text").alias("vec"))
            out["role_semantic"] = semantic_list(placed, "company_id", "vec", hashed_vector(" ".join(roles)), tie="contact_id", depth=depth)
    return out


def fused(found: dict[str, DataFrame]) -> DataFrame:
    """Documents projected to companies by best rank before fusion, in the fixed order of the lists."""
    projected = []
    for name, listed in found.items():
        if name.startswith(("job", "intent")):
            projected.append(company_ranks(ranks(listed, "job_id")))
        else:
            projected.append(ranks(listed, "company_id").select("company_id", "rank"))
    return fuse(projected)


def details(t: Tables) -> DataFrame:
    """What a result shows of a company; one without a signal row has no details and is no result."""
    s = t.of("company_signal", "company_id", "paraphrase", "technologies", "industry_raw", "industry_canonical")
    return s.join(t.companies.select("company_id", "domain", "name", "hq_city", "hq_state", "hq_country", "segments", "linkedin_url"), "company_id")


def ranked(t: Tables, chips: Chips, p: Predicate, vocabulary: Vocabulary, query: Sequence[float], now: Column, *, people: bool, intent_source: str | None = None, weights=None) -> DataFrame:
    """All candidates of one predicate with their scores."""
    found = lists(t, p, phrases(chips), query, roles=role_phrases(chips), people=people, intent_source=intent_source)
    counts = None
    if people:
        counts = role_counts(t, role_phrases(chips))
    return score(cut(fused(found)), details(t), t.jobs.where(p.job), chips, vocabulary.terms, now, weights=weights, role_counts=counts)


def role_counts(t: Tables, asked: list[str]) -> DataFrame:
    """Roles per company that match a phrase; without phrases all of its roles."""
    from ..operators.roles import census

    rows = census(t.of("lead_contact"), t.of("company_canonical", "canonical_id", "member_ids"))
    if asked:
        rows = rows.where(phrase_match(words("census_text"), asked))
    return rows.groupBy("company_id").agg(F.count("*").cast("int").alias("n_roles"))


def search(t: Tables, chips: Chips, vocabulary: Vocabulary, query: Sequence[float], now: Column, *, intent_source: str | None = None, weights=None) -> DataFrame:
    """The ranked companies, cut at the query's limit."""
    p = compile_predicate(chips, vocabulary, now)
    return best(ranked(t, chips, p, vocabulary, query, now, people=chips.result_mode == "PEOPLE", intent_source=intent_source, weights=weights), chips.limit)


def excluded(t: Tables, chips: Chips, vocabulary: Vocabulary, query: Sequence[float], now: Column, *, intent_source: str | None = None) -> DataFrame:
    """Companies that a negation removed, with the place they would have had and the terms that removed them.

    The whole ranking without negations is made, so that the place is the true one; it never includes contacts.
    """
    from pyspark.sql import Window as W

    p = compile_predicate(chips, vocabulary, now)
    shadow = ranked(t, chips, p.without_negation(), vocabulary, query, now, people=False, intent_source=intent_source)
    placed = shadow.select("company_id", "score").withColumn("would_rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc("company_id"))))
    used = t.of("company_signal", "company_id", "technologies").select("company_id", F.explode("technologies").alias("term")).where(F.col("term").isin(*p.not_used) if p.not_used else F.lit(False))
    hired = t.of("job_signal", "company_id", "technologies").select("company_id", F.explode("technologies").alias("term")).where(F.col("term").isin(*p.not_hired) if p.not_hired else F.lit(False))
    by = used.unionByName(hired).groupBy("company_id").agg(F.array_sort(F.collect_set("term")).alias("excluded_by"))
    return placed.join(by, "company_id").orderBy("would_rank").limit(chips.limit)


def coverage_of_fields(t: Tables) -> DataFrame:
    """One row: all companies, and how many have each field."""
    return t.companies.agg(F.count("*").alias("universe"), *[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in FIELDS.items()])


def dimension_counts(t: Tables, p: Predicate) -> DataFrame:
    """One row, from one pass: companies that pass everything, each dimension alone, and everything but it."""
    dims = list(p.dims)
    every = [F.col(f"d_{k}") for k in dims]
    aggs = [F.count_if(all_of(every)).alias("passing")]
    for k in dims:
        aggs.append(F.count_if(F.col(f"d_{k}")).alias(f"only_{k}"))
        aggs.append(F.count_if(all_of([F.col(f"d_{o}") for o in dims if o != k])).alias(f"without_{k}"))
    return flagged(t, p).agg(F.count("*").alias("universe"), *aggs)


def filter_report(t: Tables, p: Predicate) -> DataFrame:
    """One row per active filter, from one pass over the companies: ``place`` in the order of DIMENSIONS, all companies and those that
    pass everything, and of this filter those that pass it alone, that pass all others, and that have its field (null if it looks at several)."""
    dims = [k for k in DIMENSIONS if k in p.dims]
    sums = [F.count("*").alias("n_all"), F.count_if(all_of([F.col(f"d_{k}") for k in dims])).alias("n_passing")]
    for k in dims:
        sums += [F.count_if(F.col(f"d_{k}")).alias(f"alone_{k}"), F.count_if(all_of([F.col(f"d_{o}") for o in dims if o != k])).alias(f"others_{k}")]
        sums.append((F.count_if(F.col(f"f_{k}")) if k in FIELDS else F.lit(None).cast("bigint")).alias(f"field_{k}"))
    rows = [F.struct(F.lit(i).alias("place"), F.lit(k).alias("filter"), F.col(f"alone_{k}").alias("n_alone"), F.col(f"others_{k}").alias("n_others"), F.col(f"field_{k}").alias("n_field")) for i, k in enumerate(dims, 1)]
    return flagged(t, p, fields=True).agg(*sums).select(F.inline(F.array(*rows)), "n_all", "n_passing")


def why_empty(report: Sequence[Mapping]) -> str | None:
    """What a filter report says about an empty result; None if it isn't the filters that emptied it."""
    if not report or report[0]["n_passing"]:
        return None
    worst = min(report, key=lambda r: (r["n_alone"], r["place"]))
    said = [f"No company passes every filter; fewest pass {worst['filter']}: {worst['n_alone']} of {worst['n_all']}."]
    if worst["n_field"] is not None:
        said.append(f"{worst['n_field']} companies have that field.")
    said.append(f"Without this filter {worst['n_others']} would be left.")
    return " ".join(said)
