"""Incremental ingest over plain Parquet tables: what is still to do, upserts, set replacement, dead letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import dot

#: Days and cosine of a repost; most characters kept of an error and of a raw answer.
REPOST_DAYS, REPOST_COSINE, MOST_ERROR, MOST_RAW = 90, 0.95, 4000, 8000


def pending(rows: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't written yet; the written rows are the checkpoint."""
    return rows.join(done.select(*on).distinct(), list(on), "left_anti")


def pending_jobs(jobs: DataFrame, companies: DataFrame, done: DataFrame, *, cursor: int = 0, prompt_version: str, model: str, least: int = 200, batch: int | None = None) -> DataFrame:
    """Active postings of active companies with enough text that this version and model haven't done.

    With ``batch`` the first so many by id, so that the last id is the next cursor.
    """
    rows = jobs.where(F.col("active") & (F.length("description") > least) & (F.col("id") > cursor)).join(companies.where("active").select(F.col("id").alias("lead_company_id")), "lead_company_id", "left_semi")
    by = done.where((F.col("prompt_version") == prompt_version) & (F.col("model") == model)).select(F.col("job_id").alias("id"))
    left = rows.join(by, "id", "left_anti")
    return left if batch is None else left.orderBy("id").limit(batch)


def pending_roles(contacts: DataFrame, done: DataFrame, *, cursor: int = 0, batch: int | None = None) -> DataFrame:
    """Active contacts with a title or department that have no row yet; only columns that identify nobody are read."""
    told = F.coalesce(F.trim("title") != "", F.lit(False)) | F.coalesce(F.trim("department") != "", F.lit(False))
    rows = contacts.where(F.col("active") & (F.col("id") > cursor) & told).select("id", "lead_company_id", "title", "department", "seniority")
    left = pending(rows, done.select(F.col("contact_id").alias("id")), ["id"])
    return left if batch is None else left.orderBy("id").limit(batch)


def upsert(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """The old rows with the new ones in place of theirs; of new rows with one key the last by all columns."""
    rest = [c for c in new.columns if c not in on]
    last = new.groupBy(*on).agg(F.max(F.struct(*rest)).alias("r")).select(*on, *[F.col(f"r.{c}").alias(c) for c in rest])
    return old.join(last.select(*on), list(on), "left_anti").unionByName(last.select(*old.columns))


def replace_sets(old: DataFrame, new: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """The sets of every key in ``batch`` are the new rows, also where there are none."""
    return old.join(batch.select(*on).distinct(), list(on), "left_anti").unionByName(new.select(*old.columns))


def merge_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Terms with the union of their aliases; a missing new vector keeps the old one."""
    n = new.select("term", F.col("aliases").alias("more"), F.col("embedding").alias("vec"))
    empty = F.array().cast("array<string>")
    both = old.join(n, "term", "full")
    return both.select("term", F.coalesce("vec", "embedding").alias("embedding"), F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("more", empty)))).alias("aliases"))


def count_up(old: DataFrame, seen: DataFrame, key: str, counter: str) -> DataFrame:
    """A counter per key after adding the rows of ``seen``."""
    added = seen.groupBy(key).agg(F.count("*").alias(counter))
    return old.select(key, counter).unionByName(added).groupBy(key).agg(F.sum(counter).cast("bigint").alias(counter))


def update_by_key(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the rows that ``new`` names; all others stay."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = old.join(n, key, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete_keys(old: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return old.join(keys.select(*on).distinct(), list(on), "left_anti")


def split_failures(rows: DataFrame, error: Column, raw: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): rows with an error go aside with their shortened texts."""
    tagged = rows.withColumn("__e", error)
    good = tagged.where("__e IS NULL").drop("__e")
    dead = tagged.where("__e IS NOT NULL").select(F.col(key).alias("source_id"), F.substring("__e", 1, MOST_ERROR).alias("error"), F.substring(raw, 1, MOST_RAW).alias("raw_response"))
    return good, dead


def settle_letters(old: DataFrame, dead: DataFrame, done: DataFrame) -> DataFrame:
    """The side table after a run: new letters take the place of their source's, and sources that went well have none."""
    return delete_keys(upsert(old, dead, ["source_id"]), done.select("source_id"), ["source_id"])


def reposts(jobs: DataFrame, *, days: int = REPOST_DAYS, least: float = REPOST_COSINE) -> DataFrame:
    """``(job_id, is_repost)`` of every posting: an earlier one of its company and title, at most ``days`` before, is that similar.

    Only the vectors of postings that have a possible partner meet; titles that many postings share are
    cut into windows of ``days``, so that a hot title meets neighbours in time only.
    """
    rows = jobs.where("title_norm IS NOT NULL AND title_norm <> '' AND posted_date IS NOT NULL AND embedding IS NOT NULL")
    day = F.datediff(F.col("posted_date").cast("date"), F.lit("1970-01-01").cast("date"))
    window = F.floor(day / F.lit(days)).cast("int")
    late = rows.select("job_id", "company_id", "title_norm", "posted_date", "embedding", window.alias("w"))
    early = rows.select(F.col("job_id").alias("j"), "company_id", "title_norm", F.col("posted_date").alias("p"), F.col("embedding").alias("e"), F.explode(F.array(window, window + 1)).alias("w"))
    near = late.join(early, ["company_id", "title_norm", "w"]).where((F.col("job_id") != F.col("j")) & (F.col("p") < F.col("posted_date")) & (F.col("p") >= F.col("posted_date") - F.make_dt_interval(days=F.lit(days))))
    norm = F.nullif(F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("e"), F.col("e"))), F.lit(0.0))
    hit = near.where(F.round(dot(F.col("embedding"), F.col("e")) / norm, 9) > least).select("job_id").distinct().withColumn("is_repost", F.lit(True))
    return jobs.select("job_id").join(hit, "job_id", "left").select("job_id", F.coalesce("is_repost", F.lit(False)).alias("is_repost"))


# Size words by the most people they stand for.
SIZES = ((500, "Small"), (1000, "Mid-size"), (10_000, "Large"))


def template_paraphrase(industry: Column, low: Column, high: Column, city: Column, state: Column, country: Column, technologies: Column, most: int = 150) -> Column:
    """A sentence made of the fields a company has; what is missing is never mentioned."""
    n = F.coalesce(high, low)
    size = F.when(n.isNull(), F.lit(None).cast("string"))
    for top, word in SIZES:
        size = size.when(n <= top, word)
    size = size.otherwise("Enterprise")
    text = lambda c: F.when(F.trim(c) != "", F.trim(c))
    subject = F.concat_ws(" ", size, text(industry))
    subject = F.when(subject == "", "Company").otherwise(F.concat(subject, F.lit(" company")))
    places = F.array_compact(F.array(text(city), text(state), text(country)))
    place = F.array_join(F.filter(places, lambda p, i: ~F.exists(F.slice(places, F.lit(1), i), lambda q: F.lower(q) == F.lower(p))), ", ")
    named = F.slice(F.filter(F.coalesce(technologies, F.array().cast("array<string>")), lambda t: F.coalesce(F.trim(t) != "", F.lit(False))), 1, most)
    k = F.size(named)
    listed = F.when(k == 1, F.get(named, F.lit(0))).when(k > 1, F.concat(F.array_join(F.slice(named, F.lit(1), k - 1), ", "), F.lit(" and "), F.element_at(named, -1)))
    return F.concat(F.concat_ws(" ", subject, F.when(place != "", F.concat(F.lit("in "), place)), F.concat(F.lit("running "), listed)), F.lit("."))


def labelled(fields: Sequence[tuple[str, Column]]) -> Column:
    """``Label: value`` lines of the fields that have a value."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.when(F.trim(c) != "", F.trim(c))) for name, c in fields])
