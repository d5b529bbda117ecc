"""Queries of the record problems of the core: units (2) and orphan references (5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import find_orphans, orphan_report
from ..operators.units import company_sizes
from ..sources.tables import load

#: Of each referencing table: record key, reference, own time, parent table, parent key.
REFERENCES = {
    "job_signal": ("job_id", "company_id", "run_at", "company_canonical", "canonical_id"),
    "apollo_company_data": ("id", "lead_company_id", "fetched_at", "lead_company", "id"),
    "apollo_contact_data": ("id", "lead_contact_id", "fetched_at", "lead_contact", "id"),
}


def _sizes(spark: SparkSession, d: str, **how) -> DataFrame:
    companies = load(spark, d, "lead_company", "id", "source", "created_at", "employee_count", "employee_range")
    return company_sizes(companies, load(spark, d, "feed"), **how)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in whole people of the rows whose count isn't already one."""
    return _sizes(spark, d).where("NOT plain").select("id", "emp_low", "emp_high")


def p2_units_unaided(spark: SparkSession, d: str) -> DataFrame:
    """Rows by feed and decoded unit when the feeds' notes aren't believed: what the model finds by itself."""
    return _sizes(spark, d, believe_notes=False).where("NOT from_range").groupBy("source", "factor").agg(F.count("*").alias("n_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose parent is missing, deleted or later."""
    found = []
    for table, (record, ref, seen, parent, key) in REFERENCES.items():
        gone = load(spark, d, "deletion_log", "table_name", "key_id").where(F.col("table_name") == parent)
        misses = find_orphans(load(spark, d, table, record, ref, seen), load(spark, d, parent, key, "created_at"), gone, record=record, ref=ref, seen=seen, key=key, made="created_at")
        found.append(misses.select(F.lit(table).alias("src_table"), "record_id", "ref_id", "reason", "period"))
    return reduce(DataFrame.unionByName, found)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphan_report(p5_found(spark, d))


def _orphan_sql() -> str:
    parts = [
        f"""SELECT DISTINCT '{t}' AS src_table, c.{record} AS record_id, c.{ref} AS ref_id,
  CASE WHEN p.{key} IS NOT NULL THEN 'late' WHEN g.key_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason,
  coalesce(strftime(c.{seen}, '%Y-%m'), 'none') AS period
FROM {t} c LEFT JOIN (SELECT {key}, min(created_at) AS created_at FROM {parent} GROUP BY 1) p ON p.{key} = c.{ref}
LEFT JOIN (SELECT DISTINCT key_id FROM deletion_log WHERE table_name = '{parent}') g ON g.key_id = c.{ref}
WHERE c.{ref} IS NOT NULL AND (p.{key} IS NULL OR p.created_at > c.{seen})"""
        for t, (record, ref, seen, parent, key) in REFERENCES.items()
    ]
    return "\nUNION ALL\n".join(parts)


QUERIES = {"p2_found": p2_found, "p2_units_unaided": p2_units_unaided, "p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _orphan_sql(),
    "p5_report": f"SELECT src_table, period, reason, count(*) AS n_refs, count(DISTINCT ref_id) AS n_keys FROM ({_orphan_sql()}) GROUP BY 1, 2, 3",
}
