"""Where models would be: batches of texts to vectors, and documents to fields. Both take any function; both come with one without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import hashed_vector

#: Texts of one call.
BATCH = 100


def hashed_batch(texts: Sequence[str]) -> list[list[float]]:
    """Vectors without a model."""
    return [hashed_vector(t) for t in texts]


def embed(rows: DataFrame, key: str, text: str, of: Callable[[Sequence[str]], Sequence[Sequence[float]]] = hashed_batch, *, dim: int = 64, batch: int = BATCH) -> DataFrame:
    """``(key, vec)`` of every row with a text; ``of`` gets up to ``batch`` texts and has to give a vector of ``dim`` numbers for each.

    A blank text is refused before any call, a missing or misshapen vector after it; both fail the task.
    Rows that repeat give one row each; null keys stay null.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                texts = [str(t).strip() if t is not None else "" for t in part["text"]]
                if not all(texts):
                    raise ValueError("an empty text has no vector")
                vecs = [list(map(float, v)) for v in of(texts)]
                if len(vecs) != len(texts) or any(len(v) != dim for v in vecs):
                    raise ValueError(f"{len(texts)} texts need as many vectors of {dim} numbers")
                yield pd.DataFrame({"key": part["key"], "vec": vecs})

    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, vec array<double>")
    return out.withColumnRenamed("key", key)


def normalise(rows: DataFrame, of: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Documents to fields of a declared schema by any function of a frame; what it gives is checked against the schema by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), BATCH):
                yield of(b.iloc[a : a + BATCH])

    return rows.mapInPandas(run, schema)


# Cues by which a posting tells its initiative, the first that is found counts; a migration names where from and where to.
INITIATIVES = (
    ("MIGRATION", r"\b(migrat\w+|mov\w+|replatform\w*)\b.{1,60}\b(to|into|onto)\b|\blift and shift\b"),
    ("NEW_IMPLEMENTATION", r"\bimplement\w*\b|\bstand(ing)? up\b|\bbuild out our first\b|\bgreenfield\b|\blaunching a new platform\b"),
    ("MODERNIZATION", r"\bmoderni[sz]\w+|\bupgrad\w+|\brefactor\w*|\bautomat\w+|\bdigital transformation\b"),
    ("MAINTENANCE", r"\bmaint(ain\w*|enance)\b|\bsupport our users\b|\bkeep systems running\b|\btroubleshoot\w*"),
    ("SCALE_OUT", r"\bscal(e|ing)\b|\broll out\b|\bgrowing the team\b|\bexpanding coverage\b"),
)
# The title's own words for seniority, the first in this order.
TITLE_LEVELS = (
    ("INTERN", r"\b(intern|co-op|apprentice)\b"),
    ("JUNIOR", r"\b(junior|jr|graduate|associate|entry)\b"),
    ("SENIOR", r"\b(senior|sr)\b"),
    ("LEAD", r"\b(lead|principal|staff)\b"),
    ("ARCHITECT", r"\barchitect\b"),
    ("MANAGER", r"\bmanager\b|\bhead of\b"),
    ("DIRECTOR", r"\bdirector\b"),
    ("EXEC", r"\b(vp|vice president|chief|c-level)\b"),
)
# What the field for the kind of employment means.
ENGAGEMENTS = {"FULL_TIME": "PERMANENT", "PART_TIME": "PERMANENT", "INTERNSHIP": "PERMANENT", "CONTRACT": "CONTRACT", "TEMPORARY": "CONTRACT"}


def _first(c: Column, rules, otherwise: str) -> Column:
    return F.coalesce(*[F.when(c.rlike("(?i)" + x), n) for n, x in rules], F.lit(otherwise))


def rule_fields(title: str, description: str, kind: str) -> dict[str, Column]:
    """Initiative, seniority and engagement of a posting by rules alone, inside the JVM: what stands in for the model's answer."""
    said = F.coalesce(F.col(kind), F.lit(""))
    named = F.coalesce(*[F.when(F.upper(said) == k, v) for k, v in ENGAGEMENTS.items()], F.lit("UNKNOWN"))
    return {
        "initiative": _first(F.coalesce(F.col(description), F.lit("")), INITIATIVES, "UNKNOWN"),
        "seniority": _first(F.coalesce(F.col(title), F.lit("")), TITLE_LEVELS, "UNKNOWN"),
        "engagement_type": named,
    }
