"""From a text, or a structured query, to an answer: parsing, triage, the query's vector, ranking, exclusions and the reason of an empty result."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import max_cosine
from ..operators.boundary import hashed_batch
from .chips import Chips, ground, paraphrase, parse, triage, values
from .engine import Tables, Vocabulary, compile_predicate, excluded, filter_report, search, why_empty

#: What a result consists of, whatever the query; more columns may follow.
RESULT = "company_id bigint, score double, coverage double, recency double, volume double, best_doc double, distinct_roles bigint, matched_groups array<string>, unmatched_groups array<string>, evidence array<struct<place: int, job_id: bigint, title_norm: string, posted_date: timestamp_ntz, paraphrase: string, matched_terms array<string>, days_ago: bigint>>"
STATUSES = ("ok", "empty", "refused")


@dataclass
class Answer:
    """``companies`` and ``removed`` are lazy; a refusal has neither."""

    status: str
    chips: Chips
    reason: str | None = None
    notes: list[str] = field(default_factory=list)
    sentence: str = ""
    companies: DataFrame | None = None
    removed: DataFrame | None = None
    seconds: dict[str, float] = field(default_factory=dict)


def answer(t: Tables, asked: str | Chips, vocabulary: Vocabulary, now: Column, *, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]] = hashed_batch, vector: Sequence[float] | None = None) -> Answer:
    """Answers a query. A text is parsed and grounded in its own words; what isn't a search, or asks for nothing, is refused unread.

    ``embed`` gives the vector of the query's sentence and of each positive industry; ``vector`` stands in for the former. An empty
    result is looked into only then, by one pass over the companies.
    """
    took, began = {}, time.perf_counter()

    def lap(name: str) -> None:
        nonlocal began
        took[name], began = round(time.perf_counter() - began, 3), time.perf_counter()

    chips = asked
    if isinstance(asked, str):
        chips = ground(parse(asked, technologies=[n for n, _ in vocabulary.technologies], industries=[n for n, _ in vocabulary.industries], places=[n for n, _ in vocabulary.places]), asked)
    lap("parse")
    if (refused := triage(chips)) is not None:
        return Answer("refused", chips, refused.reason, seconds=took)
    p = compile_predicate(chips, vocabulary, now)
    sentence, industries = paraphrase(chips), values(chips.industries)
    vectors = list(embed(([] if vector is not None else [sentence]) + industries))
    query = list(vector) if vector is not None else vectors.pop(0)
    lap("embed")
    found = search(t, chips, vocabulary, query, now)
    near = t.of("company_signal", "company_id", max_cosine("embedding", vectors).alias("industry_similarity"))
    found = found.join(near, "company_id", "left").orderBy(F.desc("score"), "company_id")
    lap("plan")
    if not found.isEmpty():
        removed = excluded(t, chips, vocabulary, query, now) if p.not_used or p.not_hired else None
        lap("search")
        return Answer("ok", chips, None, p.notes, sentence, found, removed, took)
    lap("search")
    report = [r.asDict() for r in filter_report(t, p).orderBy("place").collect()] if p.dims else []
    lap("explain")
    return Answer("empty", chips, why_empty(report), p.notes, sentence, found, None, took)
