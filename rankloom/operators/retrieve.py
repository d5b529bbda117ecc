"""Ranked lists of documents, their projection to companies, and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.match import cosine, lexical_score, phrase_match, words

#: Rows of a list; constant of reciprocal rank fusion; below this spread all scores are equal.
DEPTH, K_RRF, FLAT = 200, 60.0, 1e-12


def best_per(df: DataFrame, key: str, *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the cut runs in each task before the exchange."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def lexical_list(docs: DataFrame, key: str, text: str, phrases: Sequence[str], *, tie: str | None = None, depth: int = DEPTH) -> DataFrame:
    """``(key, company_id, score)``: documents that hold all words of a phrase, best first by (score, key).

    With ``tie`` a key has several documents, of which the best by (score, ``tie``) counts. Without
    phrases the list is empty. Scores are rounded, so that equal ones tie on any machine.
    """
    cols = [key, "company_id"] + ([tie] if tie else [])
    tokens = docs.select(*dict.fromkeys(cols), words(text).alias("__w")).where(phrase_match(F.col("__w"), phrases))
    scored = tokens.select(*dict.fromkeys(cols), F.round(lexical_score(F.col("__w"), phrases), 9).alias("score"))
    if tie:
        scored = best_per(scored, key, F.desc("score"), F.asc(tie))
    return scored.select(*dict.fromkeys((key, "company_id")), "score").orderBy(F.desc("score"), F.asc(key)).limit(depth)


def semantic_list(docs: DataFrame, key: str, vector: str, query: Sequence[float], *, tie: str | None = None, depth: int = DEPTH) -> DataFrame:
    """``(key, company_id, score)`` by exact cosine, over all documents with a vector; cases as in ``lexical_list``."""
    cols = [key, "company_id"] + ([tie] if tie else [])
    scored = docs.where(F.col(vector).isNotNull()).select(*dict.fromkeys(cols), F.round(cosine(vector, query), 9).alias("score")).where("score IS NOT NULL")
    if tie:
        scored = best_per(scored, key, F.desc("score"), F.asc(tie))
    return scored.select(*dict.fromkeys((key, "company_id")), "score").orderBy(F.desc("score"), F.asc(key)).limit(depth)


def ranks(listed: DataFrame, key: str) -> DataFrame:
    """Position of each row of a list, which holds ``DEPTH`` rows at most."""
    return listed.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc(key))))


def company_ranks(ranked: DataFrame) -> DataFrame:
    """Companies by their best document, ranked anew by (best rank, company)."""
    best = ranked.groupBy("company_id").agg(F.min("rank").alias("best"))
    return best.select("company_id", F.row_number().over(W.orderBy("best", "company_id")).alias("rank"))


def fuse(lists: Sequence[DataFrame]) -> DataFrame:
    """``(company_id, fused, best_doc)``: reciprocal ranks added in the order of the lists.

    Each list is one column, so that the sum never depends on the order of arrival.
    ``best_doc`` spreads the sums over 0 to 1; if all are equal it is 1.
    """
    tagged = [x.select("company_id", *[(F.col("rank") if i == j else F.lit(None).cast("int")).alias(f"r{j}") for j in range(len(lists))]) for i, x in enumerate(lists)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    wide = rows.groupBy("company_id").agg(*[F.min(f"r{j}").alias(f"r{j}") for j in range(len(lists))])
    total = F.lit(0.0)
    for j in range(len(lists)):
        total = total + F.coalesce(F.lit(1.0) / (F.lit(K_RRF) + F.col(f"r{j}")), F.lit(0.0))
    fused = wide.select("company_id", total.alias("fused"))
    return with_01(fused, "fused", "best_doc")


def with_01(df: DataFrame, score: str, name: str) -> DataFrame:
    """Min-max over all rows, from a one-row aggregate."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    both = df.join(F.broadcast(ends))  # one row
    return both.withColumn(name, F.when(spread < FLAT, F.lit(1.0)).otherwise((F.col(score) - F.col("__lo")) / spread)).drop("__lo", "__hi")
