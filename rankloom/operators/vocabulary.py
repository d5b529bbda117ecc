"""Controlled vocabularies: the resolution ladder, its upkeep, and its invariants.

Vocabularies join by key; values are distributed. Nothing is looked up row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import term_key
from ..functions.match import dot, hashed_column
from ..plans.lineage import cut
from .retrieve import best_per

#: Cosines above which the nearest term of a technology, or of an industry, is the same thing.
TECH_NEAR, INDUSTRY_NEAR = 0.85, 0.82
#: Rows of a block of vectors.
BLOCK = 2048


def keys_of(vocabulary: DataFrame) -> DataFrame:
    """``(key, term, step)``: every term's own key (1) and its aliases' keys (2); of several terms the first in order."""
    own = vocabulary.select(term_key("term").alias("key"), "term", F.lit(1).alias("step"))
    other = vocabulary.select("term", F.explode("aliases").alias("a")).select(term_key("a").alias("key"), "term", F.lit(2).alias("step"))
    return own.unionByName(other).where("key <> ''").groupBy("key").agg(F.min(F.struct("step", "term")).alias("m")).select("key", "m.term", "m.step")


def resolve_industries(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``resolve`` for industries: exact, alias, or the nearest name above a lower cosine; texts have hashed vectors. Blank values are none."""
    raw = values.select(F.trim("raw").alias("raw")).where("raw <> ''").distinct()
    return resolve(raw, vocabulary, raw.select("raw", hashed_column("raw").alias("vec")), vocabulary.select("term", hashed_column("term").alias("vec")), near=INDUSTRY_NEAR)


def resolve(values: DataFrame, vocabulary: DataFrame, vectors: DataFrame | None = None, term_vectors: DataFrame | None = None, near: float = TECH_NEAR) -> DataFrame:
    """``(raw, term, step, similarity)`` of each different value: exact (1), alias (2), nearest vector (3), or unresolved (4).

    ``vectors`` is (raw, vec), ``term_vectors`` (term, vec); without them the third step is left out.
    """
    raw = values.select("raw").where("raw IS NOT NULL").distinct()
    found = raw.withColumn("key", term_key("raw")).join(keys_of(vocabulary), "key", "left").select("raw", "term", "step")
    none = F.lit(None).cast("double")
    out = found.where("term IS NOT NULL").withColumn("similarity", none)
    rest = found.where("term IS NULL").select("raw")
    if vectors is not None and term_vectors is not None:
        close = nearest_term(rest.join(vectors, "raw"), term_vectors)
        rest = rest.join(close, "raw", "left").select("raw", F.when(F.col("similarity") > near, F.col("term")).alias("term"), "similarity")
        return out.unionByName(rest.select("raw", "term", F.when(F.col("term").isNotNull(), 3).otherwise(4).alias("step"), "similarity"))
    return out.unionByName(rest.select("raw", F.lit(None).cast("string").alias("term"), F.lit(4).alias("step"), none.alias("similarity")))


def nearest_term(values: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """``(raw, term, similarity)``: the nearest term of each value's vector, ties to the first term.

    The terms are a controlled list; they travel as one array, so that no pairs are made by a join.
    """
    v = F.col("vec")
    listed = term_vectors.agg(F.array_sort(F.collect_list(F.struct("term", "vec"))).alias("terms"))
    cos = lambda t: dot(v, t["vec"]) / F.nullif(F.sqrt(dot(v, v)) * F.sqrt(dot(t["vec"], t["vec"])), F.lit(0.0))
    scored = values.join(F.broadcast(listed)).select("raw", F.transform("terms", lambda t: F.struct(F.round(cos(t), 9).alias("similarity"), t["term"].alias("term"))).alias("s"))
    top = F.aggregate("s", F.struct(F.lit(-2.0).alias("similarity"), F.lit("").alias("term")), lambda a, x: F.when(x["similarity"] > a["similarity"], x).otherwise(a))
    return scored.select("raw", top.alias("t")).select("raw", F.when(F.col("t.similarity") > -2, F.col("t.term")).alias("term"), F.when(F.col("t.similarity") > -2, F.col("t.similarity")).alias("similarity"))


def _packed(block: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of unit vectors of one dimension, in the order of their names."""
        for b in batches:
            for dim, part in b.groupby(b["vec"].map(len)):
                part = part.sort_values("name")
                m = np.stack(part["vec"].to_numpy()).astype(np.float64)
                norm = np.sqrt((m * m).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                m, names = m[ok] / norm[ok, None], part["name"].to_numpy()[ok]
                for a in range(0, len(m), block):
                    yield pd.DataFrame({"names": [names[a : a + block]], "dim": [int(dim)], "vecs": [m[a : a + block].tobytes()]})

    return pack


def _nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each value of a block with the nearest term of another block, of those equal in nine digits the first."""
    for b in batches:
        for raws, da, va, terms, db, vb in zip(b["raws"], b["da"], b["va"], b["terms"], b["db"], b["vb"]):
            if da != db:
                continue
            cos = np.frombuffer(va).reshape(-1, da) @ np.frombuffer(vb).reshape(-1, db).T
            top = cos.max(1)
            i, j = np.nonzero(cos >= (top - 2e-9)[:, None])
            same = np.round(cos[i, j], 9) == np.round(top, 9)[i]
            i, at = np.unique(i[same], return_index=True)
            yield pd.DataFrame({"raw": np.asarray(raws)[i], "term": np.asarray(terms, object)[j[same][at]], "similarity": np.round(top, 9)[i]})


def nearest_of_many(values: DataFrame, term_vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``nearest_term`` for terms that are a table of their own: exact, block against block, nothing is broadcast as a list.

    Null, empty, all-zero and non-finite vectors have no direction; such values, and those that no term's
    vector has the dimension of, are left out.
    """
    kind = values.schema["raw"].dataType.simpleString()
    pack = lambda df, name, t: cut(df.select(F.col(name).alias("name"), "vec").where("name IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)").mapInPandas(_packed(block), f"names array<{t}>, dim int, vecs binary"))
    left = pack(values, "raw", kind).select(F.col("names").alias("raws"), F.col("dim").alias("da"), F.col("vecs").alias("va"))
    right = pack(term_vectors, "term", "string").select(F.col("names").alias("terms"), F.col("dim").alias("db"), F.col("vecs").alias("vb"))
    each = left.crossJoin(right).mapInPandas(_nearest, f"raw {kind}, term string, similarity double")
    return best_per(each, "raw", F.desc("similarity"), F.asc("term"))


def canonical_arrays(rows: DataFrame, id: str, column: str, vocabulary: DataFrame) -> DataFrame:  # noqa: A002
    """Each row's array as canonical terms: in order, each once, without unresolved ones."""
    each = rows.select(F.col(id).alias("id"), F.posexplode(column).alias("at", "raw")).withColumn("key", term_key("raw"))
    named = each.join(keys_of(vocabulary), "key").groupBy("id", "term").agg(F.min("at").alias("at"))
    lists = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias(column))
    return rows.select(F.col(id).alias("id")).join(lists, "id", "left").select("id", F.coalesce(column, F.array().cast("array<string>")).alias(column))


def review_queue(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Unresolved values with their true number of occurrences."""
    each = rows.select(F.explode(column).alias("raw_term")).where("raw_term IS NOT NULL").withColumn("key", term_key("raw_term"))
    return each.join(keys_of(vocabulary).select("key"), "key", "left_anti").groupBy("raw_term").agg(F.count("*").alias("occurrences"))


def collisions(vocabulary: DataFrame) -> DataFrame:
    """Terms that are an alias of another term: has to be empty."""
    aliases = vocabulary.select(F.col("term").alias("owner"), F.explode("aliases").alias("alias")).withColumn("key", term_key("alias"))
    return vocabulary.select("term", term_key("term").alias("key")).join(aliases, "key").where("term <> owner").select("term", "owner", "alias")


def reconcile(vocabulary: DataFrame, declared: DataFrame) -> DataFrame:
    """The vocabulary after ``declared`` (alias, term): alias terms are merged away, aliases that another term owns are pruned."""
    owner = declared.select(term_key("alias").alias("key"), F.col("term").alias("owner")).distinct()
    kept = vocabulary.withColumn("key", term_key("term")).join(owner, "key", "left").where("owner IS NULL OR owner = term").select("term", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    each = kept.select("term", F.explode("aliases").alias("a")).withColumn("key", term_key("a")).join(owner, "key", "left").where("owner IS NULL OR owner = term").select("term", "a")
    own = declared.select("term", F.col("alias").alias("a")).join(kept.select("term"), "term", "left_semi")
    lists = each.unionByName(own).groupBy("term").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    return kept.select("term").join(lists, "term", "left").select("term", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def contradictions(vocabulary: DataFrame) -> DataFrame:
    """``(kind, key, terms)`` of what a hand-made vocabulary must not have: an ``empty`` key, a key of ``two terms``, a ``term as alias``
    of another, an alias of ``two owners``. A term may restate itself."""
    terms = vocabulary.select("term", term_key("term").alias("key"))
    aliases = vocabulary.select("term", F.explode("aliases").alias("a")).select("term", term_key("a").alias("key"))
    each = terms.withColumn("own", F.lit(True)).unionByName(aliases.withColumn("own", F.lit(False)))
    by = each.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("own"), F.col("term")))).alias("own"), F.array_sort(F.collect_set(F.when(~F.col("own"), F.col("term")))).alias("other"))
    foreign = F.size(F.array_except("other", "own")) > 0
    kind = F.when(F.col("key") == "", "empty").when(F.size("own") > 1, "two terms").when((F.size("own") > 0) & foreign, "term as alias").when((F.size("own") == 0) & (F.size("other") > 1), "two owners")
    return by.select(kind.alias("kind"), "key", F.array_sort(F.array_union("own", "other")).alias("terms")).where("kind IS NOT NULL")


def check_vocabulary(vocabulary: DataFrame) -> None:
    """Raises if the vocabulary contradicts itself."""
    if wrong := contradictions(vocabulary).orderBy("kind", "key").limit(10).collect():
        raise ValueError("; ".join(f"{r.kind} {r.key!r}: {', '.join(r.terms)}" for r in wrong))


def spelling_splits(values: DataFrame, column: str) -> DataFrame:
    """``(family, spellings, n)``: values in use that are spelt in several ways, by their key without any version number at its end."""
    each = values.select(F.explode(column).alias("v")).where("v IS NOT NULL")
    family = F.regexp_replace(term_key("v"), r"(?<=[a-z])[0-9]+$", "")
    by = each.groupBy(family.alias("family")).agg(F.array_sort(F.collect_set("v")).alias("spellings"), F.count("*").alias("n"))
    return by.where((F.size("spellings") > 1) & (F.col("family") != ""))


def dotless(aliases: DataFrame) -> DataFrame:
    """Aliases as written, and without their full stops: what a column holds and what a person types."""
    bare = F.replace("alias", F.lit("."), F.lit(""))
    return aliases.unionByName(aliases.where(F.col("alias").contains(".")).withColumn("alias", bare)).where(F.trim("alias") != "")


def seed(hand: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hand-made entries, and every corpus value that none of them names or has as an alias."""
    new = corpus.select(F.col("raw").alias("term")).where("term IS NOT NULL").distinct().withColumn("key", term_key("term")).join(keys_of(hand).select("key"), "key", "left_anti")
    first = best_per(new, "key", F.asc("term")).select("term", F.array().cast("array<string>").alias("aliases"))
    return hand.select("term", "aliases").unionByName(first)


def priority_aliases(sources: DataFrame) -> DataFrame:
    """``(alias, canonical, kind)`` from (alias, canonical, kind, priority): the lowest priority wins, corpus identities come as 0."""
    return best_per(sources, "alias", F.asc("priority"), F.asc("canonical")).select("alias", "canonical", "kind")
