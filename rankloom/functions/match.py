"""Lexical and vector scores of documents, as expressions."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limit of the sum of 1/j^2, by which a word's repeated occurrences count; weight of a plain word.
REPEATS, WEIGHT = 1.64493406685, 0.1


def words(c: str | Column) -> Column:
    """Runs of letters a-z and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def phrase_words(phrases: Sequence[str]) -> list[list[str]]:
    """Words of each phrase; empty phrases are dropped, the order is that of the texts."""
    return [w for w in (list(dict.fromkeys(words_of(p))) for p in sorted(set(phrases))) if w]


def phrase_match(tokens: Column, phrases: Sequence[str]) -> Column:
    """Any phrase has all of its words in the text."""
    alternatives = [F.size(F.array_except(F.array(*[F.lit(x) for x in w]), tokens)) == 0 for w in phrase_words(phrases)]
    return F.lit(False) if not alternatives else _any(alternatives)


def _any(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def lexical_score(tokens: Column, phrases: Sequence[str]) -> Column:
    """Over the different words asked for: the n-th occurrence adds 1/n^2; the mean over the words."""
    asked = sorted({x for w in phrase_words(phrases) for x in w})
    if not asked:
        return F.lit(0.0)

    def worth(x: Column) -> Column:
        places = F.slice(F.sequence(F.lit(1), F.size(tokens) + 1), F.lit(1), F.size(F.filter(tokens, lambda t: t == x)))
        return F.lit(WEIGHT) * F.aggregate(places, F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j).cast("double")) / F.lit(REPEATS)

    each = F.transform(F.array(*[F.lit(x) for x in asked]), worth)  # one expression, however many words are asked for
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(asked)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(c: str | Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column with a literal vector; null for null, empty and all-zero vectors."""
    v = F.col(c) if isinstance(c, str) else c
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    q = F.expr("array(" + ", ".join(f"{float(x) / norm if norm else 0.0!r}D" for x in query) + ")")  # one call instead of one per element
    return dot(v, q) / F.nullif(F.sqrt(dot(v, v)), F.lit(0.0)) if norm else F.lit(None).cast("double")


def max_cosine(c: str | Column, queries: Sequence[Sequence[float]]) -> Column:
    """The best cosine over several vectors, null if none is asked for."""
    return F.array_max(F.array(*[cosine(c, q) for q in queries])) if queries else F.lit(None).cast("double")


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector of a text's words, for use without a model; an empty text is refused."""
    found = words_of(text)
    if not found:
        raise ValueError("an empty text has no vector")
    out = [0.0] * dim
    for w in found:
        h = hashlib.md5(w.encode()).hexdigest()
        out[int(h[:4], 16) % dim] += 1.0 if int(h[4], 16) % 2 else -1.0
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, whatever number of times it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def hashed_column(c: str | Column, dim: int = 64) -> Column:
    """``hashed_vector`` of a text column, inside the JVM; null and wordless texts have no vector."""
    number = lambda w, at, n: F.conv(F.substring(w, at, n), 16, 10).cast("int")
    signed = lambda m: F.struct((number(m, 1, 4) % dim).alias("at"), F.when(number(m, 5, 1) % 2 == 1, 1.0).otherwise(-1.0).alias("sign"))
    hashed = F.transform(F.transform(words(c), lambda w: F.md5(w)), signed)
    counts = lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(h, lambda x: x["at"] == i), F.lit(0.0), lambda a, x: a + x["sign"]))
    scaled = lambda raw: _once(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(raw, lambda x: x / F.when(n > 0, n).otherwise(1.0)))
    return _once(hashed, lambda h: F.when(F.size(h) > 0, _once(counts(h), scaled)))
