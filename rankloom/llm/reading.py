"""Reading level by a familiar-word formula.

The difficulty of a text comes from two figures over its whole length: the share of its words that are
not familiar, and its average sentence length. Familiar are the words of high document frequency in
the corpus itself. The weights of both figures are fitted on labelled texts; every other number is
counted over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .wordhash import Lookup, code_points, hashes, lower, property_of

#: A word is familiar if at least this part of the texts has it; there are at most (different words of a text) / FAMILIAR such words.
FAMILIAR = 0.10
#: Labelled texts the formula is fitted on at most; beyond them a hashed sample of that size is taken.
LABELS = 20_000
#: Labelled texts below which the formula isn't fitted and CLASSIC holds.
FEWEST = 30
BANDS = ("basic", "intermediate", "advanced")
LANGUAGES = ("en", "de", "fr")
#: Frequent function words by which languages are told apart.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in is that it for you with on are this be as by at or from we our not they will can has have an a if who which their more than".split()),
    "de": frozenset("der die das und ist zu den von mit sich auf für nicht ein eine im wir sie dem des als bei nach einen ihre ihnen uns aus wer ihr oder einer werden".split()),
    "fr": frozenset("le la les de des et est un une à en du que pour dans qui sur au par vous nous avec ce sont votre il elle aux ne pas plus ou d l".split()),
}
#: Letters and endings of words, for texts that have no function word at all.
_MARKS = {"de": re.compile(r"[äöüß]|(?:ung|keit|heit|lich|isch)(?:en|e|er|s)?\b"), "fr": re.compile(r"[éèêàçôû]|(?:eux|euse|ement|aire)s?\b"), "en": re.compile(r"(?:tion|ment|ity|ing|ly|ous|ive|ies|ship|ance)s?\b")}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?;…]+[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[A-ZÄÖÜÉÀ0-9•*\-–])|\n+|[•▪]|[.!?]+\s*$")


def clean(text: str) -> str:
    """Without soft hyphens and the other marks that only guide the layout."""
    return text.replace("­", "").replace("​", "").replace("﻿", "")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; an apostrophe between two letters is part of the word."""
    return _WORD.findall(clean(text).lower())


def language(words: list[str]) -> str:
    """The language with most function words; without any, the one whose spellings occur most; ``""`` without words."""
    if not words:
        return ""
    hits = {k: sum(w in s for w in words) for k, s in FUNCTION_WORDS.items()}
    if max(hits.values()) == 0:
        joined = " ".join(words)
        hits = {k: len(p.findall(joined)) for k, p in _MARKS.items()}
    return max(LANGUAGES, key=lambda k: hits[k])


def sentence_length(text: str, n_words: int) -> float:
    """Words per sentence; list items and lines end a sentence too, pieces without a word are none."""
    pieces = sum(1 for p in _END.split(clean(text)) if _WORD.search(p))
    return n_words / max(1, pieces)


def _role(c: str) -> int:
    """What a character does: 1 ends a line, 2 ends a sentence, 4 may close behind it, 8 is a blank, 16 may open, 32 begins the next one, 64 is a letter, 128 an apostrophe."""
    out = (c in "\n•▪") | (c in ".!?;…") * 2 | (c in "\"'”’)]") * 4 | c.isspace() * 8 | (c in "\"'“‘([") * 16
    out |= ("A" <= c <= "Z" or "0" <= c <= "9" or c in "ÄÖÜÉÀ•*-–") * 32
    return out | (c.isalnum() and not c.isdecimal()) * 64 | (c in "'’") * 128


@cache
def _function_words() -> Lookup:
    """Of each function word the languages that have it, as bits."""
    every = sorted(frozenset().union(*FUNCTION_WORDS.values()))
    return Lookup(word_hashes(every), np.array([sum((w in FUNCTION_WORDS[k]) << i for i, k in enumerate(LANGUAGES)) for w in every]))


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """The hash of each word; every one has a letter and no blank."""
    cp, begins = code_points(words)
    inside = np.ones(len(cp), bool)
    inside[begins[1:] - 1] = False
    return hashes(cp, inside)[0]


class Measured:
    """The words of some texts, all at once: their hashes, text by text, and the pieces they stand in."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts = [clean(t) for t in texts]
        cp, begins = code_points(self.texts)
        role = property_of(cp, _role)
        inside = (role & 64) > 0
        mark = np.flatnonzero(role & 128)
        mark = mark[mark > 0]  # the last code point is a line end
        inside[mark[inside[mark - 1] & inside[mark + 1]]] = True
        self.hash, starts, ends = hashes(property_of(cp, lower), inside)
        self.n = np.diff(np.searchsorted(starts, begins))
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        # A piece ends between two words where a line does, or a sentence that is followed by a blank and a new beginning.
        at = np.flatnonzero(role & 2)

        def beyond(place: np.ndarray, bit: int) -> np.ndarray:
            """The first place at or after it that isn't of this kind; line ends are blanks, and the last of them stays."""
            place = place.copy()
            on = np.flatnonzero((role[place] & bit > 0) & (place + 1 < len(cp)))
            while len(on):
                place[on] += 1
                on = on[(role[place[on]] & bit > 0) & (place[on] + 1 < len(cp))]
            return place

        closed = beyond(at + 1, 4)
        blank = beyond(closed, 8)
        stops = np.sort(np.concatenate([np.flatnonzero(role & 1), at[(blank > closed) & (role[beyond(blank, 16)] & 32 > 0)]]))
        before = np.searchsorted(stops, starts)
        new = np.ones(len(starts), bool)
        new[1:] = (before[1:] > before[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.pieces = np.bincount(self.owner[new], minlength=len(texts))

    def among(self, listed: Lookup) -> np.ndarray:
        """How many words of each text are in a list."""
        return np.bincount(self.owner[listed(self.hash) > 0], minlength=len(self.texts))

    def languages(self) -> np.ndarray:
        has = _function_words()(self.hash)
        hits = np.stack([np.bincount(self.owner[has & (1 << i) > 0], minlength=len(self.texts)) for i in range(len(LANGUAGES))])
        out = np.array(LANGUAGES, object)[hits.argmax(0)]
        for i in np.flatnonzero(hits.max(0) == 0):
            out[i] = language(words_of(self.texts[i]))
        return out


def _pieces(texts: list[str]) -> Iterator[tuple[int, Measured]]:
    """Texts, a bounded number of them and of characters at a time; only a longer text exceeds it, alone."""
    a = 0
    while a < len(texts):
        e, chars = a, 0
        while e < len(texts) and e - a < 512 and (e == a or chars < 1_000_000):
            chars += len(texts[e])
            e += 1
        yield a, Measured(texts[a:e])
        a = e


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every, docs = [np.empty(0, np.uint64)], 0
        for _, m in _pieces(b.column("text").to_pylist()):
            english = m.languages() == "en"
            docs += int(english.sum())
            h, owner = m.hash[english[m.owner]], m.owner[english[m.owner]]
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            every.append(h[first])
        word, n = np.unique(np.concatenate(every), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(word.view(np.int64), 0)), pa.array(np.append(n, docs)), pa.array(np.append(np.zeros(len(n), bool), True))], ["word", "n", "texts"])


class Familiar:
    """Familiar words as a sorted list of hashes."""

    def __init__(self, hashed: Sequence[int] = ()) -> None:
        self.hashed = np.sort(np.array(hashed, np.int64).view(np.uint64))

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.hashed, np.ones(len(self.hashed), np.int64))

    def __contains__(self, word: str) -> bool:
        return bool(self.lookup(word_hashes([word.lower()])).all())


def familiar_words(texts: DataFrame, part: float = FAMILIAR) -> Familiar:
    """Words that at least ``part`` of the English texts have; a list of bounded length whatever the corpus.

    The texts are read once: the counts are kept, and only the familiar words come to the driver.
    """
    counted = cut(texts.select(F.col("text")).where("text IS NOT NULL").mapInArrow(_count, "word bigint, n bigint, texts boolean").groupBy("word", "texts").agg(F.sum("n").alias("n")))
    total = counted.where("texts").agg(F.sum("n").alias("n")).first()
    least = part * (total.n or 0)
    return Familiar([r.word for r in counted.where(~F.col("texts") & (F.col("n") >= F.lit(least))).select("word").collect()])


def measure(docs: DataFrame, familiar: Familiar, *, id: str, text: str) -> DataFrame:  # noqa: A002
    """``(id, lang, n_words, unfamiliar, sentence)`` of each text, over its whole length."""
    known = docs.sparkSession.sparkContext.broadcast(familiar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, m in _pieces(b.column("text").to_pylist()):
                words = np.maximum(m.n, 1)
                lang = np.where(m.n > 0, m.languages(), "")
                figures = [pa.array(lang, pa.string()), pa.array(m.n), pa.array((m.n - m.among(known.value.lookup)) / words), pa.array(m.n / np.maximum(1, m.pieces))]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(a, len(m.n)), *figures], ["id", "lang", "n_words", "unfamiliar", "sentence"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, lang string, n_words bigint, unfamiliar double, sentence double")


def _design(unfamiliar: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    u, s = unfamiliar * 4, np.log(np.maximum(sentence, 1.0))
    return np.stack([np.ones_like(u), u, s, u * u, s * s, u * s], 1)


#: Bands when too few labels are there: the classic weights of the familiar-word formula and their usual cuts.
CLASSIC = (15.79, 0.0496, 6.9, 11.0)


def fit_bands(unfamiliar: np.ndarray, sentence: np.ndarray, band: np.ndarray, rounds: int = 400) -> np.ndarray | None:
    """Weights (terms x bands) of a softmax over both figures; wrong labels weigh less from round to round."""
    if len(band) < FEWEST or len(np.unique(band)) < len(BANDS):
        return None
    x, y = _design(unfamiliar, sentence), np.eye(len(BANDS))[band]
    scale = np.maximum(x.std(0), 1e-9)
    scale[0] = 1.0
    w, trust = np.zeros((x.shape[1], len(BANDS))), np.ones(len(band))
    z = x / scale
    for outer in range(4):
        for _ in range(rounds):  # Newton's bound of the softmax: H <= 0.5 X'X
            p = _softmax(z @ w)
            g = z.T @ ((p - y) * trust[:, None]) + 0.05 * w
            h = 0.5 * (z * trust[:, None]).T @ z + 0.05 * np.eye(z.shape[1])
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        trust = np.where(_softmax(z @ w)[np.arange(len(band)), band] < 0.1, 0.1, 1.0)
    return w / scale[:, None]


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _agreed(labels: DataFrame, doc: str) -> DataFrame:
    """One band per text: the most frequent one, of equals the lower rater's."""
    known = labels.where(F.col("band").isin(*BANDS) & F.col(doc).isNotNull())
    votes = known.groupBy(F.col(doc).cast("bigint").alias("id"), "band").agg(F.count("*").alias("n"), F.min("rater").alias("r"))
    return votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("r")).alias("r"), "band")).alias("v")).select("id", "v.band")


def reading_levels(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label_doc: str = "doc_id", corpus: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """``(id, lang, n_words, unfamiliar, sentence, band)`` of every text that has a word, in any language.

    ``labels`` is (``label_doc``, ``rater``, ``band``); ``corpus`` (default ``docs``) is what word frequencies are counted over.
    Defined cases: null ids and texts give no row, texts without a word none either; of repeated rows
    each gives its row; unknown bands are no labels; with fewer than FEWEST labelled English texts, or a
    band missing among them, the classic weights hold; an empty corpus makes every word unfamiliar.
    """
    every = (corpus if corpus is not None else docs).select(F.col(text).alias("text"))
    figures = cut(measure(docs, familiar_words(every), id=id, text=text))  # a few numbers of each text, read once
    agreed = _agreed(labels, label_doc)
    n = agreed.count()
    if n > LABELS:
        agreed = agreed.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // LABELS))) == 0)
    known = figures.join(F.broadcast(agreed), "id").where("lang = 'en' AND n_words >= 20").toPandas()  # LABELS rows at most
    w = fit_bands(known["unfamiliar"].to_numpy(float), known["sentence"].to_numpy(float), known["band"].map(BANDS.index).to_numpy(int) if len(known) else np.empty(0, int))
    if w is None:
        a, b, low, high = CLASSIC
        score = F.col("unfamiliar") * a + F.col("sentence") * b
        level = F.when(score < low, BANDS[0]).when(score < high, BANDS[1]).otherwise(BANDS[2])
    else:
        u, s = F.col("unfamiliar") * 4, F.log(F.greatest(F.col("sentence"), F.lit(1.0)))
        terms = [F.lit(1.0), u, s, u * u, s * s, u * s]
        score = [sum((t * float(c) for t, c in zip(terms[1:], w[1:, k])), F.lit(float(w[0, k]))) for k in range(len(BANDS))]
        top = F.greatest(*score)
        level = F.when(score[0] == top, BANDS[0]).when(score[1] == top, BANDS[1]).otherwise(BANDS[2])
    return figures.where("n_words > 0").withColumn("band", level)
