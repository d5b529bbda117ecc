"""Free-entered values to the entries of a reference list.

An automaton over all names and aliases finds the mentions embedded in a value; of overlapping ones
the longest wins. What the automaton leaves goes to token-set similarity: the words of a name are
matched to the words of the value in any order, each by spelling, abbreviation or a few edits, and
once more without any spaces. Only different values are matched, once each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words around a name that leave its meaning (fixed values).
DECORATION = frozenset("state province region county of the and hq hosted cluster suite edition enterprise cloud version v company sector industry industries group main other inc ltd llc co services service platform software pro system systems area district".split())
#: An alias this short counts only if nothing but decoration surrounds it.
SHORT = 5
#: Least similarity of the fuzzy step, and by how much the best entry has to lead.
LEAST, LEAD = 0.69, 0.04
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "&": " and "})


def fold(text: str) -> str:
    """Lower case, no accents, punctuation as spaces."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip()


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; anything above ``most`` is ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return min(prev[-1], most + 1)


def _likeness(word: str, of: str) -> float:
    """Of two words: 1 if equal, less by edits; an abbreviation keeps the first letter and the order of letters."""
    if word == of:
        return 1.0
    longest = max(len(word), len(of))
    most = 1 if longest <= 4 else 2 if longest <= 7 else 3
    n = edits(word, of, most)
    best = 1 - n / longest if n <= most and longest >= 3 else 0.0
    if len(word) < len(of) and word[:1] == of[:1] and len(of) >= 4:
        rest = iter(of)
        if all(c in rest for c in word):
            best = max(best, 0.9 if len(word) <= len(of) * 0.7 else best)
    return best if best >= 0.6 else 0.0


class _Letters:
    """How often each letter occurs in each of some words: a bound of their edit distances to any other."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.counts = np.array([self.count(w) for w in words], np.int32).reshape(len(words), 36)
        self.length = self.counts.sum(1)
        self.first: dict[str, list[str]] = {}
        for w in words:
            self.first.setdefault(w[:1], []).append(w)

    @staticmethod
    def count(word: str) -> np.ndarray:
        """Of each letter and digit; a folded word has no others."""
        n = np.bincount(np.frombuffer(word.encode(), np.uint8), minlength=128)
        return np.concatenate([n[48:58], n[97:123]])

    def apart(self, word: str) -> np.ndarray:
        """No edit distance is smaller: an edit changes the count of one letter up and of one down, a swap changes none."""
        off = self.counts - self.count(word)
        up = np.maximum(off, 0).sum(1)
        return np.maximum(up, up - off.sum(1))

    def within(self, word: str, most: int) -> set[str]:
        return {self.words[k] for k in np.flatnonzero(self.apart(word) <= most)}

    def shortened(self, word: str) -> set[str]:
        """Those that this word may be an abbreviation of: the same first letter, and longer."""
        return {w for w in self.first.get(word[:1], ()) if len(w) > len(word)}


class Vocabulary:
    """Names and aliases of one kind: ``(term_id, term, aliases)``."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]) -> None:
        import ahocorasick

        self.names: dict[str, int] = {}
        self.terms: dict[int, str] = {}
        aliases: dict[str, int] = {}
        self.exact = {t for _, t, _ in entries}
        for i, term, more in sorted(entries, key=lambda e: e[0]):  # of equal spellings the smallest id wins
            key = fold(term)
            if key:
                self.names.setdefault(key, i)
                self.terms.setdefault(i, key)
            for a in more or []:
                if a and fold(a):
                    aliases.setdefault(fold(a), i)
        self.aliases = {a: i for a, i in aliases.items() if a not in self.names}
        self.solid: dict[str, int] = {}
        for key, i in [*self.names.items(), *self.aliases.items()]:
            self.solid.setdefault(key.replace(" ", ""), i)
        # For the fuzzy step: the letters of each name without spaces, and of each of their words.
        self.listed = [(i, name.replace(" ", ""), [w for w in name.split() if w != "and"]) for i, name in self.terms.items()]
        self.flats = _Letters([flat for _, flat, _ in self.listed])
        self.most = np.array([max(1, round(0.26 * len(flat))) for _, flat, _ in self.listed], np.int64)
        self.words = _Letters(sorted({w for _, _, name in self.listed for w in name}))
        self.known: dict[str, dict[str, float]] = {}
        self.machine = ahocorasick.Automaton()
        for key, i in [*self.aliases.items(), *self.names.items()]:
            self.machine.add_word(f" {key} ", (key, i))
        if len(self.machine):
            self.machine.make_automaton()

    def mention(self, key: str) -> int:
        """The entry of the longest embedded mention; of equally long ones the first."""
        if not len(self.machine):
            return 0
        text = f" {key} "
        hits = [(end - len(name) - 1, name, i) for end, (name, i) in self.machine.iter(text)]
        taken: list[tuple[int, int]] = []
        for start, name, i in sorted(hits, key=lambda h: (-len(h[1]), h[0])):
            end = start + len(name)
            if any(start < b and a < end for a, b in taken):
                continue
            taken.append((start, end))
            if name in self.aliases and len(name) < SHORT:
                around = f"{text[:start]} {text[end:]}".split()
                if any(w not in DECORATION and not re.fullmatch(r"v?\d+", w) for w in around):
                    continue
            return i
        return 0

    def likes(self, word: str) -> dict[str, float]:
        """The words of names that this word is like, and how much; each different word is compared once."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = {of: x for of in self.words.within(word, 3) | self.words.shortened(word) if (x := _likeness(word, of)) > 0}
        return self.known[word]

    def similar(self, key: str) -> int:
        """The entry that the value's words or letters spell best, 0 if none does clearly."""
        words = [w for w in key.split() if w != "and"]
        own = sum(w not in DECORATION and not re.fullmatch(r"v?\d+", w) for w in words)
        solid = key.replace(" ", "")
        scores: dict[int, float] = {}
        for k in np.flatnonzero(self.flats.apart(solid) <= self.most):
            i, flat, _ = self.listed[k]
            n = edits(solid, flat, int(self.most[k]))
            if n <= self.most[k]:
                scores[i] = 1 - n / max(len(flat), len(solid))
        if words:
            likes = [self.likes(w) for w in words]
            for i, _, name in self.listed:
                score = self._token_set(words, likes, name, own)
                if score > scores.get(i, 0.0):
                    scores[i] = score
        best = sorted(((s, i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))
        if not best or best[0][0] < LEAST:
            return 0
        if len(best) > 1 and best[0][0] - best[1][0] < LEAD:
            return 0
        return best[0][1]

    @staticmethod
    def _token_set(words: list[str], likes: list[dict[str, float]], name: list[str], own: int) -> float:
        """Mean likeness of the name's words, each to a word of its own; words left over must be decoration."""
        if len(words) < len(name) or own > len(name):  # each name word takes one, and one would be left over
            return 0.0
        free, total, letters = list(range(len(words))), 0.0, 0
        for w in sorted(name, key=len, reverse=True):
            best = max(free, key=lambda x: likes[x].get(w, 0.0), default=None)
            like = likes[best].get(w, 0.0) if best is not None else 0.0
            if like == 0.0:
                return 0.0
            free.remove(best)
            total += like * len(w)
            letters += len(w)
        if any(words[x] not in DECORATION and not re.fullmatch(r"v?\d+", words[x]) for x in free):
            return 0.0
        return total / letters if letters else 0.0

    def find(self, value: str) -> int:
        """The entry that ``value`` names, 0 if none."""
        key = fold(value)
        if not key:
            return 0
        if key in self.names:
            return self.names[key]
        solid = key.replace(" ", "")
        if solid in self.solid:
            return self.solid[solid]
        if found := self.mention(key):
            return found
        if found := self.similar(key):
            return found
        bare = " ".join(w for w in key.split() if w not in DECORATION and not re.fullmatch(r"v?\d+", w))
        return self.similar(bare) if bare and bare != key else 0


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """``(kind, raw_value, term_id)`` of each different pair in ``values`` (``kind``, ``raw_value``); 0 names no entry.

    ``terms`` (``term_id``, ``kind``, ``term``, ``aliases``) is a reference list that fits into every task.
    Defined cases: null values and kinds are left out; a value of a kind without entries, one without
    letters and digits, and one that two entries fit about equally are 0; null terms and aliases are
    ignored; of equal spellings the smallest id counts.
    """
    lists: dict[str, list] = {}
    for r in terms.select("term_id", "kind", "term", "aliases").where("term IS NOT NULL AND kind IS NOT NULL").collect():
        lists.setdefault(r.kind, []).append((r.term_id, r.term, list(r.aliases or [])))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Vocabulary] = {}
        for b in batches:
            out = []
            for kind, value in zip(b["kind"], b["raw_value"]):
                if kind not in made:
                    made[kind] = Vocabulary(lists.get(kind, []))
                out.append(made[kind].find(value))
            yield b.assign(term_id=pd.Series(out, b.index, "int64"))[["kind", "raw_value", "term_id"]]

    different = values.select(F.col("kind").cast("string"), F.col("raw_value").cast("string")).where("kind IS NOT NULL AND raw_value IS NOT NULL").distinct()
    # By count, not by bytes: a value costs its comparison, however short it is.
    return different.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "raw_value").mapInPandas(match, "kind string, raw_value string, term_id bigint")


def map_fields(fields: DataFrame, terms: DataFrame) -> DataFrame:
    """``(field, record_id, raw_value, term_id)`` of each different valued, not already exact value of a record.

    ``fields`` is ``(field, kind, record_id, raw_value)``; values that say nothing or are spelt exactly as a
    term of their kind are left out. Repeated rows count once; an empty table gives no rows.
    """
    from .survivor import has_value

    exact = F.broadcast(terms.select("kind", F.col("term").alias("raw_value")).distinct())  # the reference list
    open_ = fields.where(has_value("raw_value")).join(exact, ["kind", "raw_value"], "left_anti").select("field", "kind", "record_id", "raw_value").distinct()
    return open_.join(map_values(open_, terms), ["kind", "raw_value"]).select("field", "record_id", "raw_value", "term_id")
