"""The structured query and what is derived from it on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

SOURCES, MODES, RESULTS, INTENTS = ("USES", "HIRING", "ANY"), ("USES", "HIRING", "EITHER"), ("COMPANIES", "PEOPLE"), ("SEARCH", "ACTION", "UNPARSEABLE")


@dataclass(frozen=True)
class Group:
    """Alternatives of which one suffices; a negated group removes."""

    any_of: tuple[str, ...]
    source: str = "ANY"
    negate: bool = False

    def __post_init__(self) -> None:
        if self.source not in SOURCES:
            raise ValueError(f"unknown source {self.source}")


@dataclass(frozen=True)
class Value:
    value: str
    negate: bool = False


@dataclass(frozen=True)
class Chips:
    intent: str = "SEARCH"
    terms: tuple[Group, ...] = ()
    industries: tuple[Value, ...] = ()
    industry_strict: bool = False
    locations: tuple[Value, ...] = ()
    segments: tuple[str, ...] = ()
    naics: tuple[str, ...] = ()
    sic: tuple[str, ...] = ()
    has_linkedin: bool | None = None
    since_days: int | None = None
    function: str | None = None
    seniority: str | None = None
    min_employees: int | None = None
    max_employees: int | None = None
    min_revenue_usd: float | None = None
    max_revenue_usd: float | None = None
    intent_mode: str = "EITHER"
    result_mode: str = "COMPANIES"
    limit: int = 20

    def __post_init__(self) -> None:
        for value, known in ((self.intent, INTENTS), (self.intent_mode, MODES), (self.result_mode, RESULTS)):
            if value not in known:
                raise ValueError(f"{value} is none of {known}")

    def positive_groups(self) -> tuple[Group, ...]:
        return tuple(g for g in self.terms if not g.negate)

    def negated_groups(self) -> tuple[Group, ...]:
        return tuple(g for g in self.terms if g.negate)

    def is_empty(self) -> bool:
        """Nothing is asked; a group list with nothing but blank alternatives counts as nothing."""
        asked = [a for g in self.terms for a in g.any_of if a.strip()] + values(self.industries) + values(self.industries, True) + values(self.locations) + values(self.locations, True)
        rest = (self.segments, self.naics, self.sic, self.has_linkedin, self.since_days, self.function, self.seniority, self.min_employees, self.max_employees, self.min_revenue_usd, self.max_revenue_usd)
        return not asked and all(x is None or x == () for x in rest)


@dataclass(frozen=True)
class Refusal:
    reason: str
    companies: tuple = field(default=())


def triage(chips: Chips) -> Refusal | None:
    """Queries that aren't searches, and empty ones, are refused before anything is read."""
    if chips.intent != "SEARCH":
        return Refusal({"ACTION": "this asks for an action", "UNPARSEABLE": "this is not understood"}[chips.intent])
    return Refusal("nothing is asked for") if chips.is_empty() else None


def values(of: tuple[Value, ...], negate: bool = False) -> list[str]:
    return [v.value.strip() for v in of if v.negate is negate and v.value.strip()]


def phrases(chips: Chips) -> list[str]:
    """Positive alternatives, then positive industries, each once in order."""
    return list(dict.fromkeys([a.strip() for g in chips.positive_groups() for a in g.any_of if a.strip()] + values(chips.industries)))


def role_phrases(chips: Chips) -> list[str]:
    return list(dict.fromkeys(a.strip() for g in chips.positive_groups() for a in g.any_of if a.strip()))


def _or(items: list[str]) -> str:
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + " or " + items[-1]


def _and(items: list[str]) -> str:
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + " and " + items[-1]


def paraphrase(chips: Chips) -> str:
    """A sentence of the query to embed, made as those of the documents are; negated parts are left out."""
    by = {s: [_or([a.strip() for a in g.any_of if a.strip()]) for g in chips.positive_groups() if g.source == s and any(a.strip() for a in g.any_of)] for s in SOURCES}
    about = [(verb, _and(by[source])) for verb, source in (("running", "USES"), ("hiring for", "HIRING"), ("working with", "ANY")) if by[source]]
    if places := values(chips.locations):
        about.append(("based in", _or(places)))
    if chips.function or chips.seniority:
        about.append(("in", " ".join(x.replace("_", " ").lower() for x in (chips.seniority, chips.function) if x) + " roles"))
    kind = values(chips.industries)
    subject = f"{_or(kind)} company" if kind else "Company"
    return (subject + " " + ", ".join(f"{verb} {what}" for verb, what in about)).strip() + "."


_NUMBER = r"([\d,.]+)\s*(k|m|bn?|thousand|million|billion)?"
_SCALE = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}


def parse(text: str, *, technologies: list[str], industries: list[str], places: list[str]) -> Chips:
    """Words to a query without a model: listed names that occur in the text, plain rules for the rest.

    Every term comes from the text itself, so that nothing can be invented.
    """
    t = " ".join(text.lower().split())

    def said(names: list[str]) -> list[tuple[str, bool]]:
        out = []
        for n in sorted(names, key=lambda n: (-len(n), n)):
            m = re.search(r"(?<![a-z0-9])" + re.escape(n.lower()) + r"(?![a-z0-9])", t)
            if m and not any(n.lower() in o.lower() for o, _ in out):
                out.append((n, bool(re.search(r"\b(?:not|no|without|except|excluding)(?: (?:in|using|from|based in|hiring for))?\s*$", t[: m.start()]))))
        return out

    terms = []
    for name, no in said(technologies):
        before = t[: t.index(name.lower())]
        verb = re.findall(r"\b(using|uses|use|running|runs|on|hiring|hire|recruiting|looking)\b", before)
        source = "ANY" if not verb else "HIRING" if verb[-1] in ("hiring", "hire", "recruiting", "looking") else "USES"
        terms.append(Group((name,), source, no))
    chips = Chips(terms=tuple(terms), industries=tuple(Value(n, no) for n, no in said(industries)), locations=tuple(Value(n, no) for n, no in said(places)))
    if m := re.search(r"\b(?:last|past|within) (\d+)? ?(day|week|month|quarter|year)s?\b", t):
        chips = replace(chips, since_days=int(m[1] or 1) * {"day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}[m[2]])
    for word, low, high in (("(?:more than|over|at least|above)", True, False), ("(?:fewer than|less than|under|at most|below|up to)", False, True)):
        for m in re.finditer(rf"\b{word} \$?{_NUMBER}\s*(employees|people|staff|revenue|in revenue|dollars)?", t):
            n = float(m[1].replace(",", "").rstrip(".") or 0) * _SCALE.get(m[2] or "", 1)
            money = "$" in m[0] or "revenue" in (m[3] or "") or "dollars" in (m[3] or "")
            name = ("min" if low else "max") + ("_revenue_usd" if money else "_employees")
            chips = replace(chips, **{name: n if money else int(n)})
    if re.search(r"\b(?:people|contacts|who|persons)\b", t):
        chips = replace(chips, result_mode="PEOPLE")
    if re.search(r"\b(?:send|delete|email|export|schedule|create)\b", t):
        return replace(chips, intent="ACTION")
    hiring = any(g.source == "HIRING" for g in chips.positive_groups())
    using = any(g.source == "USES" for g in chips.positive_groups())
    return replace(chips, intent_mode="HIRING" if hiring and not using else "USES" if using and not hiring else "EITHER", intent="SEARCH" if t else "UNPARSEABLE")


def ground(chips: Chips, text: str) -> Chips:
    """Without the terms and places whose words don't all occur in the text; industries and segments stay."""
    there = set(re.findall("[a-z0-9]+", text.lower()))
    ok = lambda s: all(w in there for w in re.findall("[a-z0-9]+", s.lower()))
    terms = tuple(replace(g, any_of=tuple(a for a in g.any_of if ok(a))) for g in chips.terms)
    return replace(chips, terms=tuple(g for g in terms if g.any_of), locations=tuple(v for v in chips.locations if ok(v.value)))
