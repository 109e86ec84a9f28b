"""Questions that need no model: a small grammar that either keeps every condition of the wording or defers."""

from __future__ import annotations

import re

from sparkledger.plans.spec import ExposureMetric, FilterSpec, Intent, Op, QuerySpec

# fixed values: how statuses, classes and places are written
STATUSES = {"ongoing": "Ongoing", "terminated": "Terminated", "completed": "Completed"}
CLASSES = {"i": "Class I", "1": "Class I", "ii": "Class II", "2": "Class II", "iii": "Class III", "3": "Class III"}
COUNTRIES = {"canada": "Canada", "china": "China", "germany": "Germany", "india": "India", "united states": "United States", "usa": "United States", "u.s.": "United States"}
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
#: Words that carry no condition.
PLAIN = frozenset("a all an and are by class companies company count did drug enforcement entities entity exposure firm firms for from group groups had has have highest how in largest leaderboard list many me most much number of on or parent parents rank ranked ranking recall recalls report reported reports score severity show that the there these top total were what which with weighted worst".split())
_CLASS = re.compile(r"\bclass\s+(iii|ii|i|[123])\b", re.I)
_YEAR = re.compile(r"\b((?:19|20)\d\d)\b")
_OTHER_TIME = re.compile(r"\b(today|yesterday|week|month|quarter|since|before|after|between|last|past|recent|january|february|march|april|may|june|july|august|september|october|november|december)\b", re.I)
_NEGATED = re.compile(r"\b(not|non|never|except|excluding|without)\b", re.I)


def limit_of(question: str, usual: int = 20) -> int:
    """The number of a "top N" wording, in figures or as ten or five, in English or Chinese."""
    words = {"ten": 10, "five": 5, "十": 10, "五": 5}
    m = re.search(r"\btop\s*(\d{1,3}|ten\b|five\b)|前\s*(\d{1,3}|十|五)", question.casefold())
    if not m:
        return usual
    n = m.group(1) or m.group(2)
    return min(100, max(1, words.get(n) or int(n)))


def _one_of(column: str, values: list[str]) -> list[FilterSpec]:
    values = list(dict.fromkeys(values))
    return [FilterSpec(column, Op.eq if len(values) == 1 else Op.in_, tuple(values))] if values else []


def conditions(question: str) -> tuple[list[FilterSpec], str] | None:
    """Filters of a question and what is left of it; None if a condition can't be kept exactly.

    Known: status words, one bare year of the report, states or countries, a class.
    """
    if _NEGATED.search(question) or _OTHER_TIME.search(question):
        return None
    rest, found = question, []
    if m := _CLASS.search(rest):
        found += _one_of("classification", [CLASSES[m.group(1).casefold()]])
        rest = _CLASS.sub(" ", rest)
    years = list(dict.fromkeys(_YEAR.findall(rest)))
    if len(years) > 1:
        return None
    if years:
        found.append(FilterSpec("report_date", Op.between, (f"{years[0]}-01-01", f"{years[0]}-12-31")))
        rest = _YEAR.sub(" ", rest)
    columns = {}
    for column, table in (("status", STATUSES), ("state", STATES), ("country", COUNTRIES)):
        hits = []
        for word in sorted(table, key=len, reverse=True):
            pattern = re.compile(rf"(?<!\w){re.escape(word)}(?!\w)", re.I)
            if pattern.search(rest):
                hits.append(table[word])
                rest = pattern.sub(" ", rest)
        columns[column] = hits
    codes = [c for c in re.findall(r"\b[A-Z]{2}\b", rest) if c in STATES.values()]
    columns["state"] += codes
    rest = re.sub(r"\b(" + "|".join(codes) + r")\b", " ", rest) if codes else rest
    if columns["state"] and columns["country"]:  # may mean either or both
        return None
    for column, hits in columns.items():
        found += _one_of(column, hits)
    return found, rest


def _subject(rest: str) -> list[str]:
    """Words of a question that no condition took: a product or topic that this grammar can't express."""
    return [w for w in re.findall(r"[a-z][a-z0-9]+", rest.casefold()) if w not in PLAIN and w not in ("ten", "five")]


def explanation(question: str, nodes: list[tuple[str, str]]) -> QuerySpec | None:
    """"What is ...": the category, of (id, label) pairs, with the longest name in the question."""
    q = " ".join(re.findall("[a-z0-9]+", question.casefold()))
    if not re.match(r"(what (is|are|does|do)|explain|define|describe|meaning of)\b", q) or re.search(r"\b(how many|count|trend|chart|plot|number)\b", q):
        return None
    names = [(n, node) for node, label in nodes for base in (node.replace("_", " "), label.casefold()) for n in (base, f"{base}s") if len(n) >= 4]
    hits = [(len(n), node) for n, node in names if re.search(rf"\b{re.escape(n)}\b", q)]
    return QuerySpec(Intent.explain_taxonomy_node, taxonomy_node_id=max(hits)[1]) if hits else None


def class_count(question: str) -> QuerySpec | None:
    """"How many class X recalls ...", with no grouping and no subject."""
    if not re.search(r"\bhow many\b.*\brecalls?\b", question, re.I) or not _CLASS.search(question):
        return None
    if re.search(r"\b(by|trend|distribution|breakdown|most|top|rank\w*|firm|firms|company|companies)\b", question, re.I):
        return None
    got = conditions(question)
    return QuerySpec(Intent.count_total, tuple(got[0])) if got and not _subject(got[1]) else None


def _exposure(question: str, intent: Intent, class_needs_severity: bool) -> QuerySpec | None:
    weighted = re.search(r"\b(severity|severe|weighted|exposure|worst|risk)\b", question, re.I)
    if not re.search(r"\b(recalls?|exposure)\b", question, re.I):
        return None
    got = conditions(question)
    if got is None or _subject(got[1]):
        return None
    if class_needs_severity and not weighted and _CLASS.search(question):
        return None
    metric = ExposureMetric.severity_weighted if weighted else ExposureMetric.recall_count
    return QuerySpec(intent, tuple(got[0]), exposure_metric=metric, limit=limit_of(question))


def parent_exposure(question: str) -> QuerySpec | None:
    """Rankings of parent companies or groups."""
    if not re.search(r"\b(parent (company|companies|group|groups|firm|firms)|parents|corporate groups?)\b", question, re.I):
        return None
    return _exposure(question, Intent.parent_group_exposure, False)


def raw_exposure(question: str) -> QuerySpec | None:
    """Rankings of firms as they are named; a class without severity wording is left to a plain count."""
    if not re.search(r"\b(firms?|compan(y|ies)|entit(y|ies))\b", question, re.I) or not re.search(r"\b(top|most|highest|largest|rank\w*|leaderboard|worst)\b", question, re.I):
        return None
    return _exposure(question, Intent.raw_firm_exposure, True)


def route(question: str, nodes: list[tuple[str, str]]) -> QuerySpec | None:
    """The first router that can keep the whole question; None leaves it to a model."""
    return explanation(question, nodes) or class_count(question) or parent_exposure(question) or raw_exposure(question)


def title(question: str) -> str:
    """At most six words and 44 characters of a question."""
    words = re.findall(r"[^\s]+", re.sub(r"[?!.]+$", "", question.strip()))[:6]
    while len(" ".join(words)) > 44 and len(words) > 1:
        words.pop()
    return " ".join(words)[:44]
