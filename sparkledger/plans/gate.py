"""What a question is about, before a specification is made of it: answered at once or handed on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

# fixed values: the routes of a question
ROUTES = ("in_domain", "chitchat_meta", "out_of_domain", "ambiguous")
MAX_SUGGESTIONS = 3

#: What is said on a route whose classifier gives no message.
MESSAGES = {
    "chitchat_meta": "This engine answers questions about drug recall records, each figure with the records behind it: counts, trends, rankings, examples and estimates.",
    "out_of_domain": "Only drug recall records can be asked about: their number, course over time, firms, classes, products and reasons.",
    "ambiguous": "The question is too wide to be run. Name a reason, a firm, a class, a span of time or a product.",
}
SUGGESTIONS = ("How many Class I recalls were there?", "Show some recalls about sterility.", "Which firms had the most Class I recalls?")


@dataclass(frozen=True)
class Decision:
    route: str
    reason: str
    message: str = ""
    suggestions: tuple[str, ...] = ()


def decide(question: str, classify: Callable[[str], Mapping]) -> Decision:
    """The route of a question by a classifier that returns route, reason, message and suggestions (all but route optional).

    A blank question is ambiguous without being asked about; a classifier's errors go to the caller, and a route that
    isn't known is one.
    """
    if not (question or "").strip():
        return Decision("ambiguous", "empty_question", MESSAGES["ambiguous"], SUGGESTIONS[:2])
    said = classify(question)
    route = said.get("route")
    if route not in ROUTES:
        raise ValueError(f"unknown route {route!r}")
    reason = (said.get("reason") or "").strip() or f"llm_{route}"
    if route == "in_domain":
        return Decision(route, reason)
    offered = tuple(s.strip() for s in said.get("suggestions") or () if s and s.strip())[:MAX_SUGGESTIONS]
    return Decision(route, reason, (said.get("message") or "").strip() or MESSAGES[route], offered or SUGGESTIONS)


def closing(decision: Decision) -> dict | None:
    """The payload that ends a question here; None if it is to be run."""
    if decision.route == "in_domain":
        return None
    kind = "clarification" if decision.route == "ambiguous" else "message"
    return {"kind": kind, "route": decision.route, "message": decision.message, "reason": decision.reason, "suggestions": list(decision.suggestions)}
