"""Validated filters and their lowering to Column predicates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkledger.plans.catalog import Catalog, Kind

OPS = ("eq", "ne", "in", "gte", "lte", "between", "ilike")
#: Operators that suit each kind of column.
SUITS = {
    Kind.DIMENSION: {"eq", "ne", "in"},
    Kind.ID: {"eq", "ne", "in"},
    Kind.TEXT: {"eq", "ne", "in", "ilike"},
    Kind.DATE: {"eq", "ne", "in", "gte", "lte", "between"},
}
MAX_CHARS, MAX_ITEMS, MAX_BYTES = 200, 25, 4096
_DATES = ("%Y-%m-%d", "%Y%m%d", "%Y/%m/%d")


@dataclass(frozen=True)
class Filter:
    """One condition on a column of a catalog. Conditions are always joined by AND."""

    column: str
    op: str
    value: Any

    def check(self, catalog: Catalog, strict: bool = False) -> "Filter":
        """Itself, if the column and operator are known; `strict` also asks whether they suit each other."""
        kind = catalog.kind(self.column)
        if self.op not in OPS:
            raise ValueError(f"unknown op: {self.op!r}, not one of {', '.join(OPS)}")
        if strict and self.op not in SUITS[kind]:
            raise ValueError(f"op {self.op!r} doesn't suit the {kind.value} column {self.column!r}")
        if self.op == "between" and (not isinstance(self.value, (list, tuple)) or len(self.value) != 2):
            raise ValueError("between takes two values")
        if self.op == "in" and isinstance(self.value, str):
            raise ValueError("in takes a list")
        return self


def like_pattern(text: str) -> str:
    """`%text%` as a pattern: % and _ of the text stay wildcards, an escape before any other character is that character."""
    body = re.sub(r"\\([^%_\\])", r"\1", text)
    if (len(body) - len(body.rstrip("\\"))) % 2:
        body += "\\"
    return f"%{body}%"


def predicate(f: Filter) -> Column:
    """The Column of one filter; NULLs satisfy none of the operators."""
    c, v = F.col(f"`{f.column}`"), f.value
    if f.op == "in":
        return c.isin(list(v)) if len(list(v)) else F.lit(False)
    if f.op == "between":
        return c.between(v[0], v[1])
    if f.op == "ilike":
        return c.ilike(like_pattern(str(v)))
    return {"eq": c == v, "ne": c != v, "gte": c >= v, "lte": c <= v}[f.op]


def apply(df: DataFrame, filters: Iterable[Filter], catalog: Catalog, strict: bool = False) -> DataFrame:
    """Rows of df that satisfy all filters. The predicates are plain comparisons, so they reach the file scan."""
    tests = [predicate(f.check(catalog, strict)) for f in filters]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def with_label(df: DataFrame, labels: DataFrame, node_id: str, catalog: Catalog, version: str = "v1") -> DataFrame:
    """Rows whose record has the label, each once however often it has it."""
    have = labels.where((F.col("version") == version) & (F.col("node_id") == node_id)).select(F.col("record_id").alias(catalog.key))
    return df.join(have, catalog.key, "left_semi")


def not_blank(column: str) -> Column:
    """Not null and not spaces alone."""
    return F.col(f"`{column}`").isNotNull() & (F.btrim(F.col(f"`{column}`")) != "")


def parse_date(text: Any) -> date:
    """A date in one of three notations; anything else is an error."""
    if isinstance(text, datetime):
        return text.date()
    if isinstance(text, date):
        return text
    for form in _DATES:
        try:
            return datetime.strptime(str(text).strip(), form).date()
        except ValueError:
            continue
    raise ValueError(f"not a date: {text!r}")


def lower_filter(column: str, op: str, value: Any, catalog: Catalog, strict: bool = False) -> Filter:
    """A filter with dates parsed and the number of values checked."""
    kind = catalog.kind(column)
    if value is None:
        raise ValueError(f"filter on {column!r} has no value")
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError("between takes two values")
        value = tuple(parse_date(v) if kind is Kind.DATE else v for v in value)
    elif op == "in":
        value = [parse_date(v) if kind is Kind.DATE else v for v in (value if isinstance(value, (list, tuple)) else [value])]
    elif kind is Kind.DATE and op != "ilike":
        value = parse_date(value[0] if isinstance(value, (list, tuple)) and len(value) == 1 else value)
    elif isinstance(value, (list, tuple)):
        if len(value) != 1:
            raise ValueError(f"{op} takes one value")
        value = value[0]
    return Filter(column, op, value).check(catalog, strict)


def coerce_filters(payload: dict[str, Any] | None, catalog: Catalog) -> list[Filter]:
    """Filters of a request object: a scalar means eq, a list in, {"op", "value"} itself, {"gte", "lte"} both bounds.

    Null, empty strings and empty lists are skipped. Strings, lists and the whole object are capped; every value is a
    string; operators must suit their columns.
    """
    if not payload:
        return []
    if not isinstance(payload, dict):
        raise ValueError("filters must be an object")
    if len(json.dumps(payload, default=str).encode()) > MAX_BYTES:
        raise ValueError(f"filters exceed {MAX_BYTES} bytes")
    found: list[Filter] = []
    for column, given in payload.items():
        kind = catalog.kind(column)
        if given is None or given == "" or given == []:
            continue
        if isinstance(given, dict):
            if "op" in given:
                parts = [(given["op"], given.get("value"))]
            else:
                if unknown := set(given) - set(OPS):
                    raise ValueError(f"unknown op: {sorted(unknown)[0]!r}")
                parts = list(given.items())
        else:
            parts = [("in" if isinstance(given, list) else "eq", given)]
        for op, value in parts:
            if value is None or value == "" or value == []:
                continue
            items: Sequence[Any] = value if isinstance(value, (list, tuple)) else [value]
            if len(items) > MAX_ITEMS:
                raise ValueError(f"{column!r} lists more than {MAX_ITEMS} values")
            for x in items:
                if not isinstance(x, str):
                    raise ValueError(f"values of {column!r} must be strings")
                if len(x) > MAX_CHARS:
                    raise ValueError(f"a value of {column!r} exceeds {MAX_CHARS} characters")
            if op not in OPS or op not in SUITS[kind]:
                raise ValueError(f"op {op!r} doesn't suit the {kind.value} column {column!r}")
            found.append(lower_filter(column, op, value, catalog, strict=True))
    return found
