"""Column catalogs: which columns of a records table may be asked for, and how."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kind(str, Enum):
    DIMENSION = "dimension"
    DATE = "date"
    TEXT = "text"
    ID = "id"


#: Distinct values of a column that the value index lists at most.
VALUES_SHOWN = 60


@dataclass(frozen=True)
class Catalog:
    """The queryable columns of one table and the roles that some of them play."""

    columns: dict[str, Kind]
    key: str = "id"
    shown_id: str = "recall_number"
    entity: str = "recalling_firm"
    severity: str = "classification"
    event_date: str = "recall_initiation_date"
    classes: tuple[tuple[str, int], ...] = (("Class I", 3), ("Class II", 2), ("Class III", 1))
    sample_columns: tuple[str, ...] = ("recall_number", "recalling_firm", "classification", "reason_for_recall")
    indexed: tuple[str, ...] = ("classification", "status", "product_type", "voluntary_mandated", "initial_firm_notification", "state", "country")
    comments: dict[str, str] = field(default_factory=dict)

    def kind(self, column: str) -> Kind:
        if column not in self.columns:
            raise ValueError(f"unknown column: {column!r}")
        return self.columns[column]

    def require(self, column: str, kind: Kind) -> str:
        if self.kind(column) is not kind:
            raise ValueError(f"{column!r} is a {self.kind(column).value} column, not a {kind.value} one")
        return column


#: Columns of recall enforcement reports (fixed values: the data model).
RECALLS = Catalog(
    {name: Kind.DIMENSION for name in ("classification", "status", "product_type", "voluntary_mandated", "initial_firm_notification", "recalling_firm", "state", "country", "city", "distribution_pattern")}
    | {name: Kind.DATE for name in ("recall_initiation_date", "center_classification_date", "termination_date", "report_date")}
    | {name: Kind.TEXT for name in ("product_description", "reason_for_recall", "code_info", "product_quantity")}
    | {name: Kind.ID for name in ("recall_number", "event_id")}
)


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """df whose schema carries the comments, so that it describes itself."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(f"`{c}`") for c in df.columns])


def schema_context(df: DataFrame, catalog: Catalog) -> list[tuple[str, str, str]]:
    """(column, kind, comment) of the columns that may be asked for and exist."""
    notes = {f.name: f.metadata.get("comment", "") for f in df.schema.fields}
    return [(c, k.value, notes[c] or catalog.comments.get(c, "")) for c, k in catalog.columns.items() if c in notes]


def value_index(df: DataFrame, catalog: Catalog, shown: int = VALUES_SHOWN) -> DataFrame:
    """(column_name, value): the first `shown` distinct values, in order, of each low-cardinality column."""
    parts = []
    for c in (c for c in catalog.indexed if c in df.columns):
        values = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        parts.append(values.distinct().orderBy("value").limit(shown))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
