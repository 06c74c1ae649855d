"""Arguments of an update run and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_columns(entries: Sequence[str | None]) -> list[str]:
    """Clean the user's update-column list: trim, drop blanks, keep order and repeats."""
    out = []
    for e in entries:
        v = (e or "").strip()
        if v:
            out.append(v)
    return out


def normalize_columns_expr(text: Column, sep: str = ",") -> Column:
    """The same cleaning as a column expression over a separated list in text."""
    parts = F.transform(F.split(text, sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


@dataclass(frozen=True)
class UpdateSpec:
    """What to change and how strictly.

    ``on_failure``: ``"keep"`` publishes the good rows (the tool's code path),
    ``"restore"`` publishes nothing when any change fails (its documentation).
    ``unmatched``: ``"ignore"`` skips change keys absent from the target,
    ``"fail"`` counts them as failures.
    """

    table: str
    key_column: str
    update_columns: tuple[str, ...]
    not_null: frozenset[str] = field(default_factory=frozenset)
    schema: str = ""
    on_failure: str = "keep"
    unmatched: str = "ignore"
    max_rows: int | None = None          # None: no row limit at scale
    max_text: int | None = None          # staged text limit (4000 in the tool)
    row_key: tuple[str, ...] = ()        # what tells the target rows of one key apart (undo in a version store)

    def __post_init__(self):
        object.__setattr__(self, "update_columns", tuple(normalize_columns(self.update_columns)))
        object.__setattr__(self, "not_null", frozenset(c.upper() for c in self.not_null))
        problems = self.argument_problems()
        if problems:
            raise ValueError("; ".join(problems))

    def argument_problems(self) -> list[str]:
        out = []
        if not (self.table or "").strip():
            out.append("target table is required")
        if not (self.key_column or "").strip():
            out.append("key column is required")
        if not self.update_columns:
            out.append("at least one update column is required")
        seen = set()
        for c in self.update_columns:
            if c.upper() in seen:
                out.append(f"update column {c!r} is listed twice")
            seen.add(c.upper())
        if self.on_failure not in ("keep", "restore"):
            out.append("on_failure must be 'keep' or 'restore'")
        if self.unmatched not in ("ignore", "fail"):
            out.append("unmatched must be 'ignore' or 'fail'")
        return out

    def is_not_null(self, column: str) -> bool:
        return column.upper() in self.not_null
