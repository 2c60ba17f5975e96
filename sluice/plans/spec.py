"""Compact text queries: ``relations|predicates|selections``.

    0 2 4|0.1=1.1&1.0>3|0.1 1.4

Relations are catalog numbers; a binding is a place in that list.  A predicate equates two columns, or compares a column
with a constant by =, < or >.  Each selection is summed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """The text is no query, or the query cannot be planned."""


@dataclass(frozen=True, order=True)
class ColumnRef:
    binding: int
    column: int

    def __str__(self) -> str:
        return f"{self.binding}.{self.column}"

    @property
    def sql(self) -> str:
        return f'"{self.binding}".c{self.column}'


@dataclass(frozen=True)
class Equality:
    left: ColumnRef
    right: ColumnRef

    def __str__(self) -> str:
        return f"{self.left}={self.right}"

    @property
    def sql(self) -> str:
        return f"{self.left.sql}={self.right.sql}"


@dataclass(frozen=True)
class Comparison:
    column: ColumnRef
    op: str
    value: int

    def __str__(self) -> str:
        return f"{self.column}{self.op}{self.value}"

    @property
    def sql(self) -> str:
        return f"{self.column.sql}{self.op}{self.value}"


_REF = re.compile(r"(\d+)\.(\d+)")
_PREDICATE = re.compile(r"(\d+\.\d+)(=|<|>)(\d+\.\d+|\d+)")


def parse_refs(text: str) -> tuple[ColumnRef, ...]:
    out = []
    for word in text.split():
        if not (m := _REF.fullmatch(word)):
            raise QueryError(f"{word!r} is no column")
        out.append(ColumnRef(int(m[1]), int(m[2])))
    return tuple(out)


def parse_predicates(text: str) -> tuple[tuple[Equality, ...], tuple[Comparison, ...]]:
    joins, filters = [], []
    for word in filter(None, text.strip().split("&")):
        if not (m := _PREDICATE.fullmatch(word.strip())):
            raise QueryError(f"{word!r} is no predicate")
        (left,) = parse_refs(m[1])
        if "." in m[3]:
            if m[2] != "=":
                raise QueryError(f"{word!r}: columns can only be equated")
            joins.append(Equality(left, *parse_refs(m[3])))
        elif int(m[3]) >= 1 << 64:
            raise QueryError(f"{word!r}: the constant leaves 64 bits")
        else:
            filters.append(Comparison(left, m[2], int(m[3])))
    return tuple(joins), tuple(filters)


@dataclass(frozen=True)
class QuerySpec:
    relations: tuple[int, ...]
    joins: tuple[Equality, ...]
    filters: tuple[Comparison, ...]
    selections: tuple[ColumnRef, ...]

    @classmethod
    def parse(cls, text: str) -> QuerySpec:
        parts = text.strip().split("|")
        if len(parts) != 3:
            raise QueryError(f"{text!r} must have three parts")
        ids = parts[0].split()
        if not ids or not all(x.isdigit() for x in ids):
            raise QueryError(f"{parts[0]!r} is no list of relations")
        spec = cls(tuple(map(int, ids)), *parse_predicates(parts[1]), parse_refs(parts[2]))
        for ref in spec.refs():
            if ref.binding >= len(ids):
                raise QueryError(f"{ref}: there are {len(ids)} bindings")
        if not spec.selections:
            raise QueryError("nothing is selected")
        return spec

    def refs(self) -> list[ColumnRef]:
        return [*self.selections, *(r for j in self.joins for r in (j.left, j.right)), *(f.column for f in self.filters)]

    def to_text(self) -> str:
        """Canonical text: equalities first, then comparisons."""
        return "|".join([" ".join(map(str, self.relations)), "&".join(map(str, [*self.joins, *self.filters])), " ".join(map(str, self.selections))])

    def to_sql(self) -> str:
        where = " and ".join(x.sql for x in [*self.joins, *self.filters])
        tables = ", ".join(f'r{r} "{i}"' for i, r in enumerate(self.relations))
        return f"SELECT {', '.join(f'SUM({s.sql})' for s in self.selections)} FROM {tables}" + (f" WHERE {where}" if where else "") + ";"
