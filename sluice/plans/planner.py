"""From a query spec to one lazy DataFrame.

Each binding is projected to the columns that it needs and filtered; bindings are then joined one after the other, each with
all equalities that connect it.  Catalyst pushes projections and filters into the scans, and adaptive execution picks the join
strategy; ``ordered`` first sorts the equalities by exact filtered counts, ``strategy`` forces one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.unsigned import checksum, compare
from sluice.plans.spec import ColumnRef, Equality, QueryError, QuerySpec
from sluice.sources.catalog import Catalog


def _name(ref: ColumnRef) -> str:
    return f"b{ref.binding}_c{ref.column}"


def validate(spec: QuerySpec, catalog: Catalog, allow_cross: bool = False) -> None:
    for ref in spec.refs():
        df = catalog[spec.relations[ref.binding]]
        if ref.column >= len(df.columns):
            raise QueryError(f"{ref}: relation {spec.relations[ref.binding]} has {len(df.columns)} columns")
    if not allow_cross and len(reached(spec, 0)) < len(spec.relations):
        raise QueryError("the equalities do not connect all bindings; allow_cross=True permits their product")


def reached(spec: QuerySpec, start: int) -> set[int]:
    """Bindings connected to ``start``."""
    seen, grew = {start}, True
    while grew:
        more = {b for j in spec.joins for b in (j.left.binding, j.right.binding) if seen & {j.left.binding, j.right.binding}}
        grew = not more <= seen
        seen |= more
    return seen


def scan(spec: QuerySpec, catalog: Catalog, binding: int) -> DataFrame:
    """The binding's needed columns, with its comparisons and its equalities of two own columns applied."""
    number = spec.relations[binding]
    df = catalog[number]
    for f in spec.filters:
        if f.column.binding == binding:
            df = df.where(compare(F.col(f"c{f.column.column}"), f.op, f.value, number in catalog.wide))
    for j in spec.joins:
        if j.left.binding == j.right.binding == binding:
            df = df.where(F.col(f"c{j.left.column}") == F.col(f"c{j.right.column}"))
    needed = sorted({r for r in spec.refs() if r.binding == binding})
    return df.select(*[F.col(f"c{r.column}").alias(_name(r)) for r in needed])


def cardinalities(spec: QuerySpec, catalog: Catalog) -> dict[int, int]:
    """Filtered rows of each binding; bindings of one relation with the same filters are counted once."""
    known: dict = {}
    out = {}
    for b, number in enumerate(spec.relations):
        key = number, frozenset((f.column.column, f.op, f.value) for f in spec.filters if f.column.binding == b)
        if key not in known:
            known[key] = scan(spec, catalog, b).count()
        out[b] = known[key]
    return out


def greedy_order(spec: QuerySpec, counts: dict[int, int]) -> list[Equality]:
    """Equalities of two bindings, cheapest product of filtered counts first."""
    return sorted((j for j in spec.joins if j.left.binding != j.right.binding), key=lambda j: counts[j.left.binding] * counts[j.right.binding])


def joined(spec: QuerySpec, catalog: Catalog, strategy: str | None = None, ordered: bool = False, allow_cross: bool = False) -> DataFrame:
    """The joined rows, with columns b<binding>_c<column>."""
    validate(spec, catalog, allow_cross)
    pending = greedy_order(spec, cardinalities(spec, catalog)) if ordered else [j for j in spec.joins if j.left.binding != j.right.binding]
    first = pending[0].left.binding if pending else 0
    used, out = {first}, scan(spec, catalog, first)
    while len(used) < len(spec.relations):
        # the first equality with one side joined; those with none wait
        link = next((j for j in pending if (j.left.binding in used) != (j.right.binding in used)), None)
        new = (link.right if link.left.binding in used else link.left).binding if link else min(set(range(len(spec.relations))) - used)
        right = scan(spec, catalog, new)
        if strategy:
            right = right.hint(strategy)
        links = [j for j in pending if {j.left.binding, j.right.binding} <= used | {new} and new in (j.left.binding, j.right.binding)]
        on = [F.col(_name(j.left)) == F.col(_name(j.right)) for j in links]
        out = out.join(right, on, "inner") if on else out.crossJoin(right)
        used.add(new)
    return out


def execute(spec: QuerySpec, catalog: Catalog, **options) -> DataFrame:
    """One row: the sum modulo 2^64 of each selection, as s0, s1, ...; nulls if no row qualifies."""
    rows = joined(spec, catalog, **options)
    return rows.agg(*[checksum(F.col(_name(s))).alias(f"s{i}") for i, s in enumerate(spec.selections)])


def answer(df: DataFrame) -> str:
    """The result line of an executed query."""
    return " ".join("NULL" if v is None else str(int(v)) for v in df.first())
