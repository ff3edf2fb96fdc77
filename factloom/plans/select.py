"""Selections over patterns: projection, groups, conditions, order and limit, in the order in which they apply."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import time_text
from ..operators.patterns import Clause, Filter, match


@dataclass(frozen=True)
class Out:
    """An output column: a binding, or an aggregate of one ('count', 'count_distinct', 'sum_int', 'sum_float')."""

    name: str
    of: str
    how: str | None = None

    @property
    def column(self) -> Column:
        if self.how is None:
            return F.col(self.of).alias(self.name)
        found = {
            "count": lambda: F.count(F.lit(1)),
            # null counts as a value
            "count_distinct": lambda: F.count_distinct(F.coalesce(F.col(f"{self.of}.key"), F.lit("<NULL>"))),
            "sum_int": lambda: F.sum(_typed(self.of, "int64", "i")),
            "sum_float": lambda: F.sum(_typed(self.of, "float64", "f")),
        }[self.how]()
        return found.alias(self.name)


def _typed(name: str, kind: str, part: str) -> Column:
    """The number of a literal; an error for a value of another type."""
    wrong = F.raise_error(F.concat(F.lit(f"the sum of ?{name} takes {kind} only, not "), F.coalesce(F.col(f"{name}.type"), F.col(f"{name}.kind"))))
    return F.when(F.col(f"{name}.kind").isNull() | (F.col(f"{name}.type") == kind), F.col(f"{name}.{part}")).otherwise(wrong.cast("bigint" if part == "i" else "double"))


def _group(rows: DataFrame, name: str) -> Column:
    """A binding as a group: times as their UTC text, so that one instant is one group. It is hashed whole, without sorting."""
    parts = rows.schema[name].dataType.names
    if "ns" not in parts:
        return F.col(name)
    txt = F.when(F.col(f"{name}.ns").isNotNull(), time_text(F.col(f"{name}.ns"))).otherwise(F.col(f"{name}.txt"))
    return F.when(F.col(name).isNotNull(), F.struct(*[(txt if p == "txt" else F.col(f"{name}.{p}")).alias(p) for p in parts]))


def select(
    facts: DataFrame,
    clauses: list[Clause],
    outs: list[Out],
    *,
    graphs: tuple[str, ...] = (),
    filters: tuple[Filter, ...] = (),
    group_by: tuple[str, ...] = (),
    having: Column | None = None,
    order_by: tuple[Column, ...] | Callable[[], list[Column]] = (),
    limit: int | None = None,
    before: str | None = None,
    after: str | None = None,
) -> DataFrame:
    """Without groups, conditions see all variables; with groups, the outputs. Groups are named by output, also by an alias."""
    source = facts.filter(F.col("graph").isin(*graphs)) if graphs else facts
    rows = match(source, clauses, filters, before, after)
    missing = {o.of for o in outs} - set(rows.columns)
    if missing:
        raise ValueError(f"no clause binds {sorted(missing)}")
    aggregates = [o for o in outs if o.how]
    if group_by:
        plain = {o.name: o.of for o in outs if not o.how}
        if set(group_by) != set(plain):
            raise ValueError("outputs are groups or aggregates")
        keys = [_group(rows, plain[g]).alias(g) for g in group_by]
        rows = rows.groupBy(*keys).agg(*[o.column for o in aggregates]) if aggregates else rows.select(*keys).distinct()
    elif aggregates:
        raise ValueError("aggregates need groups")
    if having is not None:
        rows = rows.filter(having)
    keys = order_by() if callable(order_by) else order_by
    if not group_by:
        # conditions and order may use variables that are not put out
        rows = rows.withColumns({o.name: F.col(o.of) for o in outs if o.name != o.of})
    if keys:
        rows = rows.orderBy(*keys)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.select(*[o.name for o in outs])
