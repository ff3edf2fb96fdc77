"""Lookups of facts by what is known of them, their options, and the filters of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Literal, Node, Predicate


def is_subject(node: Node) -> Column:
    return (F.col("s") == node.key) & (F.col("s_type") == node.type)


def is_predicate(p: Predicate) -> Column:
    """The same name and the same instant, or none on both sides."""
    return (F.col("p_id") == p.id) & (F.col("p_ns").isNull() if p.at is None else F.col("p_ns") == p.ns)


def is_object(o: Node | Predicate | Literal) -> Column:
    if isinstance(o, Node):
        return (F.col("o_kind") == "N") & (F.col("o") == o.key) & (F.col("on_type") == o.type)
    if isinstance(o, Predicate):
        return (F.col("o_kind") == "P") & (F.col("op_id") == o.id) & (F.col("op_ns").isNull() if o.at is None else F.col("op_ns") == o.ns)
    return (F.col("ol_type") == o.type) & (F.col(o.column) == F.lit(bytearray(o.value) if o.type == "blob" else o.value))


def in_graphs(facts: DataFrame, *graphs: str) -> DataFrame:
    """All facts of the graphs: one that is in two of them is two rows."""
    return facts.filter(F.col("graph").isin(*graphs))


def within(low: int | None = None, high: int | None = None) -> Column:
    """Both ends belong to it; immutable facts always pass."""
    ok = F.lit(True)
    if low is not None:
        ok &= F.col("p_ns") >= low
    if high is not None:
        ok &= F.col("p_ns") <= high
    return F.col("p_ns").isNull() | ok


def is_immutable(of: str = "p") -> Column:
    """Predicates without an anchor; with of='op', objects that are such predicates."""
    return F.col("p_ns").isNull() if of == "p" else (F.col("o_kind") == "P") & F.col("op_ns").isNull()


def is_temporal(of: str = "p") -> Column:
    return F.col(f"{of}_ns").isNotNull()


def latest(facts: DataFrame, of: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Facts whose anchor is the last of their predicate's name, in each graph and each combination of `by`; ties stay.

    The last anchors are aggregated before they meet the facts, so one name that holds most facts is no task's burden.
    """
    keys = ["graph", *by, f"{of}_id"]
    last = facts.filter(is_temporal(of)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(f"{of}_ns").alias("_last"))
    same = F.col(f"{of}_ns") == F.col("_last")
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return facts.join(last, same).select(*facts.columns)


#: Filters of patterns by name; a filter takes facts, the predicate's place and the columns that earlier clauses fix.
FILTERS = {
    "latest": latest,
    "isimmutable": lambda facts, of, by: facts.filter(is_immutable(of)),
    "istemporal": lambda facts, of, by: facts.filter(is_temporal(of)),
}


def lookup(
    facts: DataFrame,
    subject: Node | None = None,
    predicate: Predicate | None = None,
    obj: Node | Predicate | Literal | None = None,
    *,
    low: int | None = None,
    high: int | None = None,
    filtered: str | None = None,
    of: str = "p",
    page: int | None = None,
    size: int | None = None,
) -> DataFrame:
    """Facts with the given parts, within the bounds, then filtered, then page `page` (from 0) of `size` in order of their text."""
    found = facts
    for given, test in ((subject, is_subject), (predicate, is_predicate), (obj, is_object)):
        if given is not None:
            found = found.filter(test(given))
    found = found.filter(within(low, high))
    if filtered:
        found = FILTERS[filtered.lower()](found, of, ())
    if size:
        found = found.orderBy("graph", "s", "p_id", F.col("p_ns").asc_nulls_first(), "o").offset((page or 0) * size).limit(size)
    return found


def exists(facts: DataFrame, subject: Node, predicate: Predicate, obj: Node | Predicate | Literal) -> DataFrame:
    """One row if any graph has the fact, else none."""
    return lookup(facts, subject, predicate, obj).select(F.lit(1).alias("found")).limit(1)


def predicates_of(facts: DataFrame, subject: Node | None = None, obj: Node | Predicate | Literal | None = None) -> DataFrame:
    """Predicates of the facts of a subject, an object, or both."""
    return lookup(facts, subject, None, obj).select("p_id", "p_ns", "p_txt")


def set_union(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Facts of both; a fact is once in a graph."""
    return facts.unionByName(more).dropDuplicates(["graph", "s", "p", "o"])


def set_difference(facts: DataFrame, gone: DataFrame) -> DataFrame:
    return facts.join(gone.select("graph", "s", "p", "o").distinct(), ["graph", "s", "p", "o"], "left_anti").select(*facts.columns)
