"""What bindings are worth: parts of their structs, comparisons by kind, sort keys, and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Literal, Node, Predicate, nanoseconds


def key(name: str) -> Column:
    return F.col(f"{name}.key")


def id_of(name: str) -> Column:
    return F.col(f"{name}.id")


def time_of(name: str) -> Column:
    """Microseconds since 1970 of a time."""
    ns = F.col(f"{name}.ns")
    return F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))


def int_of(name: str) -> Column:
    return F.col(f"{name}.i")


def float_of(name: str) -> Column:
    return F.col(f"{name}.f")


def text_of(name: str) -> Column:
    return F.col(f"{name}.txt")


def has_kind(name: str, kind: str) -> Column:
    return F.coalesce(F.col(f"{name}.kind") == kind, F.lit(False))


def _signed(left: Column, sign: str, right: Column) -> Column:
    test = {"=": left == right, "<": left < right, ">": left > right}[sign]
    return F.coalesce(test, F.lit(False))


def compare(name: str, sign: str, other: str | Literal | Node | Predicate, *, time: str | None = None) -> Column:
    """A binding against a constant: literals of its own type; times by instant; nodes and predicates for equality only.

    A value of another kind or type never passes. With time=..., the constant is that time and `other` is ignored.
    """
    if time is not None:
        return has_kind(name, "T") & _signed(F.col(f"{name}.ns"), sign, F.lit(nanoseconds(time)))
    if isinstance(other, Node | Predicate):
        if sign != "=":
            raise ValueError("nodes and predicates have no order")
        return has_kind(name, "N" if isinstance(other, Node) else "P") & _signed(key(name), "=", F.lit(other.key))
    if isinstance(other, Literal):
        part = {"bool": "b", "int64": "i", "float64": "f", "text": "txt", "blob": "x"}[other.type]
        value = F.lit(bytearray(other.value) if other.type == "blob" else other.value)
        return has_kind(name, "L") & _signed(F.col(f"{name}.type"), "=", F.lit(other.type)) & _signed(F.col(f"{name}.{part}"), sign, value)
    return has_kind(name, "S") & _signed(key(name), sign, F.lit(other))


def compare_cells(a: str, sign: str, b: str, part: str = "key") -> Column:
    """Two bindings of one kind, by a part of theirs: key, or i, f, ns for their order."""
    return _signed(F.col(f"{a}.kind"), "=", F.col(f"{b}.kind")) & _signed(F.col(f"{a}.{part}"), sign, F.col(f"{b}.{part}"))


def order(name: str, parts: tuple[str, ...] = ("key",), descending: bool = False) -> list[Column]:
    """Sort keys of a binding: nulls first, then its kind, then its typed values."""
    columns = [F.col(f"{name}.kind"), *(F.col(f"{name}.{p}") for p in parts)]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in columns]
