"""Facts and the values they are made of.

A fact is subject, predicate, object in a named graph. A predicate may carry a time anchor, in nanoseconds since 1970 with the
text it was written as. All facts are one DataFrame of FACTS columns, flat, so that Parquet filters and statistics work on each.
The canonical keys s, p and o tell kinds apart and are what joins compare.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS = (
    "graph string, s_type string, s_id string, s string, p_id string, p_ns bigint, p_txt string, p string, "
    "o_kind string, o string, on_type string, on_id string, op_id string, op_ns bigint, op_txt string, "
    "ol_type string, ol_b boolean, ol_i bigint, ol_f double, ol_t string, ol_x binary"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
BLANK = "/_"
LITERAL_COLUMNS = {"bool": "ol_b", "int64": "ol_i", "float64": "ol_f", "text": "ol_t", "blob": "ol_x"}

_TIME = re.compile(r"\"?(\d{4})-(\d\d)-(\d\d)T(\d{1,2}):(\d\d):(\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)\"?\Z")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def nanoseconds(text: str) -> int:
    """Nanoseconds since 1970 of a time with zone; hours may have one digit."""
    m = _TIME.match(text.strip())
    if not m:
        raise ValueError(f"not a time: {text!r}")
    zone = timezone.utc if m[8] == "Z" else timezone((1 if m[8][0] == "+" else -1) * timedelta(hours=int(m[8][1:3]), minutes=int(m[8][4:])))
    at = datetime(*(int(m[k]) for k in range(1, 7)), tzinfo=zone)
    return ((at - _EPOCH) // timedelta(seconds=1)) * 10**9 + int((m[7] or "0").ljust(9, "0"))


@dataclass(frozen=True)
class Node:
    type: str
    id: str

    def __post_init__(self):
        if not self.type.startswith("/") or self.type.endswith("/") or re.search(r"\s", self.type) or not self.id or re.search("[<>]", self.id):
            raise ValueError(f"not a node: {self.type}<{self.id}>")

    @property
    def key(self) -> str:
        return f"{self.type}<{self.id}>"

    def covariant(self, other: Node) -> bool:
        """Whether this node's type is the other's or below it."""
        return self.type == other.type or self.type.startswith(other.type + "/")


@dataclass(frozen=True)
class Predicate:
    """A predicate with a time, or an immutable one."""

    id: str
    at: str | None = None

    @property
    def ns(self) -> int | None:
        return None if self.at is None else nanoseconds(self.at)

    @property
    def key(self) -> str:
        return f"{self.id}@{'' if self.at is None else self.ns}"


@dataclass(frozen=True)
class Literal:
    type: str
    value: object

    def __post_init__(self):
        kinds = {"bool": bool, "int64": int, "float64": float, "text": str, "blob": bytes}
        if self.type not in kinds or not isinstance(self.value, kinds[self.type]) or (self.type == "int64" and isinstance(self.value, bool)):
            raise ValueError(f"not a literal: {self.type} {self.value!r}")

    @property
    def column(self) -> str:
        return LITERAL_COLUMNS[self.type]


def node_columns(prefix: str, kind: Column, name: Column) -> dict[str, Column]:
    return {f"{prefix}_type": kind, f"{prefix}_id": name.cast("string")}


def node_key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit("<"), name.cast("string"), F.lit(">"))


def predicate_key(name: Column, ns: Column) -> Column:
    return F.concat(name, F.lit("@"), F.coalesce(ns.cast("string"), F.lit("")))


def literal_key(kind: str, value: Column) -> Column:
    """Equal for equal values of one type only."""
    text = F.base64(value) if kind == "blob" else value.cast("string")
    return F.concat(F.lit('"'), text, F.lit(f'"^^type:{kind}'))


def time_text(ns: Column) -> Column:
    """A time in UTC, without the zeros at its end."""
    part = F.pmod(ns, F.lit(1_000_000_000))
    days = F.call_function("div", ns - F.pmod(ns, F.lit(86_400_000_000_000)), F.lit(86_400_000_000_000)).cast("int")
    second = F.call_function("div", F.pmod(ns, F.lit(86_400_000_000_000)) - part, F.lit(1_000_000_000))
    clock = F.format_string("%02d:%02d:%02d", F.call_function("div", second, F.lit(3600)), F.pmod(F.call_function("div", second, F.lit(60)), F.lit(60)), F.pmod(second, F.lit(60)))
    # by days from the epoch, so that no session's time zone comes in
    seconds = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), clock)
    rest = F.regexp_replace(F.lpad(part.cast("string"), 9, "0"), "0+$", "")
    return F.concat(seconds, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("Z"))


def fact(
    graph: str,
    subject: tuple[str, Column],
    predicate: str | Column,
    *,
    node: tuple[str, Column] | None = None,
    reified: tuple[Column, Column] | None = None,
    literal: tuple[str, Column] | None = None,
    at: Column | None = None,
) -> list[Column]:
    """The FACTS columns of one fact a row: a subject (type, id), a predicate anchored at nanoseconds or immutable, and one object."""
    name = F.lit(predicate) if isinstance(predicate, str) else predicate
    none = F.lit(None)
    ns = none.cast("bigint") if at is None else at.cast("bigint")
    values: dict[str, Column] = {
        "graph": F.lit(graph),
        **node_columns("s", F.lit(subject[0]), subject[1]),
        "s": node_key(F.lit(subject[0]), subject[1]),
        "p_id": name,
        "p_ns": ns,
        "p_txt": none if at is None else time_text(ns),
        "p": predicate_key(name, ns),
    }
    if node:
        values |= {"o_kind": F.lit("N"), "o": node_key(F.lit(node[0]), node[1]), **node_columns("on", F.lit(node[0]), node[1])}
    elif reified:
        values |= {"o_kind": F.lit("P"), "o": predicate_key(*reified), "op_id": reified[0], "op_ns": reified[1], "op_txt": time_text(reified[1])}
    elif literal:
        values |= {"o_kind": F.lit("L"), "o": literal_key(*literal), "ol_type": F.lit(literal[0]), LITERAL_COLUMNS[literal[0]]: literal[1]}
    return [values.get(c.split()[0], none).cast(c.split()[1]).alias(c.split()[0]) for c in FACTS.split(", ")]

