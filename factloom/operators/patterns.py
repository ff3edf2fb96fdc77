"""Graph patterns: clauses over facts, joined on the bindings they share.

A binding is a column that holds a struct: kind ('N' node, 'P' predicate, 'L' literal, 'S' text, 'T' time) and key, which
alone is compared in joins and groups, and what else its kind has. Objects may be of any kind, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Literal, Node, Predicate, nanoseconds
from .lookups import FILTERS, is_object, is_predicate, is_subject, within


#: The most pairs that one part of a join of large groups makes, about.
PART_PAIRS = 4_000_000


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Anchored:
    """A predicate's name with what its anchor must be: bound to a variable, or in a range with ends that may be open.

    Ends are times as text or variables bound to times by earlier clauses.
    """

    id: str
    at: Var | None = None
    low: str | Var | None = None
    high: str | Var | None = None

    def __post_init__(self):
        if isinstance(self.low, str) and isinstance(self.high, str) and nanoseconds(self.low) > nanoseconds(self.high):
            raise ValueError("the range ends before it starts")


@dataclass(frozen=True)
class Part:
    """A subject, predicate or object: a constant or a variable, and variables for what it holds."""

    value: Var | Node | Predicate | Literal | Anchored
    alias: Var | None = None
    id: Var | None = None
    type: Var | None = None
    at: Var | None = None


@dataclass(frozen=True)
class Clause:
    subject: Part
    predicate: Part
    object: Part
    optional: bool = False


@dataclass(frozen=True)
class Filter:
    """latest, isImmutable or isTemporal of the predicate or object that a variable stands for."""

    name: str
    of: Var
    #: names of variables it looks at, for error messages
    known: tuple[str, ...] = field(default=tuple(FILTERS))


def part(x: Var | Node | Predicate | Literal | Anchored | Part) -> Part:
    return x if isinstance(x, Part) else Part(x)


def clause(s, p, o, optional: bool = False) -> Clause:
    return Clause(part(s), part(p), part(o), optional)


def optional(s, p, o) -> Clause:
    return clause(s, p, o, True)


def _node(prefix: str, key: str) -> Column:
    return F.struct(F.lit("N").alias("kind"), F.col(key).alias("key"), F.col(f"{prefix}_type").alias("type"), F.col(f"{prefix}_id").alias("id"))


def _predicate(prefix: str, key: Column) -> Column:
    return F.struct(F.lit("P").alias("kind"), key.alias("key"), F.col(f"{prefix}_id").alias("id"), F.col(f"{prefix}_ns").alias("ns"), F.col(f"{prefix}_txt").alias("txt"))


def _object() -> Column:
    return F.struct(
        F.col("o_kind").alias("kind"),
        F.col("o").alias("key"),
        F.coalesce("on_type", "ol_type").alias("type"),
        F.coalesce("on_id", "op_id").alias("id"),
        F.col("op_ns").alias("ns"),
        F.coalesce("op_txt", "ol_t").alias("txt"),
        F.col("ol_b").alias("b"),
        F.col("ol_i").alias("i"),
        F.col("ol_f").alias("f"),
        F.col("ol_x").alias("x"),
    )


def _text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit("S").alias("kind"), value.alias("key"), value.alias("txt")))


def _time(prefix: str) -> Column:
    ns = F.col(f"{prefix}_ns")
    return F.when(ns.isNotNull(), F.struct(F.lit("T").alias("kind"), ns.cast("string").alias("key"), ns.alias("ns"), F.col(f"{prefix}_txt").alias("txt")))


def _bindings(c: Clause) -> list[tuple[str, Column, str | None, bool]]:
    """(variable, value, kind or None for any, whether a missing value drops the row) of a clause, in reading order."""
    out: list[tuple[str, Column, str | None, bool]] = []

    def add(var: Var | None, value: Column, kind: str | None, may_miss: bool = False) -> None:
        if var is not None:
            out.append((var.name, value, kind, may_miss))

    s, p, o = c.subject, c.predicate, c.object
    add(s.value if isinstance(s.value, Var) else None, _node("s", "s"), "N")
    add(s.alias, _node("s", "s"), "N")
    add(s.type, _text(F.col("s_type")), "S")
    add(s.id, _text(F.col("s_id")), "S")
    add(p.value if isinstance(p.value, Var) else None, _predicate("p", F.col("p")), "P")
    add(p.alias, _predicate("p", F.col("p")), "P")
    add(p.id, _text(F.col("p_id")), "S")
    if isinstance(p.value, Anchored):
        add(p.value.at, _time("p"), "T", True)
    add(p.at, _time("p"), "T", True)
    add(o.value if isinstance(o.value, Var) else None, _object(), None)
    add(o.alias, _object(), None)
    add(o.type, _text(F.col("on_type")), "S", True)
    own = o.value.name if isinstance(o.value, Var) else None
    # an id that is named like the object itself stands for it
    add(o.id if o.id is None or o.id.name != own else None, _text(F.coalesce("on_id", "op_id")), "S", True)
    if isinstance(o.value, Anchored):
        add(o.value.at, _time("op"), "T", True)
    add(o.at, _time("op"), "T", True)
    return out


def _fixed(value: object, bound: set[str]) -> bool:
    return (isinstance(value, Var) and value.name in bound) or isinstance(value, Node | Predicate | Literal)


def _with_ends(facts: DataFrame, value: object, prefix: str, misses: bool) -> tuple[DataFrame, list[tuple[str, str, Var]]]:
    """Facts whose anchor passes the constant ends of a range, and the ends that are variables: (column, '>=' or '<=', variable)."""
    if not isinstance(value, Anchored):
        return facts, []
    facts = facts.filter(F.col(f"{prefix}_id") == value.id)
    if value.at is None or not misses:
        facts = facts.filter(F.col(f"{prefix}_ns").isNotNull())
    ends = []
    for end, sign in ((value.low, ">="), (value.high, "<=")):
        if isinstance(end, str):
            at = nanoseconds(end)
            facts = facts.filter(F.col(f"{prefix}_ns") >= at if sign == ">=" else F.col(f"{prefix}_ns") <= at)
        elif end is not None:
            ends.append((f"{prefix}_ns", sign, end))
    return facts, ends


def scan(facts: DataFrame, c: Clause, bound: dict[str, str | None], filters: tuple[Filter, ...] = (), low: int | None = None, high: int | None = None) -> tuple[DataFrame, list[tuple[str, str, Var]]]:
    """The clause's bindings for all facts that match it by itself, and the range ends that other clauses bind.

    Constants and bounds come first, then filters, then what anchors must be: 'latest' is the last within the bounds.
    """
    s, p, o = c.subject.value, c.predicate.value, c.object.value
    found = facts
    if isinstance(s, Node):
        found = found.filter(is_subject(s))
    if isinstance(p, Predicate):
        found = found.filter(is_predicate(p))
    if isinstance(o, Node | Predicate | Literal):
        found = found.filter(is_object(o))
    found = found.filter(within(low, high))
    found, ends = _with_ends(found, p, "p", c.optional)
    for f in filters:
        if f.name.lower() not in FILTERS:
            raise ValueError(f"no filter {f.name!r}")
        places = [place for place, q in (("p", c.predicate), ("op", c.object)) if f.of in (q.value, q.alias)]
        if places:
            by = tuple(k for k, v in (("s", s), ("p", p), ("o", o)) if _fixed(v, set(bound)))
            found = FILTERS[f.name.lower()](found, places[0], by)
        elif f.of in (c.subject.value, c.subject.alias):
            raise ValueError("filters take predicates and objects")
    if isinstance(o, Anchored):
        found = found.filter(F.col("o_kind") == "P")
        found, more = _with_ends(found, o, "op", c.optional)
        ends += more
    columns: dict[str, Column] = {}
    kinds: dict[str, str | None] = {}
    for name, value, kind, may_miss in _bindings(c):
        if may_miss and not c.optional:
            found = found.filter(value.isNotNull())
        if name in columns:  # the same variable twice in a clause
            if kinds[name] and kind and kinds[name] != kind:
                found = found.limit(0)
            found = found.filter(columns[name]["key"] == value["key"])
            continue
        columns[name], kinds[name] = value, kind
    outs = [value.alias(name) for name, value in columns.items()]
    extra = [F.col(column).alias(f"_end{k}") for k, (column, _, _) in enumerate(ends)]
    return found.select(*outs, *extra), [(f"_end{k}", sign, var) for k, (_, sign, var) in enumerate(ends)]


def _dealt(left: DataFrame, right: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column _part: where a value pairs large groups, its rows of the left are dealt to parts and each part gets those of the right.

    Values go by a hash, and two of one hash only make parts smaller. Broadcast are the values of more than PART_PAIRS pairs: at most a row
    in 2,000 of both sides.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("_hash", F.xxhash64(*[F.col(f"{c}.key") for c in shared]))
    right = right.withColumn("_hash", F.xxhash64(*[F.col(f"_other_{c}.key") for c in shared]))
    sizes = left.select("_hash", F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select("_hash", F.lit(0), F.lit(1)))
    pairs = F.sum("_l").cast("double") * F.sum("_r")
    large = sizes.groupBy("_hash").agg(F.sum("_l").alias("_l"), pairs.alias("_pairs")).filter(F.col("_pairs") > PART_PAIRS)
    large = F.broadcast(large.select("_hash", F.least(F.ceil(F.col("_pairs") / PART_PAIRS), "_l").cast("int").alias("_parts")))
    keys = [F.col(f"{c}.key") for c in left.columns if not c.startswith("_")]
    left = left.join(large, "_hash", "left").withColumn("_part", F.pmod(F.xxhash64(*keys), F.coalesce("_parts", F.lit(1))).cast("int"))
    right = right.join(large, "_hash", "left").withColumn("_other_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    # a fixed number of tasks, since rows that are few may make very many pairs; on both sides, since either may be sent to all tasks of the other
    left = left.drop("_hash", "_parts").repartition(parts, *[F.col(f"{c}.key") for c in shared], "_part")
    return left, right.drop("_hash", "_parts").repartition(parts, *[F.col(f"_other_{c}.key") for c in shared], "_other_part")


def _merge(left: DataFrame, right: DataFrame, ends: list[tuple[str, str, Var]], is_optional: bool, in_groups: bool = False) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    own = [c for c in right.columns if c not in left.columns and not c.startswith("_end")]
    for c in shared:
        right = right.withColumnRenamed(c, f"_other_{c}")
    columns = left.columns
    on = [F.col(f"{c}.key") == F.col(f"_other_{c}.key") for c in shared]
    if shared and in_groups:
        left, right = _dealt(left, right, shared)
        on.append(F.col("_part") == F.col("_other_part"))
    for column, sign, var in ends:
        if var.name not in left.columns:
            raise ValueError(f"no earlier clause binds ?{var.name}")
        on.append(F.col(column) >= F.col(f"{var.name}.ns") if sign == ">=" else F.col(column) <= F.col(f"{var.name}.ns"))
    if not on and not is_optional:
        joined = left.crossJoin(right)
    elif not on:
        # rows of the left are dealt to parts and each part gets the right: by a shuffle, since its size has no bound
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = F.pmod(F.xxhash64(*[F.col(f"{c}.key") for c in left.columns if not c.startswith("_")]), F.lit(parts)).cast("int")
        every = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_every"))
        joined = left.withColumn("_part", dealt).join(every, F.col("_part") == F.col("_every"), "left")
    else:
        condition = F.lit(True)
        for x in on:
            condition &= x
        joined = left.join(right, condition, "left" if is_optional else "inner")
    return joined.select(*columns, *own)


def match(facts: DataFrame, clauses: list[Clause], filters: tuple[Filter, ...] = (), before: str | None = None, after: str | None = None) -> DataFrame:
    """A column for each variable, a row for each way in which facts match all clauses.

    Clauses share variables by equal values; nothing else removes rows, so repeats stay. An optional clause without a
    match leaves its new variables null; it can't be the first. `after` and `before` bound the anchors of all facts, ends included.
    """
    if not clauses or clauses[0].optional:
        raise ValueError("a pattern starts with a clause that is not optional")
    low, high = (None if t is None else nanoseconds(t) for t in (after, before))
    whole: DataFrame | None = None
    tests: list[DataFrame] = []
    bound: dict[str, str | None] = {}
    subjects: set[str] = set()
    for c in clauses:
        # a subject has few facts of a predicate; values that are no clause's subject may pair groups of any size
        before_it = set(bound)
        subjects |= {v.name for v in (c.subject.value, c.subject.alias, c.subject.id) if isinstance(v, Var)}
        here, ends = scan(facts, c, bound, filters, low, high)
        bound |= {name: kind for name, _, kind, _ in _bindings(c)}
        if not here.columns or all(x.startswith("_end") for x in here.columns) and not ends:
            if not c.optional:  # nothing to bind: the fact must exist
                tests.append(here.select(F.lit(1).alias("_exists")).limit(1))
            continue
        if whole is None:
            if ends:
                raise ValueError(f"no earlier clause binds ?{ends[0][2].name}")
            whole = here
        else:
            whole = _merge(whole, here, ends, c.optional, not subjects & before_it & set(here.columns))
    if whole is None:
        whole, *tests = tests
    for t in tests:
        whole = whole.join(t, F.lit(True), "left_semi")
    return whole
