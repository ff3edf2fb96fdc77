"""Facts made of bindings: templates, and facts about facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLANK, COLUMNS, FACTS, Literal, Node, Predicate, literal_key, node_key, predicate_key
from .patterns import Anchored, Var

_TYPES = dict(c.split() for c in FACTS.split(", "))


@dataclass(frozen=True)
class Template:
    """A fact to make of each row; `more` are further (predicate, object) pairs that tell about that fact."""

    subject: Node | Var
    predicate: Predicate | Anchored | Var
    object: Node | Predicate | Literal | Var
    more: tuple[tuple[Predicate | Anchored | Var, Node | Predicate | Literal | Var], ...] = ()


def blank(label: str) -> Node:
    """A constant blank node."""
    return Node(BLANK, label)


def _must(test: Column, value: Column, what: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(what)).cast("string"))


def _subject(x: Node | Var) -> dict[str, Column]:
    if isinstance(x, Node):
        return {"s_type": F.lit(x.type), "s_id": F.lit(x.id), "s": F.lit(x.key)}
    key = _must(F.col(f"{x.name}.kind") == "N", F.col(f"{x.name}.key"), f"?{x.name} is no node and can't be a subject")
    return {"s_type": F.col(f"{x.name}.type"), "s_id": F.col(f"{x.name}.id"), "s": key}


def _predicate(x: Predicate | Anchored | Var) -> dict[str, Column]:
    if isinstance(x, Predicate):
        return {"p_id": F.lit(x.id), "p_ns": F.lit(x.ns), "p_txt": F.lit(x.at), "p": F.lit(x.key)}
    if isinstance(x, Anchored):
        ns = F.col(f"{x.at.name}.ns")
        key = _must(F.col(f"{x.at.name}.kind") == "T", predicate_key(F.lit(x.id), ns), f"?{x.at.name} is no time")
        return {"p_id": F.lit(x.id), "p_ns": ns, "p_txt": F.col(f"{x.at.name}.txt"), "p": key}
    key = _must(F.col(f"{x.name}.kind") == "P", F.col(f"{x.name}.key"), f"?{x.name} is no predicate")
    return {"p_id": F.col(f"{x.name}.id"), "p_ns": F.col(f"{x.name}.ns"), "p_txt": F.col(f"{x.name}.txt"), "p": key}


def _object(x: Node | Predicate | Literal | Var, rows: DataFrame) -> dict[str, Column]:
    if isinstance(x, Node):
        return {"o_kind": F.lit("N"), "o": F.lit(x.key), "on_type": F.lit(x.type), "on_id": F.lit(x.id)}
    if isinstance(x, Predicate):
        return {"o_kind": F.lit("P"), "o": F.lit(x.key), "op_id": F.lit(x.id), "op_ns": F.lit(x.ns), "op_txt": F.lit(x.at)}
    if isinstance(x, Literal):
        value = F.lit(bytearray(x.value) if x.type == "blob" else x.value)
        return {"o_kind": F.lit("L"), "o": literal_key(x.type, value), "ol_type": F.lit(x.type), x.column: value}
    has = set(rows.schema[x.name].dataType.names)
    kind = F.col(f"{x.name}.kind")

    def get(part: str, of: str) -> Column:
        return F.when(kind == of, F.col(f"{x.name}.{part}")) if part in has else F.lit(None)

    literal = {c: get(part, "L") for c, part in (("ol_type", "type"), ("ol_b", "b"), ("ol_i", "i"), ("ol_f", "f"), ("ol_x", "x"))}
    text = F.when(F.col(f"{x.name}.type") == "text", get("txt", "L")) if {"txt", "type"} <= has else F.lit(None)
    key = _must(kind.isin("N", "P", "L"), F.col(f"{x.name}.key"), f"?{x.name} can't be an object")
    return {"o_kind": kind, "o": key, "on_type": get("type", "N"), "on_id": get("id", "N"), "op_id": get("id", "P"), "op_ns": get("ns", "P"), "op_txt": get("txt", "P"), "ol_t": text, **literal}


def _struct(graph: Column, *parts: dict[str, Column]) -> Column:
    values = {"graph": graph}
    for p in parts:
        values |= p
    return F.struct(*[values.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in COLUMNS])


def _about(base: tuple[dict, dict, dict], name: Column) -> list[tuple[dict, dict, dict]]:
    """The three facts that tell a fact's parts on a blank node, anchored as the fact is."""
    s, p, o = base
    on = {"s_type": F.lit(BLANK), "s_id": name, "s": node_key(F.lit(BLANK), name)}

    def told(label: str) -> dict[str, Column]:
        return {"p_id": F.lit(label), "p_ns": p["p_ns"], "p_txt": p["p_txt"], "p": predicate_key(F.lit(label), p["p_ns"].cast("bigint"))}

    subject = {"o_kind": F.lit("N"), "o": s["s"], "on_type": s["s_type"], "on_id": s["s_id"]}
    predicate = {"o_kind": F.lit("P"), "o": p["p"], "op_id": p["p_id"], "op_ns": p["p_ns"], "op_txt": p["p_txt"]}
    return [(on, told("_subject"), subject), (on, told("_predicate"), predicate), (on, told("_object"), o)]


def _variables(templates: list[Template]) -> list[str]:
    """Names of all variables that templates use, each once."""
    parts = [x for t in templates for x in (t.subject, t.predicate, t.object, *(y for pair in t.more for y in pair))]
    parts = [x.at if isinstance(x, Anchored) else x for x in parts]
    return list(dict.fromkeys(x.name for x in parts if isinstance(x, Var)))


def construct(rows: DataFrame, templates: list[Template], graphs: tuple[str, ...]) -> DataFrame:
    """Facts of all templates for all rows, in each of the graphs.

    A template with further pairs makes the facts about its fact in place of the fact itself. Their blank node is named by a hash of
    the template and the fact, so that it is the same however often a row is computed.
    """
    made = []
    names = _variables(templates)
    if names:
        # repeats go while rows are few and narrow, before facts are made of them
        rows = rows.select(*names).distinct()
    for nth, t in enumerate(templates):
        base = (_subject(t.subject), _predicate(t.predicate), _object(t.object, rows))
        if not t.more:
            made.append(base)
            continue
        pairs = [(_predicate(p), _object(o, rows)) for p, o in t.more]
        keys = [base[0]["s"], base[1]["p"], base[2]["o"], *(x for p, o in pairs for x in (p["p"], o["o"]))]
        # a column of its own, so that it is computed once a row and not in each fact that holds it
        rows = rows.withColumn(f"_blank{nth}", F.sha1(F.concat_ws("\x1f", F.lit(str(nth)), *keys).cast("binary")))
        name = F.col(f"_blank{nth}")
        on = {"s_type": F.lit(BLANK), "s_id": name, "s": node_key(F.lit(BLANK), name)}
        made += _about(base, name) + [(on, p, o) for p, o in pairs]
    structs = [_struct(F.lit(g), *m) for g in graphs for m in made]
    facts = rows.select(F.explode(F.array(*structs)).alias("fact")).select("fact.*")
    if len(templates) == 1 and names:
        # hardly any two facts of different rows are equal now, so a table of those in a task before they are dealt would only fill its memory
        facts = facts.repartition("graph", "s", "p", "o")
    # equal rows are hashed away; facts that differ in how a time is written become one where they are stored
    return facts.distinct()


def reify(facts: DataFrame) -> DataFrame:
    """Facts with the three facts about each of them, on a blank node that is named by a hash of the fact."""
    name = F.sha1(F.concat_ws("\x1f", "graph", "s", "p", "o").cast("binary"))
    base = tuple({c: F.col(c) for c in COLUMNS if c.startswith(k)} for k in ("s", "p", "o"))
    structs = [_struct(F.col("graph"), *m) for m in [base, *_about(base, name)]]
    return facts.select(F.explode(F.array(*structs)).alias("fact")).select("fact.*")
