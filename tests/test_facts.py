"""Patterns, filters, templates and stores on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.cells import compare, compare_cells, id_of, int_of, key, order
from factloom.model import Literal, Node, Predicate, fact, nanoseconds
from factloom.operators.lookups import exists, latest, lookup, predicates_of, within
from factloom.operators.patterns import Anchored, Filter, Part, Var, clause, match, optional
from factloom.operators.templates import Template, blank, construct, reify
from factloom.plans.select import Out, select
from factloom.sources.generators import random_graph, tree
from factloom.sources.graphs import GraphError, Graphs
from factloom.sources.text import fact_text, float_text, parsed, read_facts, read_stories, to_json, to_text, write_facts

HARBOUR = """
# an island harbour: which lock feeds which, what vessels did, and how they are registered
/lock<north> "feeds"@[] /lock<basin>
/lock<north> "feeds"@[] /quay<long>
/lock<basin> "feeds"@[] /quay<short>
/lock<basin>\t"feeds"@[]\t/quay<fish market>
/quay<short> "feeds"@[] /quay<slip>

/vessel<tern> "moored"@[2031-06-03T07:15:00+02:00] /quay<short>
/vessel<tern> "moored"@[2031-06-09T23:00:00+02:00] /quay<long>
/vessel<tern> "moored"@[2031-07-20T5:30:00.000000000Z] /quay<slip>
/vessel<auk> "moored"@[2031-07-20T05:30:00Z] /quay<slip>
/vessel<eider> "moored"@[2031-06-11T00:00:00Z] /quay<long>
/vessel<tern> "flag"@[] /land<faroe>
/vessel<auk> "reported"@[] "leak"@[2031-06-04T12:00:00Z]
/vessel<auk> "reported"@[] "leak"@[2031-06-08T12:00:00.25Z]
/vessel<auk> "reported"@[] "overhaul"@[]
/lock<north> "fill_minutes"@[] "48"^^type:int64
/lock<basin> "fill_minutes"@[] "-7"^^type:int64
/quay<slip> "fill_minutes"@[] "9"^^type:int64
/quay<short> "sign"@[] "no \\"wake\\" > 3 kn"^^type:text
/quay<slip> "sign"@[] "2.75"^^type:float64
/quay<slip> "lit"@[] "T"^^type:bool
/quay<slip> "beacon"@[] "[7 0 255]"^^type:blob
_:log "mentions"@[] /quay<slip>
"""

a, b, c, n, o, p, s, t, x, y = map(Var, "abcnopstxy")


@pytest.fixture(scope="module")
def facts(spark):
    lines = spark.createDataFrame([(line,) for line in HARBOUR.split("\n")], "value string")
    return parsed(lines, "?harbour").cache()


def P(name, at=None):
    return Predicate(name, at)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_text_and_back(spark, facts, tmp_path):
    assert facts.count() == 22
    write_facts(facts, str(tmp_path / "out"))
    again = read_facts(spark, str(tmp_path / "out"), "?harbour")
    columns = [f for f in facts.columns if f not in ("p_txt", "op_txt")]
    assert sorted(map(repr, again.select(columns).collect())) == sorted(map(repr, facts.select(columns).collect()))
    lines = {r[0] for r in facts.select(fact_text()).collect()}
    assert '/quay<slip>\t"beacon"@[]\t"[7 0 255]"^^type:blob' in lines and '/quay<slip>\t"sign"@[]\t"2.75"^^type:float64' in lines and '/quay<slip>\t"lit"@[]\t"true"^^type:bool' in lines
    assert '/_<log>\t"mentions"@[]\t/quay<slip>' in lines


def test_random_values_and_back(spark, tmp_path):
    import random
    import struct

    rng = random.Random(6)
    floats = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 24) for _ in range(300)]
    floats = [f for f in floats if f == f] + [0.0, -0.0, 0.1, 1e21, 1e-4, 0.00012345678901234567, 123456789.0, 12345678.9, 1e7, 2.0**70, float("inf"), float("-inf")]
    odd = ["\n", "\r", "\\", "n", "r", "\\n", '"', "\t", " ", "é", "日", ">", "]", "^^type:text", "\u2028"]
    texts = ["", *odd, *("".join(rng.choices(odd, k=rng.randint(1, 9))) for _ in range(300))]
    blobs = [b"", bytes(range(256)), *(rng.randbytes(rng.randint(1, 30)) for _ in range(50))]
    rows = [("float64", f, None, None) for f in floats] + [("text", None, t, None) for t in texts] + [("blob", None, None, bytearray(x)) for x in blobs]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, kind string, f double, t string, x binary")
    made = []
    for kind, column in (("float64", "f"), ("text", "t"), ("blob", "x")):
        made.append(rows.filter(F.col("kind") == kind).select(fact("?g", ("/n", F.col("k")), "p", literal=(kind, F.col(column)))))
    facts = made[0].union(made[1]).union(made[2])
    write_facts(facts, str(tmp_path / "out"))
    columns = ["s", "o_kind", "ol_type", "ol_f", "ol_t", "ol_x"]
    again = read_facts(spark, str(tmp_path / "out"), "?g").select(columns).collect()
    assert len(again) == rows.count() and sorted(map(repr, again)) == sorted(map(repr, facts.select(columns).collect()))
    shown = dict(spark.createDataFrame([(f,) for f in (1.0, 2.5, 0.001, 12345678.9, 1e7, 123456789012345.0, 1e21, 1e-5, -0.00012)], "f double").select("f", float_text(F.col("f"))).collect())
    assert list(shown.values()) == ["1", "2.5", "0.001", "12345678.9", "10000000", "123456789012345", "1.0e21", "1.0e-5", "-0.00012"]
    # files of others, in which a backslash is one
    line = spark.createDataFrame([('/n<a> "p"@[] "c:\\new"^^type:text',)], "value string")
    assert [parsed(line, "?g", escapes=e).first().ol_t for e in (False, True)] == ["c:\\new", "c:\new"]


@pytest.mark.parametrize("line", ["nonsense", '/u<a> "p"@[] "1"^^type:int8', '/u<a> "p"@[yesterday] /u<b>', '/u<a> "p"@[] "maybe"^^type:bool', '/u<a> "p"@[]', '/u<a> "p"@[] "long text"^^type:text', '/u<a> "p"@[] "[999]"^^type:blob', '/u<a> "p"@[] "[-1]"^^type:blob'])
def test_bad_lines_are_errors(spark, line):
    with pytest.raises(Exception, match="not a|cast|CAST|malformed"):
        parsed(spark.createDataFrame([(line,)], "value string"), "?g", most_bytes=5).collect()


def test_times():
    assert nanoseconds("2020-01-01T00:00:00-08:00") == nanoseconds("2020-01-01T8:00:00Z") == 1577865600 * 10**9
    assert nanoseconds("1969-12-31T23:59:59.999999999Z") == -1
    with pytest.raises(ValueError):
        nanoseconds("2020-01-01")
    with pytest.raises(ValueError):
        Anchored("p", low="2021-01-01T00:00:00Z", high="2020-01-01T00:00:00Z")


def test_values():
    for bad in (("u", "a"), ("/u/", "a"), ("/u v", "a"), ("/u", ""), ("/u", "a>")):
        with pytest.raises(ValueError):
            Node(*bad)
    assert Node("/a/b", "x").covariant(Node("/a", "y")) and not Node("/ab", "x").covariant(Node("/a", "y"))
    with pytest.raises(ValueError):
        Literal("int64", True)


def test_lookups(facts):
    assert lookup(facts, Node("/lock", "north")).count() == 3
    assert lookup(facts, predicate=P("moored", "2031-06-09T21:00:00Z")).count() == 1 and lookup(facts, predicate=P("moored")).count() == 0
    assert lookup(facts, obj=Literal("int64", -7)).count() == 1 and lookup(facts, obj=P("overhaul")).count() == 1
    assert exists(facts, Node("/lock", "north"), P("feeds"), Node("/lock", "basin")).count() == 1 and exists(facts, Node("/lock", "basin"), P("feeds"), Node("/lock", "north")).count() == 0
    assert rows(predicates_of(facts, Node("/lock", "north"), Node("/quay", "long")), "p_id") == [("feeds",)]
    pages = [rows(lookup(facts, predicate=P("feeds"), page=k, size=3), "o") for k in (0, 1, 2)]
    assert [len(q) for q in pages] == [3, 2, 0]
    # the immutable facts and the two moorings in between
    assert facts.filter(within(nanoseconds("2031-06-09T21:00:00Z"), nanoseconds("2031-07-01T00:00:00Z"))).count() == 17 + 2
    assert rows(lookup(facts, Node("/vessel", "tern"), filtered="latest"), "on_id") == [("slip",)]


def test_latest(facts):
    last = latest(facts)
    assert rows(last, "s_id", "on_id") == [("auk", "slip"), ("tern", "slip")]  # ties stay
    assert rows(latest(facts, by=("s",)), "s_id") == [("auk",), ("eider",), ("tern",)] and rows(latest(facts, "op"), "op_ns") == [(nanoseconds("2031-06-08T12:00:00.25Z"),)]
    found = match(facts, [clause(s, p, o)], (Filter("latest", p),), before="2031-06-30T00:00:00Z")
    assert rows(found, id_of("o")) == [("long",)]
    # another clause fixes the subject: the last of each
    each = match(facts, [clause(s, P("flag"), x), clause(s, Anchored("moored", t), o)], (Filter("latest", o),))
    assert each.count() == 0  # the objects are no predicates
    assert rows(match(facts, [clause(c, P("reported"), Part(o, at=t))], (Filter("latest", o),)), id_of("o")) == [("leak",)]
    assert match(facts, [clause(c, P("reported"), o)], (Filter("isImmutable", o),)).count() == 1
    assert match(facts, [clause(c, P("reported"), o)], (Filter("isTemporal", o),)).count() == 2
    with pytest.raises(ValueError):
        match(facts, [clause(s, p, o)], (Filter("newest", p),))
    with pytest.raises(ValueError):
        match(facts, [clause(s, p, o)], (Filter("latest", s),))


def test_joins(facts):
    two = match(facts, [clause(a, P("feeds"), b), clause(b, P("feeds"), c)])
    assert rows(two, id_of("a"), id_of("c")) == [("basin", "slip"), ("north", "fish market"), ("north", "short")]
    assert match(facts, [clause(a, P("feeds"), a)]).count() == 0
    assert match(facts, [clause(a, P("feeds"), b), clause(x, P("flag"), y)]).count() == 5
    there = match(facts, [clause(a, P("feeds"), b), clause(Node("/lock", "north"), P("feeds"), Node("/quay", "long"))])
    gone = match(facts, [clause(a, P("feeds"), b), clause(Node("/quay", "long"), P("feeds"), Node("/lock", "north"))])
    assert there.count() == 5 and gone.count() == 0
    # an id never equals a node
    assert match(facts, [clause(Part(a, id=x), P("feeds"), b), clause(b, P("feeds"), x)]).count() == 0


def test_large_groups_are_joined_in_parts(spark, monkeypatch):
    member = spark.range(0, 60, 1, 1).select(fact("?g", ("/m", F.col("id")), "of", node=("/team", F.when(F.col("id") < 50, 0).otherwise(F.col("id")))))
    lone = spark.range(1).select(fact("?g", ("/m", F.lit("lone")), "of", node=("/team", F.lit("none"))))
    member = member.union(lone)
    clauses = [clause(a, P("of"), x), clause(b, P("of"), x)]
    plain = rows(match(member, clauses), id_of("a"), id_of("b"), id_of("x"))
    assert len(plain) == 50 * 50 + 11
    monkeypatch.setattr("factloom.operators.patterns.PART_PAIRS", 100)
    found = match(member, clauses)
    assert found.columns == ["a", "x", "b"] and rows(found, id_of("a"), id_of("b"), id_of("x")) == plain
    by_task = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    assert len(by_task) == 4 and by_task[-1] < 1500  # one task made them all
    # an optional clause finds none for some and many for others
    some = member.filter("on_id <> 'none'").withColumn("p_id", F.lit("in")).withColumn("p", F.lit("in@"))
    left = match(member.union(some), [clause(a, P("of"), x), optional(b, P("in"), x)])
    assert left.count() == 50 * 50 + 11 and left.filter("b is null").count() == 1


def test_optional(facts):
    found = match(facts, [clause(a, P("feeds"), b), optional(b, P("fill_minutes"), n)])
    assert rows(found, id_of("b"), F.coalesce(int_of("n"), F.lit(0))) == [("basin", -7), ("fish market", 0), ("long", 0), ("short", 0), ("slip", 9)]
    assert match(facts, [clause(a, P("flag"), b), optional(x, P("nowhere"), y)]).count() == 1
    # without a shared variable and with matches: every row with each of them, and not by sending the right side to all
    both = match(facts, [clause(a, P("feeds"), b), optional(x, P("fill_minutes"), n)])
    assert both.count() == 15 and both.select(key("x")).distinct().count() == 3 and both.columns == ["a", "b", "x", "n"]
    assert "NestedLoop" not in both._jdf.queryExecution().executedPlan().toString()
    kinds = match(facts, [clause(a, P("moored", "2031-07-20T05:30:00Z"), b), optional(a, P("reported"), Part(o, at=t))])
    assert kinds.count() == 4 and kinds.filter("t is null").count() == 2
    with pytest.raises(ValueError):
        match(facts, [optional(a, P("flag"), b)])


def test_anchors(facts):
    assert match(facts, [clause(a, Anchored("moored", t), b)]).count() == 5
    assert match(facts, [clause(a, Anchored("moored", low="2031-06-09T21:00:00Z"), b)]).count() == 4
    ranged = match(facts, [clause(Node("/vessel", "tern"), Anchored("moored", t), Node("/quay", "long")), clause(a, Anchored("moored", low=t), b)])
    assert ranged.count() == 4
    assert match(facts, [clause(c, P("reported"), Anchored("leak", low="2031-06-05T00:00:00Z"))]).count() == 1
    assert match(facts, [clause(c, P("reported"), Part(Anchored("leak", t)))]).count() == 2
    with pytest.raises(ValueError):
        match(facts, [clause(a, Anchored("moored", low=t), b)])


def test_select(facts):
    grouped = select(facts, [clause(a, P("feeds"), b)], [Out("from", "a"), Out("n", "b", "count")], group_by=("from",), having=F.col("n") > 1)
    assert rows(grouped, id_of("from"), "n") == [("basin", 2), ("north", 2)]
    total = select(facts, [clause(a, P("fill_minutes"), n), clause(a, Part(p, id=x), o)], [Out("x", "x"), Out("sum", "n", "sum_int")], group_by=("x",))
    assert dict(rows(total, key("x"), "sum"))["fill_minutes"] == 50
    ordered = select(facts, [clause(a, P("fill_minutes"), n)], [Out("a", "a")], order_by=tuple(order("n", ("i",))), limit=2)
    assert [r[0] for r in ordered.select(id_of("a")).collect()] == ["basin", "slip"]  # -7 before 9, as numbers
    slow = compare("n", ">", Literal("int64", 9)) | compare("a", "=", Node("/lock", "basin"))
    assert rows(select(facts, [clause(a, P("fill_minutes"), n)], [Out("a", "a")], having=slow), id_of("a")) == [("basin",), ("north",)]
    assert select(facts, [clause(a, P("sign"), n)], [Out("a", "a")], having=compare("n", ">", Literal("int64", 0))).count() == 0  # another type
    pairs = match(facts, [clause(a, P("fill_minutes"), n), clause(b, P("fill_minutes"), o)])
    assert pairs.filter(compare_cells("n", "<", "o", "i")).count() == 3
    late = compare("t", ">", "", time="2031-07-01T00:00:00+01:00")
    assert select(facts, [clause(a, Anchored("moored", t), b)], [Out("a", "a")], having=late).count() == 2
    # no rows to group: no groups, and a count of all is none as well
    assert select(facts, [clause(a, P("nowhere"), b)], [Out("a", "a"), Out("n", "b", "count")], group_by=("a",)).collect() == []
    with pytest.raises(ValueError):
        compare("a", "<", Node("/lock", "basin"))
    with pytest.raises(ValueError):
        select(facts, [clause(a, P("flag"), b)], [Out("z", "z")])
    with pytest.raises(ValueError):
        select(facts, [clause(a, P("flag"), b)], [Out("n", "a", "count")])
    with pytest.raises(Exception, match="takes int64 only"):
        select(facts, [clause(a, P("sign"), n)], [Out("a", "a"), Out("n", "n", "sum_int")], group_by=("a",)).collect()


def test_templates(facts):
    pairs = match(facts, [clause(a, P("feeds"), b), clause(b, P("feeds"), c)])
    made = construct(pairs, [Template(a, P("feeds_at_last"), c), Template(c, P("sheltered"), Literal("bool", True))], ("?x", "?y"))
    assert rows(made, "graph", "s_id", "p_id").count(("?x", "north", "feeds_at_last")) == 2 and made.count() == 12
    moored = match(facts, [clause(a, Anchored("moored", t), b)])
    told = construct(moored, [Template(a, Anchored("seen", t), b, ((P("sure"), Literal("bool", True)),))], ("?x",))
    assert told.count() == 20 and told.select("s").distinct().count() == 5 and told.filter("p_id = '_object' and p_ns is not null").count() == 5
    assert construct(moored, [Template(blank("v"), P("p"), a)], ("?x",)).select("s").distinct().collect()[0][0] == "/_<v>"
    assert reify(facts).count() == 88
    with pytest.raises(Exception, match="no node"):
        construct(match(facts, [clause(a, P("sign"), o)]), [Template(o, P("p"), a)], ("?x",)).collect()


def test_facts_of_templates_fill_no_table_before_they_are_dealt(spark, facts):
    moored = match(facts, [clause(a, Anchored("moored", t), b)])
    told = construct(moored.union(moored), [Template(a, Anchored("seen", t), b, ((P("sure"), Literal("bool", True)), (P("sure"), Literal("bool", True))))], ("?x",))
    plan = told._jdf.queryExecution().executedPlan().toString()
    # between the facts and their shuffle nothing is aggregated; below the facts, rows are
    above, below = plan[: plan.index("Generate")], plan[plan.index("Generate") :]
    assert "Aggregate" not in above[above.index("Exchange") :] and below.count("HashAggregate") >= 2
    assert told.count() == 20
    # a time that is written in two ways makes two rows, which share the facts that have no time
    late = moored.withColumn("t", F.struct("t.kind", "t.key", "t.ns", F.concat("t.txt", F.lit(" ")).alias("txt")))
    both = construct(moored.union(late), [Template(a, Anchored("seen", t), b, ((P("sure"), Literal("bool", True)),))], ("?x",))
    assert both.count() == 35 and both.dropDuplicates(["graph", "s", "p", "o"]).count() == 20


def test_text_and_json_of_results(facts):
    found = match(facts, [clause(Part(a, id=x), Part(P("moored", "2031-06-03T05:15:00Z"), alias=p, at=t), b), optional(b, P("nowhere"), y)]).select("x", "p", "t", "b", "y")
    assert to_text(found).collect()[0][0] == 'tern\t"moored"@[2031-06-03T07:15:00+02:00]\t2031-06-03T07:15:00+02:00\t/quay<short>\t<NULL>'
    assert json.loads(to_json(found).collect()[0][0]) == {"?x": {"string": "tern"}, "?p": {"pred": '"moored"@[2031-06-03T07:15:00+02:00]'}, "?t": {"anchor": "2031-06-03T07:15:00+02:00"}, "?b": {"node": "/quay<short>"}, "?y": {}}


def test_graphs(spark, facts, tmp_path):
    g = Graphs(spark, str(tmp_path / "store"))
    assert g.names().collect() == []
    g.create("?a", "?b")
    with pytest.raises(GraphError, match=r"\?a exists"):
        g.create("?a", "?c d/e")
    assert rows(g.names(), "graph_id") == [("?a",), ("?b",), ("?c d/e",)] and g.read("?a").count() == 0
    g.insert(facts, "?a", "?b")
    g.insert(facts.limit(3).union(facts.limit(3)), "?a")
    assert g.read("?a").count() == 22 and g.read("?a", "?b").count() == 44 and g.read("?a", "?a").count() == 44
    g.delete(facts.filter("p_id = 'sign'"), "?a")
    g.delete(facts.filter("p_id = 'sign'"), "?a")
    assert g.read("?a").count() == 20 and g.read("?b").count() == 22
    before = g.read("?a")
    g.insert(facts.filter("p_id = 'sign'"), "?a")  # what was taken away may come back
    assert g.read("?a").count() == 22 and before.count() == 20
    clauses = [clause(x, P("feeds"), y)]
    g.construct([Template(y, P("fed_by"), x)], ("?a",), ("?a",), clauses)  # reads what it changes
    assert g.read("?a").count() == 27
    g.deconstruct([Template(x, P("feeds"), y)], ("?a",), ("?a",), clauses)
    assert rows(g.read("?a").filter("p_id like '%fe%d%'"), "p_id") == [("fed_by",)] * 5
    held = sorted(map(repr, g.read("?a").collect()))
    g.compact("?a")
    assert sorted(map(repr, g.read("?a").collect())) == held and len(g._log("?a")[1]) == 1
    g.export(str(tmp_path / "lines"), "?a", "?b")
    assert spark.read.text(str(tmp_path / "lines")).count() == 22 + 22
    with pytest.raises(ValueError):
        g.deconstruct([Template(x, P("p"), y, ((P("q"), y),))], ("?a",), ("?a",), clauses)
    with pytest.raises(GraphError, match=r"\?z does not exist"):
        g.drop("?z", "?c d/e")
    assert rows(g.names(), "graph_id") == [("?a",), ("?b",)]
    with pytest.raises(GraphError):
        g.read("?c d/e")
    g.drop("?b")
    g.create("?b")
    assert g.read("?b").count() == 0 and g.vacuum() > 3 and sorted(map(repr, g.read("?a").collect())) == held
    assert len(g._listed(g.folder + "/facts")) == 1


def test_inserting_writes_new_facts_only(spark, facts, tmp_path):
    g = Graphs(spark, str(tmp_path / "store"))
    g.create("?a")
    g.insert(facts, "?a")
    one = facts.filter("p_id = 'flag'")
    g.insert(one.union(one.withColumn("s", F.lit("/vessel<new>")).withColumn("s_id", F.lit("new"))), "?a")
    added = [spark.read.parquet(f"{g.folder}/{x['folder']}").count() for x in g._log("?a")[1] if x["folder"]]
    assert added == [22, 1]


def test_lines_are_taken_apart_once(spark, facts, tmp_path):
    write_facts(facts, str(tmp_path / "out"))
    found = read_facts(spark, str(tmp_path / "out"), "?harbour").filter("p_id = 'moored' and p_ns is not null and s is not null and o is not null")
    assert found.count() == 5
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 100  # hundreds, if the filter is moved below
    # what repeats inside a line costs no stack, and ends of lines and odd times are as they were
    ends = ['/u<a> "p"@[] /u<b> \t\u2028', '/u<a>b<c> "p"@[2031-06-03T07:15:00.5Z]\t"x"@[2031-06-03T7:15:00.5Z] ', f'/u<a> "{"p" * 20000}"@[] "1"^^type:int64']
    read = parsed(spark.createDataFrame([(x,) for x in ends], "value string"), "?g").collect()
    assert [(r.s_type, r.s_id, r.o) for r in read] == [("/u", "a", "/u<b>"), ("/u<a>b", "c", f"x@{nanoseconds('2031-06-03T07:15:00.5Z')}"), ("/u", "a", '"1"^^type:int64')]
    assert read[1].p_ns == read[1].op_ns == nanoseconds("2031-06-03T07:15:00.5Z") and len(read[2].p_id) == 20000


def test_an_insert_shuffles_and_sorts_once(spark, facts, tmp_path, monkeypatch):
    g, plans = Graphs(spark, str(tmp_path / "store")), []
    changed = g._changed

    def kept(graph, change):
        def seen(log):
            kind, new = change(log)
            plans.append(new._jdf.queryExecution().executedPlan().toString())
            return kind, new

        return changed(graph, seen)

    monkeypatch.setattr(g, "_changed", kept)
    g.create("?a", "?b", "?c")
    g.insert(facts.filter("p_id = 'flag'"), "?c")
    late = facts.filter("p_id = 'flag'").withColumn("s", F.lit("/vessel<tern>"))
    g.insert(facts.union(late), "?c", "?a", "?b", "?a")
    # the first of the empty graphs has each fact once, and the second is given the same
    assert plans[2].count("Exchange") == 1 and plans[2].count("Sort [") == 1 and "Exchange" not in plans[3]
    assert [g.read(x).count() for x in ("?a", "?b", "?c")] == [22, 22, 22]
    assert rows(g.read("?b").select("graph").distinct(), "graph") == [("?b",)]


def test_writers_at_once_lose_nothing(spark, facts, tmp_path, monkeypatch):
    g, other = Graphs(spark, str(tmp_path / "store")), Graphs(spark, str(tmp_path / "store"))
    g.create("?a")
    note, late = g._note, []

    def slow(graph, number, kind, folder=""):
        if not late:  # another writer is quicker
            late.append(other.insert(facts.filter("p_id = 'feeds'"), "?a"))
        return note(graph, number, kind, folder)

    monkeypatch.setattr(g, "_note", slow)
    g.insert(facts.filter("p_id in ('feeds', 'flag')"), "?a")
    assert g.read("?a").count() == 6

    def always(graph, number, kind, folder=""):
        other.delete(facts.limit(0), "?a")
        return note(graph, number, kind, folder)

    monkeypatch.setattr(g, "_note", always)
    with pytest.raises(GraphError, match="changed by others"):
        g.delete(facts, "?a")
    assert other.read("?a").count() == 6


def test_stories(spark, tmp_path):
    story = {"Name": "one", "Sources": [{"ID": "?a", "Facts": ['/u<a> "knows"@[] /u<b>', '/u<b> "knows"@[] /u<c>']}, {"ID": "?b", "Facts": ['/u<x> "knows"@[] /u<y>']}]}
    story["Assertions"] = [{"Requires": "two hops", "Statement": "LINE1\nLINE2", "WillFail": False, "MustReturn": [{"?o": "/u<c>"}]}]
    (tmp_path / "story.json").write_text(json.dumps(story).replace("\\n", "\n"))
    found, asserted = read_stories(spark, str(tmp_path / "story.json"))
    assert rows(found, "graph", "s_id") == [("?a", "a"), ("?a", "b"), ("?b", "x")]
    want = asserted.first()
    two = match(found.filter("graph = '?a'"), [clause(a, P("knows"), b), clause(b, P("knows"), o)])
    assert [{"?o": r[0]} for r in two.select(key("o")).collect()] == want.MustReturn and want.Statement == "LINE1\nLINE2"


def test_generators(spark):
    found = tree(spark, 14, 2)
    assert found.count() == 14 and rows(found.groupBy("s").count(), "count") == [(2,)] * 7
    pairs = random_graph(spark, 30, 900)
    assert pairs.select("s", "o").distinct().count() == 900


def test_streams(spark, tmp_path):
    from factloom.streaming.ingest import append, counts, stream_facts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text(HARBOUR)
    append(stream_facts(spark, str(tmp_path / "in"), "?g"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    again = '/vessel<tern> "flag"@[] /land<faroe>\n'  # in an earlier batch
    (tmp_path / "in" / "two.txt").write_text('/vessel<skua> "moored"@[2031-07-20T05:45:00Z] /quay<long>\n' + again + again)
    append(stream_facts(spark, str(tmp_path / "in"), "?g"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 23
    q = counts(stream_facts(spark, str(tmp_path / "in"), "?g")).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 1, 1, 3]
