"""The registered queries over facts, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cells import compare, compare_cells, float_of, id_of, int_of, key, order, text_of, time_of
from .model import Literal, Node, Predicate, fact, nanoseconds
from .operators.lookups import exists, is_predicate, latest, lookup, predicates_of, set_difference, set_union
from .operators.patterns import Anchored, Filter, Part, Var, clause, match, optional
from .operators.templates import Template, blank, construct, reify
from .plans.select import Out, select
from .sources import tables as T
from .sources.generators import tree
from .sources.graphs import Graphs
from .sources.scratch import scratch
from .sources.text import fact_text, parsed, read_facts, to_json, to_text, write_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

a, b, c, e, k, n, o, p, r, s, t, u, v, w, x = map(Var, "abceknoprstuvwx")


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def at(text: str) -> Predicate:
    return Predicate(text)


def ids(*names: str) -> list:
    return [id_of(x).alias(x) for x in names]



# lookups ------------------------------------------------------------------------------------------------------------


@query("SELECT 'in_nation' AS p, '/nation<' || c_nationkey || '>' AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'segment', '\"' || c_mktsegment || '\"^^type:text' FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'acctbal', '\"' || c_acctbal || '\"^^type:float64' FROM customer WHERE c_custkey = 7")
def scan_s(spark, d):
    found = lookup(T.sales(spark, d), Node("/customer", "7"))
    return found.select(F.col("p_id").alias("p"), "o")


@query("SELECT CAST(c_custkey AS VARCHAR) AS s, c_mktsegment AS v FROM customer")
def scan_p(spark, d):
    return lookup(T.sales(spark, d), predicate=at("segment")).select(F.col("s_id").alias("s"), F.col("ol_t").alias("v"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s, 'in_nation' AS p FROM supplier WHERE s_nationkey = 3")
def scan_o(spark, d):
    return lookup(T.supply(spark, d), obj=Node("/nation", "3")).select(F.col("s_id").alias("s"), F.col("p_id").alias("p"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS o FROM customer WHERE c_custkey = 11")
def scan_sp(spark, d):
    return lookup(T.sales(spark, d), Node("/customer", "11"), at("in_nation")).select(F.col("on_id").alias("o"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS s FROM part WHERE p_size = 15")
def scan_po(spark, d):
    return lookup(T.supply(spark, d), predicate=at("size"), obj=Literal("int64", 15)).select(F.col("s_id").alias("s"))


@query("SELECT 'in_region' AS p FROM nation WHERE n_nationkey = 5 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 5) AND n_regionkey = 0")
def scan_so(spark, d):
    return predicates_of(T.geo(spark, d), Node("/nation", "5"), Node("/region", "0")).select(F.col("p_id").alias("p"))


@query("SELECT CAST(event_id AS VARCHAR) AS s FROM events ORDER BY '/event<' || event_id || '>' LIMIT 25")
def page_first(spark, d):
    return lookup(T.events(spark, d), predicate=at("value"), size=25).select(F.col("s_id").alias("s"))


@query("SELECT CAST(event_id AS VARCHAR) AS s FROM events ORDER BY '/event<' || event_id || '>' LIMIT 25 OFFSET 75")
def page_offset(spark, d):
    return lookup(T.events(spark, d), predicate=at("value"), size=25, page=3).select(F.col("s_id").alias("s"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-03-01'")
def lookup_bounds(spark, d):
    found = lookup(T.sales(spark, d), low=nanoseconds("1997-01-01T00:00:00Z"), high=nanoseconds("1997-03-01T00:00:00Z"))
    return found.filter("p_id = 'placed_by'").select(F.col("s_id").alias("s"))


@query("SELECT count(*) AS found FROM (SELECT 1 FROM nation WHERE n_nationkey = 5 AND n_regionkey = 0 LIMIT 1)")
def exist_fact(spark, d):
    return exists(T.geo(spark, d), Node("/nation", "5"), at("in_region"), Node("/region", "0")).agg(F.count("*").alias("found"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o, epoch_us(o_orderdate) AS at FROM orders WHERE o_custkey = 13")
def scan_po_temporal(spark, d):
    found = lookup(T.sales(spark, d), obj=Node("/customer", "13")).filter("p_id = 'placed_by'")
    return found.select(F.col("s_id").alias("o"), F.expr("p_ns div 1000").alias("at"))


@query("SELECT event_type AS p, epoch_us(ts) AS at FROM events WHERE user_id = 17 UNION ALL SELECT 'did', NULL FROM events WHERE user_id = 17")
def predicates_of_subject(spark, d):
    found = predicates_of(T.events(spark, d), Node("/user", "17"))
    return found.select(F.col("p_id").alias("p"), F.expr("p_ns div 1000").alias("at"))


@query("SELECT 'placed_by' AS p, count(*) AS n FROM orders WHERE o_custkey = 13 HAVING count(*) > 0")
def predicates_of_object(spark, d):
    return predicates_of(T.sales(spark, d), obj=Node("/customer", "13")).groupBy(F.col("p_id").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS s, event_type AS p FROM events WHERE ts <= TIMESTAMP '2024-01-10' QUALIFY ts = max(ts) OVER (PARTITION BY user_id, event_type)")
def latest_within_bounds(spark, d):
    rows = T.events(spark, d).filter("on_type = '/event'").filter(F.col("p_ns") <= nanoseconds("2024-01-10T00:00:00Z"))
    return latest(rows, "p", ("s",)).select(F.col("on_id").alias("s"), F.col("p_id").alias("p"))


# joins --------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS c, CAST(n_regionkey AS VARCHAR) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def chain_join_2hop(spark, d):
    return match(T.union([T.sales(spark, d), T.geo(spark, d)]), [clause(c, at("in_nation"), n), clause(n, at("in_region"), r)]).select(*ids("c", "r"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o, r_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def chain_join_3hop(spark, d):
    facts = T.union([T.sales(spark, d), T.geo(spark, d)])
    found = match(facts, [clause(o, Anchored("placed_by", t), c), clause(c, at("in_nation"), n), clause(n, at("in_region"), r), clause(r, at("name"), v)])
    return found.select(*ids("o"), text_of("v").alias("name"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p, p_brand AS brand, p_size AS size FROM part")
def star_join(spark, d):
    found = match(T.supply(spark, d), [clause(p, at("brand"), b), clause(p, at("size"), s), clause(p, at("type"), t)])
    return found.select(*ids("p"), text_of("b").alias("brand"), int_of("s").alias("size"))


@query("SELECT a.n_name AS a, b.r_name AS b FROM nation a, region b")
def cross_product(spark, d):
    nations = clause(n, at("in_region"), x), clause(n, at("name"), a)
    found = match(T.geo(spark, d), [*nations, clause(Part(Var("m"), type=Var("kind")), at("name"), b)])
    return found.filter(key("kind") == "/region").select(text_of("a").alias("a"), text_of("b").alias("b"))


@query("SELECT CAST(a.s_suppkey AS VARCHAR) AS a, CAST(b.s_suppkey AS VARCHAR) AS b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE CAST(a.s_suppkey AS VARCHAR) < CAST(b.s_suppkey AS VARCHAR)")
def self_join_same_nation(spark, d):
    return match(T.supply(spark, d), [clause(a, at("in_nation"), n), clause(b, at("in_nation"), n)]).filter(id_of("a") < id_of("b")).select(*ids("a", "b"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_name < b.n_name")
def having_theta_join(spark, d):
    found = match(T.geo(spark, d), [clause(n, at("in_region"), r), clause(n, at("name"), a), clause(Var("m"), at("in_region"), Var("q")), clause(Var("m"), at("name"), b)])
    return found.filter(compare_cells("a", "<", "b", "txt")).select(text_of("a").alias("a"), text_of("b").alias("b"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n, CAST(n_regionkey AS VARCHAR) AS copy FROM nation")
def alias_as(spark, d):
    return match(T.geo(spark, d), [clause(Part(n), at("in_region"), Part(r, alias=x))]).select(id_of("n").alias("n"), id_of("x").alias("copy"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sid, 'in_nation' AS pid, CAST(c_nationkey AS VARCHAR) AS oid FROM customer")
def extract_id(spark, d):
    found = match(T.sales(spark, d), [clause(Part(s, id=a), Part(at("in_nation"), id=p), Part(o, id=b))])
    return found.select(key("a").alias("sid"), key("p").alias("pid"), key("b").alias("oid"))


@query("SELECT DISTINCT '/customer' AS s, '/nation' AS o FROM customer UNION ALL SELECT DISTINCT '/order', '/customer' FROM orders")
def extract_type(spark, d):
    found = match(T.sales(spark, d), [clause(Part(s, type=a), p, Part(o, type=b))])
    return found.select(key("a").alias("s"), key("b").alias("o")).distinct()


@query("SELECT CAST(user_id AS VARCHAR) AS u, event_type AS p, epoch_us(ts) AS at FROM events")
def extract_at(spark, d):
    return match(T.events(spark, d), [clause(u, Part(p, at=t), Part(e, type=x))]).select(*ids("u"), id_of("p").alias("p"), time_of("t").alias("at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o, epoch_us(o_orderdate) AS at FROM orders")
def anchor_binding(spark, d):
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by", t), c)]).select(*ids("o"), time_of("t").alias("at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def pred_range(spark, d):
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by", low="1996-01-01T00:00:00Z", high="1996-12-31T0:00:00Z"), c)]).select(*ids("o"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate <= TIMESTAMP '1994-06-01'")
def pred_range_open_low(spark, d):
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by", high="1994-06-01T00:00:00Z"), c)]).select(*ids("o"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def pred_range_open_high(spark, d):
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by", low="1998-01-01T02:00:00+02:00"), c)]).select(*ids("o"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS e FROM events WHERE event_type = 'error'")
def pred_any_temporal(spark, d):
    return match(T.events(spark, d), [clause(u, Anchored("error"), e)]).select(*ids("u", "e"))


@query(
    "SELECT CAST(a.user_id AS VARCHAR) AS u, CAST(b.event_id AS VARCHAR) AS e FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts"
)
def range_join_binding_bounds(spark, d):
    return match(T.events(spark, d), [clause(u, Anchored("signup", t), x), clause(u, Anchored("purchase", low=t), e)]).select(*ids("u", "e"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, epoch_us(ts) AS at FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'")
def object_pred_range(spark, d):
    found = match(T.events(spark, d), [clause(u, at("did"), Part(Anchored("error", low="2024-01-15T00:00:00Z"), at=t))])
    return found.select(*ids("u"), time_of("t").alias("at"))


@query(
    "SELECT CAST(a.user_id AS VARCHAR) AS u, epoch_us(b.ts) AS at FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'error' AND b.ts <= a.ts"
)
def object_range_binding_bounds(spark, d):
    return match(T.events(spark, d), [clause(u, Anchored("signup", t), x), clause(u, at("did"), Part(Anchored("error", high=t), at=v))]).select(*ids("u"), time_of("v").alias("at"))


@query("SELECT CAST(doc_id AS VARCHAR) AS d, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def optional_match(spark, d):
    found = match(T.docs(spark, d), [clause(a, at("lang"), b), optional(a, at("quality"), c)])
    return found.select(id_of("a").alias("d"), text_of("b").alias("lang"), int_of("c").cast("int").alias("quality"))


@query("SELECT n_name AS n, CAST(NULL AS VARCHAR) AS o FROM nation")
def optional_disjoint(spark, d):
    found = match(T.geo(spark, d), [clause(n, at("in_region"), r), clause(n, at("name"), a), optional(b, at("nowhere"), o)])
    return found.select(text_of("a").alias("n"), id_of("o").alias("o"))


@query("SELECT 'L' AS kind, CAST(NULL AS VARCHAR) AS type, count(*) AS n FROM documents UNION ALL SELECT 'L', NULL, count(*) FROM documents WHERE false HAVING count(*) > 0")
def optional_type_null(spark, d):
    found = match(T.docs(spark, d), [clause(a, at("lang"), b), optional(a, at("source"), Part(o, type=t))])
    return found.groupBy(F.col("o.kind").alias("kind"), key("t").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 5 AND n_regionkey = 0) AND c_nationkey = 5")
def exist_filter(spark, d):
    facts = T.union([T.sales(spark, d), T.geo(spark, d)])
    return match(facts, [clause(Node("/nation", "5"), at("in_region"), Node("/region", "0")), clause(c, at("in_nation"), Node("/nation", "5"))]).select(*ids("c"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n FROM nation WHERE false")
def repeated_binding(spark, d):
    return match(T.geo(spark, d), [clause(n, at("in_region"), n)]).select(*ids("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    facts = T.sales(spark, d)
    rich = match(facts, [clause(o, Anchored("placed_by", t), c), clause(o, at("total"), v)]).filter(compare("v", ">", Literal("float64", 400000.0)))
    wanted = rich.select(key("c").alias("wanted")).distinct()
    found = match(facts, [clause(c, at("in_nation"), n)])
    return found.join(wanted, key("c") == F.col("wanted"), "left_semi").select(*ids("c"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def optional_missing(spark, d):
    found = match(T.sales(spark, d), [clause(c, at("in_nation"), n), optional(o, Anchored("placed_by", t), c)])
    return found.filter("o is null").select(*ids("c"))


@query("SELECT CAST(a.o_orderkey AS VARCHAR) AS a, CAST(b.o_orderkey AS VARCHAR) AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def same_anchor_join(spark, d):
    found = match(T.sales(spark, d), [clause(a, Anchored("placed_by", t), c), clause(b, Anchored("placed_by", t), c)])
    return found.filter(id_of("a").cast("long") < id_of("b").cast("long")).select(*ids("a", "b"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p, p_size AS v FROM part JOIN (SELECT DISTINCT p_partkey AS k FROM part WHERE p_brand = 'Brand#12') ON p_partkey = k")
def intersection(spark, d):
    found = match(T.supply(spark, d), [clause(p, at("brand"), Literal("text", "Brand#12")), clause(p, at("size"), s)])
    return found.select(*ids("p"), int_of("s").cast("int").alias("v"))


# filters and bounds -------------------------------------------------------------------------------------------------


@query("SELECT CAST(event_id AS VARCHAR) AS e, event_type AS p FROM events QUALIFY ts = max(ts) OVER (PARTITION BY event_type)")
def filter_latest(spark, d):
    found = match(T.events(spark, d), [clause(u, p, Part(e, type=x))], (Filter("latest", p),))
    return found.select(*ids("e"), id_of("p").alias("p"))


@query("SELECT CAST(event_id AS VARCHAR) AS e, event_type AS p FROM events QUALIFY ts = max(ts) OVER (PARTITION BY user_id, event_type)")
def filter_latest_correlated(spark, d):
    found = match(T.events(spark, d), [clause(u, at("did"), Part(o, at=t)), clause(u, p, Part(e, type=x))], (Filter("LATEST", p),))
    return found.select(*ids("e"), id_of("p").alias("p")).distinct()


@query("SELECT CAST(event_id AS VARCHAR) AS e FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND event_type = 'click' QUALIFY ts = max(ts) OVER ()")
def filter_latest_between(spark, d):
    return match(T.events(spark, d), [clause(u, Part(Anchored("click"), alias=p), e)], (Filter("latest", p),), before="2024-01-10T00:00:00Z").select(*ids("e"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, event_type AS p, epoch_us(ts) AS at FROM events QUALIFY ts = max(ts) OVER (PARTITION BY user_id, event_type)")
def filter_object_latest(spark, d):
    found = latest(T.events(spark, d).filter("p_id = 'did'"), "op", ("s",))
    return found.select(F.col("s_id").alias("u"), F.col("op_id").alias("p"), F.expr("op_ns div 1000").alias("at"))


@query("SELECT event_type AS p, count(*) AS n FROM events GROUP BY 1")
def filter_is_temporal(spark, d):
    found = match(T.events(spark, d), [clause(s, p, o)], (Filter("isTemporal", p),))
    return found.groupBy(id_of("p").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT 'value' AS p, count(*) AS n FROM events UNION ALL SELECT 'did', count(*) FROM events")
def filter_is_immutable(spark, d):
    found = match(T.events(spark, d), [clause(s, p, o)], (Filter("isImmutable", p),))
    return found.groupBy(id_of("p").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01'")
def global_before(spark, d):
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by"), c)], before="1995-01-01T00:00:00Z").select(*ids("o"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def global_after(spark, d):
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by"), c)], after="1998-01-01T00:00:00Z").select(*ids("o"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o, o_orderstatus AS st FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' AND o_orderdate >= TIMESTAMP '1996-06-01'")
def global_between(spark, d):
    found = match(T.sales(spark, d), [clause(o, Anchored("placed_by", low="1996-06-01T00:00:00Z"), c), clause(o, at("status"), s)], after="1996-01-01T00:00:00Z", before="1997-01-01T00:00:00Z")
    return found.select(*ids("o"), text_of("s").alias("st"))


# groups, order, conditions ------------------------------------------------------------------------------------------


@query("SELECT CAST(c_nationkey AS VARCHAR) AS n, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def count(spark, d):
    found = select(T.sales(spark, d), [clause(o, Anchored("placed_by", t), c), clause(c, at("in_nation"), n)], [Out("n", "n"), Out("n_orders", "o", "count")], group_by=("n",))
    return found.select(*ids("n"), "n_orders")


@query("SELECT event_type AS p, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_distinct(spark, d):
    found = select(T.events(spark, d), [clause(u, Part(p, id=k, at=t), Part(e, type=x))], [Out("p", "k"), Out("users", "u", "count_distinct")], group_by=("p",))
    return found.select(key("p").alias("p"), "users")


@query("SELECT lang, count(*) AS n, count(DISTINCT coalesce(CAST(quality AS VARCHAR), '')) AS qualities FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def count_nulls(spark, d):
    outs = [Out("lang", "b"), Out("n", "c", "count"), Out("qualities", "c", "count_distinct")]
    return select(T.docs(spark, d), [clause(a, at("lang"), b), optional(a, at("quality"), c)], outs, group_by=("lang",)).select(text_of("lang").alias("lang"), "n", "qualities")


@query("SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def sum_int(spark, d):
    found = select(T.supply(spark, d), [clause(p, at("brand"), b), clause(p, at("size"), s)], [Out("b", "b"), Out("total", "s", "sum_int")], group_by=("b",))
    return found.select(text_of("b").alias("brand"), "total")


@query("SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def sum_float(spark, d):
    clauses = [clause(o, Anchored("placed_by", t), c), clause(c, at("segment"), s), clause(o, at("total"), v)]
    found = select(T.sales(spark, d), clauses, [Out("s", "s"), Out("total", "v", "sum_float")], group_by=("s",))
    return found.select(text_of("s").alias("segment"), F.round("total", 2).alias("total"))


@query("SELECT DISTINCT p_type AS type FROM part")
def group_distinct(spark, d):
    return select(T.supply(spark, d), [clause(p, at("type"), t)], [Out("t", "t")], group_by=("t",)).select(text_of("t").alias("type"))


@query("SELECT o_orderstatus AS x, count(*) AS n FROM orders GROUP BY 1")
def group_by_alias(spark, d):
    return select(T.sales(spark, d), [clause(o, at("status"), s)], [Out("x", "s"), Out("n", "o", "count")], group_by=("x",)).select(text_of("x").alias("x"), "n")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o, o_totalprice AS v FROM orders ORDER BY o_totalprice DESC, '/order<' || o_orderkey || '>' LIMIT 20")
def order_limit_topk(spark, d):
    found = select(T.sales(spark, d), [clause(o, at("total"), v)], [Out("o", "o"), Out("v", "v")], order_by=(*order("v", ("f",), True), *order("o")), limit=20)
    return found.select(*ids("o"), float_of("v").alias("v"))


@query("SELECT p_brand AS b, p_size AS s FROM part ORDER BY p_size DESC, p_brand LIMIT 30")
def order_desc_multi(spark, d):
    clauses = [clause(p, at("brand"), b), clause(p, at("size"), s)]
    found = select(T.supply(spark, d), clauses, [Out("b", "b"), Out("s", "s")], order_by=(*order("s", ("i",), True), *order("b", ("txt",))), limit=30)
    return found.select(text_of("b").alias("b"), int_of("s").cast("int").alias("s"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS n, count(*) AS k FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*) / 25 FROM customer)")
def having_agg(spark, d):
    facts = T.sales(spark, d)
    mean = facts.filter(is_predicate(at("in_nation"))).agg((F.count("*") / 25).alias("m"))
    found = select(facts, [clause(c, at("in_nation"), n)], [Out("n", "n"), Out("k", "c", "count")], group_by=("n",))
    return found.join(F.broadcast(mean), F.col("k") > F.col("m")).select(*ids("n"), "k")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE p_size < 10")
def having_literal(spark, d):
    return select(T.supply(spark, d), [clause(p, at("size"), s)], [Out("p", "p")], having=compare("s", "<", Literal("int64", 10))).select(*ids("p"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s FROM supplier WHERE s_nationkey = 4")
def having_node(spark, d):
    return select(T.supply(spark, d), [clause(s, at("in_nation"), n)], [Out("s", "s")], having=compare("n", "=", Node("/nation", "4"))).select(*ids("s"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate > TIMESTAMP '1997-07-01'")
def having_time(spark, d):
    having = compare("t", ">", "", time="1997-06-30T16:00:00-08:00")
    return select(T.sales(spark, d), [clause(o, Anchored("placed_by", t), c)], [Out("o", "o")], having=having).select(*ids("o"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS s FROM customer")
def having_pred(spark, d):
    return select(T.sales(spark, d), [clause(s, p, o)], [Out("s", "s")], having=compare("p", "=", Predicate("segment"))).select(*ids("s"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_brand = 'Brand#11'")
def having_and_or_not(spark, d):
    having = (compare("s", "<", Literal("int64", 5)) | compare("s", ">", Literal("int64", 45))) & ~compare("b", "=", Literal("text", "Brand#11"))
    return select(T.supply(spark, d), [clause(p, at("size"), s), clause(p, at("brand"), b)], [Out("p", "p")], having=having).select(*ids("p"))


@query("SELECT '?sales' AS g, CAST(c_custkey AS VARCHAR) AS s, CAST(c_nationkey AS VARCHAR) AS n FROM customer UNION ALL SELECT '?supply', CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier")
def multi_graph_union(spark, d):
    both = T.union([T.sales(spark, d), T.supply(spark, d), T.geo(spark, d)])
    found = select(both, [clause(Part(s, type=t), at("in_nation"), n)], [Out("s", "s"), Out("n", "n"), Out("t", "t")], graphs=("?sales", "?supply"))
    return found.select(F.when(key("t") == "/customer", "?sales").otherwise("?supply").alias("g"), *ids("s", "n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 3 DESC LIMIT 10")
def group_order_limit(spark, d):
    clauses = [clause(o, Anchored("placed_by", t), c), clause(o, at("total"), v)]
    outs = [Out("c", "c"), Out("n", "o", "count"), Out("total", "v", "sum_float")]
    found = select(T.sales(spark, d), clauses, outs, group_by=("c",), order_by=(F.col("total").desc(),), limit=10)
    return found.select(*ids("c"), "n", F.round("total", 2).alias("total"))


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS n FROM documents GROUP BY 1")
def aggregates_of_one_binding(spark, d):
    clauses = [clause(a, at("lang"), b), clause(a, at("n_chars"), c)]
    found = select(T.docs(spark, d), clauses, [Out("lang", "b"), Out("chars", "c", "sum_int"), Out("n", "c", "count")], group_by=("lang",))
    return found.select(text_of("lang").alias("lang"), "chars", "n")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS a FROM nation WHERE n_regionkey <> 2")
def having_not(spark, d):
    return select(T.geo(spark, d), [clause(a, at("in_region"), r)], [Out("a", "a")], having=~compare("r", "=", Node("/region", "2"))).select(*ids("a"))


@query("SELECT 'n_nationkey ' || n_nationkey AS value FROM nation")
def result_text(spark, d):
    found = match(T.geo(spark, d), [clause(Part(n, id=x), at("in_region"), r)])
    return to_text(found.select(F.lit("n_nationkey").alias("label"), "x"), " ")


@query("""SELECT '/nation<' || n_nationkey || '>	"in_region"@[]	/region<' || n_regionkey || '>' AS line FROM nation UNION ALL SELECT '/nation<' || n_nationkey || '>	"name"@[]	"' || n_name || '"^^type:text' FROM nation UNION ALL SELECT '/region<' || r_regionkey || '>	"name"@[]	"' || r_name || '"^^type:text' FROM region""")
def export_lines(spark, d):
    return T.geo(spark, d).select(fact_text().alias("line"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS s, p_size AS size FROM part")
def import_lines(spark, d):
    lines = T.supply(spark, d).filter("p_id = 'size'").select(fact_text().alias("value"))
    return parsed(lines, "?again").select(F.col("s_id").alias("s"), F.col("ol_i").cast("int").alias("size"))


# facts from bindings, and changes -----------------------------------------------------------------------------------


@query("SELECT DISTINCT '/nation<' || c_nationkey || '>' AS s, 'sells_to' AS p, '\"' || c_mktsegment || '\"^^type:text' AS o FROM customer")
def construct_edges(spark, d):
    rows = match(T.sales(spark, d), [clause(c, at("in_nation"), n), clause(c, at("segment"), s)])
    return construct(rows, [Template(n, at("sells_to"), s)], ("?out",)).select("s", F.col("p_id").alias("p"), "o")


@query("SELECT x AS p, count(*) AS n FROM orders, (SELECT unnest(['_subject', '_predicate', '_object', 'status']) AS x) GROUP BY 1")
def construct_reify_count(spark, d):
    rows = match(T.sales(spark, d), [clause(o, Anchored("placed_by", t), c), clause(o, at("status"), s)])
    made = construct(rows, [Template(c, Anchored("ordered", t), o, ((at("status"), s),))], ("?out",))
    return made.groupBy(F.col("p_id").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS s FROM customer WHERE c_mktsegment <> 'BUILDING'")
def deconstruct(spark, d):
    facts = T.sales(spark, d).filter("p_id = 'segment'")
    gone = construct(match(facts, [clause(c, at("segment"), Part(Literal("text", "BUILDING"), alias=s))]), [Template(c, at("segment"), s)], ("?sales",))
    return set_difference(facts, gone).select(F.col("s_id").alias("s"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS s, 'in_region' AS p FROM nation UNION ALL SELECT 'new', 'in_region' UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'name' FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'name' FROM region")
def insert_data(spark, d):
    facts = T.geo(spark, d)
    one = construct(spark.range(1), [Template(Node("/nation", "new"), at("in_region"), Node("/region", "1"))], ("?geo",))
    return set_union(facts, one.union(one)).select(F.col("s_id").alias("s"), F.col("p_id").alias("p"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS s FROM nation WHERE n_nationkey <> 5")
def delete_data(spark, d):
    facts = T.geo(spark, d).filter("p_id = 'name' AND s_type = '/nation'")
    return set_difference(facts, lookup(facts, Node("/nation", "5"))).select(F.col("s_id").alias("s"))


@query("SELECT p_id, count(*) AS n FROM (SELECT unnest(['in_nation', '_subject', '_predicate', '_object']) AS p_id FROM supplier) GROUP BY 1")
def reify_facts(spark, d):
    return reify(T.supply(spark, d).filter("p_id = 'in_nation'")).groupBy("p_id").agg(F.count("*").alias("n"))


@query("SELECT '?geo' AS graph_id UNION ALL SELECT '?sales' UNION ALL SELECT '?supply' UNION ALL SELECT '?events' UNION ALL SELECT '?docs'")
def show_graphs(spark, d):
    everything = T.union([f(spark, d) for f in (T.geo, T.sales, T.supply, T.events, T.docs)])
    return everything.select(F.col("graph").alias("graph_id")).distinct()


# stores and files: what is asked for is written to the shared folder and read back ------------------------------------


@query(
    "SELECT '?orders' AS g, 'status' AS p, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2 UNION ALL SELECT '?orders', 'total', count(*) FROM orders UNION ALL SELECT '?copy', 'total', count(*) FROM orders"
)
def store_changes(spark, d):
    """Created, filled twice with the same, cut down, dropped and compacted."""
    graphs, facts = Graphs(spark, scratch(spark)), T.sales(spark, d)
    graphs.create("?orders", "?copy", "?gone")
    wanted = facts.filter("s_type = '/order' and p_id in ('status', 'total')")
    graphs.insert(wanted, "?orders", "?gone")
    graphs.insert(facts.filter("s_type = '/order' and p_id = 'total'"), "?orders", "?copy")
    graphs.delete(facts.filter("p_id = 'status' and ol_t = 'F'"), "?orders")
    graphs.drop("?gone")
    graphs.compact("?copy")
    found = graphs.read(*[r.graph_id for r in graphs.names().orderBy("graph_id").collect()])
    return found.groupBy(F.col("graph").alias("g"), F.col("p_id").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT '?by_' || lower(o_orderstatus) AS graph_id FROM orders WHERE o_orderstatus <> 'P'")
def store_names(spark, d):
    """A graph for each status, of which one is dropped, as the catalog lists them."""
    graphs, facts = Graphs(spark, scratch(spark)), T.sales(spark, d).filter("p_id = 'status'")
    names = [f"?by_{r.ol_t.lower()}" for r in facts.select("ol_t").distinct().orderBy("ol_t").collect()]  # of three statuses
    graphs.create(*names)
    graphs.drop("?by_p") if "?by_p" in names else None
    return graphs.names()


@query("SELECT '/nation<' || c_nationkey || '>' AS s, '/customer<' || c_custkey || '>' AS o FROM customer WHERE c_mktsegment <> 'BUILDING'")
def store_construct(spark, d):
    """Facts made of a graph into the same graph, and some of them taken out again by template."""
    graphs = Graphs(spark, scratch(spark))
    graphs.create("?g")
    graphs.insert(T.sales(spark, d).filter("p_id in ('in_nation', 'segment')"), "?g")
    graphs.construct([Template(n, at("has"), c)], ("?g",), ("?g",), [clause(c, at("in_nation"), n)])
    graphs.deconstruct([Template(n, at("has"), c)], ("?g",), ("?g",), [clause(c, at("in_nation"), n), clause(c, at("segment"), Literal("text", "BUILDING"))])
    return lookup(graphs.read("?g"), predicate=at("has")).select("s", "o")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS s, o_totalprice / 3 AS v, epoch_us(o_orderdate) AS at FROM orders")
def export_and_import(spark, d):
    """Two graphs exported as one folder of lines and read again: floats and anchors come back as they were."""
    folder, facts = scratch(spark), T.sales(spark, d)
    graphs = Graphs(spark, f"{folder}/store")
    graphs.create("?placed", "?third")
    third = T.table(spark, d, "orders").select(fact("?third", ("/order", F.col("o_orderkey")), "third", literal=("float64", F.col("o_totalprice") / 3)))
    graphs.insert(facts.filter("p_id = 'placed_by'"), "?placed")
    graphs.insert(third, "?third")
    graphs.export(f"{folder}/lines", "?placed", "?third")
    again = read_facts(spark, f"{folder}/lines", "?again", most_bytes=1000)
    found = match(again, [clause(o, at("third"), v), clause(o, Anchored("placed_by", t), c)])
    return found.select(id_of("o").alias("s"), float_of("v").alias("v"), time_of("t").alias("at"))


@query("SELECT CAST(doc_id AS VARCHAR) AS s, text AS t FROM documents WHERE text IS NOT NULL")
def export_texts(spark, d):
    """Whole texts, line ends and all, as fact lines and back."""
    folder, docs = scratch(spark), T.table(spark, d, "documents").filter("text is not null")
    write_facts(docs.select(fact("?texts", ("/doc", F.col("doc_id")), "text", literal=("text", F.col("text")))), folder)
    return read_facts(spark, folder, "?texts").select(F.col("s_id").alias("s"), F.col("ol_t").alias("t"))


@query("SELECT '{\"?c\":{\"node\":\"/customer<' || c_custkey || '>\"},\"?o\":' || CASE WHEN o_orderkey IS NULL THEN '{}' ELSE '{\"node\":\"/order<' || o_orderkey || '>\"}' END || '}' AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def result_json(spark, d):
    return to_json(match(T.sales(spark, d), [clause(c, at("in_nation"), n), optional(o, Anchored("placed_by"), c)]).select("c", "o"))


@query("SELECT '/customer<' || c_custkey || '> ' || c_mktsegment AS value FROM customer")
def result_text_customers(spark, d):
    found = match(T.sales(spark, d), [clause(c, at("segment"), s)])
    return to_text(found.select("c", text_of("s").alias("s")), " ")


@query("SELECT '?seg_' || lower(c_mktsegment) AS graph, count(*) AS n FROM customer GROUP BY 1")
def story_files(spark, d):
    """Facts in files of the story form, a file a market segment, read back."""
    folder = scratch(spark)
    lines = lookup(T.sales(spark, d), predicate=at("segment")).select(F.concat(F.lit("?seg_"), F.lower("ol_t")).alias("id"), F.pmod(F.xxhash64("s"), F.lit(16)).alias("part"), fact_text().alias("line"))
    # a story is one JSON document, so a segment's lines are dealt to sixteen of them
    sources = lines.groupBy("id", "part").agg(F.collect_list("line").alias("Facts")).select(F.array(F.struct(F.col("id").alias("ID"), "Facts")).alias("Sources"))
    story = sources.select(F.lit("segments").alias("Name"), "Sources", F.from_json(F.lit("[]"), "array<struct<Requires:string>>").alias("Assertions"))
    story.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    stories = parsed(
        spark.read.schema("Sources array<struct<ID:string,Facts:array<string>>>").json(folder).select(F.explode("Sources").alias("x")).select(F.col("x.ID").alias("id"), F.explode("x.Facts").alias("value")),
        F.col("id"),
    )
    return stories.groupBy("graph").agg(F.count("*").alias("n"))


# the same operators over tables that grow, and cases that the queries above leave out ---------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer WHERE c_custkey = c_nationkey")
def repeated_id(spark, d):
    """One variable for the ids of a subject and its object."""
    return match(T.sales(spark, d), [clause(Part(c, id=x), at("in_nation"), Part(n, id=x))]).select(*ids("c"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS e FROM events WHERE user_id = event_id % 97")
def repeated_node(spark, d):
    """One variable for a subject and its object, over links between users made of the events."""
    links = T.table(spark, d, "events").select(fact("?links", ("/user", F.col("user_id")), F.concat(F.lit("e"), F.col("event_id")), node=("/user", F.col("event_id") % 97)))
    return match(links, [clause(u, Part(p, id=e), u)]).select(*ids("u"), F.substring(key("e"), 2, 99).alias("e"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o FROM orders WHERE o_orderdate <= (SELECT min(o_orderdate) + INTERVAL 300 DAY FROM orders)")
def pred_range_open_low_rows(spark, d):
    first = lookup(T.sales(spark, d), filtered=None).filter("p_id = 'placed_by'").agg(F.min("p_ns")).first()[0] or 0
    high = spark.range(1).select(F.date_format(F.timestamp_micros(F.lit(first // 1000 + 300 * 86_400_000_000)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).first()[0]
    return match(T.sales(spark, d), [clause(o, Anchored("placed_by", high=high), c)]).select(*ids("o"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p FROM part WHERE p_brand <> 'Brand#11' AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey AND q.p_size > 25)")
def optional_missing_rows(spark, d):
    facts = T.supply(spark, d)
    large = lookup(facts, predicate=at("size")).filter("ol_i > 25").withColumn("p_id", F.lit("large")).withColumn("p", F.lit("large@"))
    found = match(facts.union(large), [clause(p, at("brand"), b), optional(p, at("large"), s)])
    return found.filter(F.col("s").isNull() & ~compare("b", "=", Literal("text", "Brand#11"))).select(*ids("p"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c, CAST(s_suppkey AS VARCHAR) AS s FROM customer LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 4) ON true WHERE c_nationkey = 4")
def optional_disjoint_rows(spark, d):
    """An optional clause that shares no variable and has matches."""
    facts = T.sales(spark, d).union(T.supply(spark, d).filter("p_id = 'in_nation'").withColumn("p_id", F.lit("based_in")).withColumn("p", F.lit("based_in@")))
    return match(facts, [clause(c, at("in_nation"), Node("/nation", "4")), optional(s, at("based_in"), Node("/nation", "4"))]).select(*ids("c", "s"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, event_type AS p, epoch_us(ts) AS at FROM events QUALIFY ts = max(ts) OVER (PARTITION BY event_type)")
def filter_object_latest_pattern(spark, d):
    """The filter on an object, through a pattern."""
    found = match(T.events(spark, d), [clause(u, at("did"), Part(o, id=k, at=t))], (Filter("latest", o),))
    return found.select(*ids("u"), key("k").alias("p"), time_of("t").alias("at"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS e FROM events WHERE ts = (SELECT max(ts) FROM events WHERE event_type = 'view') AND event_type = 'view'")
def lookup_filtered(spark, d):
    found = lookup(T.events(spark, d).filter("p_id = 'view'"), filtered="latest")
    return found.select(F.col("s_id").alias("u"), F.col("on_id").alias("e"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1 AND c_nationkey = 99) AND false")
def exist_filter_absent(spark, d):
    """A fact that is not there leaves no rows, whatever else matches."""
    return match(T.sales(spark, d), [clause(Node("/customer", "1"), at("in_nation"), Node("/nation", "99")), clause(c, at("segment"), s)]).select(*ids("c"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, event_type AS p FROM events WHERE ts = (SELECT ts FROM events WHERE event_id = 5) AND event_type = (SELECT event_type FROM events WHERE event_id = 5)")
def pred_constant_temporal(spark, d):
    """A predicate with its anchor as a constant."""
    row = T.table(spark, d, "events").filter("event_id = 5").select("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at")).first()
    known = Predicate(row.event_type, row.at) if row else Predicate("none", "1970-01-01T00:00:00Z")
    return match(T.events(spark, d), [clause(u, Part(known, alias=p), e)]).select(*ids("u"), id_of("p").alias("p"))


@query("SELECT CAST(user_id AS VARCHAR) AS u, epoch_us(ts) AS at FROM events WHERE event_type = 'signup'")
def object_anchor_binding(spark, d):
    """A variable for the anchor of an object's predicate."""
    return match(T.events(spark, d), [clause(u, at("did"), Part(Anchored("signup", t)))]).select(*ids("u"), time_of("t").alias("at"))


@query("SELECT CAST(NULL AS VARCHAR) AS b, CAST(NULL AS BIGINT) AS n WHERE false")
def group_of_nothing(spark, d):
    """Groups of no rows are none."""
    found = select(T.supply(spark, d), [clause(p, at("brand"), Literal("text", "Brand#none")), clause(p, at("type"), b)], [Out("b", "b"), Out("n", "p", "count")], group_by=("b",))
    return found.select(text_of("b").alias("b"), "n")


@query("SELECT 'by_' || o_orderstatus AS p, '/_<v>' AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1, 2")
def construct_blank(spark, d):
    """Facts of a blank node, with the predicates' names taken from the rows."""
    rows = match(T.sales(spark, d), [clause(o, at("status"), s), clause(o, Anchored("placed_by"), c)])
    made = [construct(rows.filter(compare("s", "=", Literal("text", x))), [Template(blank("v"), at(f"by_{x}"), c)], ("?out",)) for x in "FOP"]
    return T.union(made).groupBy(F.col("p_id").alias("p"), "s").agg(F.count("*").alias("n"))


@query("SELECT g, p, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier), (SELECT unnest(['?x', '?y']) AS g), (SELECT unnest(['sells', 'is_market']) AS p) GROUP BY 1, 2")
def construct_many(spark, d):
    """Two templates into two graphs; a fact is once in each."""
    rows = match(T.supply(spark, d), [clause(s, at("in_nation"), n)])
    made = construct(rows, [Template(n, at("sells"), Node("/thing", "goods")), Template(n, at("is_market"), Literal("bool", True))], ("?x", "?y"))
    return made.groupBy(F.col("graph").alias("g"), F.col("p_id").alias("p")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS s, 'status' AS p FROM orders WHERE o_orderkey < 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status' FROM orders UNION ALL SELECT 'new', 'status'")
def insert_orders(spark, d):
    facts = T.sales(spark, d).filter("p_id = 'status'")
    one = construct(spark.range(1), [Template(Node("/order", "new"), at("status"), Literal("text", "O"))], ("?sales",))
    return set_union(set_union(facts, one), facts).select(F.col("s_id").alias("s"), F.col("p_id").alias("p"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS s FROM orders WHERE o_orderstatus <> 'F'")
def delete_orders(spark, d):
    facts = T.sales(spark, d).filter("p_id = 'status'")
    return set_difference(facts, lookup(facts, obj=Literal("text", "F"))).select(F.col("s_id").alias("s"))


@query("SELECT depth, count(*) AS n FROM (SELECT CAST(floor(log2(o_orderkey + 1)) AS BIGINT) AS depth FROM (SELECT row_number() OVER () AS o_orderkey FROM orders)) GROUP BY 1")
def generated_tree(spark, d):
    """A binary tree of as many facts as there are orders: its nodes by depth."""
    made = tree(spark, T.table(spark, d, "orders").count(), 2)
    depth = F.floor(F.log2(F.col("on_id").cast("long") + 1)).cast("long")
    return made.groupBy(depth.alias("depth")).agg(F.count("*").alias("n"))
