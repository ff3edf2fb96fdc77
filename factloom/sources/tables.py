"""Facts of relational tables. Graph and predicate are constants of each part, so a query reads only the tables it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import fact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchor(column: str) -> Column:
    """Nanoseconds since 1970 of a time without zone, taken as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})") * 1000


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    n, r = ("/nation", F.col("n_nationkey")), ("/region", F.col("r_regionkey"))
    return union(
        [
            nation.select(fact("?geo", n, "in_region", node=("/region", F.col("n_regionkey")))),
            nation.select(fact("?geo", n, "name", literal=("text", F.col("n_name")))),
            region.select(fact("?geo", r, "name", literal=("text", F.col("r_name")))),
        ]
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    c, o = ("/customer", F.col("c_custkey")), ("/order", F.col("o_orderkey"))
    return union(
        [
            customer.select(fact("?sales", c, "in_nation", node=("/nation", F.col("c_nationkey")))),
            customer.select(fact("?sales", c, "segment", literal=("text", F.col("c_mktsegment")))),
            customer.select(fact("?sales", c, "acctbal", literal=("float64", F.col("c_acctbal")))),
            orders.select(fact("?sales", o, "placed_by", node=("/customer", F.col("o_custkey")), at=anchor("o_orderdate"))),
            orders.select(fact("?sales", o, "status", literal=("text", F.col("o_orderstatus")))),
            orders.select(fact("?sales", o, "total", literal=("float64", F.col("o_totalprice")))),
        ]
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    s, p = ("/supplier", F.col("s_suppkey")), ("/part", F.col("p_partkey"))
    return union(
        [
            supplier.select(fact("?supply", s, "in_nation", node=("/nation", F.col("s_nationkey")))),
            part.select(fact("?supply", p, "size", literal=("int64", F.col("p_size").cast("long")))),
            part.select(fact("?supply", p, "brand", literal=("text", F.col("p_brand")))),
            part.select(fact("?supply", p, "type", literal=("text", F.col("p_type")))),
        ]
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    u, e = ("/user", F.col("user_id")), ("/event", F.col("event_id"))
    return union(
        [
            rows.select(fact("?events", u, F.col("event_type"), node=e, at=anchor("ts"))),
            rows.select(fact("?events", e, "value", literal=("float64", F.col("value")))),
            # what a user last did, as a predicate that is an object
            rows.select(fact("?events", u, "did", reified=(F.col("event_type"), anchor("ts")))),
        ]
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = ("/doc", F.col("doc_id"))
    return union(
        [
            rows.select(fact("?docs", d, "lang", literal=("text", F.col("lang")))),
            rows.select(fact("?docs", d, "source", literal=("text", F.col("source")))),
            rows.select(fact("?docs", d, "n_chars", literal=("int64", F.col("n_chars")))),
            labels.select(fact("?docs", d, "quality", literal=("int64", F.col("quality").cast("long")))),
        ]
    )
