import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = []
    for i in range(400):
        source = ["a", "a", "b", "c", None, "dé", "\U0001f600"][i % 7] if i % 5 else "hot"
        out.append((i, " ".join(["w"] * (i * 37 % 90)), "en", source, 0))
    out += [(1000, None, None, "empty", 0), (1001, "", None, "empty", 0), (7, "again and again", "en", "b", 0), (8, "w w", "en", "c", 0), (8, "w w", "en", "c", 0), (1002, "x" * 10 + " y" * 20000, "en", "c", 0)]
    return out


def oracle(data):
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if data:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", data)
    return con.sql(mixing.ORACLE_SQL).fetchall()


def mixed(spark, data):
    df = mixing.mix(spark.createDataFrame(data, FIELDS))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def test_mix_equals_sql(spark):
    got = sorted(tuple(r) for r in mixed(spark, rows()).collect())
    assert got == sorted(oracle(rows()))


def test_mix_targets_and_limits(spark):
    data = rows()
    got = mixed(spark, data).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
    df = mixing.mix(spark.createDataFrame(data, FIELDS)).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max("source_size").alias("all")
    )
    for r in df.collect():
        by[r["source"]] = r["target"]
        assert abs(r["taken"] - r["target"]) <= r["most"] + 1e-6
        assert r["target"] <= 2 * r["all"]
    assert sum(by.values()) == pytest.approx(1.5 * total)


def test_mix_is_repeatable_and_empty(spark):
    assert sorted(map(tuple, mixed(spark, rows()).collect())) == sorted(map(tuple, mixed(spark, rows()).collect()))
    assert mixed(spark, []).collect() == []


def test_mixed_documents_keeps_columns(spark):
    df = spark.createDataFrame(rows()[:400], FIELDS).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(9))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert out.count() == want and out.filter("size <> 'mine' or copies <> 9").count() == 0


def test_groups_of_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 12)
    monkeypatch.setattr(mixing, "GROUP", 3)
    assert sorted(map(tuple, mixed(spark, rows()).collect())) == sorted(oracle(rows()))


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame(rows()[:200], FIELDS).selectExpr("*", "1 as _mix", "2 as _of_source", "3 as _mix_copy", "4 as _mix_copies", "5 as _mix_size", "6 as row", "7 as n", "8 as size", "9 as col")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert out.select(*df.columns[5:]).distinct().collect() == [tuple(range(1, 10))]
    assert mixing.mixed_documents(df.limit(0)).collect() == []
