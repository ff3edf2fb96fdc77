import random

import duckdb
import numpy as np

from factloom.llm import line_dedup as L
from factloom.llm.minimal_hash import LineIndex

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(3)
    lines = [f"Line number {i} of the  pool" for i in range(60)] + ["short", "", "   ", "\tÄÖÜ äöü ßß é\x0b", "a" * 10, "b" * 9, "ⅷ" * 10, "  A COMMON LINE \r", "a common line"]
    out = []
    for i in range(300):
        picked = [rng.choice(lines) if rng.random() < 0.4 else f"own line {i} {k} {rng.random()}" for k in range(rng.randint(0, 12))]
        if i % 3 == 0:
            picked.insert(rng.randint(0, len(picked)), "a line that a third of all documents hold")
        out.append((i * 7 % 307, "\n".join(picked), "en", "s", 5))
    out += [(900, None, None, None, None), (901, "", "", "", 0), (902, "A common line\na common line", "en", "s", 0), (903, "x" * 50000 + "\n" + "a common line", "en", "s", 0)]
    return out


def oracle(data):
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", data)
    return sorted(con.sql(L.ORACLE_SQL).fetchall())


def test_digest_equals_sql(spark, monkeypatch):
    df = spark.createDataFrame(rows(), FIELDS)
    want = oracle(rows())
    assert sorted(map(tuple, L.line_digest(df).collect())) == want
    monkeypatch.setattr(L, "SHARD_KEYS", 5)
    monkeypatch.setattr(L, "SHARD_PROBES", 7)
    monkeypatch.setattr(L, "HOT", 1)
    assert sorted(map(tuple, L.line_digest(df).collect())) == want
    assert sum(r[2] for r in want) > 300


def test_documents(spark):
    df = spark.createDataFrame(rows(), FIELDS).withColumnRenamed("lang", "h1").withColumnRenamed("source", "shard")
    out = L.deduplicated_lines(df)
    assert out.schema.names == df.schema.names
    got = {r.doc_id: r for r in out.collect()}
    import hashlib

    for doc_id, _, _, digest in oracle(rows()):
        assert hashlib.sha256((got[doc_id].text or "").encode()).hexdigest() == digest
    assert got[900].text is None and got[900].n_chars is None and got[902].n_chars == len(got[902].text)


def test_few_repeated_lines_among_many(spark, monkeypatch):
    """Shards follow the lines that probe, so that no task has them all when hardly any line is common."""
    data = [(i, "\n".join(f"a line of its own {i} {k}" for k in range(10)) + ("\none common line" if i in (3, 5) else ""), "en", "s", 0) for i in range(400)]
    df = spark.createDataFrame(data, FIELDS)
    monkeypatch.setattr(L, "SHARD_PROBES", 100)
    of = L.probe_shards

    def counting(batches):
        n = 0
        for batch in batches:
            n += batch.num_rows
        yield L.pa.RecordBatch.from_arrays([L.pa.array([n]), L.pa.array([0]), L.pa.array([0])], names=["doc_id", "h1", "h2"])

    monkeypatch.setattr(L, "probe_shards", counting)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = [r.doc_id for r in L.dropped_lines(df).select("doc_id").collect() if r.doc_id]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 4 and max(tasks) < 0.4 * 4002
    monkeypatch.setattr(L, "probe_shards", of)
    assert [(r.doc_id, r.n_dropped) for r in L.line_digest(df).filter("n_dropped > 0").collect()] == [(5, 1)]


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame(rows(), FIELDS).selectExpr("*", "1 as _gone", "2 as _of", "3 as of", "4 as Lines", "5 as h1", "6 as copy", "7 as index")
    out = L.deduplicated_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.select("_gone", "_of", "of", "Lines", "h1", "copy", "index").distinct().collect() == [(1, 2, 3, 4, 5, 6, 7)]


def test_edges(spark):
    df = spark.createDataFrame([(None, "a line that repeats", "", "", 0), (1, "a line that repeats", "", "", 0), (1, "a line that repeats", "", "", 0), (None, "a line that repeats", "", "", 0)], FIELDS)
    assert sorted((r.doc_id or 0, r.n_dropped) for r in L.line_digest(df).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0)]
    df = df.union(spark.createDataFrame([(2, "A line that repeats\nA LINE THAT REPEATS", "", "", 0)] * 2, FIELDS))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in L.line_digest(df).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert L.line_digest(df.limit(0)).collect() == []


def test_index():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 20000):
        h1 = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        h1[: n // 2] = h1[0] if n else 0  # pairs may share a half
        h2 = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        index = LineIndex.from_bytes(LineIndex.build(h1, h2, np.arange(n) + 2, np.arange(n) * 5).to_bytes())
        assert sorted(index.number(h1, h2)) == list(range(n))
        found, count, first = index.probe(h1, h2)
        assert found.all() and (count == np.arange(n) + 2).all() and (first == np.arange(n) * 5).all()
        others = index.probe(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
        assert not others[0].any()
