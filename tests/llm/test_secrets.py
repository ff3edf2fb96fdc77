import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from factloom.llm import secrets as S

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "", None, "nothing here", "password=hunter2hunter2", "PassWord : 'abcdef'", 'token="short"', 'token="token: abcdefgh"', "secret==abc", "api_key=aaaaaa apikey:bbbbbbb API-KEY=cccccc",
    "é\U0001f600 token = " + "0123456789abcdef" * 2 + " end", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "A", "xAKIAAKIA" + "Z" * 20 + "é AKIAB", "deadbeef" * 3, "deadbeef" * 2 + "dead", "f" * 24 + "g" + "0" * 30,
    "token=" + "a" * 40, "passwd:x passwd: yyyyyy", "ſecret=abcdef toKen=abcdef toKen=abcdef", "\n".join(f"secret: value{i:04d}" for i in range(300)), "password=\n'abcdefgh", "token=tok_en=abcdef",
]


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def rows():
    return [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 0), (None, TEXTS[4], None, None, None), (50, TEXTS[9], "en", "s", 0)]


def test_digest_equals_brute_force_and_sql(spark):
    df = spark.createDataFrame(rows(), FIELDS).withColumnRenamed("lang", "found").withColumnRenamed("source", "spans")
    got = sorted((tuple(r) for r in S.digest(S.scan(df)[0]).collect()), key=repr)
    want = []
    for i, t, *_ in rows():
        spans = brute(t)
        n = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        want.append((i, *n, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)))
    assert got == sorted(want, key=repr)
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows())
    assert sorted(con.sql(S.ORACLE_SQL).fetchall(), key=repr) == got
    assert S.digest(S.scan(df.limit(0))[0]).collect() == []


def test_only_unseen_pairs_are_scanned(spark):
    path = lambda rows: spark.createDataFrame(rows, "path string, at int, text string")
    first = path([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("c", 1, "clean")])
    found, new = S.scan(first)
    assert new.count() == 2 * len(S.RULES) and found.filter(F.size("found") > 0).count() == 2
    ledger = new
    second = path([("a", 1, "token=abcdef"), ("a", 2, "token=abcdef AKIA" + "A" * 16), ("d", 1, "clean")])
    found, new = S.scan(second, ledger)
    assert new.count() == len(S.RULES) and new.select("blob").distinct().count() == 1
    assert sorted((r.path, r.at, len(r.found)) for r in found.collect()) == [("a", 1, 1), ("a", 2, 2), ("d", 1, 0)]
    ledger = ledger.unionByName(new)
    newer = (*S.RULES[:2], S.Rule("hex", "[0-9a-f]{3,}", version=2))
    found, new = S.scan(second, ledger, newer)
    assert {(r.rule, r.version) for r in new.collect()} == {("hex", 2)} and new.count() == 3
    assert sorted((r.path, r.at, sorted(x.rule for x in r.found)) for r in found.collect()) == [("a", 1, ["assign", "hex"]), ("a", 2, ["access", "assign", "hex"]), ("d", 1, [])]
    assert S.scan(second, ledger.unionByName(new), newer)[1].count() == 0


def test_a_history_scans_each_pair_once(spark):
    texts = ["token=abcdef", "clean", None, "", "AKIA" + "B" * 16]
    rows = [(k, texts[k % 5], k // 10) for k in range(40)] + [(99, "secret: abcdefg", 3), (98, "token=abcdef", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    found, new = S.scan_history(df, F.col("at"), 4)
    # the four texts of the first age and the one of the last, for each rule; null and empty are one
    pairs = [(r.blob, r.rule, r.version) for r in new.collect()]
    assert len(pairs) == len(set(pairs)) == 5 * len(S.RULES)
    want = sorted((i, ",".join(brute(t))) for i, t, _ in rows)
    assert sorted((r.doc_id, r.spans) for r in S.digest(found).collect()) == want
    # against that ledger, a second history of the same texts scans nothing
    again, none = S.scan_history(df, F.lit(0), 1, ledger=new)
    assert none.count() == 0 and sorted((r.doc_id, r.spans) for r in S.digest(again).collect()) == want


def test_the_query_scans_copies_of_the_first_age_no_more(spark, tmp_path, monkeypatch):
    from factloom.llm import queries

    rows = [(k, f"password: secret{k % 7}x", "en", "s", 0) for k in range(60)]
    spark.createDataFrame(rows, FIELDS).write.parquet(str(tmp_path / "documents.parquet"))
    scanned, seen = [], S.scanned

    def counting(texts, rules):
        scanned.append(texts.count())
        return seen(texts, rules)

    monkeypatch.setattr(S, "scanned", counting)
    assert len(queries.op5_secrets(spark, str(tmp_path)).collect()) == 60
    assert scanned[0] == 7 and scanned[1] == 0


def test_a_stored_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, None)], "doc_id long, text string")
    folder = str(tmp_path / "ledger")
    first = S.digest(S.scan_stored(df, folder)).collect()
    assert spark.read.parquet(folder).count() == 2 * len(S.RULES)
    assert S.digest(S.scan_stored(df, folder)).collect() == first
    S.scan_stored(df.union(spark.createDataFrame([(4, "new token=zzzzzz")], df.schema)), folder)
    assert spark.read.parquet(folder).count() == 3 * len(S.RULES)


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "token=abcdef", "mine", 5, 6, 7)], "doc_id long, text string, blob string, found int, todo int, rule int")
    (row,) = S.scan(df)[0].collect()
    assert row.blob != "mine" and len(row.found) == 1 and (row.todo, row.rule) == (6, 7)
