import random
import re

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash as S
from factloom.llm.components import components

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """rows (doc_id, fp): doc_id to the smallest reachable, by comparing all pairs."""
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 3:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "Ünï Äa b c\x1cd e\tf", "a b c a b c a b c", " ".join(str(i * i) for i in range(500))])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_sparks_hash(spark):
    text = "Größe zählt nicht immer sehr"
    grams = [["größe zählt nicht"], ["zählt nicht immer"], ["nicht immer sehr"]]
    hs = [r[0] % (1 << 64) for r in spark.createDataFrame(grams, "g string").selectExpr("xxhash64(g)").collect()]
    assert S.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 3)


def test_every_close_pair_meets_at_a_home():
    rng = random.Random(5)
    for flips in (0, 1, 2, 3):
        for _ in range(300):
            x = rng.getrandbits(64) if rng.random() < 0.7 else rng.choice([0, (1 << 64) - 1, 0x7FFFFFFF])
            y = x
            for b in rng.sample(range(64), flips):
                y ^= 1 << b
            _, kx, hx = S.anchors(np.array([x], np.uint64))
            _, ky, hy = S.anchors(np.array([y], np.uint64))
            assert set(kx[hx]) & set(ky) and set(ky[hy]) & set(kx)


def clouds():
    rng = random.Random(7)
    out = [0, 1, 0xFFFF]
    for _ in range(8):
        x = rng.getrandbits(64)
        bits = rng.sample(range(64), 9)
        for _ in range(40):
            y = x
            for b in rng.sample(bits, rng.randint(0, 4)):
                y ^= 1 << b
            out.append(y)
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):  # far ends that only others join
        chain ^= 7 << b
        out.append(chain)
    return list(dict.fromkeys(out + [rng.getrandbits(64) for _ in range(300)]))


@pytest.mark.parametrize("block", [4096, 8])
def test_links_give_the_components_of_all_pairs(spark, block):
    fps = clouds()
    want = brute_components(list(enumerate(fps)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)).collect()
    group = {r.node: r.root for r in roots}
    got = [group.get(x, x) for x in signed]
    ours, theirs = {}, {}
    for i, g in enumerate(got):
        ours.setdefault(g, set()).add(i)
        theirs.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    assert all(g == min(g_ for g_ in [got[i]]) for i, g in enumerate(got))


def docs():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for k in range(12):
        words = rng.choices(vocabulary, k=200)
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(200)] = "changed"
            out.append(" ".join(copy))
        out.append(" ".join(words).upper())
    out += ["", None, " \n", "one", "One", "two words"]
    rng.shuffle(out)
    return [(i * 3, t, "en", "s", 0) for i, t in enumerate(out)]


def test_near_duplicates(spark):
    rows = docs() + [docs()[0]]
    df = spark.createDataFrame(rows, FIELDS).withColumnRenamed("n_chars", "fp")
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in docs()])
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got} == {(r[0], brute_fingerprint(r[1]), want[r[0]]) for r in rows}
    kept = S.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_nulls_and_no_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], FIELDS)).collect() == []
    df = spark.createDataFrame([(None, "a b c d", "", "", 0), (None, "a b c d", "", "", 0), (4, "a b c d", None, None, None)], FIELDS)
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [4, 4, 4]
    assert sorted(r.doc_id or 0 for r in S.deduplicated(df).collect()) == [0, 0, 4]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub + [(5, 5), (7, 6)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_columns_of_the_same_names(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 2), (2, "a b c d", 3), (None, "other words here", 4), (None, "other words here", 5), (3, "", 6), (4, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").selectExpr("*", "1 as _alone", "2 as alone", "3 as row", "4 as fp", "5 as component_id")
    out = S.deduplicated(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got if r.doc_id) == [1, 3] and sum(r.doc_id is None for r in got) == 2
    assert {tuple(r)[3:] for r in got} == {(1, 2, 3, 4, 5)} and S.deduplicated(df.limit(0)).collect() == []
