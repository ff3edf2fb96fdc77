import base64
import os
import pydoc_data.topics
import random
import re
from pathlib import Path

import zstandard

from factloom.llm import quality_rules as Q

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 5, 40, 300):
        for alphabet in (["a"], ["a", "b"], [f"w{i}é#" for i in range(40)], ["x y", "\x1c", "z|"]):
            text = "".join(rng.choice(alphabet) + rng.choice([" ", "\n", "\t ", "\r\n", "\x0b"]) for _ in range(n))
            assert Q.counts(text) == brute(text)


def test_judge(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FFF)) for _ in range(8)) for _ in range(2000))
    repeated = "\n".join(f"{i} all work and no play makes jack a dull boy {i * i}" for i in range(800))
    data = [(1, prose, "en", "s", 0), (2, noise, "en", "s", 0), (3, repeated, "en", "s", 0), (4, None, None, None, None), (5, "", "", "", 0), (1, prose, "en", "s", 0), (6, "a " * 60, "en", "s", 0), (7, prose[:500], None, None, 0)]
    df = spark.createDataFrame(data, FIELDS)
    got = [(r.doc_id, r.kept) for r in Q.judge(df).collect()]
    assert sorted(got) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, True)]
    for r in Q.judge(df).collect():
        text = next(x[1] for x in data if x[0] == r.doc_id)
        n, chars, symbols, dup, repeats = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 7]
    assert Q.judge(df.limit(0)).collect() == []


def passes(raw):
    zstd = zstandard.ZstdCompressor(level=Q.Bands().level, write_content_size=False, write_checksum=False)
    return Q.compression(raw, Q.Bands(), zstd)[2]


def test_natural_texts_and_code_pass_in_every_band():
    rng = random.Random(3)
    topics = [t.encode() for t in pydoc_data.topics.topics.values() if len(t.split()) >= 50]
    code = [p.read_bytes() for p in sorted(Path(os.__file__).parent.glob("*.py"))]
    for texts, most in ((topics, 0.03), (code, 0.03)):
        assert sum(not passes(t) for t in texts if len(t) >= 200) <= most * len(texts)
        edges = [x[0] for x in Q.Bands().limits][1:]
        for low, high in zip(edges, edges[1:]):
            parts = [t[(at := rng.randrange(len(t) - low)) : at + rng.randrange(low, high)] for t in texts if len(t) > low]
            assert sum(not passes(t) for t in parts) <= max(1, 2 * most * len(parts))


def test_repeated_text_fails_in_every_band():
    for n in (200, 499, 500, 999, 1000, 1999, 2000, 4000, 8192, 16000, 64000, 300_000):
        for line in (b"all work and no play\n", b"buy now ", b"x"):
            assert not passes((line * n)[:n])


def test_chunks_judge_common_documents():
    rng = random.Random(6)
    for n in (1024, 1500, 2048, 3833, 8000):
        noise, line = base64.b64encode(rng.randbytes(n))[:n], (b"all work and no play\n" * n)[:n]
        zstd = zstandard.ZstdCompressor(level=Q.Bands().level, write_content_size=False, write_checksum=False)
        ratio, bad, ok = Q.compression(noise + line, Q.Bands(), zstd)
        assert not Q.Bands().out(2 * n, ratio) and bad > 0.34 and not ok


def test_verdicts_equal_a_plain_reading_of_the_rules(spark):
    """kept by brute force: the counts by definition, the bands from a table of their own, chunks by slicing."""
    import random
    import zstandard

    bands = [(64000, 0.06, 0.55), (16000, 0.08, 0.56), (4000, 0.1, 0.6), (2000, 0.12, 0.65), (1000, 0.14, 0.7), (500, 0.18, 0.78), (200, 0.25, 0.85), (0, 0.0, 9.0)]

    def within(raw):
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(raw)) / len(raw)
        low, high = next((low, high) for n, low, high in bands if len(raw) >= n)
        return low <= ratio <= high

    def kept(text):
        raw = (text or "").encode()
        words = raw.split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = {w for w in windows if windows.count(w) > 1}
        repeated = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            return False
        chunks = max(1, len(raw) // 1024)
        bad = sum(not within(raw[k * len(raw) // chunks : (k + 1) * len(raw) // chunks]) for k in range(chunks)) if chunks > 1 else 0
        return within(raw) and bad <= 0.34 * chunks

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, n)))
    noise = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    texts = [None, "", " ", "a " * 60, "x" * 5000, noise(3000), " ".join(noise(9) for _ in range(400))]
    for n in (20, 60, 150, 400, 900):
        pool = [word(9) for _ in range(max(5, n // 3))]
        texts += [" ".join(word(9) for _ in range(n)), " ".join(rng.choices(pool, k=n)), " ".join(rng.choices(pool[:6], k=n))]
        half = " ".join(word(8) for _ in range(n))
        texts += [half + "\n" + "one line again and again " * (n // 5), half + "\n" + " ".join(noise(40) for _ in range(n // 4)), " ".join(f"{a} {a}" for a in pool)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in Q.judge(df).collect()}
    want = {k: kept(t) for k, t in enumerate(texts)}
    assert got == want and 5 < sum(want.values()) < len(want) - 5
    assert {r.doc_id for r in Q.kept_documents(df).collect()} == {k for k, v in want.items() if v}
