"""The pipeline's stages on a small corpus, each against a brute-force version over its own input."""

import random
import re

import duckdb
import numpy as np

import corpus_pipeline
from factloom.llm import bpe, mixing, quality_rules
from tests.llm.test_simhash import brute_components, brute_fingerprint

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2500)]
    common = ["a line that many documents share at their end", "All Rights Reserved, as ever."]
    out = []
    for i in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(8, 20))) for _ in range(rng.randint(6, 14))]
        if i % 3 == 0:
            lines.append(common[i % 2])
        out.append("\n".join(lines))
    out += [t.replace(" ", "  ", 3) for t in out[:10]] + [t + " extra" for t in out[10:20]] + out[20:23]
    out += ["spam " * 200, "", None, "too short", "\n".join(f"{k} same same same words over again" for k in range(50))]
    return [(i * 2, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(out)]


def brute_rules(rows):
    import zstandard

    zstd, kept = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False), []
    for row in rows:
        text = row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = {}
        for i in range(len(words) - 2):
            windows.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {k for at in windows.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
        if len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and quality_rules.compression(text.encode(), quality_rules.Bands(), zstd)[2]:
            kept.append(row)
    return kept


def brute_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t, *rest in rows:
        kept = "\n".join(line for line in (t or "").split("\n") if len(held.get(key(line), ())) < 2 or min(held[key(line)]) == i)
        out.append((i, kept, *rest[:-1], len(kept)))
    return out


def brute_copies(rows):
    found = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    return [r for r in rows if found[r[0]] == r[0]]


def brute_mix(rows):
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    copies = {i: taken // size if size else 0 for i, size, _, _, taken in con.sql(mixing.ORACLE_SQL).fetchall()}
    return [r for r in rows for _ in range(copies[r[0]])]


def brute_tokens(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    encoded = [library.encode(r[1], add_special_tokens=False).ids for r in rows]
    return [(r[0], r[3], r[2], len(e), np.array(e, "<u4").tobytes()) for r, e in zip(rows, encoded)]


def test_stages_and_run(spark, tmp_path):
    rows, docs = corpus(), spark.createDataFrame(corpus(), FIELDS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (brute_rules, brute_lines, brute_copies, brute_mix, brute_tokens), strict=True):
        rows, docs = brute(rows), stage(spark, docs, str(tmp_path))
        got = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in docs.collect()), key=repr)
        assert got == sorted(map(tuple, rows), key=repr), name
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == [f.split()[0] for f in FIELDS.split(", ")]
        sizes.append(len(rows))
    assert 100 < sizes[0] < len(corpus()) and sizes[2] < sizes[1] == sizes[0]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, docs.collect()))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], FIELDS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
