import random
import zlib

import numpy as np

from factloom.llm import toxicity as T

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=900):
    rng = random.Random(8)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    marks = ["dreckig", "VERMIN!", "filthy", "swine,"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(20, 120))
        toxic = int(i % 3 == 0)
        for _ in range(toxic * rng.randint(2, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(marks) + rng.choice(["", "er", "ly"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(2000, None, None, None, None), (2001, "", "", "", 0), (2002, "x" * 100000, "", "", 0), (None, "filthy", "", "", 0), (3, docs[3][1], "", "", 0)]
    df = spark.createDataFrame(docs, FIELDS).withColumnRenamed("lang", "label").withColumnRenamed("source", "toxic")
    lb = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.train(df, lb)
    rows = T.score(df, model).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    known = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 200
    assert np.mean([r.predicted for r in held if known[r.doc_id]]) > 0.95 and np.mean([r.predicted for r in held if not known[r.doc_id]]) < 0.03
    assert len({r.score for r in rows if r.doc_id == 3}) == 1 and all(r.predicted == 0 for r in rows if r.doc_id in (2000, 2001, 2002))
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert T.train(df, flipped) == T.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_nothing_to_learn(spark):
    docs, labels = corpus(30)
    df = spark.createDataFrame(docs, FIELDS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.train(df, none) is None and {r.score for r in T.score(df, None).collect()} == {0.0}
    assert T.score(df.limit(0), None).collect() == []


def test_distances_are_of_the_dictionaries():
    marks, common = T.dictionary([(b" filthy", 9)]), T.dictionary([(b" rather", 9), (b" others", 8)])
    d = T.Distances(T.Model(common + marks + T.DICTIONARY_END, marks[:0] + common + T.DICTIONARY_END))
    assert d.of([b" filthy "])[0] >= 3 and max(d.of([b" rather ", b" things ", b" "])) <= 1


def test_windows():
    assert T.windows("Ab, 'CD' -- ÉÈ!") == [b" ab ", b" cd ", " éè ".encode()]
    assert T.windows(None) == [] and b"".join(T.windows("y" * 200)) == b" " + b"y" * 200 + b" "
