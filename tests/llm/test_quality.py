import random
import zlib

import numpy as np

from factloom.llm import quality as Q

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400):
    rng = random.Random(9)
    good = ["river", "stone", "walking", "quietly", "gardens", "morning", "letters", "between"]
    docs, labels = [], []
    for i in range(n):
        k = i % 2
        pool = good if k else [w.upper() + "$$!" for w in good]
        docs.append((i, " ".join(rng.choice(pool) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 80))), "en", "s", 0))
        labels.append((i, k, 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, "\U0001f600" * 3000, "", "", 0), (None, "stray", "", "", 0), (5, docs[5][1], "en", "s", 0)]
    df = spark.createDataFrame(docs, FIELDS).withColumnRenamed("lang", "label")
    lb = spark.createDataFrame(labels + [(7, None, None), (None, 1, 0), (4000, 1, 1)], "doc_id long, quality int, toxic int")
    logits = Q.train(df, lb, per_class=100)
    rows = Q.score(df, logits).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = dict((i, k) for i, k, _ in labels)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert len(held) > 50 and np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in rows if r.doc_id == 5}) == 1 and len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1
    # the same again
    assert (Q.train(df, lb, per_class=100) == logits).all()
    # nothing is learned from the documents that are held out
    flipped = spark.createDataFrame([(i, 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k, 0) for i, k, _ in labels], "doc_id long, quality int, toxic int")
    assert (Q.train(df, flipped, per_class=1000) == Q.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_class=1000)).all()


def test_no_labels_and_no_documents(spark):
    docs, _ = corpus(6)
    df = spark.createDataFrame(docs, FIELDS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score(df, Q.train(df, none)).collect()} == {0.5}
    assert Q.score(df.limit(0), Q.train(df.limit(0), none)).collect() == []


def slow_vectors(text, shape):
    """Each unit of a document with the buckets whose vectors it averages, by bytes and by characters."""
    found, units = (text or "").encode().split(), []
    for w in [*found, Q.END]:
        own = [zlib.crc32(w) * 2654435761 % 2**32 % shape.buckets]
        padded = "<" + w.decode() + ">"
        for n in shape.grams:
            for k in range(len(padded) - n + 1):
                h = n
                for c in padded[k : k + n]:
                    h = (h ^ ord(c)) * 16777619 % 2**32
                    h ^= h >> 15
                own.append(h * 2654435761 % 2**32 % shape.buckets)
        units.append(own)
    for a, b in zip(found, found[1:]):
        h = zlib.crc32(a) ^ zlib.crc32(b)
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        units.append([(h ^ h >> 13) % shape.pair_buckets + shape.buckets])
    return units


def test_score_is_the_layer_over_the_mean_of_vectors():
    shape = Q.Shape(buckets=512, pair_buckets=128, epochs=2)
    docs, labels = corpus(60)
    logits = Q.learn([(d[1], lb[1]) for d, lb in zip(docs, labels)], shape)
    for text in [docs[0][1] + " añadido x", "", None, "x", "x x x", "größe 日本", *(d[1] for d in docs[:9])]:
        units = slow_vectors(text, shape)
        mean = np.mean([logits[u].mean(axis=0) for u in units], axis=0)
        p = np.exp(mean) / np.exp(mean).sum()
        assert abs(Q.Scorer(logits, shape).scores([text or ""])[0] - p[1]) < 1e-5
        bag, weight = Q._bag(text, shape)
        want = np.zeros(shape.buckets + shape.pair_buckets)
        for u in units:
            np.add.at(want, u, 1 / len(u) / len(units))
        assert np.allclose(weight, want[bag], atol=1e-6) and set(bag) == set(np.flatnonzero(want))


def test_a_first_step_by_hand():
    """One batch, one epoch: vectors move by the mean over the documents that hold them of the gradient of their own loss."""
    shape = Q.Shape(buckets=64, pair_buckets=16, epochs=1, batch=8, rate=0.5, longest=1e9)
    documents = [("a b", 0), ("b c c", 1), ("d", 1), ("", 0)]
    layer = np.random.default_rng(shape.seed).normal(0, 1, (shape.dims, 2)).astype(np.float32)
    vectors, held = np.zeros((80, shape.dims)), np.zeros(80)
    for text, y in documents:
        bag, weight = Q._bag(text, shape)
        p = np.array([0.5, 0.5])
        p[y] -= 1  # both classes have two documents
        vectors[bag] -= shape.rate * shape.vector_rate * np.outer(weight, layer @ p)
        held[bag] += 1
    # the hidden layer is zero at first, so the layer does not move
    assert np.allclose(Q.learn(documents, shape), vectors / np.maximum(held, 1)[:, None] @ layer, atol=1e-4)


def test_features_that_all_documents_share_stay_finite():
    docs, labels = corpus(200)
    for rates in ({}, {"rate": 50.0}, {"vector_rate": 5000.0, "epochs": 30}):
        logits = Q.learn([("same " * 400 + (d[1] if k % 3 else ""), lb[1]) for k, (d, lb) in enumerate(zip(docs, labels))], Q.Shape(buckets=1 << 12, pair_buckets=1 << 12, **rates))
        assert np.isfinite(logits).all()
    odd = ["", None, "same", "same same", "x" * 100000, "\U0001f600 " * 50000]
    assert np.isfinite(Q.Scorer(logits, Q.Shape(buckets=1 << 12, pair_buckets=1 << 12)).scores([t or "" for t in odd])).all()


def test_words_that_repeat_are_learned_as_such():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    make = lambda bad: " ".join(w for _ in range(40) for w in [word()] * (5 if bad else 1))
    shape = Q.Shape(buckets=1 << 12, pair_buckets=1 << 12)
    logits = Q.learn([(make(k % 2 == 0), k % 2) for k in range(300)], shape)
    scores = Q.Scorer(logits, shape).scores([make(k % 2 == 0) for k in range(100)])
    assert ((scores >= 0.3) == np.arange(100) % 2).all()


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    shape = Q.Shape()
    known = [b"a", "größe".encode(), b"walking", b"a", b" length 3", "日本語".encode()]
    buckets, sizes = Q.features(known, shape)
    at = np.cumsum(sizes) - sizes
    for k, w in enumerate(known):
        alone, n = Q.features([w], shape)
        assert sizes[k] == n[0] == 1 + sum(max(0, len(w.decode()) + 2 - g + 1) for g in shape.grams)
        assert sorted(buckets[at[k] : at[k] + sizes[k]]) == sorted(alone)
