"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors of the word and of its character n-grams, found by hash. Words that follow each other have
a learned vector as a pair; a pair's hash is the difference (xor) of its words' hashes, so that pairs in either order share a vector and a
word that follows itself has the same one whatever the word is. A document's vector is the mean of those of its words, its pairs and
the mark of its end. A linear layer and softmax give the class. All is learned by numpy stochastic
gradient descent on a bounded sample: at most PER_CLASS documents of each class. Of a batch, a vector moves by the mean step of the
documents that hold it, and no step is longer than `longest`, so that a feature that all documents share can't run away.

The layer is linear, so a word adds fixed logits to its documents. Scoring multiplies the table of vectors with the
layer once and keeps the logits of words it has met, so whole texts cost a lookup a word and one a pair.

Defined results: null and empty texts are scored by the mark of their end alone; very long texts are read whole; rows that repeat get one score,
and so do texts that tie; a null doc_id is not held out; without labels of both classes there is nothing to learn, and every score is 0.5; an empty
table gives an empty one; columns of other names than doc_id and text are not read and not returned, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .text import texts, words

FOLDS = 5
PER_CLASS = 2000
THRESHOLD = 0.3
MEMORY = 300_000
#: A document's end, as a word. Real words hold no blank, so it never collides with one.
END = b" end"


@dataclass(frozen=True)
class Shape:
    #: words and n-grams, and pairs
    buckets: int = 1 << 18
    pair_buckets: int = 1 << 20
    dims: int = 8
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.5
    #: a batch's mean gradient moves the layer, each document's own moves its vectors, so many times as far
    vector_rate: float = 20.0
    #: the longest step of a vector and of a column of the layer
    longest: float = 1.0
    batch: int = 32
    seed: int = 17


def hashed(word: bytes) -> int:
    return zlib.crc32(word)


def pairs(hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """Buckets of the pairs of words in a row, from the words' hashes (uint32)."""
    h = hashes[1:] ^ hashes[:-1]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) % np.uint32(shape.pair_buckets) + np.uint32(shape.buckets)


def features(known: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word, one after the other, and how many each word has."""
    whole = np.array([hashed(w) for w in known], np.uint32)
    text = ["<" + w.decode("utf-8", "replace") + ">" for w in known]
    sizes = np.array([len(t) for t in text])
    chars = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(known)), sizes)
    hashes, owners = [whole * np.uint32(2654435761)], [np.arange(len(known))]
    for n in shape.grams:
        if len(chars) < n:
            continue
        inside = of[: len(of) - n + 1] == of[n - 1 :]
        h = np.full(len(chars) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        hashes.append(h[inside] * np.uint32(2654435761))
        owners.append(of[: len(of) - n + 1][inside])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return (h[order] % np.uint32(shape.buckets)).astype(np.int64), np.bincount(o, minlength=len(known))


def _bag(text: str | None, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a document; its vector is the weighted sum of theirs."""
    found = words(text)
    count = Counter(found)
    count[END] = 1
    buckets, sizes = features(list(count), shape)
    weights = np.repeat(np.array(list(count.values())) / sizes, sizes)
    of_pairs = pairs(np.fromiter(map(hashed, found), np.uint32, len(found)), shape)
    bag, inverse = np.unique(np.concatenate([buckets, of_pairs.astype(np.int64)]), return_inverse=True)
    units = len(found) + 1 + len(of_pairs)
    return bag, (np.bincount(inverse, np.concatenate([weights, np.ones(len(of_pairs))])) / units).astype(np.float32)


def _bounded(steps: np.ndarray, longest: float) -> np.ndarray:
    """Steps, those that are too long cut to the longest."""
    size = np.sqrt((steps * steps).sum(axis=-1, keepdims=True))
    return steps * (longest / np.maximum(size, longest))


def learn(documents: list[tuple[str | None, int]], shape: Shape = Shape()) -> np.ndarray:
    """Logits of every bucket (buckets x classes) after training on (text, class)."""
    rng = np.random.default_rng(shape.seed)
    labels, size = np.array([k for _, k in documents], np.int64), shape.buckets + shape.pair_buckets
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    if not share.all():
        return np.zeros((size, 2), np.float32)
    bags = [_bag(t, shape) for t, _ in documents]
    # the layer starts apart and the vectors at none, so that what no document held adds nothing to a score
    vectors = np.zeros((size, shape.dims), np.float32)
    layer = rng.normal(0, 1, (shape.dims, 2)).astype(np.float32)
    steps, total = 0, shape.epochs * -(-len(bags) // shape.batch)
    for _ in range(shape.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), shape.batch):
            chosen = order[at : at + shape.batch]
            rate = shape.rate * (1 - steps / total)
            steps += 1
            idx = np.concatenate([bags[k][0] for k in chosen])
            weight = np.concatenate([bags[k][1] for k in chosen])
            held = [len(bags[k][0]) for k in chosen]
            hidden = np.add.reduceat(vectors[idx] * weight[:, None], np.cumsum([0, *held[:-1]]))
            logits = hidden @ layer
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p /= (2 * share[labels[chosen]])[:, None]  # both classes weigh alike
            back = p @ layer.T
            layer -= _bounded(rate * hidden.T @ p / len(chosen), shape.longest)
            # each document is a step of its own for the vectors that it holds, and a vector takes the mean of its steps
            rows = np.repeat(back, held, axis=0) * weight[:, None]
            bag, inverse = np.unique(idx, return_inverse=True)
            mean = np.stack([np.bincount(inverse, rows[:, d]) for d in range(shape.dims)], axis=1) / np.bincount(inverse)[:, None]
            vectors[bag] -= _bounded(rate * shape.vector_rate * mean, shape.longest).astype(np.float32)
    return vectors @ layer


class Scorer:
    """Scores texts by the logits of the buckets."""

    def __init__(self, logits: np.ndarray, shape: Shape):
        self.logits, self.shape = (logits[:, 1] - logits[:, 0]).astype(np.float64), shape
        self.known: dict[bytes, tuple[float, int]] = {}

    def scores(self, batch: list[str]) -> np.ndarray:
        """Probability of class 1 of each text."""
        parts = [words(t) for t in batch]
        new = {w for found in parts for w in (*found, END)} - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = {w for found in parts for w in (*found, END)}
        if new:
            new = list(new)
            buckets, sizes = features(new, self.shape)
            sums = np.add.reduceat(self.logits[buckets], np.cumsum(sizes) - sizes)
            self.known.update(zip(new, zip((sums / sizes).tolist(), map(hashed, new), strict=True), strict=True))
        means = []
        for found in parts:
            held = [self.known[w] for w in (*found, END)]
            hashes = np.fromiter((h for _, h in held[:-1]), np.uint32, len(found))
            total = sum(x for x, _ in held) + self.logits[pairs(hashes, self.shape)].sum()
            means.append(total / max(1, 2 * len(found)))
        return 1 / (1 + np.exp(-np.clip(means, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, shape: Shape = Shape(), per_class: int = PER_CLASS) -> np.ndarray:
    """The logits of the buckets, learned in one task from a sample of the documents that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), texts(b, "text"), b.column(2).to_pylist(), strict=True))
        logits = learn([(t, k) for _, t, k in documents], shape)
        yield pa.RecordBatch.from_arrays([pa.array([logits.astype(np.float32).tobytes()])], names=["logits"])

    rows = sample(docs, labels, label, remainder(folds) != 0, per_class).select("doc_id", "text", "label")
    found = rows.repartition(1).mapInArrow(run, "logits binary").first()
    return np.frombuffer(found[0], np.float32).reshape(-1, 2) if found else np.zeros((shape.buckets + shape.pair_buckets, 2), np.float32)


def score(docs: DataFrame, logits: np.ndarray, shape: Shape = Shape(), folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    # two numbers a bucket, 10 MB whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(logits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, shape)
        for batch in batches:
            text = texts(batch)
            found = [scorer.scores(text[at : at + 500]) for at in range(0, len(text), 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(folds) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
