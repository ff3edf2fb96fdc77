"""Toxicity by compression distance: two zstandard dictionaries, and the windows that one of them packs better.

A window is a word between blanks, in lower case, without ASCII punctuation at its ends, cut at WINDOW bytes. From a bounded
sample of labelled documents (at most PER_CLASS of each class, near copies left out) Spark counts how often the windows' segments
of SEGMENT bytes occur in each class. Segments that stand out in toxic documents make one dictionary, the commonest of
the ordinary documents the other. Both hold bare content: zstandard's own trainer picks for size, not for what tells the
classes apart, and adds code tables that differ by dictionary, which blurs a distance of a few bytes. A window's
distance is how many bytes fewer the toxic dictionary packs it into. A document is measured by how many of its windows
reach each of the distances in LEVELS, and by their share of its windows; a logistic curve over these, fitted to the
sample, makes the score, so that the threshold on the score is one on all of them.

Windows recur, so workers keep the distances of those they have met, up to MEMORY of them.

Defined results: null and empty texts, and texts without words, have no hits and get the score of none; very long texts are read whole; rows that repeat and
texts that tie get one score; a null doc_id is not held out; without labels of both classes, or without a segment that stands out, every score is 0; an
empty table gives an empty one; columns of other names than doc_id and text are not read and not returned, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .session import checkpointed
from .text import texts

FOLDS, HELD = 3, 1
PER_CLASS = 3000
THRESHOLD = 0.7
WINDOW = 48
MEMORY = 300_000
DICTIONARY = 16 << 10
LEVEL = 3
#: After a window, bytes that pack well by themselves: a block that didn't gain would be stored as it is, and hide what a match saves.
TAIL = b"\0" * 24
#: zstandard doesn't index the last bytes of a dictionary, and of the others not each position: so these end it, and a segment
#: stands in it at all three remainders of its position.
DICTIONARY_END = bytes(range(0x80, 0x90))
SEGMENT = 7
#: A segment stands out if it is in this share of the toxic documents, LEAST_DOCS at least, so many times as often among their
#: words as among the ordinary ones', and in so many deviations more documents than the ordinary ones let expect.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO, LEAST_DEVIATIONS = 0.01, 4, 5.0, 6.0
#: Segments read for a dictionary; it holds fewer.
SEGMENTS = 2000
LEVELS = (1, 2, 3, 4, 5)
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def windows(text: str | None) -> list[bytes]:
    """The windows of a text."""
    low = (text or "").lower().encode("utf-8", "surrogatepass")
    found = [b" " + core + b" " for w in low.split() if (core := w.strip(PUNCTUATION))]
    if any(len(w) > WINDOW for w in found):
        found = [w[at : at + WINDOW] for w in found for at in range(0, len(w), WINDOW)]
    return found


def dictionary(samples: list[tuple[bytes, int]], size: int = DICTIONARY) -> bytes:
    """Content of a dictionary from segments and their counts, the most frequent last, where offsets are short."""
    content = b"".join(3 * (w + b"\xff" * ((1 - len(w)) % 3)) for w, _ in sorted(samples, key=lambda x: (x[1], x[0])))
    return content[-size:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    #: logistic weights of measures()
    weights: tuple[float, ...] = (0.0,) * (1 + 2 * len(LEVELS))


class Distances:
    """How many bytes fewer the toxic dictionary needs for a window."""

    def __init__(self, model: Model):
        def packer(data: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary = packer(model.toxic), packer(model.ordinary)
        self.known: dict[bytes, int] = {}

    def of(self, found: list[bytes]) -> list[int]:
        new = {w for w in found if w not in self.known}
        if len(self.known) + len(new) > MEMORY:
            self.known, new = {}, set(found)
        for w in new:
            self.known[w] = len(self.ordinary.compress(w + TAIL)) - len(self.toxic.compress(w + TAIL))
        return [self.known[w] for w in found]


def measures(distances: list[int]) -> list[float]:
    """A constant, and for each level how many windows reach it and their percentage, both as logarithms."""
    n, found = max(1, len(distances)), np.array(distances, np.int64)
    hits = [int((found >= t).sum()) for t in LEVELS]
    return [1.0, *(math.log1p(h) for h in hits), *(math.log1p(100 * h / n) for h in hits)]


def score_of(model: Model, distances: list[int]) -> float:
    z = sum(w * x for w, x in zip(model.weights, measures(distances), strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def segments(window: bytes) -> list[bytes]:
    """The runs of SEGMENT bytes of a window; all of a shorter one."""
    return [window[k : k + SEGMENT] for k in range(max(1, len(window) - SEGMENT + 1))]


def _without_copies(chosen: DataFrame) -> DataFrame:
    """One of the documents of a class that share the least hash of their shingles of three windows; near copies mostly do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in texts(batch):
                w = windows(text)
                least.append(min((xxhash.xxh3_64_intdigest(b"".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "label", "least"])

    rows = chosen.select("doc_id", "text", F.col("label").cast("long").alias("label")).mapInArrow(run, "doc_id long, text string, label long, least long")
    first = F.row_number().over(Window.partitionBy("label", "least").orderBy("doc_id"))
    return rows.withColumn("nth", first).filter("nth = 1").select("doc_id", "text", "label")


def _segment_counts(chosen: DataFrame) -> DataFrame:
    """segment, and for each class (t, o) how often it occurs and in how many documents; the empty segment counts all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                found = windows(text)
                held = Counter(x for w in found for x in segments(w))
                held[b""] = len(found)
                n, docs = pa.array(held.values(), pa.int64()), pa.array([1] * len(held), pa.int64())
                none = pa.array([0] * len(held), pa.int64())
                of = [n, docs, none, none] if label else [none, none, n, docs]
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), *of], names=["segment", "t", "t_docs", "o", "o_docs"])

    rows = chosen.select("text", "label").mapInArrow(run, "segment binary, t long, t_docs long, o long, o_docs long")
    return rows.groupBy("segment").agg(*[F.sum(c).alias(c) for c in ("t", "t_docs", "o", "o_docs")])


def _leading(ranked: list[bytes], found: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Of ranked segments, those whose windows (with counts) mostly hold no better one; with the counts of these windows.

    Neighbours of a telling segment stand out as well, but part of them belongs to ordinary words.
    """
    holds: dict[bytes, list[int]] = {x: [] for x in ranked}
    for k, (w, _) in enumerate(found):
        for x in set(segments(w)) & holds.keys():
            holds[x].append(k)
    covered: set[int] = set()
    kept = []
    for x in ranked:
        new = sum(found[k][1] for k in holds[x] if k not in covered)
        if new and 2 * new > sum(found[k][1] for k in holds[x]):
            kept.append((x, new))
            covered.update(holds[x])
    return kept


def _windows_with(chosen: DataFrame, wanted: set[bytes]) -> list[tuple[bytes, int]]:
    """The commonest windows of toxic documents that hold one of the segments, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter(w for text in texts(batch) for w in windows(text) if not wanted.isdisjoint(segments(w)))
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["win", "n"])

    rows = chosen.filter("label = 1").select("text").mapInArrow(run, "win binary, n long").groupBy("win").agg(F.sum("n").alias("n"))
    return [(bytes(r.win), r.n) for r in rows.orderBy(F.col("n").desc(), "win").limit(10 * SEGMENTS).collect()]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by Newton steps, both classes weighing alike."""
    of = 0.5 / np.where(y == 1, y.mean(), 1 - y.mean())
    w, hold = np.zeros(x.shape[1]), np.diag([1e-3] + [0.3] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (of * p * (1 - p))[:, None]).T @ x + hold, x.T @ (of * (y - p)) - hold @ w)
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """The dictionaries and thresholds, from a sample of the documents that aren't held out; None if there is nothing to learn."""
    chosen = checkpointed(_without_copies(sample(docs, labels, label, remainder(FOLDS) != HELD, per_class)))
    counts = checkpointed(_segment_counts(chosen))
    every = counts.filter(F.col("segment") == F.lit(b"")).first()
    if every is None or not (every.t_docs and every.o_docs):
        return None
    ratio = (F.col("t") / max(1, every.t)) / ((F.col("o") + 0.5) / max(1, every.o))
    expected = F.col("o_docs") * (every.t_docs / every.o_docs)
    stands_out = (F.col("t_docs") >= max(LEAST_DOCS, LEAST_SHARE * every.t_docs)) & (ratio >= LEAST_RATIO) & (F.col("t_docs") >= expected + LEAST_DEVIATIONS * F.sqrt(expected + 1))
    counts = counts.filter(F.col("segment") != F.lit(b"")).withColumn("stands_out", stands_out)
    # more segments than a dictionary holds, the clearest first
    toxic = counts.filter("stands_out").orderBy((F.col("t") * F.log(ratio)).desc(), "segment").limit(SEGMENTS).select("segment", "t").collect()
    ordinary = counts.filter(~F.col("stands_out")).orderBy(F.col("o").desc(), "segment").limit(SEGMENTS).select("segment", "o").collect()
    if not toxic:
        return None
    ranked = [bytes(r.segment) for r in toxic]
    marks = dictionary(_leading(ranked, _windows_with(chosen, set(ranked))))
    common = dictionary([(bytes(r.segment), r.o) for r in ordinary])
    # the toxic dictionary holds ordinary segments as well, so that what both know makes no distance
    model = Model(common[len(marks) :] + marks + DICTIONARY_END, common + DICTIONARY_END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model)
        for batch in batches:
            found = [measures(distances.of(windows(text))) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    seen = chosen.select("text", "label").mapInArrow(run, "x array<double>, label long").collect()
    model.weights = _fit(np.array([r.x for r in seen]), np.array([r.label for r in seen]))
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model) if model else None
        for batch in batches:
            scores = [score_of(model, distances.of(windows(text))) if model else 0.0 for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(remainder(FOLDS) == HELD, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
