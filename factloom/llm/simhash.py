"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits and link at 3 or fewer differing bits. Of the two halves of such a pair, one
differs in at most one bit. In each half the anchors are the code words of a covering code: the perfect
Hamming code on 31 bits, of covering radius 1, and the 32nd bit as it is, so 2**27 anchors. A fingerprint is at
home at the anchor within radius 1 of its half, and is copied to every anchor within covering radius plus
threshold, which is 2 in the 31 bits (or 1 with the 32nd bit flipped): 17 anchors a half at most. Two halves
that differ in one bit so meet at the home of either. Per anchor the fingerprints at home are compared with
all that were copied there. Distinct fingerprints are compared once, however many texts share them.

An anchor of more than BLOCK fingerprints is cut into blocks, each of its own group; a block gives
at most a spanning forest of its links, so what comes out grows with the fingerprints and not with pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows get one
component, and of texts that tie the smallest doc_id stands for all; a null doc_id takes part in links but is never a component's id; very
long texts are hashed whole, in parts; an empty table gives an empty one; other columns pass through deduplicated() whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import checkpointed
from .text import LOWER, texts

SHINGLE = 3
SEED = 42
THRESHOLD = 3
BLOCK = 4096
#: Broadcast limit of the table of hot anchors, in rows (16 bytes each).
BROADCAST_ROWS = 100_000

_POSITION = np.arange(1, 32, dtype=np.uint32)
#: For a syndrome s: the masks that lead to the code words at distance 2, flipping positions i and i ^ s.
_PAIRS = np.zeros((32, 15), np.uint32)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < i ^ _s and i != _s]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the text's word shingles, unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)] + [b""] * (shingle - 1)
        grams = iter(words[:1])
        n = 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (uint64): index of the fingerprint, anchor (int64), and whether it is at home there."""
    index, keys, homes = [], [], []
    everyone = np.arange(len(fps))
    for half in (0, 1):
        value = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bits, top = value & np.uint32(0x7FFFFFFF), value & np.uint32(0x80000000)
        syndrome = np.bitwise_xor.reduce(np.where((bits[:, None] >> (_POSITION - 1)) & np.uint32(1), _POSITION, np.uint32(0)), axis=1)
        home = np.where(syndrome > 0, bits ^ (np.uint32(1) << np.where(syndrome > 0, syndrome - np.uint32(1), np.uint32(0))), bits)
        near = (bits[:, None] ^ _PAIRS[syndrome])[syndrome > 0]
        of = np.concatenate([everyone, everyone, np.repeat(everyone[syndrome > 0], 15)])
        words = np.concatenate([home | top, home | (top ^ np.uint32(0x80000000)), (near | top[syndrome > 0][:, None]).ravel()])
        index.append(of)
        keys.append(words.astype(np.int64) | (half << 32))
        homes.append(np.arange(len(of)) < len(fps))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def copies(nodes: DataFrame) -> DataFrame:
    """anchor, fp, home for every anchor that a fingerprint (column fp, distinct) is copied to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                index, keys, home = anchors(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[index]), pa.array(home)], names=["anchor", "fp", "home"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def forest(home: np.ndarray, member: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join all members within the threshold of a fingerprint at home, directly or through others."""
    nodes = np.unique(np.concatenate([home, member]))
    label = np.arange(len(nodes))
    left, right = [], []
    step = max(1, (1 << 22) // len(member))
    for at in range(0, len(home), step):
        i, j = np.nonzero(np.bitwise_count(home[at : at + step, None] ^ member[None, :]) <= threshold)
        a, b = np.searchsorted(nodes, home[at + i]), np.searchsorted(nodes, member[j])
        left.append(a[a != b])
        right.append(b[a != b])
        if sum(map(len, left)) > 1 << 20:  # fold what was found, so that memory stays bounded
            label = _least(label, np.concatenate(left), np.concatenate(right))
            left, right = [], []
    if left:
        label = _least(label, np.concatenate(left), np.concatenate(right))
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _least(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a and b: each node gets the least of its component."""
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_in_blocks(batches: Iterator[pa.RecordBatch], threshold: int = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, row, col, fp, role) sorted by block give links a, b. role: 0 copied there, 1 at home, 2 both."""
    rest = None

    def links(x: list[np.ndarray]) -> pa.RecordBatch:
        anchor, row, col, fp, role = x
        starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])])) if len(anchor) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(anchor))
        at_home = np.add.reduceat((role > 0).astype(np.int64), starts) if len(starts) else starts
        a, b = [], []
        for s, e in zip(starts[(ends - starts > 1) & (at_home > 0)], ends[(ends - starts > 1) & (at_home > 0)], strict=True):
            part, kind = fp[s:e].view(np.uint64), role[s:e]
            if e - s == 2 and int(part[0] ^ part[1]).bit_count() > threshold:
                continue
            node, root = forest(part[kind > 0], part[kind != 1], threshold)
            a.append(node.view(np.int64))
            b.append(root.view(np.int64))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [none])), pa.array(np.concatenate(b or [none]))], names=["a", "b"])

    for batch in batches:
        x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            x = [np.concatenate(pair) for pair in zip(rest, x, strict=True)]
        if not len(x[0]):
            continue
        same = np.ones(len(x[0]), bool)
        for c in x[:3]:
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [c[cut:] for c in x]
        if cut:
            yield links([c[:cut] for c in x])
    if rest is not None:
        yield links(rest)


def links(nodes: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links a, b (fingerprints as longs) that connect all fingerprints within the threshold of each other."""
    spread = copies(nodes)
    hot = checkpointed(spread.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    if n := hot.count():
        rows = spread.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "anchor", "left")
        own, every = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
        as_member = F.transform(every, lambda k: F.struct(k.alias("row"), own.alias("col"), F.lit(0).alias("role")))
        as_home = F.transform(every, lambda k: F.struct(own.alias("row"), k.alias("col"), F.lit(1).alias("role")))
        whole = F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.when(F.col("home"), 2).otherwise(0).alias("role")))
        places = F.when(F.col("blocks").isNull(), whole).when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)
        rows = rows.select("anchor", "fp", F.inline(places))
    else:
        rows = spread.select("anchor", "fp", F.lit(0).alias("row"), F.lit(0).alias("col"), F.when(F.col("home"), 2).otherwise(0).alias("role"))
    rows = rows.select("anchor", "row", "col", "fp", "role").repartition("anchor", "row", "col").sortWithinPartitions("anchor", "row", "col")
    return rows.mapInArrow(partial(links_in_blocks, threshold=threshold), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for every row of docs."""
    if threshold != THRESHOLD:
        raise ValueError("the covering is built for 3 differing bits")
    fps = checkpointed(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(nodes, threshold, block))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    member = placed.join(groups, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest doc_id; rows without a doc_id stay."""
    found = checkpointed(near_duplicates(docs))
    losers = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty():
        return kept
    # rows that share a doc_id: one of them stays
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return kept.select("doc_id", alone.alias("alone"), F.struct("*").alias("row")).dropDuplicates(["doc_id", "alone"]).select("row.*")
