"""Line dedup: a line found in several documents stays only in the one of the smallest doc_id.

Lines are hashed to 128 bits where their document is read. Hashes held by two or more documents are dealt
to shards; each shard is a minimal perfect hash with arrays of fingerprints, counts
and first documents. The hashes of the documents' lines are dealt to the shards and probe the arrays as they
stream by: no line is joined with a line, and no shard or common line is gathered. There are as many shards as keep both the keys and the probes of
one within SHARD_KEYS and SHARD_PROBES on average. A shard with far more probes is
copied, and its probes are dealt to the copies by document, so a line that a third of all documents holds
is no task's burden. What a document loses then meets its text by doc_id.

Defined results: null and empty texts are one empty line; a row without a doc_id neither holds nor loses lines;
rows that share a doc_id are one document, and each loses its lines alike; keys under MIN_CHARS code points are never
dropped; of documents that tie on a line the smallest doc_id keeps it; a very long text may lose any number of lines; a document that loses all lines keeps
the empty text; an empty table gives an empty one; other columns pass through whatever they are called, but n_chars, which is the new length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minimal_hash import LineIndex
from .session import checkpointed, free_name
from .text import LOWER, SPACE, texts

MIN_CHARS = 10
#: Keys, and hashes that probe, of a shard on average.
SHARD_KEYS, SHARD_PROBES = 50_000, 100_000
#: A shard's probes are dealt to copies of the shard if they are more than so many times the mean.
HOT = 4
#: Broadcast limit of the table of hot shards, in rows (8 bytes each).
BROADCAST_ROWS = 100_000
_SPACE = SPACE.encode()


def line_hashes(text: str | None) -> list[bytes | None]:
    """A 16-byte hash of each line's key; None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(_SPACE)
        # code points are the bytes that don't continue one
        if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS):
            out.append(xxhash.xxh3_128_digest(key.translate(LOWER)))
        else:
            out.append(None)
    return out


def held_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 of the distinct lines of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [set(line_hashes(t)) - {None} for t in texts(batch)]
            pairs = np.frombuffer(b"".join(h for one in held for h in one), np.int64).reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(one) for one in held])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "h1", "h2"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long")


def build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, h1, h2, n, first), sorted by shard, to one row (shard, probes, index) a shard."""

    def built(x: list[np.ndarray]) -> pa.RecordBatch:
        index = LineIndex.build(x[1].view(np.uint64), x[2].view(np.uint64), x[3], x[4])
        return pa.RecordBatch.from_arrays([pa.array([int(x[0][0])], pa.int64()), pa.array([int(x[3].sum())], pa.int64()), pa.array([index.to_bytes()], pa.binary())], names=["shard", "probes", "index"])

    rest = None
    for batch in batches:
        x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x = x if rest is None else [np.concatenate(p) for p in zip(rest, x, strict=True)]
        cuts = [0, *(np.flatnonzero(x[0][1:] != x[0][:-1]) + 1)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield built([c[s:e] for c in x])
        rest = [c[cuts[-1] :] for c in x]
    if rest is not None and len(rest[0]):
        yield built(rest)


def probe_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, copy, doc_id, h1, h2, index), a shard's index before its probes, to the lines (doc_id, h1, h2) that go.

    A shard without an index holds no repeated line.
    """
    index, of = None, None
    for batch in batches:
        shard, doc_id, h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
        found = batch.column(5)
        head = found.is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | head[1:]])) if len(shard) else []
        goes = np.zeros(batch.num_rows, bool)
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if head[s]:
                index, of = LineIndex.from_bytes(found[int(s)].as_py()), shard[s]
                s += 1
            if e > s and of == shard[s]:
                is_held, count, first = index.probe(h1[s:e].view(np.uint64), h2[s:e].view(np.uint64))
                goes[s:e] = is_held & (count > 1) & (first != doc_id[s:e])
        yield batch.select(["doc_id", "h1", "h2"]).filter(pa.array(goes))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, lines (hashes of 16 bytes) of the documents that lose lines."""
    held = checkpointed(held_lines(docs))
    # a document's own repeats are one: a key is in several documents if its least and greatest differ
    repeated = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    repeated = checkpointed(repeated.select("h1", "h2", "n", "first"))
    n_held = held.count()
    shards = max(1, -(-repeated.count() // SHARD_KEYS), -(-n_held // SHARD_PROBES))
    shard = F.pmod("h1", F.lit(shards))
    index = repeated.select(shard.alias("shard"), "h1", "h2", "n", "first").repartition("shard").sortWithinPartitions("shard")
    index = checkpointed(index.mapInArrow(build_shards, "shard long, probes long, index binary"))
    most = HOT * (n_held // shards + 1)
    copies = F.ceil(F.col("probes") / most).cast("int")
    hot = index.filter(F.col("probes") > most).select("shard", copies.alias("copies"))
    n_hot = hot.count()
    probes = held.select(shard.alias("shard"), "doc_id", "h1", "h2")
    if n_hot:
        probes = probes.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "shard", "left")
        copy = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"), F.lit(0))
    else:
        copy = F.lit(0)
    probes = probes.select("shard", copy.alias("copy"), "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("index"))
    every = F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)).alias("copy")
    none = F.lit(0).cast("long")
    heads = index.select("shard", every, none.alias("doc_id"), none.alias("h1"), none.alias("h2"), "index")
    streams = heads.union(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("index").isNull())
    gone = streams.mapInArrow(probe_shards, "doc_id long, h1 long, h2 long")
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lines"))


def kept_lines(text: str, gone: set[bytes]) -> tuple[int, list[str]]:
    """Number of lines, and those that stay."""
    lines = text.split("\n")
    if not gone:
        return len(lines), lines
    return len(lines), [line for line, h in zip(lines, line_hashes(text), strict=True) if h not in gone]


def _with_gone(docs: DataFrame) -> DataFrame:
    """docs and, as the last column, the lines that each of its rows loses."""
    of, lines = free_name(docs, "of"), free_name(docs, "lines")
    gone = dropped_lines(docs).select(F.col("doc_id").alias(of), F.col("lines").alias(lines))
    return docs.join(gone, docs["doc_id"] == gone[of], "left").drop(of)


def _gone(column: pa.Array) -> list[set[bytes]]:
    """The hashes of each row; an empty set for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    pairs = column.flatten()
    flat = np.stack([pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(np.int64).tobytes() if len(pairs) else b""
    out, at = [], 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        out.append({flat[16 * k : 16 * k + 16] for k in range(at, at + n)})
        at += n
    return out


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, dropped, digests = [], [], []
            for text, gone in zip(texts(batch), _gone(batch.column(2)), strict=True):
                n, kept = kept_lines(text, gone)
                n_lines.append(n)
                dropped.append(n - len(kept))
                digests.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _with_gone(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs without the lines that go; n_chars, where there is one, is the new length."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = _gone(batch.column(len(names)))
            batch = batch.select(names)
            if any(gone):
                kept = ["\n".join(kept_lines(t, g)[1]) if g else t for t, g in zip(batch.column("text").to_pylist(), gone, strict=True)]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))
            yield batch

    out = _with_gone(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in names else out


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.*, coalesce(r.first <> k.doc_id, false) AS goes FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
