"""Media columns: payloads as PNG in binary columns, and hashes of their low frequencies.

A payload is bytes in rows of ROW: 64 pixels of three 8-bit samples. PNG keeps it as zlib-packed, filtered rows in chunks
with checksums; each row has the filter that leaves the least sum of absolute differences, as PNG writers choose it. Reading tests the
signature, each chunk's CRC, the header and the packed stream's own checksum, and undoes the five filters in numpy: the
pictures of a part of an Arrow batch go side by side, and a step takes one diagonal of each, whose pixels wait for nothing but the two diagonals
before. The feature is the sign pattern of the lowest cosine frequencies of the picture's
brightness, scaled to 32 x 32, around their median: 64 bits as 16 hex digits, alike for pictures that look alike.

Defined results: null and empty texts are one row of blanks; a null or damaged medium is null in reading, or an error
with strict=True; equal payloads give equal bytes, whatever stands beside them; very long texts make high pictures, of which several
are read at a time only up to OUT_BYTES; rows that repeat are stored alike; an empty table gives an empty one; of other columns, stored() keeps none, and
read_back() all but those named payload and feature, which are its own.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import texts

ROW, PIXEL = 192, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6
#: Rows are given back to Spark when their media have so many bytes.
OUT_BYTES = 8 << 20
#: Stacks of pictures that are read side by side.
SIDE_BY_SIDE = 32

_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi * np.outer(np.arange(_LOW), 2 * np.arange(_SIDE) + 1) / (2 * _SIDE))


class DamagedMedia(ValueError):
    """Stored bytes that fail a test."""


def padded(data: bytes) -> bytes:
    """Data with blanks up to a positive multiple of ROW."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _predicted(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, ...]:
    """What each of the five filters expects of samples, from their neighbours as int16."""
    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.zeros_like(left), left, up, (left + up) >> 1, paeth


def filtered(rows: np.ndarray, first: np.ndarray, kind: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The filter of each row, and the filtered rows (uint8). `first` marks the pictures' first rows; `kind` sets one filter for all."""
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, PIXEL:], up[1:] = x[:, :-PIXEL], x[:-1]
    up[first] = 0
    corner[:, PIXEL:] = up[:, :-PIXEL]
    made = np.stack([(x - guess).astype(np.uint8) for guess in _predicted(left, up, corner)])
    if kind is None:
        kinds = abs(made.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int32).argmin(axis=0)
    else:
        kinds = np.full(len(rows), kind)
    return kinds.astype(np.uint8), made[kinds, np.arange(len(rows))]


def unfiltered(kinds: np.ndarray, rows: np.ndarray, heights: list[int]) -> np.ndarray:
    """The samples of the filtered rows of pictures of these heights, one below the other."""
    if len(kinds) and kinds.max() > 4:
        raise DamagedMedia(f"filter {kinds.max()}")
    if not kinds.any():
        return rows
    # pictures are dealt to stacks, the highest first and each to the lowest stack, since all stacks go on until the highest ends
    tops = np.cumsum([0, *heights])
    stacks: list[list[int]] = [[] for _ in range(min(SIDE_BY_SIDE, len(heights)))]
    heap = [(0, k) for k in range(len(stacks))]
    for p in sorted(range(len(heights)), key=lambda p: -heights[p]):
        n, k = heapq.heappop(heap)
        stacks[k].append(p)
        heapq.heappush(heap, (n + heights[p], k))
    place, height, width = np.zeros(len(rows), np.int64), max(n for n, _ in heap), ROW // PIXEL
    steps = height + width - 1  # pixel c of row r is on diagonal r + c
    for k, stack in enumerate(stacks):
        at = k * (steps + width - 1) + width - 1
        for p in stack:
            place[tops[p] : tops[p + 1]] = np.arange(at, at + heights[p])
            at += heights[p]
    padded_rows = len(stacks) * (steps + width - 1)
    samples = np.zeros((padded_rows, ROW), np.uint8)
    samples[place] = rows
    # 0 above a picture's first row, and which of the filters a row has
    below, kind = np.zeros(padded_rows, np.int16), np.zeros(padded_rows, np.uint8)
    below[place] = 1
    below[place[tops[:-1]]] = 0
    kind[place] = kinds

    def diagonals(x: np.ndarray, *pixel: int) -> np.ndarray:
        """A view (diagonal, stack, pixel, sample) of padded rows."""
        row = x.strides[0]
        start = x[width - 1 :]
        across = pixel[0] * x.itemsize if pixel else 0
        shape, strides = (steps, len(stacks), width, *(pixel or (1,))), (row, (steps + width - 1) * row, across - row, x.itemsize if pixel else 0)
        return np.lib.stride_tricks.as_strided(start, shape, strides)

    given, below, kind = diagonals(samples, PIXEL), diagonals(below), diagonals(kind)
    out = np.zeros_like(samples)
    made = diagonals(out, PIXEL)
    before = last = np.zeros(given.shape[1:], np.int16)
    left, corner = np.zeros_like(last), np.zeros_like(last)
    for d in range(steps):
        left[:, 1:], corner[:, 1:] = last[:, :-1], before[:, :-1]
        guess = np.choose(kind[d], _predicted(left, last * below[d], corner * below[d]))
        before, last = last, (given[d] + guess) & 255
        made[d] = last
    return out[place]


def to_png(payloads: list[bytes], kind: int | None = None) -> list[bytes]:
    """Payloads, each of a positive multiple of ROW bytes, as PNG; with the best filter of each row, or one kind for all."""
    heights = [len(p) // ROW for p in payloads]
    tops = np.cumsum([0, *heights])
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    first = np.zeros(len(rows), bool)
    first[tops[:-1]] = True
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = filtered(rows, first, kind)
    out = []
    for top, height in zip(tops, heights, strict=False):
        header = struct.pack(">IIBBBBB", ROW // PIXEL, height, 8, 2, 0, 0, 0)
        packed = zlib.compress(lines[top : top + height].tobytes(), LEVEL)
        out.append(SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", packed) + _chunk(b"IEND", b""))
    return out


def unpacked(data: bytes) -> np.ndarray:
    """The lines of a PNG, each its filter and its filtered row; all of its tests passed."""
    if data[:8] != SIGNATURE:
        raise DamagedMedia("signature")
    at, header, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise DamagedMedia(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or header is None or len(header) != 13:
        raise DamagedMedia("chunks are missing")
    width, height, *form = struct.unpack(">IIBBBBB", header)
    if form != [8, 2, 0, 0, 0] or width != ROW // PIXEL:
        raise DamagedMedia("form")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise DamagedMedia("packed samples") from e
    if not height or len(lines) != height * (ROW + 1):
        raise DamagedMedia("size")
    lines = lines.reshape(height, ROW + 1)
    if lines[:, 0].max(initial=0) > 4:
        raise DamagedMedia("filter")
    return lines


def from_png(media: list[bytes | None], strict: bool = True) -> list[bytes | None]:
    """The payloads of PNGs. Null for null; for a damaged one an error, or null if not strict."""
    found: list[np.ndarray | None] = []
    for m in media:
        try:
            found.append(None if m is None else unpacked(m))
        except DamagedMedia:
            if strict:
                raise
            found.append(None)
    pictures = [x for x in found if x is not None]
    if not pictures:
        return found
    lines = np.concatenate(pictures)
    samples = unfiltered(lines[:, 0], lines[:, 1:], [len(x) for x in pictures])
    ends = iter(np.cumsum([len(x) for x in pictures]).tolist())
    return [None if x is None else samples[(e := next(ends)) - len(x) : e].tobytes() for x in found]


def cosine_hash(payload: bytes) -> str:
    """16 hex digits of the signs of the lowest 8 x 8 cosine coefficients around their median, without the constant's weight."""
    gray = np.frombuffer(payload, np.uint8).reshape(-1, ROW // PIXEL, PIXEL).sum(axis=2, dtype=np.int64)
    gray = gray.reshape(len(gray), _SIDE, -1).sum(axis=2)
    # areas of the picture by running sums, so that any height costs one pass
    sums = np.concatenate([np.zeros((1, _SIDE)), np.cumsum(gray, axis=0)])
    at = np.linspace(0, len(gray), _SIDE + 1)
    low = np.minimum(at.astype(np.int64), len(gray) - 1)
    edges = sums[low] + (at - low)[:, None] * (sums[low + 1] - sums[low])
    picture = np.diff(edges, axis=0)
    found = (_COSINE @ picture @ _COSINE.T).ravel()
    bits = found > np.median(found[1:])
    return np.packbits(bits).tobytes().hex()


def _batched(sizes: list[int]) -> Iterator[slice]:
    """Slices of rows of about OUT_BYTES."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total > OUT_BYTES or k + 1 == len(sizes):
            yield slice(first, k + 1)
            first, total = k + 1, 0


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8), media (PNG) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts(batch)]
            for part in _batched([len(r) for r in raw]):
                media = pa.array(to_png([padded(r) for r in raw[part]]), pa.binary())
                n_bytes = pa.array([len(r) for r in raw[part]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], n_bytes, media], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(rows: DataFrame, strict: bool = True) -> DataFrame:
    """The rows with payload (binary) and feature (string), read from their column media."""
    names = [c for c in rows.columns if c not in ("payload", "feature")]
    place = names.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(place).to_pylist()
            for part in _batched([struct.unpack_from(">I", m, 20)[0] * ROW if m and len(m) > 24 else 0 for m in media]):
                payloads = from_png(media[part], strict)
                features = [None if p is None else cosine_hash(p) for p in payloads]
                columns = [c[part] for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*names, "payload", "feature"])

    return rows.select(*names).mapInArrow(run, rows.select(*names).schema.add("payload", "binary").add("feature", "string"))


def digest(rows: DataFrame) -> DataFrame:
    """Sizes and checksums of rows of read_back()."""
    tail = F.expr("substring(payload, -16, 16)")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
