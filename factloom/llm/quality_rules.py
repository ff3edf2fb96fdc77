"""Quality rules: counts of words, symbols and repeats, then compression bands.

The bands: a text's zstandard ratio (compressed bytes / bytes) as a whole and, from twice a chunk's size on, in chunks of equal size. Text of
natural variety has a ratio between limits that depend on its length, since short texts compress less.
Below them a text repeats itself, above them it has no structure. A document is rejected if its
whole ratio is out of the band of its length, or if over a share of its chunks are.

Rows are handled one by one in Arrow batches; nothing is shuffled.

Defined results: null and empty texts have no words, so base_failed is true and kept false; very long texts are packed whole and in chunks; texts under 200 bytes
have no band, and those under two chunks are judged by their whole ratio alone; a ratio at a limit is within; rows that repeat
are judged alike; an empty table gives an empty table; other columns of the input are left out of the digest and pass through kept_documents(), whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .text import SPACE, texts

SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes: (from this length, lowest ratio, highest ratio).

    The lowest are set by natural texts and program code, of which hardly any falls below them; see the README for the rates.
    """

    level: int = 3
    #: least bytes of a chunk; texts of twice as many or more are cut into chunks of equal size
    chunk: int = 1024
    #: share of the chunks that may be out of their band
    chunks_out: float = 0.34
    limits: tuple[tuple[int, float, float], ...] = field(
        default=((0, 0.0, 9.0), (200, 0.25, 0.85), (500, 0.18, 0.78), (1000, 0.14, 0.7), (2000, 0.12, 0.65), (4000, 0.1, 0.6), (16000, 0.08, 0.56), (64000, 0.06, 0.55))
    )

    def out(self, n: int, ratio: float) -> bool:
        _, low, high = self.limits[bisect_right(self.limits, n, key=lambda x: x[0]) - 1]
        return not low <= ratio <= high


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in windows of so many words found twice or more, the first find included."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if len(index) == n:
        return 0
    key = ids[: n - window + 1]
    for k in range(1, window):  # numbers of ever longer windows, so keys never overflow
        key = key * len(index) + ids[k : n - window + 1 + k]
        if k + 1 < window:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 1, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    starts = np.zeros(n + 1, np.int64)
    starts[: len(key)] += twice[:-1]
    starts[window : window + len(key)] -= twice[:-1]
    return int((np.cumsum(starts[:n]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def compression(raw: bytes, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of the chunks out of their band, and whether the text passes."""
    if not raw:
        return 0.0, 0.0, False
    ratio = len(zstd.compress(raw)) / len(raw)
    chunks = max(1, len(raw) // bands.chunk)
    out = 0
    if chunks > 1:
        for k in range(chunks):
            part = raw[k * len(raw) // chunks : (k + 1) * len(raw) // chunks]
            out += bands.out(len(part), len(zstd.compress(part)) / len(part))
    return ratio, out / chunks, not bands.out(len(raw), ratio) and out <= bands.chunks_out * chunks


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The counts and the verdict of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            rows = []
            for text in texts(batch):
                n, chars, symbols, dup, repeats = counts(text)
                failed = n < 50 or 100 * repeats > 50 * n
                ratio, bad, passes = compression(text.encode("utf-8", "surrogatepass"), bands, zstd)
                rows.append((n, chars, symbols, dup, repeats, failed, not failed and passes, ratio, bad))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def kept_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            keep = []
            for text in texts(batch):
                n, _, _, _, repeats = counts(text)
                keep.append(n >= 50 and 100 * repeats <= 50 * n and compression(text.encode("utf-8", "surrogatepass"), bands, zstd)[2])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)
