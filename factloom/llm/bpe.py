"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over a text's bytes cuts it where its last WINDOW bytes say so, so that passages which documents share
fall into the same chunks wherever they stand. A chunk is encoded when a worker process first meets
it, and its ids are reused after that, in whatever document, task or place it comes up again. What a
part of an Arrow batch brings anew goes to the tokenizers library together. Where the tokenizer file states that its pieces hold no white space, new chunks are
themselves cut at white space into smaller ones, which recur far more often, and only those not met before reach the library.

Cuts may fall inside a word, so the ids at a chunk's ends are not yet those of the text. A join is repaired by encoding a window over it:
from a word boundary in one chunk to one in the next, with whole words between these and the cut. The window has to give
those words the ids that they have in the chunks and by themselves; then both sides agree with it, and its ids stand between theirs. If not, the window
grows by a word on each side; where the words at hand never agree, the text is encoded as a whole. For a tokenizer whose
pieces hold no white space, as the public one's, agreement is certain and exact: what stands between two of the six ASCII white space
characters is encoded alike wherever it stands. A join that comes up again is remembered as chunks are.

The memories are bounded in entries and in bytes; of a full one the half that goes on being met stays, which changes no
result. Decoding reads the ids alone, by a table of the vocabulary or by the decoder of the tokenizer file. No text is
shuffled: to encode each chunk once in the whole cluster, all chunks and all ids would cross the network.

Defined results: null and empty texts have no ids and decode to the empty text; a very long text costs in proportion to its length, and
one without white space is a single chunk; rows that repeat and texts that tie are encoded alike; an empty
table gives an empty one; other columns stay as they are where documents are passed on, but for columns named text, ids or decoded, which are the operator's own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import islice, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


WINDOW_BITS = 5  # the hash sees 2**5 bytes
MASK_BITS = 10  # one cut in 2**10 bytes on average
SHORTEST, LONGEST = 256, 8192
#: Bounds of the memories: entries (chunks and joins each, small chunks) and bytes in each of two halves, and bytes counted for an entry besides its own.
CHUNKS, SMALL = 20_000, 150_000
MEMORY_BYTES = 16 << 20
ENTRY_BYTES = 170
#: Small chunks of more bytes are not remembered.
LONG = 256
#: Small chunks that are given to the library as one text, and a character that stands between them and is a piece of one id.
TOGETHER, BETWEEN = 200, "\x1c"
#: Words with known boundaries at each end of a chunk, and so the most by which a window over a join can grow.
WORDS = 4
#: Texts of so many bytes are encoded together, and given back to Spark together.
IN_BYTES = 1 << 20
_GEAR = np.array([(0x9E3779B97F4A7C15 * (b + 1) ** 3 >> 16) & 0xFFFFFFFF for b in range(256)], np.uint32)
#: The last white space before a word.
_BOUNDARY = re.compile(rb"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])")
#: What the public file states of its normalizer and of the pieces that it keeps. For Latin-1 text these are the same as lower case alone.
_LOWER_CASE = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PIECES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def vocabulary() -> str:
    """Place of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes, by its content alone; never inside a character."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for k in range(WINDOW_BITS):
        step = 1 << k
        shifted = h[:-step] * np.uint32(pow(31, step, 1 << 32))
        h[step:] += shifted
    # the top bits depend on all bytes of the window
    at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    starts = (raw & 0xC0) != 0x80
    ends, last = [], 0
    for p in [*at[at < n][starts[at[at < n]]].tolist(), n]:
        while p - last > LONGEST:
            q = last + LONGEST
            while not starts[q]:
                q -= 1
            ends.append(q)
            last = q
        if p - last >= SHORTEST or p == n:
            if p > last:
                ends.append(p)
            last = p
    return ends


class Chunk(NamedTuple):
    """A chunk, its address, and its first and last WORDS word boundaries (none if these are not 2 * WORDS different ones)."""

    data: bytes
    key: bytes
    first: list[int]
    last: list[int]


class Join(NamedTuple):
    """How many ids, in bytes, a window over a join replaces at the end of one chunk and at the start of the next, and its own ids."""

    before: int
    ids: bytes
    after: int


def chunk(part: bytes) -> Chunk:
    key = xxhash.xxh3_128_digest(part)
    first = [m.start() for m in islice(_BOUNDARY.finditer(part), WORDS)]
    if len(first) < WORDS:
        return Chunk(part, key, [], [])
    back, last = 32 * WORDS, []
    while len(last) < WORDS:
        last = [m.start() for m in _BOUNDARY.finditer(part, max(0, len(part) - back))]
        back *= 2
    last = last[-WORDS:]
    return Chunk(part, key, first, last) if last[0] > first[-1] else Chunk(part, key, [], [])


def chunks(data: bytes) -> list[Chunk]:
    """The chunks of a text. One with too few words to repair its ends by is joined with the next, or the last with the one before."""
    found, start = [], 0
    for end in cuts(data):
        one = chunk(data[start:end])
        if one.first:
            found.append(one)
            start = end
    if start < len(data):
        found.append(chunk((found.pop().data if found else b"") + data[start:]))
    return found


class Memory(dict):
    """Ids by key, of bounded size. What a batch asks for is there until the next one."""

    def __init__(self, entries: int):
        self.entries, self.size, self.old = entries, 0, {}

    def add(self, key: bytes, found: bytes | Join) -> None:
        self[key] = found
        self.size += len(key) + len(found if isinstance(found, bytes) else found.ids) + ENTRY_BYTES

    def lacks(self, keys: set[bytes]) -> set[bytes]:
        """The keys of a batch that are not there. Those of the older half that are asked for move to the newer one."""
        if len(self) > self.entries or self.size > MEMORY_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0
        new = keys - self.keys()
        for key in new & self.old.keys():
            self.add(key, self.old[key])
        return new - self.keys()


class ChunkedBPE:
    """Encodes and decodes texts as the tokenizer file does as a whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.path, self.has_decoder = path, stated["decoder"] is not None
        #: Whether pieces hold no white space, and Latin-1 text needs no normalizer but lower case.
        self.plain = stated["normalizer"] == _LOWER_CASE and stated["pre_tokenizer"].get("pretokenizers", [None])[0] == _PIECES
        self.added = [x["content"].lower() for x in stated["added_tokens"]]
        by_id = {n: t for t, n in stated["model"]["vocab"].items()} | {x["id"]: x["content"] for x in stated["added_tokens"]}
        self.names = [by_id.get(n) for n in range(max(by_id, default=-1) + 1)]
        self.known, self.joins, self.small = Memory(CHUNKS), Memory(CHUNKS), Memory(SMALL)

    # a worker loads of these what it needs: one that only decodes by the table above, neither

    @cached_property
    def tokenizer(self):
        """The library's tokenizer of the file."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    @cached_property
    def lower(self):
        """The same without its normalizer."""
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.normalizer = Sequence([])
        return tokenizer

    @cached_property
    def between(self) -> int:
        """The id of BETWEEN."""
        (n,) = self.lower.encode(BETWEEN, add_special_tokens=False).ids
        return n

    def _library(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts by the library, in one call for those that need no normalizer and one for the others."""
        plain, other = [], []
        out: list = [None] * len(parts)
        for k, part in enumerate(parts):
            text = part.decode("utf-8", "surrogatepass")
            if self.plain and (text.isascii() or max(text) < "\u0100"):
                low = text.lower()
                if not any(x in low for x in self.added):
                    plain.append((k, low))
                    continue
            other.append((k, text))
        for name, some in (("lower", plain), ("tokenizer", other)):
            if some:
                for (k, _), found in zip(some, getattr(self, name).encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                    out[k] = np.array(found.ids, "<u4")
        return out

    def _small_chunks(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of small chunks: those of the long ones, and the memory of the others."""
        long = [w for w in words if len(w) > LONG]
        new = self.small.lacks(words.difference(long) if long else words)
        held = dict(zip(long, (x.tobytes() for x in self._library(long)), strict=True))
        # many to a text, and Latin-1 apart, since one other character would send its whole text through the normalizer
        latin = [w for w in new if w.isascii() or max(w) < 0xC4]
        other = list(new.difference(latin))
        groups = [some[at : at + TOGETHER] for some in (latin, other) for at in range(0, len(some), TOGETHER)]
        join = f" {BETWEEN} ".encode()
        for group, ids in zip(groups, self._library([join.join(g) for g in groups]), strict=True):
            at = np.flatnonzero(ids == self.between)
            if len(at) == len(group) - 1:
                raw = ids.tobytes()
                for w, s, e in zip(group, [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True):
                    self.small.add(w, raw[s:e])
            else:  # the character itself is in one of them
                for w, ids in zip(group, self._library(group), strict=True):
                    self.small.add(w, ids.tobytes())
        return held

    def _chunks(self, found: list[Chunk]) -> None:
        """Makes the ids of chunks known; those that are not in memory are encoded together, each once."""
        data = {one.key: one.data for one in found}
        new = [data[key] for key in self.known.lacks(data.keys())]
        for key, ids in zip([xxhash.xxh3_128_digest(x) for x in new], self.encoded(new), strict=True):
            self.known.add(key, ids)

    def encoded(self, new: list[bytes]) -> list[bytes]:
        """The ids of chunks as the library encodes each by itself."""
        if not self.plain:
            return [x.tobytes() for x in self._library(new)]
        words = [x.split() for x in new]
        long, known = self._small_chunks({w for of in words for w in of}), self.small
        return [b"".join([long[w] if w in long else known[w] for w in of] if long else map(known.__getitem__, of)) for of in words]

    def _joins(self, pairs: list[tuple[Chunk, Chunk]]) -> dict[bytes, Join]:
        """The repaired joins of chunks that follow each other, by both keys; those that never agree are left out."""
        asked = {a.key + b.key: (a, b) for a, b in pairs}
        left = {key: asked[key] for key in self.joins.lacks(asked.keys())}
        for words in range(2, WORDS + 1):
            # for each join: its window, what this replaces on each side, and the whole words in that
            pieces = {}
            for key, (a, b) in left.items():
                tail, head = a.data[a.last[-words] :], b.data[: b.first[words - 1]]
                pieces[key] = tail + head, tail, a.data[a.last[-words] : a.last[-1]], head, b.data[b.first[0] : b.first[words - 1]]
            new = list({x for of in pieces.values() for x in of})
            made = dict(zip(new, self.encoded(new), strict=True))
            for key, of in pieces.items():
                a, b = left[key]
                window, tail, before, head, after = (made[x] for x in of)
                if agrees(self.known[a.key], tail, before, window, self.known[b.key], head, after):
                    self.joins.add(key, Join(len(tail), window, len(head)))
                    del left[key]
            if not left:
                break
        return {key: self.joins[key] for key in asked.keys() - left.keys()}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers."""
        cut = [chunks((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        self._chunks([one for found in cut for one in found])
        joins = self._joins([pair for found in cut for pair in pairwise(found)])
        out = []
        for text, found in zip(texts, cut, strict=True):
            repaired = [joins.get(a.key + b.key) for a, b in pairwise(found)]
            if None in repaired:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            made, start = [], 0
            for one, join in zip(found, [*repaired, None], strict=False):
                of = self.known[one.key]
                made.append(of[start : len(of) - (join.before if join else 0)])
                if join:
                    made.append(join.ids)
                    start = join.after
            out.append(b"".join(made))
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """The ids of a text as little-endian unsigned 32-bit integers, and what they decode to."""
        (ids,) = self.ids([text])
        return ids, self.decode(ids)

    def decode(self, ids: bytes | None) -> str:
        """The text of ids, as the tokenizer file has it."""
        numbers = np.frombuffer(ids or b"", "<u4").tolist()
        if self.has_decoder:
            return self.tokenizer.decode(numbers, skip_special_tokens=False)
        # without a decoder, the tokenizer decodes to its tokens with blanks between them; an id that is none is an error
        return " ".join(map(self.names.__getitem__, numbers))


def agrees(a: bytes, tail: bytes, before: bytes, window: bytes, b: bytes, head: bytes, after: bytes) -> bool:
    """Whether the window over a join of chunks a and b, their own ends (tail, head) and the whole words in these (before, after) have the same ids."""
    left = a.endswith(tail) and tail.startswith(before) and window.startswith(before)
    right = b.startswith(head) and head.endswith(after) and window.endswith(after)
    return left and right and len(before) + len(after) <= len(window)


@cache
def coder(path: str) -> ChunkedBPE:
    """The one of a worker process: its memory outlives a task."""
    return ChunkedBPE(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of docs without text, with ids (binary, little-endian unsigned 32-bit)."""
    names = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    schema = docs.select(*names).schema.add("ids", "binary")
    return _mapped(docs.select(*names, "text"), schema, path, ChunkedBPE.ids, pa.binary())


def decoded(found: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encoded() with decoded (string), made of their ids alone."""
    names = [c for c in found.columns if c not in ("ids", "decoded")] + ["ids"]
    ids = found["ids"].alias("_ids")

    def texts(bpe: ChunkedBPE, ids: list[bytes | None]) -> list[str]:
        return list(map(bpe.decode, ids))

    return _mapped(found.select(*names, ids), found.select(*names).schema.add("decoded", "string"), path, texts, pa.string())


def _mapped(rows: DataFrame, schema: StructType, path: str | None, f: Callable, kind: pa.DataType) -> DataFrame:
    """The rows with f of their last column in its place."""
    place = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(place)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.columns[-1]).fill_null(0).to_pylist()
            bounds, size = [0], 0
            for k, n in enumerate(sizes, 1):
                size += n
                if size > IN_BYTES or k == len(sizes):
                    bounds.append(k)
                    size = 0
            for first, end in pairwise(bounds):
                made = f(bpe, batch.columns[-1][first:end].to_pylist())
                others = [c[first:end] for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*others, pa.array(made, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows, which are decoded if they are not yet."""
    found = found if "decoded" in found.columns else decoded(found)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
