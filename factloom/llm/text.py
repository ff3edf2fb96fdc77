"""Words, lines and bytes as all text operators take them."""

from __future__ import annotations

import pyarrow as pa

#: Words are the runs of bytes other than these; bytes.split() cuts at exactly the same six.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: For bytes.translate: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column with null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
