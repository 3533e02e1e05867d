"""Words of many texts at once, as spans of their UTF-8 bytes.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z: ASCII digits and letters, and every
code point beyond ASCII, whose UTF-8 bytes are all 0x80 or more.  So a table of 256 bytes lower-cases and
separates, whatever the language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Each byte as a word has it, a space where it separates words.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


@dataclass
class Words:
    """All words of a batch of texts: buffer[start:end] each, in order, and the text that each is from."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    texts: int

    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)


def words_of_column(column: pa.Array) -> Words:
    """Words of each text of a binary column; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.fromiter((len(x) if x is not None else 0 for x in column.to_pylist()), np.int64, len(column)) if column.null_count else None
    if lengths is None:
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        whole = bytes(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]]) if column.buffers()[2] is not None else b""
        offsets -= offsets[0]
    else:
        whole = b"".join(x for x in column.to_pylist() if x is not None)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    buffer = np.frombuffer(whole.translate(FOLDED), np.uint8)
    inside = buffer != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    # where one text ends within the buffer, the next one's word is another word
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buffer))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(buffer, start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1, len(column))
