"""Words and word hashes of many texts at once, on the UTF-8 bytes of an Arrow string column.

All delimiters used here are ASCII, so cutting bytes equals cutting code points. A shard is a slice of a batch whose
texts have about ``SHARD_BYTES`` together; a longer text is a shard of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

SHARD_BYTES = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and everything beyond ASCII, after lower-casing A-Z.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Words between white space.
SPACED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])#: The lowest bytes of a number that are kept for a word's last block, by their number.
_KEEP = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and the offsets of its texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def shards(batch: pa.RecordBatch, column: str, limit: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text, at least one row each."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    buf: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # row of each word
    n_docs: int

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    @cached_property
    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of every word as numbers of eight bytes, the last one filled up with zeros, and where each word's begin."""
        size = self.ends - self.starts
        count = (size + 7) >> 3
        first = np.concatenate(([0], np.cumsum(count)))
        padded = np.concatenate((self.buf, np.zeros(8, np.uint8)))
        any_eight = np.ndarray((len(self.buf) + 1,), "<u8", padded, 0, (1,))
        # words of one block, and then those of more
        out = np.empty(first[-1], np.uint64)
        one = count == 1
        out[first[:-1][one]] = any_eight[self.starts[one]]
        long = np.flatnonzero(~one)
        place = np.arange(count[long].sum()) - np.repeat(np.cumsum(count[long]) - count[long], count[long])
        out[np.repeat(first[:-1][long], count[long]) + place] = any_eight[np.repeat(self.starts[long], count[long]) + 8 * place]
        out[first[1:] - 1] &= _KEEP[size - 8 * (count - 1)]
        return out, first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its blocks are mixed with their places, added and mixed again. It is never 0."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        blocks, first = self.blocks
        step = np.uint64(0x9E3779B97F4A7C15)
        h = mix64(blocks[first[:-1]] + step)
        long = np.flatnonzero(np.diff(first) > 1)
        if len(long):
            more = np.diff(first)[long] - 1
            start = np.cumsum(more) - more
            place = np.arange(more.sum()) - np.repeat(start, more) + 1
            at = np.repeat(first[:-1][long], more) + place
            h[long] += np.add.reduceat(mix64(blocks[at] + (place + 1).astype(np.uint64) * step), start)
        h = mix64(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        h[h == 0] = 1
        return h


def words_of(texts: pa.Array, inside: np.ndarray, lower: bool = True, parted: np.ndarray | None = None) -> Words:
    """Words of bytes that are ``inside``; ``parted`` has kinds 1 and 2 of bytes between which words are cut as well."""
    buf, offsets = text_bytes(texts)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, none, len(texts))
    word = inside[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True  # a word never runs over into the next text
    if parted is not None:
        kind = parted[buf]
        cut[1:n] |= kind[1:] * kind[:-1] == 2
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return Words(buf, starts, ends, np.searchsorted(offsets, starts, "right") - 1, len(texts))
