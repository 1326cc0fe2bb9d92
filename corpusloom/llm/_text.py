"""Vectorised words: byte tables, word bounds and 64-bit word fingerprints over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
#: Bytes that are gathered before arrays are computed; a longer single text is one chunk by itself.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z is lower-cased).
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NON_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NON_WORD[_lo : _hi + 1] = True
NON_WORD[0x41:0x5B] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
_STEP, _SIZE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[start:end]: each block of 8 bytes is mixed with its rank, and the blocks are summed up."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    sizes = ends - starts
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    out = mix((eights[starts] & _MASKS[np.minimum(sizes, 8)]) + _STEP)
    longer = np.flatnonzero(sizes > 8)
    if len(longer):
        blocks = (sizes[longer] - 1) // 8
        first = np.cumsum(blocks) - blocks
        rank = np.arange(1, blocks.sum() + 1) - np.repeat(first, blocks)
        at = np.repeat(starts[longer], blocks) + 8 * rank
        own = eights[at] & _MASKS[np.minimum(np.repeat(ends[longer], blocks) - at, 8)]
        out[longer] += np.add.reduceat(mix(mix(own) + (rank.astype(U) + U(1)) * _STEP), first)
    return mix(out + sizes.astype(U) * _SIZE)


def fingerprint(word: str) -> int:
    data = LOWER[np.frombuffer(word.encode(), dtype=np.uint8)]
    return int(fingerprints(data, np.array([0]), np.array([len(data)]))[0])


@dataclass
class Words:
    """Words of some texts: ``bounds[k]:bounds[k+1]`` are those of text k."""

    data: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray  # of each text in data

    def hashes(self) -> np.ndarray:
        return fingerprints(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def looked_up(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[raw] for a table of 256 one-byte values, read-only; several times as fast."""
    return np.frombuffer(raw.tobytes().translate(table.tobytes()), dtype=table.dtype)


def words(column: pa.Array, separators: np.ndarray) -> Words:
    raw, offsets = raw_bytes(column)
    word = looked_up(raw, ~separators)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
    before[1:] = word[:-1]
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(looked_up(raw, LOWER), starts, ends, np.searchsorted(starts, offsets), offsets)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes, at least one row each."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0)).astype(np.int64)
    upto = np.cumsum(sizes)
    i, done = 0, 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, done + limit, side="right")))
        yield batch.slice(i, j - i)
        i, done = j, int(upto[j - 1])
