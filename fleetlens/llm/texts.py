"""Byte-level access to Arrow text columns, and hashing that every operator of this subpackage shares."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: ASCII white space, the word separator of all contracts.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Block(NamedTuple):
    """Rows ``first .. first + len(starts) - 1`` of a batch and their bytes."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def byte_blocks(column: pa.Array, limit: int = 4 << 20) -> Iterator[Block]:
    """Cut a text column into blocks of whole rows of about ``limit`` bytes (a longer row is a block of its own); null is empty."""
    array = column if pa.types.is_large_binary(column.type) else pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        cut = offsets[row : end + 1]
        yield Block(row, data[cut[0] : cut[-1]], cut[:-1] - cut[0], cut[1:] - cut[0])
        row = end


def scramble(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BYTE_CODES = scramble(np.arange(1, 257, dtype=np.uint64) * MIX)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of a block and the row each belongs to."""
    word = ~SPACE[block.data]
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.starts] = True
    edge[block.ends] = True
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False])) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(block.ends, starts, side="right")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that together cover ``data`` apart from separators, in one vectorised pass."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    within = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = within + np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()) + 1, MIX2, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(BYTE_CODES[data[at]] * powers[within], np.cumsum(lengths) - lengths)
    return scramble(sums + lengths.astype(np.uint64) * MIX)
