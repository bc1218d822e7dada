"""Pieces shared by the training-data operators.

Everything here is deterministic across processes: hashes come from fixed tables, never from Python's ``hash``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from loomgraph.sources.shared import materialize, release, shared_dir, table
from loomgraph.sources.ship import kept, map_arrow

__all__ = ["kept", "map_arrow", "materialize", "release", "shared_dir", "table"]

#: Bytes of text worked on at once inside a Python worker; bounds the numpy temporaries (about 60 bytes per text byte).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POSITIONS = 64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, size=_POSITIONS * 256, dtype=np.uint64)
_MIX = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)


def crc_mod(col: str, n: int):
    """crc32 of an id written as text, modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a record batch into runs of rows whose texts hold about ``limit`` bytes; a longer single row stays whole."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    lens = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    begin, held = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if offsets else np.zeros(1, np.int64)
    begin, end = int(ends[0]), int(ends[-1])
    held = np.frombuffer(data, np.uint8)[begin:end] if data and end > begin else np.zeros(0, np.uint8)
    return held, ends - begin


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, keep: np.ndarray | None = None):
    """Hash each word of each row.

    Returns (hashes, counts of words per row).  Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, or of the bytes
    ``keep`` marks.  Rows are separate: a word never crosses from one row into the next.  Hashing is tabulation by byte and
    place, with an odd factor per block of 64 bytes.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_SPACE[data] if keep is None else keep[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False  # a row's first byte never continues a word
    first = inside & ~before
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    chars = data[inside]
    if lower:
        chars = _LOWER[chars]
    at = np.flatnonzero(first[inside])  # where words begin among the kept bytes
    lens = np.diff(np.append(at, len(chars)))
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(at, lens)
    vals = _TABLE[((place & (_POSITIONS - 1)) << 8) + chars]
    if lens.max() > _POSITIONS:
        vals = vals * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    hashes = mix64(np.add.reduceat(vals, at) + lens.astype(np.uint64) * _MIX[0])
    bounds = np.searchsorted(starts, offsets)
    return hashes, np.diff(bounds)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _MIX[k + 1]
    return mix64(out)


class WordTable:
    """A bounded map from words to rows of numbers, filled on demand by ``compute(list of new words) -> array``.

    Holds at most about ``limit`` words and starts anew beyond, so memory doesn't follow the vocabulary.
    """

    def __init__(self, compute, width: int, limit: int = 300_000, dtype=np.int32):
        self.compute, self.limit, self.width, self.dtype = compute, limit, width, dtype
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.values = np.zeros((1024, self.width), self.dtype)

    def ids(self, words: list) -> np.ndarray:
        got = list(map(self.index.get, words))
        if None in got:
            new = list({w for w, i in zip(words, got) if i is None})
            if len(self.index) + len(new) > self.limit and self.index:
                self.clear()
                new = list(set(words))
            base = len(self.index)
            rows = self.compute(new)
            if base + len(new) > len(self.values):
                grown = np.zeros((2 * (base + len(new)), self.width), self.dtype)
                grown[:base] = self.values[:base]
                self.values = grown
            self.values[base : base + len(new)] = rows
            self.index.update(zip(new, range(base, base + len(new))))
            get = self.index.__getitem__
            got = list(map(get, words)) if base == 0 else [get(w) if i is None else i for w, i in zip(words, got)]
        return np.array(got, dtype=np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum runs of rows of ``values`` by ``counts``; empty runs give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.concatenate(([0], np.cumsum(counts)))
    return total[ends[1:]] - total[ends[:-1]]
