"""Vectorised text primitives over Arrow string columns.

Texts of a batch are handled as one UTF-8 byte buffer with document offsets, so
words, shingles and rolling hashes cost numpy operations, not Python loops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
BASE = U64(0xD6E8FEB86659FD93)
#: Bytes hashed at once, about.
PIECE = 1 << 22
#: ASCII white space; everything else belongs to a word.
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def space_table() -> np.ndarray:
    """Separator flags by byte: ASCII white space."""
    table = np.zeros(256, bool)
    table[list(SPACE_BYTES)] = True
    return table


def symbol_table() -> np.ndarray:
    """Separator flags by byte: all ASCII that is neither letter nor digit."""
    table = np.zeros(256, bool)
    table[:128] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        table[lo:hi] = False
    return table


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = utf8(batch.column(column))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if not n or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document index of every word."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    inside = ~separators[raw]
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range, finalised; it does not depend on where the range lies.

    Ranges, in order of their starts, are taken in stretches of about PIECE bytes,
    so a very long text costs no more memory than its longest range.
    """
    if not len(starts):
        return np.zeros(0, U64)
    table = mix(np.arange(1, 257, dtype=U64) * GOLDEN + U64(seed))
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    if len(raw) <= 2 * PIECE:
        return _range_hashes(raw, starts, ends, table, inverse)
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        out[i:j] = _range_hashes(raw[lo:hi], starts[i:j] - lo, ends[i:j] - lo, table, inverse)
        i = j
    return out


def _range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, inverse: np.uint64) -> np.ndarray:
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(table[raw] * powers(len(raw), BASE), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(raw) + 1, inverse)[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each window of ``size`` words inside a document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    total = np.zeros(len(at), U64)
    for j in range(size):
        total = total * BASE + hashes[at + j]
    return at, mix(total)


def shingles(hashes: np.ndarray, docs: np.ndarray, size: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle; a shorter document has one shingle of all its words."""
    at, value = windows(hashes, docs, size)
    owner = docs[at]
    count = np.bincount(docs, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(docs, short)
        total = np.full(len(short), GOLDEN, U64)
        for j in range(size - 1):
            has = count[short] > j
            at_j = np.where(has, first + j, 0)
            total = np.where(has, total * BASE + hashes[at_j], total)
        value = np.concatenate([value, mix(total)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def code_points(raw: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position, one entry more than bytes."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of ``values`` as an Arrow list column."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
