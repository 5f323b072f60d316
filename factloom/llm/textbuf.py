"""Vectorised text primitives over Arrow string buffers.

Every operator that needs words, lines or shingles works on the raw UTF-8 bytes of a whole Arrow
column at once: byte classes are table look-ups, spans come from transitions of the class mask and
span hashes come from one running polynomial sum.  Nothing here loops over characters, words or
lines in Python; a text may have any length, and null texts count as empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the running polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Rows whose text bytes exceed this are handed on in slices, so memory follows the slice, not the batch.
SLICE_BYTES = 2 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table that is true on the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``; every byte of a multi-byte character counts as a word byte.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row bounds (rows + 1); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if column.null_count:
        empty = np.asarray(column.is_null())
        if (np.diff(bounds)[empty] > 0).any():
            return column_bytes(column.fill_null(""))
    return data, bounds


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` text bytes each (one row at least)."""
    data, bounds = column_bytes(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start), data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs of ``mask``, cut at row bounds."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):
        begin[inner] = mask[inner]
        stop[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def rows_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The index, for each row, of its first span: spans of row r are [out[r], out[r + 1])."""
    return np.searchsorted(starts, bounds, side="left")


@functools.lru_cache(maxsize=8)
def _symbols(seed: int) -> np.ndarray:
    """256 random odd 64-bit values, one for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U64) | U64(1)


#: Bytes whose powers stand in a table; larger exponents are products of two entries.
_STEP = 1 << 16


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _running(data: np.ndarray, seed: int) -> np.ndarray:
    """Sums of the first 0, 1, .. bytes' symbols, each times the power of its place."""
    symbols, low, up = _symbols(seed), _powers(_P, _STEP), U64(1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    stride = U64(pow(_P, _STEP, 1 << 64))
    with np.errstate(over="ignore"):
        for at in range(0, len(data), _STEP):
            part = symbols[data[at : at + _STEP]]
            part *= low[: len(part)]
            part *= up
            part[0] += total[at]
            np.cumsum(part, out=total[at + 1 : at + 1 + len(part)])
            up = up * stride
    return total


def _shift(starts: np.ndarray) -> np.ndarray:
    """The inverse power of each place."""
    high = _powers(pow(_P_INV, _STEP, 1 << 64), 1 << 12)
    out = _powers(_P_INV, _STEP)[starts & (_STEP - 1)]
    blocks = starts >> 16
    while blocks.any():
        out *= high[np.minimum(blocks, len(high) - 1)]
        blocks = blocks - np.minimum(blocks, len(high) - 1)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal spans have equal hashes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    total = _running(data, seed)
    body = (total[ends] - total[starts]) * _shift(starts)
    return mix(body + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a row, and the row bounds of the result.

    ``words`` holds word hashes, ``first`` the row bounds among them; a row with fewer words has none.
    """
    salt = _symbols(seed)
    n = len(words)
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=bounds[1:])
    if n < width or bounds[-1] == 0:
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    total = words[: n - width + 1] * salt[0]
    for k in range(1, width):
        total = (total ^ (total >> U64(29))) * salt[k & 255] + words[k : n - width + 1 + k]
    keep = np.ones(n - width + 1, bool)
    for k in range(1, width):
        cut = first[1:-1] - k
        cut = cut[(cut >= 0) & (cut < len(keep))]
        keep[cut] = False
    short = np.flatnonzero((np.diff(first) > 0) & (counts == 0))
    for r in short:
        keep[first[r] : min(first[r + 1], len(keep))] = False
    return mix(total[keep]), bounds


def row_ids(bounds: np.ndarray) -> np.ndarray:
    """For items with row bounds ``bounds``, the row of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sorted_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within each row, with their row."""
    rows = row_ids(bounds)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    return values[order], rows[order]


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and their row bounds."""
    out = values.copy()
    keep = np.ones(len(values), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            part = out[a:b]
            part.sort()
            np.not_equal(part[1:], part[:-1], out=keep[a + 1 : b])
    return out[keep], np.concatenate(([0], np.cumsum(row_sums(keep, bounds))))
