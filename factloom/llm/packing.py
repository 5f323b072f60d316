"""Minimum bin slack packing of token sequences, partition by partition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbuf as tb
from factloom.llm.tokens import word_tokens

#: Id that ends each document.
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: np.ndarray, present: list[int], room: int) -> list[int]:
    """Lengths (repeats allowed up to ``counts``) whose sum comes as close to ``room`` as any subset can.

    ``present`` lists the lengths with a count, ascending.  The set of reachable sums is one integer used
    as a bitset; each step shifts it by one more piece, and the steps are walked back from the best sum.
    """
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in reversed(present):
        if length > room:
            continue
        for _ in range(min(int(counts[length]), room // length)):
            more = (reach | (reach << length)) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach & goal:
                break
        if reach & goal:
            break
    left, used = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if left and not (before >> left) & 1:
            used.append(length)
            left -= length
    return used


def minimum_slack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths`` (each 1..capacity): the longest piece left, then the best filling for it."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    ends = np.cumsum(counts)
    present = np.flatnonzero(counts).tolist()
    bins: list[list[int]] = []
    while present:
        longest = present[-1]
        counts[longest] -= 1
        if not counts[longest]:
            present.pop()
        used = fill(counts, present, capacity - longest) if longest < capacity else []
        for length in set(used):
            counts[length] -= used.count(length)
            if not counts[length]:
                present.remove(length)
        # pieces of one length are taken from the back of their run in `order`
        taken = []
        for length in [longest, *used]:
            ends[length] -= 1
            taken.append(int(order[ends[length]]))
        bins.append(taken)
    return bins


def _pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        tokens = word_tokens(path)
        ids_left: list[np.ndarray] = []  # the remainders' tokens: less than `capacity` of each document
        doc_left: list[pa.Array] = []
        start_left: list[np.ndarray] = []
        total_left: list[np.ndarray] = []
        for batch in batches:
            for part, data, bounds in tb.slices(batch, "text"):
                flat, cut = _with_end(*tokens.encode(data, bounds))
                sizes = np.diff(cut)
                whole = sizes // capacity
                doc = part.column(part.schema.get_field_index("doc_id"))
                row = np.repeat(np.arange(len(sizes)), whole)
                at = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
                if len(row):
                    begin = cut[row] + at * capacity
                    crc = [zlib.crc32(flat[b : b + capacity]) for b in begin.tolist()]
                    yield _piece_rows(doc.take(pa.array(row)), at * capacity, np.full(len(row), capacity), crc, sizes[row], sequence + np.arange(len(row)), np.zeros(len(row), np.int64))
                    sequence += len(row)
                rest = np.flatnonzero(sizes % capacity)
                for b, e in zip((cut[rest] + whole[rest] * capacity).tolist(), cut[rest + 1].tolist()):
                    ids_left.append(flat[b:e].copy())
                doc_left.append(doc.take(pa.array(rest)))
                start_left.append(whole[rest] * capacity)
                total_left.append(sizes[rest])
                if len(ids_left) >= 200_000:
                    out, sequence = _finish(ids_left, doc_left, start_left, total_left, capacity, sequence)
                    yield out
                    ids_left, doc_left, start_left, total_left = [], [], [], []
        if ids_left:
            yield _finish(ids_left, doc_left, start_left, total_left, capacity, sequence)[0]

    return run


def _with_end(ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Append ``END`` to each row."""
    n = len(cut) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = cut[1:] + np.arange(n)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[ends] = END
    out[body] = ids
    return out, cut + np.arange(n + 1)


def _finish(ids: list[np.ndarray], docs: list[pa.Array], starts: list[np.ndarray], totals: list[np.ndarray], capacity: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """Pack the remainders.  Only the last bin may be far from full: it is cut into sequences of powers of two, which need no padding."""
    doc, start, total = pa.concat_arrays(docs), np.concatenate(starts), np.concatenate(totals)
    lengths = np.array([len(x) for x in ids], np.int64)
    bins = minimum_slack(lengths, capacity)
    rows: list[tuple[int, int, int, int, int]] = []  # piece, its first id, its ids, sequence, offset
    for k, taken in enumerate(bins):
        filled = int(lengths[taken].sum())
        last = k == len(bins) - 1
        room = capacity if not last or filled == capacity else 1 << (filled.bit_length() - 1)
        offset = 0
        for piece in taken:
            done, size = 0, int(lengths[piece])
            while done < size:
                part = min(size - done, room - offset)
                rows.append((piece, done, part, sequence, offset))
                done, offset, filled = done + part, offset + part, filled - part
                if offset == room and filled:
                    sequence, offset, room = sequence + 1, 0, 1 << (filled.bit_length() - 1)
        sequence += 1
    piece, first, size, seq, offset = (np.array(x, np.int64) for x in zip(*rows))
    crc = [zlib.crc32(ids[p][f : f + s]) for p, f, s in zip(piece.tolist(), first.tolist(), size.tolist())]
    return _piece_rows(doc.take(pa.array(piece)), start[piece] + first, size, crc, total[piece], seq, offset), sequence


def _piece_rows(doc: pa.Array, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document's ids (and the end id) lie in exactly one piece each; a document of more than
    ``capacity`` ids is cut into full sequences and a remainder.  Remainders are packed within their
    partition, so no row is shuffled and memory holds the remainders of 200,000 documents at most.  A
    null text counts as empty (the end id alone); repeated rows and null ids are documents of their own;
    other columns are ignored; an empty table gives no piece.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(vocabulary, capacity), SCHEMA)
