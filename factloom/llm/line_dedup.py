"""Line deduplication with levelled sorted runs of line hashes.

Documents arrive in batches of ascending doc_id.  The keys of all earlier batches stand in sorted runs in
the shared folder, one file for each bucket of keys.  A batch brings its own keys to their buckets, which
merge-anti-join them with the files of every run where these stand, and what it writes is its run of level 0.
``FANOUT`` runs of one level are merged, bucket by bucket, into one of the next, so a batch meets few runs
however many batches came before.  No run crosses a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import textbuf as tb
from factloom.llm.common import arrow_map, attach, filesystem, longs, materialize, partitions, release, scratch_path, trim
from factloom.llm.sift import Sieve

#: Runs of one level that are merged into a run of the next.
FANOUT = 3
#: Batches that one table is cut into.
BATCHES = 4
#: Stands for a null doc_id, which counts as the greatest.
LAST = (1 << 63) - 1
LEAST_POINTS = 10


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of each text, and the row bounds among them; an empty text is one line."""
    breaks = np.flatnonzero(data == 0x0A)
    inside = np.searchsorted(breaks, bounds)
    rows = len(bounds) - 1
    first = inside + np.arange(rows + 1)
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    starts[first[:-1]] = bounds[:-1]
    ends[first[1:] - 1] = bounds[1:]
    row = np.searchsorted(bounds, breaks, side="right") - 1
    at = np.arange(len(breaks)) + row
    ends[at] = breaks
    starts[at + 1] = breaks + 1
    return starts, ends, first


def strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space ``[\\x20\\x09-\\x0D]`` at both ends."""
    a, b = tb.runs(tb.SPACE[data], bounds)
    if len(a) == 0:
        return starts, ends
    k = np.searchsorted(a, starts, side="right") - 1
    hit = (k >= 0) & (b[k] > starts)
    starts = np.where(hit, np.minimum(b[k], ends), starts)
    k = np.minimum(np.searchsorted(b, ends, side="left"), len(b) - 1)
    hit = (b[k] >= ends) & (a[k] < ends)
    return starts, np.where(hit, np.maximum(a[k], starts), ends)


def line_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line starts, ends, row bounds, 128 bits of key hash in two words, and whether the key is long enough."""
    starts, ends, first = line_spans(data, bounds)
    a, b = strip(data, starts, ends, bounds)
    low = tb.LOWER[data]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return starts, ends, first, tb.span_hashes(low, a, b, 11), tb.span_hashes(low, a, b, 12), points[b] - points[a] >= LEAST_POINTS


def _keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part, data, bounds in tb.slices(batch, "text"):
        _, _, first, h1, h2, long_ = line_keys(data, bounds)
        row = tb.row_ids(first)[long_]
        h1, h2 = h1[long_], h2[long_]
        order = np.lexsort((h2, h1, row))
        row, h1, h2 = row[order], h1[order], h2[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = pa.array(row[new])
        ids, subs = (part.column(part.schema.get_field_index(c)).take(at) for c in ("id", "sub"))
        yield pa.RecordBatch.from_arrays([longs(h1[new]), longs(h2[new]), ids, subs], ["h1", "h2", "id", "sub"])


def in_run(h1: np.ndarray, h2: np.ndarray, run1: np.ndarray, run2: np.ndarray) -> np.ndarray:
    """Which keys are in a run that is sorted by its first, then its second word."""
    out = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    at = np.searchsorted(run1, h1)
    while len(left):
        # next to each other stand the few keys that share their first word
        same = at[left] < len(run1)
        left = left[same]
        left = left[run1[at[left]] == h1[left]]
        out[left] |= run2[at[left]] == h2[left]
        left = left[~out[left]]
        at[left] += 1
    return out


_STATE = "h1 long, h2 long, owner long, docs long, new boolean, bucket long"


class Runs:
    """Levelled sorted runs of 128-bit keys in the shared folder: folders with one file of new keys for each bucket."""

    def __init__(self, spark, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or min(2 * partitions(spark), 65_536)
        self.levels: list[list[str]] = []

    def all(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def meet(self, keys: DataFrame) -> tuple[str, DataFrame]:
        """Write a batch's ``(h1, h2, owner, docs)`` with what the runs know: its path and table; new keys make a run of it."""
        runs = self.all()

        def merge(key: tuple, group: pa.Table) -> pa.Table:
            h1, h2 = (group.column(c).to_numpy() for c in ("h1", "h2"))
            order = np.lexsort((h2, h1))
            group, h1, h2 = group.take(pa.array(order)), h1[order], h2[order]
            new = np.ones(len(h1), bool)
            for run in runs:
                new &= ~in_run(h1, h2, *_run_file(run, key[0].as_py()))
            return group.select(["h1", "h2", "owner", "docs"]).append_column("new", pa.array(new)).append_column("bucket", pa.array(np.full(len(h1), key[0].as_py())))

        place = F.pmod("h1", F.lit(self.buckets)).alias("bucket")
        return self._write(0, keys.groupBy(place).applyInArrow(merge, _STATE))

    def _write(self, level: int, rows: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(self.spark, f"run{level}")
        rows.sortWithinPartitions("bucket", "h1", "h2").write.partitionBy("bucket").parquet(path)
        return path, self.spark.read.schema(_STATE).parquet(path)

    def add(self, path: str, level: int = 0) -> None:
        """Add a run; full levels are compacted."""
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []

            def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for bucket in batch.column(0).to_pylist():
                    h1, h2 = (np.concatenate(w) for w in zip(*(_run_file(run, bucket) for run in full)))
                    n = len(h1)
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.ones(n, bool)), pa.array(np.full(n, bucket))], [f.split()[0] for f in _STATE.split(", ")])

            every = self.spark.range(0, self.buckets, 1, min(self.buckets, partitions(self.spark)))
            self.add(self._write(level + 1, arrow_map(every, merge, _STATE))[0], level + 1)


def _run_file(run: str, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted new keys of one bucket of a run."""
    fs, base = filesystem(f"{run}/bucket={bucket}")
    files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".parquet")]
    parts = []
    for path in files:
        with fs.open_input_file(path) as stream:
            table = pq.ParquetFile(stream).read(["h1", "h2", "new"])
        new = table.column("new").to_numpy()
        parts.append([table.column(c).to_numpy()[new] for c in ("h1", "h2")])
    h1, h2 = (np.concatenate([np.zeros(0, np.int64), *w]) for w in (zip(*parts) if parts else ((), ())))
    if len(parts) > 1:
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
    return h1, h2


def lost_lines(lines: DataFrame, runs: Runs, last: bool = False) -> DataFrame:
    """For a batch's distinct ``(h1, h2, id, sub)``, those that an earlier batch or a smaller id of this one holds; adds the new keys to the runs."""
    path, state = runs.meet(lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.count("*").alias("docs")))
    if not last:
        runs.add(path)
    state = state.filter("not new or docs > 1").select("h1", "h2", F.when(F.col("new"), F.col("owner")).alias("owner"), "docs", F.lit(True).alias("known"))
    found = attach(lines, state, ["h1", "h2"], "docs")
    return found.filter("known and (owner is null or id > owner)").select("id", "sub", "h1", "h2")


def _drop(text_at: int, lost_at: int | None, counts: tuple[str, str]):
    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = [n for k, n in enumerate(batch.schema.names) if k != lost_at]
        for part, data, bounds in tb.slices(batch, batch.schema.names[text_at]):
            starts, ends, first, h1, h2, long_ = line_keys(data, bounds)
            columns = [c for k, c in enumerate(part.columns) if k != lost_at]
            dropped = np.zeros(len(starts), bool)
            if lost_at is not None:
                lost = part.column(lost_at).fill_null([])
                gone = lost.flatten()
                row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lost).to_numpy())
                dropped[long_] = _among(tb.row_ids(first)[long_], h1[long_], h2[long_], row, *(gone.field(c).to_numpy().view(np.uint64) for c in ("h1", "h2")))
            if dropped.any():
                columns[names.index(batch.schema.names[text_at])] = _joined(part.column(text_at), data, bounds, starts, ends, first, ~dropped)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), pa.array(tb.row_sums(dropped, first))], [*names, *counts])

    return each


def _among(row: np.ndarray, h1: np.ndarray, h2: np.ndarray, gone_row: np.ndarray, gone1: np.ndarray, gone2: np.ndarray) -> np.ndarray:
    """Which of the first triples are among the second."""
    n = len(row)
    r, a, b = np.concatenate([row, gone_row]), np.concatenate([h1, gone1]), np.concatenate([h2, gone2])
    order = np.lexsort((b, a, r))
    r, a, b = r[order], a[order], b[order]
    start = np.ones(len(r), bool)
    start[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(start) - 1
    hit = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    hit[group[order >= n]] = True
    out = np.empty(len(r), bool)
    out[order] = hit[group]
    return out[:n]


def _joined(texts: pa.Array, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept lines of each text, joined by line breaks; null texts stay null."""
    before = np.cumsum(kept) - kept
    row = tb.row_ids(first)
    # a line brings the break before it, unless it is the first that is kept
    later = before > before[first[:-1]][row]
    begin = (starts - later)[kept]
    steps = np.bincount(begin, minlength=len(data) + 1) - np.bincount(ends[kept], minlength=len(data) + 1)
    mask = np.cumsum(steps[:-1]) > 0
    offsets = np.concatenate(([0], np.cumsum(tb.row_sums(mask, bounds)))).astype(np.int32)
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data[mask].tobytes()))
    return pa.compute.if_else(texts.is_null(), pa.scalar(None, pa.string()), out)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents with repeated lines removed, and how many: all columns, then ``n_lines, n_dropped``.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  A key of at least
    10 code points keeps its lines in the smallest doc_id that holds it only; rows that share that doc_id
    all keep them.  A null doc_id counts as the greatest.  A null text has one empty line and stays null;
    a text that loses every line becomes empty.  Columns called ``n_lines`` or ``n_dropped`` are replaced.
    An empty table stays empty.  Keys are compared by 128 bits of hash.  Only documents that lose a line cross
    a shuffle; rows without doc_id are told apart by their texts there.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    sub = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    lines = materialize(arrow_map(docs.select(id_.alias("id"), sub.alias("sub"), "text"), _keys, "h1 long, h2 long, id long, sub long"), "lines")
    shares = [k / batches for k in range(1, batches)]
    found = lines.filter(F.col("id") < LAST).approxQuantile("id", shares, 0.001) if shares else []
    cuts = sorted({min(int(c), LAST - 1) for c in found})
    runs, lost = Runs(spark, fanout), []
    steps = list(zip([None, *cuts], [*cuts, None]))
    for k, (low, high) in enumerate(steps):
        mine = lines
        if low is not None:
            mine = mine.filter(F.col("id") > low)
        if high is not None:
            mine = mine.filter(F.col("id") <= high)
        lost.append(lost_lines(mine, runs, k == len(steps) - 1))
    every = lost[0]
    for part in lost[1:]:
        every = every.unionByName(part)
    name, key, key2 = (_free(n, docs.columns) for n in ("lost", "key", "sub"))
    gone = materialize(every.groupBy(F.col("id").alias(key), F.col("sub").alias(key2)).agg(F.collect_set(F.struct("h1", "h2")).alias(name)), "lost")
    release(spark)
    keyed = docs.withColumns({key: id_, key2: sub})
    sieve = Sieve(gone, key)
    joined = keyed.filter(sieve.column()).join(gone, [key, key2], "left").select(*docs.columns, name)
    text = next(f for f in docs.schema if f.name == "text")
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at, counts = docs.columns.index(text.name), ("n_lines", "n_dropped")
    fewer = joined.mapInArrow(_each(_drop(at, len(docs.columns), counts)), schema)
    place, whole = len(docs.columns), _drop(at, None, counts)

    def clear(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # the rows that cross no shuffle are told apart here, in one Python step
        some = batch.filter(pa.array(~sieve.maybe(batch.column(place).to_numpy())))
        yield from whole(some.drop_columns([batch.schema.names[place]]))

    return docs.withColumn(key, F.xxhash64(id_)).mapInArrow(_each(clear), schema).unionByName(fewer)


def _each(of_batch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from of_batch(batch)
        trim()

    return run


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column has, in any case."""
    used = {c.lower() for c in taken}
    while name in used:
        name = "_" + name
    return name
