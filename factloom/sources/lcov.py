"""Coverage traces in the line protocol ``SF:``, ``DA:``, ``end_of_record``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import repository_path


class TraceError(ValueError):
    """A trace breaks the protocol."""


def records(text: str, name: str = "<memory>") -> Iterator[tuple[str, int, int]]:
    """(source path, line, count) of each data row; unknown records are passed over."""
    source: str | None = None
    for number, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        where = f"{name}:{number}"
        if line.startswith("SF:"):
            if source is not None:
                raise TraceError(f"{where}: a record begins inside another")
            source = line[3:]
        elif line.startswith("DA:"):
            if source is None:
                raise TraceError(f"{where}: data before a source file")
            parts = line[3:].split(",")
            try:
                at, count = int(parts[0]), int(parts[1])
            except (IndexError, ValueError):
                raise TraceError(f"{where}: malformed data") from None
            if at <= 0 or count < 0:
                raise TraceError(f"{where}: numbers out of range")
            yield source, at, count
        elif line == "end_of_record":
            if source is None:
                raise TraceError(f"{where}: a record ends before it begins")
            source = None
    if source is not None:
        raise TraceError(f"{name}: the last record does not end")


def parse(traces: DataFrame, root: str) -> DataFrame:
    """``path, line, count`` from traces ``(name, text)``: paths outside of the root go, counts of equal lines add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(records(text or "", name))
                path, line, count = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(line, pa.int64()), pa.array(count, pa.int64())], ["path", "line", "count"])

    raw = traces.select("name", "text").mapInArrow(run, "path string, line long, count long")
    inside = raw.withColumn("path", repository_path(F.col("path"), root)).filter("path is not null")
    return merge(inside)


def merge(*lines: DataFrame) -> DataFrame:
    """Counts of several traces added up by path and line."""
    every = lines[0]
    for part in lines[1:]:
        every = every.unionByName(part)
    return every.groupBy("path", "line").agg(F.sum("count").cast("long").alias("count"))


def read(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Parsed and merged trace files."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))
    return parse(texts, root)
