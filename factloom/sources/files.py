"""Scanning source trees."""

from __future__ import annotations

import os
import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import excluded

EXTENSIONS = {".jl": "julia", ".odin": "odin", ".md": "markdown"}
PRUNED = (".git", ".build", "bin")


def rebased_excludes(root: str, excludes: list[str]) -> list[str]:
    """Excludes relative to a root that is itself the first segment of some of them."""
    base = os.path.basename(os.path.abspath(root))
    out = []
    for x in excludes:
        first, _, rest = x.replace("\\", "/").rstrip("/").partition("/")
        out.append(rest if rest and first == base else x)
    return out


def source_files(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """``path, language, text, file_ord`` of the sources below a root, pruned directories and excludes left out.

    Order is by path; later relations take it from ``file_ord``, never from the order of rows.
    """
    if "://" not in root and not os.path.isdir(root):
        raise NotADirectoryError(root)
    base = root.rstrip("/") if "://" in root else "file:" + os.path.abspath(root)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jl,odin,md}").load(base).select(F.col("path").alias("uri"))
    relative = F.regexp_replace(F.regexp_replace("uri", "^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in base.replace("file:", "", 1).rstrip("/")) + "/", "")
    rows = listed.select(relative.alias("path"), "uri")
    pruned = F.lit(False)
    for name in PRUNED:
        pruned = pruned | F.col("path").startswith(name + "/") | F.col("path").contains(f"/{name}/")
    language = F.lit(None).cast("string")
    for extension, name in EXTENSIONS.items():
        language = F.when(F.col("path").endswith(extension), name).otherwise(language)
    kept = rows.filter(~pruned & ~excluded(F.col("path"), rebased_excludes(root, excludes or [])))
    texts = kept.select("path", "uri").mapInArrow(_contents, "path string, content binary")
    return texts.select("path", language.alias("language"), F.decode("content", "UTF-8").alias("text")).withColumn("file_ord", F.col("path"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed files; pruned and excluded ones are never opened."""
    for batch in batches:
        for path, uri in zip(*(batch.column(c).to_pylist() for c in ("path", "uri"))):
            scheme, host, place = re.fullmatch("([A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)", uri, re.DOTALL).groups()
            fs, place = pyarrow.fs.FileSystem.from_uri(f"{scheme}://{host or ''}{urllib.parse.quote(place)}")
            with fs.open_input_file(place) as stream:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([stream.read()], pa.binary())], ["path", "content"])
