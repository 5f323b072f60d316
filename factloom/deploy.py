"""Makes the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their Python path has it already."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    if os.path.dirname(ROOT) not in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        path = os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(ROOT):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("factloom", os.path.relpath(full, ROOT)))
        context.addPyFile(path)
    context._factloom_shipped = True
