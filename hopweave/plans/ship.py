"""Python workers import this library: where they cannot find it by themselves, it is sent to them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shipped(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless the workers' search path already has it."""
    context = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_hopweave_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="hopweave-"), "hopweave.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "hopweave")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._hopweave_shipped = True
