"""Makes this package importable by Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, unless their path has it already."""
    root = os.path.dirname(PACKAGE)
    on_path = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (spark.sparkContext.master.startswith("local[") and os.getcwd() == root)
    app = spark.sparkContext.applicationId
    if on_path or app in _DONE:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="nothi-package-"), "nothi.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, root))
    spark.sparkContext.addPyFile(out)
    _DONE.add(app)
