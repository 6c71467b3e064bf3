"""Makes this package importable in Python workers, whatever folder the driver was started in."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_KEY = "tessera.shipped"


def ensure_shipped(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless PYTHONPATH already leads to it."""
    sc = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get(_KEY, None) == sc.applicationId:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-zip-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(path)
    spark.conf.set(_KEY, sc.applicationId)
