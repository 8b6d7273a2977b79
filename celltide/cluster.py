"""Making the library importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH names its folder already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_celltide_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="celltide-"), "celltide.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "celltide").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(path)
    sc._celltide_shipped = True
