"""Makes this package importable by Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED = "_tickloom_shipped"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per context, unless their PYTHONPATH has it."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False) or any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    archive = Path(tempfile.mkdtemp(prefix="tickloom-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((ROOT / "tickloom").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)
