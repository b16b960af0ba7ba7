"""Sends the package's source to the executors for Python workers that import it: all of it that is installed."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each context. The archive lies on the driver, which serves it, and goes when the driver's process ends."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_core", False):
        return
    root = Path(__file__).resolve().parent.parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    where = os.path.join(folder, f"loomspark_{uuid.uuid4().hex[:8]}.zip")
    Path(where).write_bytes(blob.getvalue())
    sc.addPyFile(where)
    sc._loomspark_core = True
