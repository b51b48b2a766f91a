"""Makes the package importable for Python workers on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    Nothing is sent where PYTHONPATH already names the folder that holds it.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return
    path = Path(tempfile.mkdtemp(prefix="terragrid-")) / "terragrid_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "terragrid").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
