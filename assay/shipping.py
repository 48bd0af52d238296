"""Send this package to Python workers that would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application, once, unless workers inherit a path that holds it."""
    root = Path(__file__).resolve().parent.parent
    inherited = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if app in _sent or root in [Path(p).resolve() for p in inherited]:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="assay-source-"), "assay.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "assay").rglob("*.py")):
            z.write(path, str(path.relative_to(root)))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
