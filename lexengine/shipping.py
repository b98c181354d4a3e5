"""Ships the package to Python workers, for clusters whose machines don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Adds the package as a zip file to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lexengine-")) / "lexengine.zip"
    with zipfile.ZipFile(to, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    _done.add(app)
