"""Send this package to the executors, for sessions that were started without it on their Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a Spark application: a zip of the package's sources by addPyFile."""
    try:
        context = spark.sparkContext
    except Exception:  # noqa: BLE001  a remote session: its artifacts are the caller's
        return
    if context.applicationId in _sent:
        return
    root = Path(__file__).parent
    handle, name = tempfile.mkstemp(prefix="lodestrata-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(name)
    _sent.add(context.applicationId)
