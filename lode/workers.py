"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to all workers, once an application.

    Nothing is sent where PYTHONPATH names the package's folder, or where it is installed: workers
    then import it as the driver does.
    """
    root, sc = _PACKAGE.parent, spark.sparkContext
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if sc.applicationId in _sent or str(root) in named or root.name in ("site-packages", "dist-packages"):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lode-")), "lode_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
