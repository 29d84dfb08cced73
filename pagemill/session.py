"""Session helpers: shipping the package to executors and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_checked: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, through Spark's own file server.

    The archive is read only by the driver, which serves it to every executor, those added later included.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagemill-")) / "pagemill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder for checkpoints that the session names in ``spark.checkpoint.dir``.

    Where it names none and Spark runs in this one process, ``fallback`` is set. On a cluster nothing is: a folder of one
    machine is no checkpoint, and Spark says at the first one that none is set. A folder once set stays.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    chosen = shared or (fallback if re.fullmatch(r"local(\[.*\])?", context.master) else None)
    if context.applicationId not in _checked and context.getCheckpointDir() is None and chosen:
        context.setCheckpointDir(chosen)
    _checked.add(context.applicationId)
    return chosen
