"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "vellumspark", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; the cluster's own come first."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir; only on one machine, where that is unset, a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vellumspark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application, so Python tasks can import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="vellumspark-"), "vellumspark-sources.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
