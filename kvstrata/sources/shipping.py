"""What executors share with the driver: the package, and a folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
_own: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """On one machine workers get this package's folder as a path; on a cluster the executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if is_local(spark):
        paths = [str(_ROOT), *filter(None, context.environment.get("PYTHONPATH", "").split(os.pathsep))]
        context.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
        return
    folder = tempfile.mkdtemp(prefix="kvstrata-")  # the driver's own, which it serves files from
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "kvstrata.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (_ROOT / "kvstrata").rglob("*.py"):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only on one machine, and where that is unset (as in tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _own:
            folder = tempfile.mkdtemp(prefix="kvstrata-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[spark.sparkContext.applicationId] = Path(folder).as_uri()
        found = _own[spark.sparkContext.applicationId]
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, at: str):
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that goes when the application ends."""
    at = f"{shared_dir(spark)}/kvstrata/{name}-{uuid.uuid4().hex[:12]}"
    path, files = hadoop_path(spark, at)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at
