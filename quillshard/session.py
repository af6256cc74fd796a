"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str, shuffle_partitions: int, app_name: str = "quillshard") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter configures its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, only a local-mode session may fall back to a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_scratch()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="quillshard-")


_shipped: set[str] = set()


def ship_packages(spark: SparkSession) -> None:
    """Give Python workers the packages of this folder, wherever the driver program was started.

    Spark serves the archive to its executors; the folder it is made in is the driver's own.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(__file__).resolve().parents[1]
    stage = Path(tempfile.mkdtemp(prefix="quillshard-ship-"))
    for package in ("quillshard", "catalog"):
        if (root / package).is_dir():
            shutil.copytree(root / package, stage / "src" / package, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(stage / "packages"), "zip", stage / "src"))
