"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ``partitions`` shuffle partitions."""
    b = SparkSession.builder.master(master).appName("textloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    return b.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as a zip file, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="textloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path(here.name) / p.relative_to(here)))
    atexit.register(Path(name).unlink, missing_ok=True)  # the driver serves it until then
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: under ``spark.checkpoint.dir``; a temporary one if that is
    unset, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"
