"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; where nothing is set a
    local session takes a temporary folder of its machine, and a cluster,
    whose executors could not read one, raises an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = os.path.join(tempfile.gettempdir(), "logweave-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; wall-clock columns become UTC instants."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each context.

    Python workers on a cluster do not have the driver's import path.
    """
    context = spark.sparkContext
    if getattr(context, "_logweave_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="logweave-")) / "logweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._logweave_shipped = True
    return spark
