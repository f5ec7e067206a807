"""Session, tables and the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def get_spark(app: str = "weftline", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings that the engine is tested with; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"  # on the driver; Spark serves it from there
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "weftline").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the way by which queries begin."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, on a local master only, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared folder, which later plans read, only the columns that they need, and a lost executor
    costs no rerun."""
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses, with its scheme, so that tasks reach it without Spark too. All of an application's
    paths stand in one folder, which is deleted when the driver ends."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/weftline-{spark.sparkContext.applicationId}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = files.makeQualified(root)
    if files.mkdirs(root):
        files.deleteOnExit(root)
    return re.sub("^file:/+", "file:///", f"{root.toString()}/{what}-{uuid.uuid4().hex}")
