"""Session settings every operator relies on, and the shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "beaconry", cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the engine's settings; a cluster session brings its own master and only needs SETTINGS."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine, so that is an
    error instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "beaconry-checkpoints"))


class Stored:
    """A table written to the shared checkpoint folder, to be read several times or to cut lineage.

    ``df`` reads it back, so its size is known to the planner and both sides of a join
    on it start at an exchange, which adaptive execution can split. ``drop`` removes it
    once nothing reads it any more.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        ensure_checkpoint_dir(self.spark)
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a ``Stored`` table that stays."""
    return Stored(df).df


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_beaconry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "beaconry_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._beaconry_shipped = True
