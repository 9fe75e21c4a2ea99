"""Session settings and written tables between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(app: str = "razao", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. A cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    return os.path.join(tempfile.gettempdir(), "razao-checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, then read back.

    Loops use it between rounds: the plan stays short, each round's input is computed once, the
    size of what comes next is known to the planner, and a lost executor costs a re-read of that
    folder instead of all rounds. The table goes when it is forgotten or the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/razao-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``cut_lineage`` made and nothing reads any more."""
    for frame in frames:
        path = _WRITTEN.pop(frame, None)
        if path:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
