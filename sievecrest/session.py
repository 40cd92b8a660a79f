"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievecrest", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session it hands out."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_MADE: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset and everything runs in one process (tests, benches) a temporary folder
    takes its place; on a cluster a machine's own folder would be incomplete for all others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sievecrest-ckpt-"))
    return os.path.dirname(context.getCheckpointDir().rstrip("/"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder below the shared checkpoint folder."""
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder made so far; call it when no table built on them is needed any more."""
    deleted = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        deleted += path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return deleted


def cut_lineage(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write once to the shared checkpoint folder as Parquet, with the writer's ``options``, and read it back.

    Survives executor loss, keeps plans from growing round by round, and gives the several readers
    of a reduced table column pruning and real size statistics instead of a recomputation each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
