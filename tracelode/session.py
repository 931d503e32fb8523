"""Session settings shared by every job in the package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", app: str = "tracelode", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings results depend on: event times are read as UTC wall clock."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: the cluster's ``spark.checkpoint.dir``; only a
    local session without one (tests) gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    global _LOCAL_FOLDER
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.mkdtemp(prefix="tracelode-")
    return _LOCAL_FOLDER


_LOCAL_FOLDER: str | None = None


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    It fixes row placement, cuts lineage and survives lost executors, costs one
    evaluation of the plan, and later reads fetch only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracelode/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
