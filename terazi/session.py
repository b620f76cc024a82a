"""Session set-up and the two ways a long plan is cut: a reliable checkpoint or a written table.

Both live in the folder named by ``spark.checkpoint.dir``; a machine-local folder is used only
where that setting is absent and the master is local (tests)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "terazi", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow. ``conf`` overrides single settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="terazi-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, *cluster_by: str) -> DataFrame:
    """``df`` as a table written once to the shared folder and read back; it outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/terazi-{df.sparkSession.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.repartition(*cluster_by)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` left in the shared folder for this application, once no result
    reads them any more. Returns how many there were."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/terazi-{spark.sparkContext.applicationId}-*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
