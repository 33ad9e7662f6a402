"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of its own gets; a session of the caller's is left as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "skewline", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. ``settings``: names with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, for this application: below ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster executors would write where no reader can look,
    so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skewline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/skewline-{context.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts the lineage as a checkpoint does: a lost executor costs no recomputation. Parquet keeps the columns
    compressed, so this takes a fraction of a checkpoint's disk. The optimizer then knows its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Deletes what ``written`` left for this application; results that still read it can't be computed afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
