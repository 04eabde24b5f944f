"""Session settings and staged tables.

Iterative operators cut their lineage by writing a table into the folder that the
cluster shares (``spark.checkpoint.dir``). Nothing here uses executor-local
checkpoints, so the loss of an executor never loses a stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "kelindan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults, overridden by ``conf`` (full keys, passed as ``**{...}``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: the session's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; a cluster
    without the setting is refused, for its executors share no local folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kelindan-")
        sc.setCheckpointDir(named)
    return f"{named.rstrip('/')}/kelindan-{sc.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there.

    The files go when the application ends, or earlier through ``unstage``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        df._staged_path = None
