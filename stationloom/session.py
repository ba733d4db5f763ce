"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",     # split hot keys even at the price of a shuffle
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",   # no call-site lookup per column expression
    "spark.sql.legacy.javaCharsets": "true",   # station files come in gbk too
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "stationloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans in this package were examined under."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder used by ``DataFrame.checkpoint``.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only a local master without that
    setting gets a folder of its own, because executors on other machines could not read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        shared = tempfile.mkdtemp(prefix="stationloom-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder as Parquet and read back. Unlike a checkpoint, which goes on with the sizes
    that were estimated for its plan, a file has its own size: in a loop of joins the estimates multiply, and a product's
    digits alone would fill the driver after some turns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
