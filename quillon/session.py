"""Session settings, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Adaptive execution re-plans joins and skewed partitions at run time; small Arrow batches bound the
#: memory of Python workers whatever the length of the texts.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_spark(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns are pruned by whatever is selected from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's `spark.checkpoint.dir`. Where that is missing, a temporary one serves a local
    session (tests); on a cluster, whose machines share no such folder, this is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quillon-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and forget how it was made, so that a lost
    executor costs no recomputation of its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, limit: int) -> bool:
    """Whether the rows of `df` take at most `limit` bytes, measured by one aggregate over them (eight bytes for anything
    but text); asked before data are sent to every worker. Inputs that the planner knows to be far larger are not read."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if 50 * limit < known < 1 << 60:
        return False
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if kind == "string" else F.lit(0)) + 8 for c, kind in df.dtypes)
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit
