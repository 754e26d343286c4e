"""Session settings, and the two places where a plan is cut: reliable checkpoints and one-row scalars."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "activity_engine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume. A cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="activity-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor never changes or repeats what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder. For rounds that join a result with itself: a checkpoint keeps the
    planner's guess of its size, which such joins multiply round by round until planning never ends; files have a size."""
    ensure_checkpoint_dir(df.sparkSession)
    where = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` cut from its lineage, marked for broadcast only if it was counted and has at most ``rows`` rows. With more its joins
    shuffle and sort both sides: neither is broadcast for the few bytes that equal rows take in a compressed shuffle."""
    held = durable(df)
    return F.broadcast(held) if held.count() <= rows else held.hint("merge")
