"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """AQE with skew handling, UTC, Arrow; callers' settings win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def settled(df):
    """df computed once into the shared checkpoint folder, for loops that build on their own result."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return df.checkpoint(eager=True)


#: Most rows of a side that is sent to all executors.
SMALL = 100_000


def small(df, most: int = SMALL):
    """df marked for broadcast if it has at most `most` rows, counted no further; else as it is, for Spark's own choice."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
