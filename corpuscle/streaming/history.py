"""Append-only run logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.sources.history import HISTORY


def stream_history(spark: SparkSession, path: str) -> DataFrame:
    """The log's folder as a stream of runs with an event time ``at``."""
    runs = spark.readStream.schema(HISTORY).json(path).filter("site IS NOT NULL")
    return runs.withColumn("at", F.timestamp_seconds("created_at"))


def latest_scores(runs: DataFrame) -> DataFrame:
    """``site, at, overall`` of each site's newest run so far; state holds one row for each site."""
    return runs.groupBy("site").agg(F.max(F.struct("at", "overall")).alias("m")).select("site", "m.at", "m.overall")


def hourly_runs(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """``site, hour, runs``: runs by site and hour; state of an hour goes once it is ``late`` past."""
    return runs.withWatermark("at", late).groupBy("site", F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("runs")).select("site", F.col("w.start").alias("hour"), "runs")


def watch_regressions(runs: DataFrame, least: float, report: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's runs whose overall score is below ``least`` to ``report``; stops when all that is there is read."""
    return runs.filter(F.col("overall") < least).writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
