"""An addition of this library, with no counterpart elsewhere: tail events counted on a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between
from ..operators.events import THRESHOLD, tail


def tail_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Counts of tail events by company and window of their start; repeated events within the watermark count once, later ones are dropped."""
    own = events.withColumn("company", F.lower(F.trim("company"))).withColumn("start_time", F.col("start_time").cast("timestamp")).withColumn("stop_time", F.col("stop_time").cast("timestamp"))
    own = own.where("stop_time >= start_time").withWatermark("start_time", late).dropDuplicatesWithinWatermark(["company", "permit_number", "start_time", "stop_time"])
    d = minutes_between(F.col("start_time"), F.col("stop_time"))
    return own.groupBy("company", F.window("start_time", window).alias("w")).agg(F.count("*").alias("events"), F.count_if(tail(d, THRESHOLD)).alias("tail_events")).select("company", F.col("w.start").alias("start"), "events", "tail_events")
