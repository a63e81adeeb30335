"""The row-level detectors on streams.

Scoring and signatures need no state, so the batch operators run unchanged on a
streaming DataFrame. Counts by window keep state only within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitor, network


def scored(events: DataFrame) -> DataFrame:
    """Flat events (ts and the telemetry fields) with score and route."""
    e = F.struct(*[F.col(c) for c in ("signature_hit", "entropy", "top_choice_margin", "sample_disagreement", "model_disagreement", "external_side_effect", "red_team_generated")])
    s = events.withColumn("score", network.event_score(e))
    return s.withColumn("route", network.route(F.col("score")))


def route_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of routes by window; rows later than `late` are dropped with their state."""
    w = scored(events.withWatermark("ts", late)).groupBy(F.window("ts", window).alias("w"), "route").agg(F.count("*").alias("n"), F.max("score").alias("max_score"))
    return w.select(F.col("w.start").alias("start"), "route", "n", "max_score")


def signature_events(sessions: DataFrame) -> DataFrame:
    return monitor.monitor_events(sessions)
