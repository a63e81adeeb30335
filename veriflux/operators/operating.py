"""Operating metrics of a risk programme, over records of risks and of intake signals.

A risk record has cell, owner, acknowledged, evidenced, created, decided, closed,
reopened, severity, mitigation_status, next_review, reviewed, first_signal: names
as text, flags as booleans, days as dates. Rates are null where there is nothing
to divide by. Dates stand against `as_of`, never against today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import as_of

HIGH = ["high", "critical"]
#: Days in one range of the as-of join.
DAYS = 32


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(F.count_if(part), F.count_if(whole))


def risk_metrics(records: DataFrame, taxonomy_cells: int, as_of: str, *by: str) -> DataFrame:
    """Coverage, ownership, decision latency, closure and reopening, freshness and lead time, one row for each group.

    Days are few distinct numbers, so exact percentiles stay small.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    owned = (F.coalesce(F.trim("owner"), F.lit("")) != "") & true("acknowledged")
    open_, high = ~true("closed"), F.col("severity").isin(HIGH)
    latency, lead = F.datediff("decided", "created"), F.datediff("created", "first_signal")
    fresh = high & F.coalesce(F.col("reviewed") <= F.col("next_review"), F.lit(False))
    return records.groupBy(*by).agg(
        F.count("*").alias("n_risks"), (F.count_distinct(F.when(owned & true("evidenced"), F.col("cell"))) / F.lit(taxonomy_cells)).alias("coverage"), share(open_ & owned, open_).alias("ownership"),
        F.percentile(latency, F.lit(0.5)).alias("median_latency"), F.percentile(latency, F.lit(0.9)).alias("p90_latency"), F.max(F.when(open_ & high, F.datediff(F.lit(as_of).cast("date"), "created"))).alias("oldest_open_high"),
        share(true("closed"), F.lit(True)).alias("closure_rate"), share(true("closed") & true("reopened"), true("closed")).alias("reopen_rate"), share(fresh, high).alias("freshness"),
        F.percentile(lead, F.lit(0.5)).alias("median_lead"), F.count(lead).alias("n_dated_signals"),
    )


def with_first_signal(records: DataFrame, signals: DataFrame) -> DataFrame:
    """records, with `first_signal`: the day of the nearest signal(cell, received) on its cell that came no later than the record."""
    day = lambda c: F.unix_date(F.col(c)).cast("long").alias("day__")
    known = signals.select("cell", day("received"), F.col("received").alias("first_signal"))
    dated = records.drop("first_signal").withColumn("day__", day("created"))
    return as_of(dated, known, ["cell"], "day__", ["first_signal"], width=DAYS).drop("day__")


def mitigation_distribution(records: DataFrame) -> DataFrame:
    """Open risks by mitigation status."""
    return records.where(~F.coalesce("closed", F.lit(False))).groupBy(F.coalesce("mitigation_status", F.lit("none")).alias("mitigation_status")).agg(F.count("*").alias("n"))


def signal_conversion(signals: DataFrame, sla_days: int, *by: str) -> DataFrame:
    """Of signals(received, triaged, material, traced, dismissed): triaged in time, and material ones that became traces."""
    in_time = F.coalesce(F.datediff("triaged", "received") <= sla_days, F.lit(False))
    return signals.groupBy(*by).agg(F.count("*").alias("n_signals"), share(in_time, F.lit(True)).alias("triaged_in_time"), share(F.col("material") & F.col("traced"), F.col("material")).alias("conversion"), F.count_if("dismissed").alias("n_dismissed"))
