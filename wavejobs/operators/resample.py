"""Hourly resampling of trajectories, by the row before and after each hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import shortest_turn, wrap_longitude
from .chunks import with_neighbours
from .trajectories import ID, TIME, first_per_time

HOUR = "interval 1 hour"


def hourly(obs: DataFrame, *, longitude: str = "nearest", values: tuple[str, ...] = ("significantWaveHeight", "peakPeriod"), max_gap_hours: float | None = None, whole: bool = False) -> DataFrame:
    """Rows of each trajectory on full hours between its first and last sample.

    An hour that meets a sample takes it as it is; else latitude and values are linear
    between the samples before and after (null if either is), and longitude is that of
    the nearer sample, the earlier one in a tie (``nearest``), or linear the short way
    round (``linear_wrapped``, after duplicate times are removed). ``max_gap_hours``
    leaves out hours between samples further apart. ``whole`` as in ``with_neighbours``.
    """
    if longitude not in ("nearest", "linear_wrapped"):
        raise ValueError(longitude)
    rows = first_per_time(obs) if longitude == "linear_wrapped" else obs
    values = tuple(values)
    for c in values:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    ahead = ("latitude", "longitude", *values)
    rows = with_neighbours(rows, ahead, whole=whole).select(ID, TIME, *ahead, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in (TIME, *ahead)))
    first = F.date_trunc("hour", TIME)
    first = F.when(first == F.col(TIME), first).otherwise(first + F.expr(HOUR))
    last = F.date_trunc("hour", F.col("next_time") - F.expr("interval 1 microsecond"))
    last = F.when(F.col("next_time").isNull(), F.col(TIME)).otherwise(last)
    if max_gap_hours is not None:
        near = F.col("next_time") - F.col(TIME) <= F.make_dt_interval(secs=F.lit(max_gap_hours * 3600))
        last = F.when(near | F.col("next_time").isNull(), last).otherwise(F.col(TIME))
    rows = rows.withColumn("first", first).withColumn("last", last).where("first <= last")
    rows = rows.withColumn("hour", F.explode(F.sequence("first", "last", F.expr(HOUR))))
    exact = F.col("hour") == F.col(TIME)
    micros = lambda c: F.unix_micros(F.col(c))
    rows = rows.withColumn("f", F.when(~exact, (micros("hour") - micros(TIME)) / (micros("next_time") - micros(TIME))))

    def between(c: str) -> Column:
        return F.when(exact, F.col(c)).otherwise(F.col(c) + F.col("f") * (F.col(f"next_{c}") - F.col(c)))

    if longitude == "nearest":
        lon = F.when(exact | (F.col("f") <= 0.5), F.col("longitude")).otherwise(F.col("next_longitude"))
    else:
        lon = wrap_longitude(F.col("longitude") + F.when(exact, 0.0).otherwise(F.col("f") * shortest_turn(F.col("longitude"), F.col("next_longitude"))))
    return rows.select(ID, F.col("hour").alias(TIME), between("latitude").alias("latitude"), lon.alias("longitude"), *(between(c).alias(c) for c in values))
