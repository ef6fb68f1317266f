"""Filters and summaries of trajectories of observations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID, TIME, TIE = "trajectory_id", "time", "obs_index"


def in_box(lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Column:
    """All bounds inclusive; a null position is outside."""
    return F.col("latitude").between(lat_min, lat_max) & F.col("longitude").between(lon_min, lon_max)


def filter_box(obs: DataFrame, **box: float) -> DataFrame:
    return obs.where(in_box(**box))


def padded(obs: DataFrame, start: datetime, end: datetime, pad_minutes: int = 30, **box: float) -> DataFrame:
    pad = timedelta(minutes=pad_minutes)
    return obs.where(F.col(TIME).between(F.lit(start - pad), F.lit(end + pad)) & in_box(**box))


def subset(obs: DataFrame, start: datetime, end: datetime, pad_minutes: int = 30, **box: float) -> DataFrame:
    """Rows in the padded period and box, of trajectories with more than one such row."""
    rows = padded(obs, start, end, pad_minutes, **box)
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(ID))).where("n > 1").drop("n")


def sparse(obs: DataFrame, start: datetime, end: datetime, pad_minutes: int = 30, **box: float) -> DataFrame:
    """The trajectories that ``subset`` drops, with what is left of them."""
    rows = padded(obs, start, end, pad_minutes, **box).groupBy(ID)
    return rows.agg(
        F.count("*").alias("n"),
        *(f(c).alias(f"{c}_{n}") for c in ("longitude", "latitude") for n, f in (("min", F.min), ("max", F.max))),
    ).where("n = 1")


def subset_time(df: DataFrame, start: datetime | None = None, end: datetime | None = None, *, end_inclusive_day: bool = False, time: str = TIME) -> DataFrame:
    """Both ends inclusive and optional; ``end_inclusive_day`` keeps the whole last day."""
    if time not in df.columns:
        raise ValueError(f"no column {time}")
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) < F.lit(end + timedelta(days=1)) if end_inclusive_day else F.col(time) <= F.lit(end))
    return df


def first_per_time(obs: DataFrame) -> DataFrame:
    """Rows with time and position; of rows at one time the first."""
    rows = obs.dropna(subset=[TIME, "latitude", "longitude"])
    nth = F.row_number().over(Window.partitionBy(ID, TIME).orderBy(TIE))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def valid_position(obs: DataFrame) -> DataFrame:
    return obs.where(F.col(TIME).isNotNull() & in_box(-90, 90, -180, 180))


def extent(obs: DataFrame) -> DataFrame:
    return obs.agg(
        *(f(c).alias(f"{c}_{n}") for c in ("longitude", "latitude") for n, f in (("min", F.min), ("max", F.max))),
        F.count("*").alias("n_rows"),
        F.countDistinct(ID).alias("n_trajectories"),
    )


def map_extent(obs: DataFrame, margin: float = 2.0) -> DataFrame:
    rows = valid_position(obs)
    return rows.agg(
        *((f(c) + s * margin).alias(f"{c}_{n}") for c in ("longitude", "latitude") for n, f, s in (("low", F.min, -1), ("high", F.max, 1))),
        F.avg("longitude").alias("longitude_centre"),
        F.avg("latitude").alias("latitude_centre"),
        F.min(TIME).alias("first_time"),
        F.max(TIME).alias("last_time"),
    )
