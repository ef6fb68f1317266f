"""QARTOD-style quality flags: 1 pass, 2 not evaluated, 3 suspect, 4 fail, 9 missing.

In every chain of conditions what decides last comes first; a null condition falls through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..sources.shared import saved
from .chunks import CHUNK, WHOLE_ROWS, with_neighbours, with_still_hours
from .trajectories import ID, TIME

PASS, NOT_EVALUATED, SUSPECT, FAIL, MISSING = 1, 2, 3, 4, 9
# Names of the codes.
MEANINGS = {PASS: "PASS", NOT_EVALUATED: "NOT_EVALUATED", SUSPECT: "SUSPECT", FAIL: "FAIL", MISSING: "MISSING"}
VELOCITY_FLAG = "drifter_velocity_qc_flag"


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds; ranges are (suspect low, suspect high, fail low, fail high)."""

    height_range: tuple[float, float, float, float] = (0.0, 15.0, 0.0, 25.0)
    period_range: tuple[float, float, float, float] = (2.0, 25.0, 1.0, 35.0)
    location: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)
    height_spike: tuple[float, float] = (2.0, 4.0)
    height_rate: tuple[float, float] = (1.5, 3.0)
    height_error: tuple[float, float] = (2.0, 4.0)
    period_error: tuple[float, float] = (4.0, 8.0)
    speed: tuple[float, float] = (1.5, 3.0)
    stuck_metres: float = 50.0
    stuck_hours: tuple[float, float] = (6.0, 12.0)


def track() -> Window:
    return Window.partitionBy(ID).orderBy(TIME)


@dataclass(frozen=True)
class Near:
    """A column's value in the row before and in the row after, of one trajectory."""

    last: Callable[[str], Column]
    next: Callable[[str], Column]


#: By a window over the whole trajectory, for tracks that one task can hold and without equal times.
BY_WINDOW = Near(lambda c: F.lag(c).over(track()), lambda c: F.lead(c).over(track()))
#: In rows of ``chunks.with_neighbours``.
CARRIED = Near(lambda c: F.col(f"_last.{c}"), lambda c: F.col(f"_next.{c}"))


def seconds_since_last(near: Near = BY_WINDOW) -> Column:
    return (F.unix_micros(TIME) - F.unix_micros(near.last(TIME))) / 1e6


def step_metres(near: Near = BY_WINDOW) -> Column:
    return haversine_m(near.last("latitude"), near.last("longitude"), F.col("latitude"), F.col("longitude"))


def gross_range(value: Column, suspect_low: float, suspect_high: float, fail_low: float, fail_high: float) -> Column:
    return F.when(value.isNull(), MISSING).when((value < fail_low) | (value > fail_high), FAIL).when((value < suspect_low) | (value > suspect_high), SUSPECT).otherwise(PASS)


def location(lat_low: float, lat_high: float, lon_low: float, lon_high: float) -> Column:
    lat, lon = F.col("latitude"), F.col("longitude")
    return F.when(lat.isNull() | lon.isNull(), MISSING).when((lat < lat_low) | (lat > lat_high) | (lon < lon_low) | (lon > lon_high), FAIL).otherwise(PASS)


def spike(column: str, suspect: float, fail: float, near: Near = BY_WINDOW) -> Column:
    v, before, after = F.col(column), near.last(column), near.next(column)
    size = F.abs(v - 0.5 * (before + after))
    return F.when(v.isNull(), MISSING).when(before.isNull() | after.isNull(), NOT_EVALUATED).when(size > fail, FAIL).when(size > suspect, SUSPECT).otherwise(PASS)


def rate_of_change(column: str, suspect: float, fail: float, near: Near = BY_WINDOW) -> Column:
    """Per hour; time that does not advance fails."""
    v, dt = F.col(column), seconds_since_last(near) / 3600
    rate = F.try_divide(F.abs(v - near.last(column)), dt)
    return F.when(v.isNull(), MISSING).when(dt.isNull(), NOT_EVALUATED).when((dt == 0) | (rate > fail), FAIL).when(rate > suspect, SUSPECT).when(dt <= 0, FAIL).otherwise(PASS)


def missing_place() -> Column:
    return F.col("latitude").isNull() | F.col("longitude").isNull() | F.col(TIME).isNull()


def drift_speed(suspect: float, fail: float, near: Near = BY_WINDOW) -> Column:
    dt = seconds_since_last(near)
    speed = F.try_divide(step_metres(near), dt)
    return F.when(missing_place(), MISSING).when(dt.isNull(), NOT_EVALUATED).when((dt == 0) | (speed > fail), FAIL).when(speed > suspect, SUSPECT).when(dt <= 0, FAIL).otherwise(PASS)


def with_stuck(df: DataFrame, name: str = "stuck_position_qc", *, metres: float = 50.0, suspect_hours: float = 6.0, fail_hours: float = 12.0, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Whole runs of steps within ``metres`` are flagged by the time they take together."""
    rows = df if "_last" in df.columns else with_neighbours(df, ("latitude", "longitude"), whole_rows=whole_rows)
    still = F.coalesce(step_metres(CARRIED) <= metres, F.lit(False))
    rows = with_still_hours(rows, still, seconds_since_last(CARRIED) / 3600)
    hours = F.round("_hours", 9)
    flag = (
        F.when(missing_place(), MISSING)
        .when(F.col("_last").isNull(), NOT_EVALUATED)
        .when(F.col("_still") & (hours >= fail_hours), FAIL)
        .when(F.col("_still") & (hours >= suspect_hours), SUSPECT)
        .otherwise(PASS)
    )
    return rows.withColumn(name, flag).select(*df.columns, name)


def model_comparison(error: Column, suspect: float, fail: float, can_fail: bool = True) -> Column:
    size = F.abs(error)
    c = F.when(error.isNull(), NOT_EVALUATED)
    c = c.when(size > fail, FAIL) if can_fail else c
    return c.when(size > suspect, SUSPECT).otherwise(PASS)


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_qc") and c != "summary_qc"]


def with_summary(df: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Missing only if all are, then fail, suspect, not evaluated only if all are, else pass."""
    cols = [F.col(c) for c in flags or flag_columns(df)]

    def every(code: int) -> Column:
        out = cols[0] == code
        for c in cols[1:]:
            out = out & (c == code)
        return out

    def any_of(code: int) -> Column:
        out = cols[0] == code
        for c in cols[1:]:
            out = out | (c == code)
        return out

    s = F.when(every(MISSING), MISSING).when(any_of(FAIL), FAIL).when(any_of(SUSPECT), SUSPECT).when(every(NOT_EVALUATED), NOT_EVALUATED).otherwise(PASS)
    return df.withColumn("summary_qc", s)


def run_all(df: DataFrame, config: QualityConfig | None = None, *, height_error: str | None = "error_era5_swh", period_error: str | None = "error_era5_pp1d", model_can_fail: bool = False, remove_failed_after: bool = False, whole: bool = False) -> DataFrame:
    """All tests and their summary; a model test whose error column is absent is left out.

    The rows are written once, as they are read for the tests, for the length of trajectories
    and, where these are cut, for the ends of chunks and the runs of still rows; with ``whole`` the
    caller has counted that no trajectory has more than ``WHOLE_ROWS`` rows, and they are read once. Equal times are in the order of obs_index where there is one.
    """
    c = config or QualityConfig()
    asked = df.columns
    df = with_neighbours(df if whole else saved(df, "quality-rows"), ("latitude", "longitude", "significantWaveHeight"), whole=whole)
    df = df.withColumns(
        {
            "location_qc": location(*c.location),
            "swh_gross_range_qc": gross_range(F.col("significantWaveHeight"), *c.height_range),
            "peak_period_gross_range_qc": gross_range(F.col("peakPeriod"), *c.period_range),
            "swh_spike_qc": spike("significantWaveHeight", *c.height_spike, CARRIED),
            "swh_rate_of_change_qc": rate_of_change("significantWaveHeight", *c.height_rate, CARRIED),
            "drifter_speed_qc": drift_speed(*c.speed, CARRIED),
        }
    )
    for column, name, limits in ((height_error, "swh_model_qc", c.height_error), (period_error, "peak_period_model_qc", c.period_error)):
        if column in df.columns:
            df = df.withColumn(name, model_comparison(F.col(column), *limits, model_can_fail))
    df = with_stuck(df, metres=c.stuck_metres, suspect_hours=c.stuck_hours[0], fail_hours=c.stuck_hours[1])
    df = with_summary(df.select(*asked, *(x for x in df.columns if x not in (*asked, CHUNK, "_last", "_next"))))
    return remove_failed(df) if remove_failed_after else df


def need(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"no column {column}: run the quality tests first")


def failed_or_suspect(df: DataFrame) -> DataFrame:
    need(df, "summary_qc")
    return df.where(F.col("summary_qc").isin(SUSPECT, FAIL))


def remove_failed(df: DataFrame, column: str = "summary_qc") -> DataFrame:
    need(df, column)
    return df.where(F.col(column) != FAIL)


def flag_counts(df: DataFrame) -> DataFrame:
    """(test, flag, meaning, count) over all flag columns and the summary."""
    flags = [*flag_columns(df), *(c for c in ("summary_qc",) if c in df.columns)]
    long = df.select(*flags).unpivot([], flags, "test", "flag")
    names = F.create_map(*(F.lit(x) for code, name in MEANINGS.items() for x in (code, name)))
    counts = long.groupBy("test", "flag").agg(F.count("*").alias("count"))
    return counts.select("test", "flag", F.coalesce(F.try_element_at(names, F.col("flag")), F.lit("UNKNOWN")).alias("meaning"), "count")
