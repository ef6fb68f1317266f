"""Drift velocity from neighbouring positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import with_geodesic
from ..sources.shared import saved
from .chunks import CHUNK, with_neighbours
from .quality import FAIL, MISSING, PASS, VELOCITY_FLAG
from .trajectories import TIME


def chosen_pair(df: DataFrame, max_gap_hours: float = 3.0, *, whole: bool = False) -> DataFrame:
    """The two positions for each row's velocity: around it, else to the next, else from the last.

    Both gaps of a central pair must be in (0, max_gap]; all ends need positions. Only the
    chosen pair is kept; equal times are in the order of obs_index where there is one (``pair``: central, forward, backward or null, and its dt_s).
    ``whole`` as in ``quality.run_all``.
    """
    rows = with_neighbours(df if whole else saved(df, "drift-rows"), ("longitude", "latitude"), whole=whole).drop(CHUNK)
    rows = rows.withColumn("_here", F.struct(TIME, "longitude", "latitude"))
    limit = max_gap_hours * 3600

    def seconds(a: str, b: str):
        return (F.unix_micros(F.col(f"{b}.time")) - F.unix_micros(F.col(f"{a}.time"))) / 1e6

    def placed(x: str):
        return F.col(f"{x}.longitude").isNotNull() & F.col(f"{x}.latitude").isNotNull()

    def gap(a: str, b: str):
        return (seconds(a, b) > 0) & (seconds(a, b) <= limit)

    central = gap("_last", "_here") & gap("_here", "_next") & placed("_last") & placed("_next")
    forward = gap("_here", "_next") & placed("_here") & placed("_next")
    backward = gap("_last", "_here") & placed("_last") & placed("_here")
    rows = rows.withColumn("pair", F.when(central, "central").when(forward, "forward").when(backward, "backward"))
    start = F.when(F.col("pair") == "forward", F.col("_here")).when(F.col("pair").isNotNull(), F.col("_last"))
    end = F.when(F.col("pair") == "backward", F.col("_here")).when(F.col("pair").isNotNull(), F.col("_next"))
    rows = rows.withColumns({"_from": start, "_to": end}).drop("_here", "_last", "_next")
    return rows.withColumn("dt_s", seconds("_from", "_to"))


def velocity(df: DataFrame, *, max_gap_hours: float = 3.0, max_speed: float = 3.0, whole: bool = False) -> DataFrame:
    """u, v, speed, direction, dt, distance and a flag: 1, 4 above ``max_speed``, 9 not computed."""
    rows = chosen_pair(df, max_gap_hours, whole=whole)
    ends = (F.col(f"{end}.{c}") for end in ("_from", "_to") for c in ("longitude", "latitude"))
    rows = with_geodesic(rows, *ends, azimuth="_az", distance="_m")
    rows = rows.withColumn("_speed", F.try_divide("_m", "dt_s"))
    ok = F.col("_speed") <= max_speed
    return rows.withColumns(
        {
            "drifter_u_m_s": F.when(ok, F.col("_speed") * F.sin(F.radians("_az"))),
            "drifter_v_m_s": F.when(ok, F.col("_speed") * F.cos(F.radians("_az"))),
            "drifter_speed_m_s": F.when(ok, F.col("_speed")),
            "drifter_direction_to_deg": F.when(ok, F.pmod(F.col("_az") + 360.0, F.lit(360.0))),
            "drifter_velocity_dt_s": F.when(F.col("_m").isNotNull(), F.col("dt_s")),
            "drifter_velocity_distance_m": F.col("_m"),
            VELOCITY_FLAG: F.when(F.col("_speed").isNull(), MISSING).when(F.col("_speed") > max_speed, FAIL).otherwise(PASS),
        }
    ).drop("_from", "_to", "_az", "_m", "_speed", "dt_s", "pair")
