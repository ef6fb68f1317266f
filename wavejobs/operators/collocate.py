"""Collocation of observations with gridded models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import saved, small
from .trajectories import ID, TIME

# Model name, its variables and the observed columns that they are compared with.
MODELS = {
    "era5": {"swh": "significantWaveHeight", "pp1d": "peakPeriod"},
    "gfs": {"Thgt": "significantWaveHeight", "Tper": "peakPeriod"},
}


def nearest_time(times: DataFrame, model_times: DataFrame, tolerance_s: float | None = None) -> DataFrame:
    """(time, model_time) for every distinct time; ties go to the later model time.

    Both sides are reduced to distinct times and sorted together: running windows give the
    model time before and after each time, in daily parts that carry the ends over, so no
    range join and no broadcast is needed. With a tolerance (inclusive) others drop out.
    """
    a = times.select(F.col(TIME).alias("t")).where("t is not null").distinct().withColumn("m", F.lit(None).cast("timestamp"))
    b = model_times.select(F.col(TIME).alias("t")).where("t is not null").distinct().withColumn("m", F.col("t"))
    day = F.to_date("t")
    ends = b.groupBy(day.alias("d")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    days = a.select(day.alias("d")).union(b.select(day.alias("d"))).distinct().join(ends, "d", "left")
    by_day = Window.orderBy("d")  # one row a day
    days = days.select(
        "d",
        F.last("last", True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("before_day"),
        F.first("first", True).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("after_day"),
    )
    rows = a.union(b).withColumn("d", day).join(days, "d")
    w = Window.partitionBy("d").orderBy("t")
    before = F.coalesce(F.last("m", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.col("before_day"))
    after = F.coalesce(F.first("m", True).over(w.rangeBetween(0, Window.unboundedFollowing)), F.col("after_day"))
    rows = rows.select("t", "m", before.alias("lo"), after.alias("hi")).where("m is null")
    gap = lambda x, y: F.unix_micros(y) - F.unix_micros(x)
    later = F.col("lo").isNull() | (gap(F.col("t"), F.col("hi")) <= gap(F.col("lo"), F.col("t")))
    found = rows.select(F.col("t").alias(TIME), F.when(F.col("hi").isNotNull() & later, F.col("hi")).otherwise(F.col("lo")).alias("model_time")).where("model_time is not null")
    if tolerance_s is not None:
        found = found.where(F.abs(gap(F.col(TIME), F.col("model_time"))) <= int(tolerance_s * 1e6))
    return found


def intervals(spark: SparkSession, axis: list[float], name: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """(cell, number, lo, hi) of neighbouring values of an axis, and the cell of a column's value.

    Cells are as wide as the mean interval, and an interval stands under every cell that it
    reaches into (together at most twice as many rows as values), so that values find
    theirs by an equi-join. The last value is an interval of its own.
    """
    x = sorted(axis)
    first, width = (x[0], (x[-1] - x[0]) / (len(x) - 1)) if len(x) > 1 else (x[0] if x else 0.0, 1.0)
    at = lambda v: floor((v - first) / width)
    rows = [(cell, k, lo, hi) for k, (lo, hi) in enumerate(zip(x, [*x[1:], None])) for cell in range(at(lo), at(lo if hi is None else hi) + 1)]
    df = spark.createDataFrame(rows, f"{name}_cell long, {name} long, {name}_lo double, {name}_hi double")
    return df, lambda c: F.floor((F.col(c) - first) / width)


CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
CELL = ["model_time", "la", "lo"]
PLACED = ["la", "lo", "la_f", "lo_f"]


@dataclass(frozen=True)
class Axes:
    """The latitudes and longitudes of a grid: some thousand values, whatever the number of times."""

    latitude: list[float]
    longitude: list[float]

    @classmethod
    def of(cls, grid: DataFrame) -> Axes:
        both = grid.agg(F.collect_set("latitude"), F.collect_set("longitude")).first()
        return cls(*(sorted(x) for x in both))

    def numbered(self, grid: DataFrame) -> DataFrame:
        """``grid`` with ``la`` and ``lo``, the numbers of its rows' latitude and longitude on the axes."""
        for c, x in (("latitude", "la"), ("longitude", "lo")):
            side = grid.sparkSession.createDataFrame(list(enumerate(getattr(self, c))), f"{x} long, {c} double")
            grid = grid.join(F.broadcast(side), c)
        return grid

    def located(self, rows: DataFrame, most: int = 200_000) -> DataFrame:
        """``rows`` with the cell that holds them (``la``, ``lo``: its lower corner) and how far in they lie (``la_f``, ``lo_f``); null outside the grid.

        A value on the last latitude or longitude is in a cell of no width.
        """
        for c, x in (("latitude", "la"), ("longitude", "lo")):
            values = getattr(self, c)
            side, cell = intervals(rows.sparkSession, values, x)
            low, high = F.col(f"{x}_lo"), F.col(f"{x}_hi")
            inside = (cell(c) == F.col(f"{x}_cell")) & (F.col(c) >= low) & ((F.col(c) < high) | (high.isNull() & (F.col(c) == low)))
            rows = rows.join(F.broadcast(side) if len(values) <= most else side, inside, "left")
            f = F.when(high.isNull(), 0.0).otherwise((F.col(c) - low) / (high - low))
            rows = rows.withColumn(f"{x}_f", F.when(low.isNotNull(), f)).drop(f"{x}_cell", f"{x}_lo", f"{x}_hi")
        return rows


def tiles(grid: DataFrame, axes: Axes, variables: list[str], asked: DataFrame) -> DataFrame:
    """(model_time, la, lo, <variable>_<a><b>): one row for each of the ``asked`` cells and times, with the values at its four corners.

    Each cell asks for its corners, so only the rows of the grid that are one are kept; they
    meet in one hash join, and are put together by cell. Of repeated rows of a grid the
    largest value counts; a corner that the grid lacks is null.
    """
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CORNERS)))
    corners = saved(asked.select(*CELL, corner.alias("c")).select(*CELL, "c.*", (F.col("la") + F.col("c.a")).alias("at_la"), (F.col("lo") + F.col("c.b")).alias("at_lo")), "grid-corners")
    nodes = axes.numbered(grid.select(F.col(TIME).alias("model_time"), "latitude", "longitude", *variables))
    nodes = nodes.select("model_time", F.col("la").alias("at_la"), F.col("lo").alias("at_lo"), *variables)
    met = nodes.join(small(corners), ["model_time", "at_la", "at_lo"])
    values = [F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(v))).alias(f"{v}_{a}{b}") for v in variables for a, b in CORNERS]
    return met.groupBy(*CELL).agg(*values)


def interpolated(rows: DataFrame, grid: DataFrame, variables: dict[str, str], places: DataFrame | None = None) -> DataFrame:
    """``rows(latitude, longitude, model_time, …)`` with each variable under its new name, linear in both directions.

    ``places``, by default ``rows``, is a written table with the same places and times, from
    which the cells are asked for. Values are null outside the grid, without a place or model time, or with a null corner of non-zero
    weight. A row meets the tile of its cell in one join and keeps its other columns.
    """
    axes = Axes.of(grid)
    asked = axes.located((rows if places is None else places).select("latitude", "longitude", "model_time"))
    return at_cells(axes.located(rows), asked, grid, axes, variables).select(*rows.columns, *variables.values(), "in_grid")


def at_cells(located: DataFrame, asked: DataFrame, grid: DataFrame, axes: Axes, variables: dict[str, str]) -> DataFrame:
    """``interpolated`` for rows, and ``asked`` ones, whose cells are known (``Axes.located``)."""
    inside = F.col("model_time").isNotNull() & F.col("la").isNotNull() & F.col("lo").isNotNull()
    asked = saved(asked.where(inside).select(*CELL).distinct(), "grid-cells")
    made = saved(tiles(grid, axes, list(variables), asked), "grid-tiles")
    # Rows without a cell are dealt by a number of their own, below all cells.
    nowhere = -1 - F.pmod(F.xxhash64(*located.columns), F.lit(65_536))
    keyed = located.withColumns({"la": F.when(inside, F.col("la")).otherwise(nowhere), "lo": F.coalesce("lo", F.lit(-1))})
    met = keyed.join(small(made, 200_000), CELL, "left")
    weight = [[1 - F.col(f"{x}_f"), F.col(f"{x}_f")] for x in ("la", "lo")]

    def value(v: str) -> Column:
        parts = []
        for a, b in CORNERS:
            w = weight[0][a] * weight[1][b]
            parts.append(F.when(w > 0, w * F.col(f"{v}_{a}{b}")).otherwise(0.0))
        return F.when(F.col("la") >= 0, reduce(lambda x, y: x + y, parts))

    return met.select(*located.columns, *(value(v).alias(name) for v, name in variables.items()), (F.col("la") >= 0).alias("in_grid"))


def bilinear(points: DataFrame, grid: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and each variable at (latitude, longitude) of those ``points`` that lie in the grid and have a model_time."""
    out = interpolated(saved(points.select(*dict.fromkeys([*keys, "latitude", "longitude", "model_time"])), "points"), grid, {v: v for v in variables})
    return out.where("in_grid").select(*keys, *variables)


def model_errors(hourly: DataFrame, grids: dict[str, DataFrame]) -> DataFrame:
    """``model_value_*`` and ``error_*`` (model less observed) of every model and variable.

    The hourly rows are written once, with their cells on every distinct pair of axes, so that
    models on the same places find them once; each model adds its columns to them where they are.
    """
    for model, grid in grids.items():
        if model not in MODELS:
            raise ValueError(f"unknown model {model}")
        if missing := [v for v in MODELS[model] if v not in grid.columns]:
            raise ValueError(f"{model} lacks {missing}")
    columns = hourly.columns
    of_model, axes = {}, []
    for model, grid in grids.items():
        own = Axes.of(grid)
        if own not in axes:
            hourly = own.located(hourly).withColumnsRenamed({c: f"_{c}_{len(axes)}" for c in PLACED})
            axes.append(own)
        of_model[model] = axes.index(own)
    hourly = base = saved(hourly, "hourly")
    for model, grid in grids.items():
        wanted, k = MODELS[model], of_model[model]
        when = small(saved(nearest_time(base, grid), "model-times"))
        names = {v: f"model_value_{model}_{v}" for v in wanted}
        cells = {f"_{c}_{k}": c for c in PLACED}
        asked = base.join(when, TIME).withColumnsRenamed(cells)
        # The written cells stay beside the copies that this model works on.
        rows = hourly.join(when, TIME, "left").withColumns({c: F.col(own) for own, c in cells.items()})
        hourly = at_cells(rows, asked, grid, axes[k], names).drop(*PLACED, "model_time", "in_grid")
        hourly = hourly.withColumns({f"error_{model}_{v}": F.col(names[v]) - F.col(c) for v, c in wanted.items()})
        columns = [*columns, *names.values(), *(f"error_{model}_{v}" for v in wanted)]
    return hourly.select(*columns)


def union_grids(grids: list[DataFrame]) -> DataFrame:
    """Yearly sets of one model as one grid."""
    return reduce(lambda a, b: a.unionByName(b), grids)
