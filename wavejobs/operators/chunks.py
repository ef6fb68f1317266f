"""Trajectories of any length, in chunks of time.

A window over a whole trajectory puts all its rows into one task. That is the cheapest way
where a count shows that no trajectory has more than ``WHOLE_ROWS`` rows (ten years of hourly
ones). Beyond that, windows are over a trajectory's chunk (a day), and what they need from
outside comes from a table with one row for each chunk, which is joined to the chunk's rows.
Both ways give the same rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved, small
from .trajectories import ID, TIE, TIME, valid_position

CHUNK = "_chunk"
DAY_US = 86_400_000_000
FIRST = -(2**62)  # the chunk of rows without time, which stand first
WHOLE_ROWS = 100_000
TASK_ROWS = 1_000_000  # rows of whole trajectories that a task is meant to get


def chunked(rows: DataFrame, width_us: int = DAY_US) -> DataFrame:
    return rows.withColumn(CHUNK, F.coalesce(F.floor(F.unix_micros(TIME) / width_us), F.lit(FIRST)).cast("long"))


def fits(rows: DataFrame, most: int) -> bool:
    """Whether no trajectory has more than ``most`` rows."""
    return rows.groupBy(ID).count().where(F.col("count") > most).isEmpty()


def tasks_of_whole(rows: DataFrame, most: int, task_rows: int = TASK_ROWS) -> int | None:
    """How many tasks to deal whole trajectories over, as many for each core; none where one has more than ``most`` rows."""
    longest, total = rows.groupBy(ID).count().agg(F.max("count"), F.sum("count")).first()
    if (longest or 0) > most:
        return None
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, ceil((total or 0) / (task_rows * cores)))


def group_of(rows: DataFrame) -> list[str]:
    """What a window of ``rows`` is within: the chunk, or the trajectory where it is not cut."""
    return [ID, CHUNK] if CHUNK in rows.columns else [ID]


def in_chunk(rows: DataFrame) -> Window:
    """The order of a trajectory, within its chunk; equal times by obs_index where there is one."""
    return Window.partitionBy(*group_of(rows)).orderBy(TIME, *(c for c in (TIE,) if c in rows.columns))


def with_neighbours(rows: DataFrame, columns: tuple[str, ...], *, width_us: int = DAY_US, whole_rows: int = WHOLE_ROWS, whole: bool = False) -> DataFrame:
    """``rows`` with ``_last`` and ``_next``: time and ``columns`` of the rows before and after in the trajectory, null at its ends.

    Where trajectories are cut, ``rows`` also gets its chunk, and a chunk's first and last row
    get theirs from the chunks before and after, by a table of the ends of each. ``rows`` is
    evaluated for the count and for the ends too, without its other columns. With ``whole``
    the caller has counted.
    """
    names = tuple(dict.fromkeys((TIME, *columns)))
    at = F.struct(*names)
    if whole or fits(rows, whole_rows):
        w = in_chunk(rows)
        return rows.withColumns({"_last": F.lag(at).over(w), "_next": F.lead(at).over(w)})
    rows = chunked(rows, width_us)
    by_chunk = Window.partitionBy(ID).orderBy(CHUNK)
    # One number for time and obs_index, and one aggregate for each column, so that no task sorts its rows for this.
    order = F.coalesce(F.unix_micros(TIME), F.lit(-(10**17)))
    if TIE in rows.columns:
        order = F.expr(f"cast(coalesce(unix_micros({TIME}), {-(10**17)}) as decimal(18,0)) * cast(1e19 as decimal(20,0)) + cast(coalesce({TIE}, 0) as decimal(19,0))")
    ends = rows.withColumn("_order", order).groupBy(ID, CHUNK).agg(*(f(c, "_order").alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in names))
    end = lambda n: F.struct(*(F.col(f"{n}_{c}").alias(c) for c in names))
    ends = saved(ends.select(ID, CHUNK, F.lag(end("last")).over(by_chunk).alias("_before"), F.lead(end("first")).over(by_chunk).alias("_after")), "chunk-ends")
    w = in_chunk(rows)
    near = rows.withColumns({"_last": F.lag(at).over(w), "_next": F.lead(at).over(w)}).join(small(ends, 200_000), [ID, CHUNK], "left")
    near = near.withColumns({"_last": F.coalesce("_last", "_before"), "_next": F.coalesce("_next", "_after")})
    return near.select(*rows.columns, "_last", "_next")


def prefix_starts(sizes: DataFrame, keys: list[str], size: str = "rowsize") -> DataFrame:
    """``sizes`` with ``start``: the sum of ``size`` over all rows before, in the order of ``keys``.

    Rows are sorted by ranges and written; sums run within each range, and the sums of the
    ranges, one number for each, are added up on the driver.
    """
    placed = saved(sizes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "prefix-sums")
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    total, starts = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("_range").agg(F.sum(size)).collect())):
        starts.append((part, total))
        total += n
    starts = placed.sparkSession.createDataFrame(starts, "_range long, _start long")
    before = F.sum(size).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("_inside", F.coalesce(before, F.lit(0))).join(F.broadcast(starts), "_range")
    return out.select(*sizes.columns, (F.col("_start") + F.col("_inside")).alias("start"))


def ranked(rows: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """``rows`` with ``rank``: 1 for the first one by trajectory, time and obs_index over the whole table."""
    rows = chunked(rows, width_us)
    starts = saved(prefix_starts(rows.groupBy(ID, CHUNK).agg(F.count("*").alias("rowsize")), [ID, CHUNK]).drop("rowsize"), "chunk-starts")
    local = rows.withColumn("_local", F.row_number().over(in_chunk(rows)))
    return local.join(small(starts), [ID, CHUNK]).withColumn("rank", F.col("start") + F.col("_local")).drop(CHUNK, "_local", "start")


def thinned(obs: DataFrame, step: int = 5) -> DataFrame:
    """Every ``step``-th valid row in the order of trajectory and time."""
    return ranked(valid_position(obs)).where((F.col("rank") - 1) % step == 0)


def with_still_hours(rows: DataFrame, still: Column, hours: Column) -> DataFrame:
    """``rows`` of ``with_neighbours`` with ``_hours``: the sum of ``hours`` over the run of consecutive ``still`` rows that a row is in.

    A run is known by the number of rows before it that are not still. It is summed within
    each chunk (or trajectory); for the runs that reach over a chunk's ends, their parts are added up.
    """
    w = in_chunk(rows).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(*group_of(rows), "_run")

    def runs(df: DataFrame) -> DataFrame:
        df = df.withColumns({"_still": still, "_dt": F.when(still, hours)})
        return df.withColumn("_run", F.sum((~F.col("_still")).cast("long")).over(w))

    if CHUNK not in rows.columns:
        return runs(rows).withColumn("_hours", F.sum("_dt").over(run)).select(*rows.columns, "_still", "_hours")
    needed = [c for c in (ID, TIME, TIE, CHUNK, "latitude", "longitude", "_last") if c in rows.columns]
    parts = runs(rows.select(*needed)).groupBy(ID, CHUNK, "_run").agg(F.sum("_dt").alias("dt"))
    parts = parts.groupBy(ID, CHUNK).agg(F.max("_run").alias("moves"), F.sum(F.when(F.col("_run") == 0, F.col("dt"))).alias("head"), F.max_by("dt", "_run").alias("tail"))
    before = F.sum("moves").over(Window.partitionBy(ID).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    chunks = saved(parts.withColumn("before", F.coalesce(before, F.lit(0))), "still-chunks")
    ends = F.array(F.struct(F.lit("_head").alias("end"), F.col("before").alias("run"), F.col("head").alias("dt")), F.struct(F.lit("_tail").alias("end"), (F.col("before") + F.col("moves")).alias("run"), F.when(F.col("moves") > 0, F.col("tail")).alias("dt")))
    whole = chunks.select(ID, CHUNK, "moves", F.explode(ends).alias("e")).select(ID, CHUNK, "moves", "e.*")
    whole = whole.withColumn("dt", F.sum("dt").over(Window.partitionBy(ID, "run")))
    whole = whole.groupBy(ID, CHUNK, F.col("moves").alias("_moves")).agg(*(F.max(F.when(F.col("end") == e, F.col("dt"))).alias(e) for e in ("_head", "_tail")))
    out = runs(rows).withColumn("_inside", F.sum("_dt").over(run)).join(small(saved(whole, "still-runs"), 200_000), [ID, CHUNK], "left")
    total = F.when(F.col("_run") == 0, F.col("_head")).when(F.col("_run") == F.col("_moves"), F.col("_tail")).otherwise(F.col("_inside"))
    return out.withColumn("_hours", total).select(*rows.columns, "_still", "_hours")
