"""Trajectory archives: ragged and observation forms, and incremental merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import prefix_starts, ranked
from .trajectories import ID, TIME, filter_box

# Legacy column names and what they are called now.
LEGACY = {"variance_density": "varianceDensity", "u10": "windSpeed"}
# Columns whose items stand at the frequencies of their row.
SPECTRAL = ("varianceDensity", "frequencyBandwidth", "a1", "b1", "a2", "b2", "direction", "directionalSpread")
FREQUENCY = "frequency"


def normalise_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in LEGACY.items() if a in df.columns})


def time_limits(existing: DataFrame) -> DataFrame:
    return existing.groupBy(ID).agg(F.min(TIME).alias("old_start"), F.max(TIME).alias("old_end"))


def row_sizes(obs: DataFrame) -> DataFrame:
    return obs.groupBy(ID).agg(F.count("*").alias("rowsize"))


def outside_existing(candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of unknown trajectories, or strictly before or after what is known of theirs.

    A null time is dropped where the trajectory is known and kept where it is not.
    """
    old = limits.select(F.col(ID).alias("old_id"), "old_start", "old_end")
    known = (F.col(ID) == F.col("old_id")) & F.col("old_start").isNotNull()
    return candidates.join(old, known & (F.col(TIME).isNull() | F.col(TIME).between(F.col("old_start"), F.col("old_end"))), "left_anti")


def indexed(obs: DataFrame) -> DataFrame:
    """Rows with a new obs_index, from 0 in the order of trajectory and time."""
    obs = obs if "obs_index" in obs.columns else obs.withColumn("obs_index", F.lit(0))
    return ranked(obs).withColumn("obs_index", F.col("rank") - 1).drop("rank")


def to_ragged(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with obs_index in the order of trajectory and time, trajectories with rowsize)."""
    return indexed(obs).drop(ID), row_sizes(obs)


def to_observations(ragged: DataFrame, trajectories: DataFrame, chunk: int = 50_000) -> DataFrame:
    """Give each row its trajectory; an error if the row sizes do not add up.

    Trajectories are posted under every chunk of row numbers that they reach into, so the
    range join is an equi-join on chunks.
    """
    total = trajectories.agg(F.coalesce(F.sum("rowsize"), F.lit(0))).first()[0]
    if (n := ragged.count()) != total:
        raise ValueError(f"row sizes add up to {total}, there are {n} rows")
    spread = prefix_starts(trajectories.select(ID, "rowsize"), [ID]).where("rowsize > 0")
    spread = spread.select(ID, "start", (F.col("start") + F.col("rowsize")).alias("stop"))
    spread = spread.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk))))
    rows = ragged.withColumn("chunk", F.floor(F.col("obs_index") / chunk))
    joined = rows.join(spread, (rows["chunk"] == spread["chunk"]) & (F.col("obs_index") >= F.col("start")) & (F.col("obs_index") < F.col("stop")))
    return joined.select(ID, *ragged.columns)


def frequency_grid(*frames: DataFrame, digits: int = 9) -> list[float]:
    """The sorted union of all frequency axes; an axis has some dozens of values."""
    each = [f.select(F.explode("frequency").alias("f")).select(F.round("f", digits).alias("f")).where("f is not null").distinct() for f in frames]
    out = each[0]
    for f in each[1:]:
        out = out.union(f)
    return sorted(r.f for r in out.distinct().collect())


def on_axis(*frames: DataFrame, axis: str = FREQUENCY) -> tuple[str, ...]:
    """The array columns that lie on ``axis``.

    A column's metadata may list its ``dimensions``; it is on the axis if they hold it. A
    column without that is on it by its name (``SPECTRAL``). Frames that state different
    dimensions for one column are an error.
    """
    stated: dict[str, bool] = {}
    arrays: dict[str, None] = {}
    for f in frames:
        for field in f.schema.fields:
            if field.dataType.typeName() != "array" or field.name == axis:
                continue
            arrays[field.name] = None
            if "dimensions" in field.metadata:
                lies = axis in field.metadata["dimensions"]
                if stated.setdefault(field.name, lies) != lies:
                    raise ValueError(f"{field.name} has different dimensions in different inputs")
    return tuple(c for c in arrays if stated.get(c, c in SPECTRAL))


def aligned(df: DataFrame, grid: list[float], columns: tuple[str, ...] = ("varianceDensity",), digits: int = 9) -> DataFrame:
    """Arrays of ``columns`` on the union grid, null where a row has no such frequency; absent columns are passed over.

    All other columns, arrays too, stay as they are. An array that is not as long as its
    row's axis (or has none) has no place on the grid, which is an error, not a cut.
    """
    axis = F.array(*map(F.lit, grid))
    place = F.transform(FREQUENCY, lambda f: F.round(f, digits))

    def placed(c: str) -> Column:
        at = lambda f: F.get(F.col(c), (F.array_position(place, f) - 1).cast("int"))
        found = F.transform(axis, lambda f: F.when(F.array_contains(place, f), at(f)))
        unlike = F.raise_error(F.concat(F.lit(f"{c} has "), F.size(c), F.lit(" items at "), F.coalesce(F.size(FREQUENCY), F.lit(0)), F.lit(" frequencies")))
        n = F.coalesce(F.when(F.col(FREQUENCY).isNotNull(), F.size(FREQUENCY)), F.lit(0))
        return F.when(F.size(c) != n, unlike).when(F.col(FREQUENCY).isNotNull(), found)

    new = {c: F.when(F.col(c).isNotNull(), placed(c)) for c in columns if c in df.columns}
    return df.withColumns({**new, FREQUENCY: F.when(F.col(FREQUENCY).isNotNull(), axis)})


def arrivals(existing: DataFrame, bulk: DataFrame, spectral: DataFrame, *, dedupe_new: bool = False, **box: float) -> DataFrame:
    """The new rows that lie in the box and outside what is known of their trajectory.

    With ``dedupe_new`` one row of each trajectory and time stays: of bulk before spectral
    ones, then the first by obs_index.
    """
    limits = time_limits(existing)
    new = [outside_existing(filter_box(df, **box), limits) for df in (bulk, spectral)]
    fresh = new[0].withColumn("_source", F.lit(0)).unionByName(new[1].withColumn("_source", F.lit(1)), allowMissingColumns=True)
    if dedupe_new:
        order = [F.col(c) for c in ("_source", "obs_index") if c in fresh.columns]
        nth = F.row_number().over(Window.partitionBy(ID, TIME).orderBy(*order))
        fresh = fresh.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return fresh.drop("_source")


def merge(existing: DataFrame, bulk: DataFrame, spectral: DataFrame, *, dedupe_new: bool = False, **box: float) -> DataFrame:
    """Existing rows and ``arrivals``.

    Array columns that lie on the frequency axis (``on_axis``) are put on the union of the
    axes; all others stay as they are.
    """
    existing, bulk, spectral = map(normalise_names, (existing, bulk, spectral))
    fresh = arrivals(existing, bulk, spectral, dedupe_new=dedupe_new, **box)
    out = existing.unionByName(fresh, allowMissingColumns=True)
    if FREQUENCY in out.columns:
        grid = frequency_grid(*(d for d in (existing, bulk, spectral) if FREQUENCY in d.columns))
        out = aligned(out, grid, on_axis(existing, bulk, spectral))
    return out


def spectral_lengths(obs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column_name, n_lengths, shortest, longest, n_unlike_frequency) of every array column."""
    rows = obs.select(F.size("frequency").alias("n"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.size(c).alias("size")) for c in columns))).alias("s"))
    return rows.groupBy("s.column_name").agg(
        F.countDistinct("s.size").alias("n_lengths"), F.min("s.size").alias("shortest"), F.max("s.size").alias("longest"),
        F.count_if(F.col("s.size") != F.col("n")).alias("n_unlike_frequency"),
    )


def validate_spectral_lengths(obs: DataFrame, columns: tuple[str, ...]) -> None:
    bad = spectral_lengths(obs, columns).where("n_lengths > 1 or n_unlike_frequency > 0").orderBy("column_name").collect()
    if bad:
        raise ValueError("arrays of unlike lengths: " + ", ".join(f"{r.column_name} {r.shortest}..{r.longest}" for r in bad))
