"""Readers and writers: raw CSV trees, archives, model grids, results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import epoch_time, number, semicolon_array
from ..functions.frequency import model_direction_degrees, model_frequency
from ..operators.archive import SPECTRAL
from ..operators.collocate import MODELS
from ..operators.trajectories import ID, TIME, subset_time
from .shared import saved, small

# Raw headers and the columns that they become.
TIME_HEADER = "Epoch Time"
NUMBERS = {
    "Latitude (deg)": "latitude",
    "Longitude (deg)": "longitude",
    "Significant Wave Height (m)": "significantWaveHeight",
    "Peak Period (s)": "peakPeriod",
    "Mean Period (s)": "meanPeriod",
    "Peak Direction (deg)": "peakDirection",
    "Mean Direction (deg)": "meanDirection",
    "Peak Directional Spread (deg)": "peakDirectionalSpread",
    "Mean Directional Spread (deg)": "meanDirectionalSpread",
    "Battery Voltage (V)": "batteryVoltage",
    "Power (W)": "power",
    "Humidity (%rel)": "humidity",
    "Surface Temperature (°C)": "surfaceTemperature",
    "Partition0 Start Frequency (hz)": "partition0StartFrequency",
    "Partition0 End Frequency (hz)": "partition0EndFrequency",
    "Partition0 Significant Wave Height (m)": "partition0SignificantWaveHeight",
    "Partition0 Mean Period (s)": "partition0MeanPeriod",
    "Partition0 Mean Direction (deg)": "partition0MeanDirection",
    "Partition0 Mean Directional Spread (deg)": "partition0MeanDirectionalSpread",
    "Partition1 Start Frequency (hz)": "partition1StartFrequency",
    "Partition1 End Frequency (hz)": "partition1EndFrequency",
    "Partition1 Significant Wave Height (m)": "partition1SignificantWaveHeight",
    "Partition1 Mean Period (s)": "partition1MeanPeriod",
    "Partition1 Mean Direction (deg)": "partition1MeanDirection",
    "Partition1 Mean Directional Spread (deg)": "partition1MeanDirectionalSpread",
    "Mean Barometric Pressure (hPa)": "meanBarometricPressure",
    "Wind Speed (m/s)": "windSpeed",
    "Wind Direction (deg)": "windDirection",
}
ARRAYS = {"f": "frequency", "df": "frequencyBandwidth", "varianceDensity": "varianceDensity", "a1": "a1", "b1": "b1", "a2": "a2", "b2": "b2", "direction": "direction", "directionalSpread": "directionalSpread"}
TEXTS = {"Processing Source": "processingSource"}
# What an archive says about its columns, beside the units in the raw headers.
ATTRIBUTES = {
    ID: {"cf_role": "trajectory_id", "long_name": "trajectory identifier"},
    "rowsize": {"long_name": "number of observations for this trajectory", "sample_dimension": "index"},
    TIME: {"standard_name": "time", "long_name": "time"},
    "frequency": {"standard_name": "sea_surface_wave_frequency", "long_name": "wave frequency", "units": "Hz"},
    "frequencyBandwidth": {"long_name": "frequency bandwidth", "units": "Hz"},
    "varianceDensity": {"long_name": "wave variance density spectrum", "units": "m2 Hz-1"},
    "a1": {"long_name": "directional Fourier coefficient a1", "units": "1"},
    "b1": {"long_name": "directional Fourier coefficient b1", "units": "1"},
    "a2": {"long_name": "directional Fourier coefficient a2", "units": "1"},
    "b2": {"long_name": "directional Fourier coefficient b2", "units": "1"},
    "latitude": {"standard_name": "latitude", "units": "degrees_north"},
    "longitude": {"standard_name": "longitude", "units": "degrees_east"},
    "windSpeed": {"standard_name": "wind_speed", "units": "m s-1"},
    "meanBarometricPressure": {"long_name": "mean barometric pressure", "units": "hPa"},
}
# What an archive says about itself; titles are our own.
TABLE = {"title": "Wave buoy spectra and bulk parameters", "source": "wave buoy", "featureType": "trajectory", "cdm_data_type": "Trajectory", "Conventions": "CF-1.8"}
MERGED = {"title": "Merged wave buoy archive", "merged_from": "existing archive, bulk wave parameters, spectral wave parameters"}


def described(df: DataFrame) -> DataFrame:
    """``df`` with each known column's metadata: units, names, role and dimensions.

    What a column's metadata says already holds. Arrays on the frequency axis have the
    dimensions index and frequency, all other columns of observations the dimension index.
    """
    raw_units = {c: {"units": h[h.rindex("(") + 1 : -1]} for h, c in NUMBERS.items()}
    for field in df.schema.fields:
        c = field.name
        dimensions = ["frequency"] if c == "frequency" else ["trajectory"] if c == "rowsize" else ["index", "frequency"] if c in SPECTRAL else ["index"]
        known = {"dimensions": dimensions} | raw_units.get(c, {}) | ATTRIBUTES.get(c, {}) | field.metadata
        if known != field.metadata and (c in ATTRIBUTES or c in raw_units or c in SPECTRAL):
            df = df.withMetadata(c, known)
    return df


def parse_raw(raw: DataFrame, *, drop_missing_spectra: bool = True, header: Column | None = None) -> DataFrame:
    """Typed columns of raw text columns: known headers only, absent ones tolerated.

    ``header``, if given, is the array of the headers that a row's own file has: an array
    column that it lacks is null, one with an empty cell is an empty array.
    """
    there = lambda h, c: c if header is None else F.when(F.array_contains(header, h), c)
    if TIME_HEADER not in raw.columns:
        raise ValueError(f"no column {TIME_HEADER}")
    has = set(raw.columns)
    out = raw.select(
        *(c for c in (ID, "sourceFile") if c in has),
        epoch_time(F.col(f"`{TIME_HEADER}`")).alias(TIME),
        *(number(F.col(f"`{h}`")).alias(c) for h, c in NUMBERS.items() if h in has),
        *(there(h, semicolon_array(F.col(f"`{h}`"))).alias(c) for h, c in ARRAYS.items() if h in has),
        *(F.col(f"`{h}`").alias(c) for h, c in TEXTS.items() if h in has),
    )
    if drop_missing_spectra:
        if not {"frequency", "varianceDensity"} <= set(out.columns):
            return out.limit(0)
        out = out.where((F.size("frequency") > 0) & (F.size("varianceDensity") > 0))
    return out


def read_csv_tree(spark: SparkSession, root: str, *, drop_missing_spectra: bool = True) -> DataFrame:
    """All files ``root/Spot-*/*/*.csv``; the trajectory is the upper-cased directory.

    Headers drift between files, so every line is parsed by its own file's header. The raw
    files are read once, as lines that are written with the file they are from; a table of
    headers, one row a file, is joined to them. The driver sees which of the known headers
    occur, no file names. Cells may be quoted, without line ends; what a line has beyond its
    header is left out, what it lacks is null.
    """
    glob = f"{root.rstrip('/')}/Spot-*/*/*.csv"
    lines = spark.read.text(glob).where("trim(value) <> ''")
    lines = saved(lines.select("value", F.col("_metadata.file_path").alias("sourceFile"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")), "csv-lines")
    plain = F.split("value", ",")
    quoted = F.transform(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"')))
    cells = F.when(F.contains("value", F.lit('"')), quoted).otherwise(plain)
    heads = lines.where("at = 0").groupBy("sourceFile").agg(F.min("line").alias("first"), F.min_by("value", "line").alias("value"))
    heads = saved(heads.select("sourceFile", "first", cells.alias("header")).where(F.array_contains("header", TIME_HEADER)), "csv-headers")
    known = [TIME_HEADER, *NUMBERS, *ARRAYS, *TEXTS]
    found = {r.h for r in heads.select(F.explode("header").alias("h")).where(F.col("h").isin(known)).distinct().collect()}
    if not found:
        raise ValueError(f"no usable file under {root}")
    rows = lines.join(small(heads), "sourceFile").where("line <> first").withColumn("cells", cells)
    cell = lambda h: F.get("cells", F.array_position("header", h).cast("int") - 1)
    raw = [F.when(~cell(h).isin("-", ""), cell(h)).alias(h) for h in known if h in found]
    trajectory = F.upper(F.regexp_extract("sourceFile", r"(Spot-[^/]+)/[^/]+/[^/]+\.csv$", 1))
    rows = rows.select("sourceFile", trajectory.alias(ID), "header", *raw)
    return parse_raw(rows, drop_missing_spectra=drop_missing_spectra, header=F.col("header"))


DATE = "date"


def of_days(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows of a table that is laid out by day, from ``start``'s day to ``end``'s, by the days' folders only; ``df`` as it is if it has no such layout."""
    if DATE not in df.columns:
        return df
    for bound, keep in ((start, F.col(DATE).__ge__), (end, F.col(DATE).__le__)):
        if bound is not None:
            df = df.where(keep(F.lit(bound).cast("date")))
    return df.drop(DATE)


def write_by_day(df: DataFrame, path: str, order: list[str], *, chunk_rows: int = 0, only_touched: bool = False) -> None:
    """Folders of days, each sorted by ``order``; with ``only_touched`` the days that ``df`` does not have stay as they are."""
    dealt = df.withColumn(DATE, F.to_date(TIME)).repartitionByRange(DATE, *order).sortWithinPartitions(DATE, *order)
    writer = dealt.write.mode("overwrite").option("maxRecordsPerFile", chunk_rows).partitionBy(DATE)
    writer.option("partitionOverwriteMode", "dynamic" if only_touched else "static").parquet(path)


def read_archive(spark: SparkSession, path: str, *, start=None, end=None) -> DataFrame:
    """Observations, cut to the period (both ends inclusive) by folders of days where there are any."""
    df = of_days(spark.read.parquet(path), start, end)
    return subset_time(df, start, end) if TIME in df.columns else df


def read_grid(spark: SparkSession, paths: list[str], variables: tuple[str, ...], *, start=None, end=None, lat=(-90.0, 90.0), lon=(-180.0, 180.0)) -> DataFrame:
    """A model grid of one or more sets, cut to period and box; an error names what is missing.

    ``end`` is a day: all its hours belong to the period. Sets in folders of days
    (``write_grid``) are read for the days asked for only.
    """
    df = spark.read.parquet(*paths)
    if missing := [v for v in variables if v not in df.columns]:
        raise ValueError(f"the grid lacks {missing}")
    df = of_days(df, start, end).select(TIME, "latitude", "longitude", *variables)
    df = df.where(F.col("latitude").between(*lat) & F.col("longitude").between(*lon))
    return subset_time(df, start, end, end_inclusive_day=True)


def write_grid(grid: DataFrame, path: str, *, only_touched: bool = False) -> None:
    """A model grid in folders of days; with ``only_touched`` other days stay."""
    write_by_day(grid, path, [TIME, "latitude", "longitude"], only_touched=only_touched)


def read_spectra(spark: SparkSession, path: str, *, start=None, end=None) -> DataFrame:
    """2-D model spectra (time, point_id, d2fd), with the frequencies and directions of the rows of d2fd as arrays."""
    df = spark.read.parquet(path)
    if missing := [c for c in (TIME, "point_id", "d2fd") if c not in df.columns]:
        raise ValueError(f"the spectra lack {missing}")
    axes = {"frequency": model_frequency(), "direction": model_direction_degrees()}
    df = df.withColumns({c: F.array(*map(F.lit, axis.tolist())) for c, axis in axes.items()})
    return subset_time(df, start, end, end_inclusive_day=True)


def read_models(spark: SparkSession, paths: dict[str, list[str]], **cut) -> dict[str, DataFrame]:
    """Grids by the name of their model; an unknown name is an error."""
    if unknown := sorted(paths.keys() - MODELS.keys()):
        raise ValueError(f"unknown models {unknown}; known are {sorted(MODELS)}")
    return {name: read_grid(spark, paths[name], tuple(MODELS[name]), **cut) for name in paths}


def write_attributes(spark: SparkSession, path: str, attributes: dict[str, str]) -> None:
    """What an archive says about itself, as a table of names and values."""
    rows = sorted((k, v) for k, v in attributes.items())
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes")


def read_attributes(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.name: r.value for r in spark.read.parquet(f"{path}/attributes").collect()}


def write_archive(obs: DataFrame, path: str, *, chunk_rows: int = 50_000, attributes: dict[str, str] | None = None) -> None:
    """Observations in folders of days, by trajectory and time, with the table of trajectories and the archive's attributes beside them.

    Columns carry their metadata (``described``) through Parquet.
    """
    obs = described(obs)
    write_by_day(obs, f"{path}/observations", [ID, TIME], chunk_rows=chunk_rows)
    sizes = obs.groupBy(ID).agg(F.count("*").alias("rowsize"))
    described(sizes).write.mode("overwrite").parquet(f"{path}/trajectories")
    now = datetime.now(timezone.utc).isoformat()
    write_attributes(obs.sparkSession, path, TABLE | {"creation_date": now} | (attributes or {}))


def write_results(collocated: DataFrame, bias: DataFrame, path: str, model_subset: DataFrame | None = None) -> None:
    """Collocated rows and hourly bias as CSV; the model subset as Parquet."""
    collocated.write.mode("overwrite").option("header", True).csv(f"{path}/collocated")
    bias.write.mode("overwrite").option("header", True).partitionBy("model", "model_var").csv(f"{path}/bias")
    if model_subset is not None:
        model_subset.write.mode("overwrite").parquet(f"{path}/model")


def write_matchup(matchup: DataFrame, by_frequency: DataFrame, heights: DataFrame, path: str) -> None:
    for name, df in (("matchup", matchup), ("metrics_by_frequency", by_frequency), ("metrics_hs", heights)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
