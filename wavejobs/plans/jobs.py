"""Whole jobs as compositions of operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frequency import model_frequency, widths
from ..operators import archive, collocate, drift, quality, resample, skill, spectra
from ..operators.chunks import WHOLE_ROWS, fits, tasks_of_whole
from ..operators.trajectories import ID, subset, subset_time
from ..sources import files
from ..sources.shared import saved


@dataclass(frozen=True)
class Region:
    start: datetime = datetime(2021, 12, 1)
    end: datetime = datetime(2021, 12, 10)
    lat_min: float = -67.5
    lat_max: float = -50.5
    lon_min: float = -180.0
    lon_max: float = 180.0

    def box(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in ("lat_min", "lat_max", "lon_min", "lon_max")}


def bulk(obs: DataFrame, grids: dict[str, DataFrame], region: Region, *, longitude: str = "nearest", config: quality.QualityConfig | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Hourly rows beside the models, failed ones removed, and the bias by hour."""
    hourly = resample.hourly(subset(obs, region.start, region.end, **region.box()), longitude=longitude)
    with_models = collocate.model_errors(hourly, grids) if grids else hourly
    kept = quality.run_all(with_models, config, model_can_fail=True, remove_failed_after=True)
    return kept, skill.bias_by_hour(kept, region.start) if grids else None


def hourly_with_drift(obs: DataFrame, config: quality.QualityConfig | None = None, *, max_gap_hours: float = 3.0, max_speed: float = 3.0) -> DataFrame:
    """Hourly rows across the date line, failed ones removed, with velocities.

    Where counts show that all trajectories fit a task, the observations are dealt by trajectory
    once and each task takes its own through all steps; else rows are written between the steps.
    """
    whole = fits(obs, WHOLE_ROWS)
    hourly = resample.hourly(obs.repartition(ID) if whole else obs, longitude="linear_wrapped", whole=whole)
    if whole and (tasks := tasks_of_whole(hourly, WHOLE_ROWS)):
        hourly = resample.hourly(obs.repartition(tasks, ID), longitude="linear_wrapped", whole=True)
    else:
        whole = False
    kept = quality.run_all(hourly, config, remove_failed_after=True, whole=whole)
    return drift.velocity(kept, max_gap_hours=max_gap_hours, max_speed=max_speed, whole=whole)


def bulk_with_drift(obs: DataFrame, grids: dict[str, DataFrame], region: Region, *, max_gap_hours: float = 3.0, max_speed: float = 3.0, **options) -> tuple[DataFrame, DataFrame | None]:
    """As ``bulk`` across the date line, with velocities of the rows that quality control keeps."""
    if not grids:
        obs = subset(obs, region.start, region.end, **region.box())
        return hourly_with_drift(obs, max_gap_hours=max_gap_hours, max_speed=max_speed, **options), None
    kept, bias = bulk(obs, grids, region, longitude="linear_wrapped", **options)
    return drift.velocity(kept, max_gap_hours=max_gap_hours, max_speed=max_speed), bias


def spectral(obs: DataFrame, model: DataFrame, points: DataFrame, source_centres, *, start=None, end=None, tolerance_s: float = 1800.0, max_distance_m: float = 50_000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matchup, metrics by frequency and metrics of wave heights."""
    binned = spectra.rebinned(subset_time(obs, start, end), source_centres)
    model = subset_time(model, start, end, end_inclusive_day=True)
    m = spectra.matchup(binned, model, points, tolerance_s=tolerance_s, max_distance_m=max_distance_m)
    return m, spectra.frequency_metrics(m), spectra.height_metrics(m, widths(model_frequency()))


def build_archive(spark: SparkSession, root: str, out: str, *, chunk_rows: int = 50_000) -> DataFrame:
    obs = saved(files.read_csv_tree(spark, root), "built")
    archive.validate_spectral_lengths(obs, tuple(c for c in files.ARRAYS.values() if c in obs.columns))
    obs = archive.indexed(obs)
    files.write_archive(obs, out, chunk_rows=chunk_rows)
    return obs


def merge_archives(existing: DataFrame, new_bulk: DataFrame, new_spectral: DataFrame, out: str | None = None, *, attributes: dict[str, str] | None = None, lat_min=-74.0, lat_max=-39.0, lon_min=-180.0, lon_max=180.0) -> DataFrame:
    """Existing and new rows under a new index; written where ``out`` is given, with the existing archive's ``attributes`` and what a merge adds."""
    merged = archive.indexed(archive.merge(existing, new_bulk, new_spectral, lat_min=lat_min, lat_max=lat_max, lon_min=lon_min, lon_max=lon_max))
    if out:
        files.write_archive(merged, out, attributes=(attributes or {}) | files.MERGED)
    return merged


def update_archive(spark: SparkSession, path: str, new_bulk: DataFrame, new_spectral: DataFrame, *, dedupe_new: bool = False, lat_min=-74.0, lat_max=-39.0, lon_min=-180.0, lon_max=180.0) -> list[date | None]:
    """Merge new rows into the archive at ``path`` and rewrite only the days that get some; the days are returned.

    New rows are numbered after all existing ones (``archive.indexed`` gives the dense order).
    Where they bring a new frequency or a new column, every day is rewritten, as all arrays
    change. What is written was first written apart, so an update that fails leaves the
    archive's days whole.
    """
    at, box = f"{path}/observations", {"lat_min": lat_min, "lat_max": lat_max, "lon_min": lon_min, "lon_max": lon_max}
    existing, bulk_rows, spectral_rows = map(archive.normalise_names, (files.read_archive(spark, at), new_bulk, new_spectral))
    columns = archive.on_axis(existing, bulk_rows, spectral_rows)
    fresh = saved(archive.arrivals(existing, bulk_rows, spectral_rows, dedupe_new=dedupe_new, **box), "arrivals")
    last = existing.agg(F.max("obs_index")).first()[0]
    fresh = archive.indexed(fresh).withColumn("obs_index", F.col("obs_index") + (-1 if last is None else last) + 1)
    every = bool(set(fresh.columns) - set(existing.columns))
    if archive.FREQUENCY in fresh.columns:
        old_grid = archive.frequency_grid(existing) if archive.FREQUENCY in existing.columns else []
        grid = archive.frequency_grid(*(d for d in (existing, fresh) if archive.FREQUENCY in d.columns))
        every = every or grid != old_grid
        fresh = archive.aligned(fresh, grid, columns)
    days = [r[0] for r in fresh.select(F.to_date("time").alias("d")).distinct().orderBy("d").collect()]
    if not days:
        return days
    stored = spark.read.parquet(at)
    old = existing if every else archive.normalise_names(stored.where(F.col(files.DATE).isin([d for d in days if d]) | F.lit(None in days) & F.col(files.DATE).isNull()).drop(files.DATE))
    if every and archive.FREQUENCY in fresh.columns and archive.FREQUENCY in old.columns:
        old = archive.aligned(old, grid, columns)
    merged = saved(old.unionByName(fresh, allowMissingColumns=True), "updated")
    sizes = saved(archive.row_sizes(fresh).unionByName(spark.read.parquet(f"{path}/trajectories")).groupBy("trajectory_id").agg(F.sum("rowsize").alias("rowsize")), "updated-sizes")
    files.write_by_day(files.described(merged), at, ["trajectory_id", "time"], only_touched=not every)
    files.described(sizes).write.mode("overwrite").parquet(f"{path}/trajectories")
    files.write_attributes(spark, path, files.read_attributes(spark, path) | files.MERGED)
    return [r[0] for r in merged.select(F.to_date("time").alias("d")).distinct().orderBy("d").collect()] if every else days
