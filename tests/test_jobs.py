"""Whole jobs and files, on folders that the tests write."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wavejobs.functions.frequency import model_frequency
from wavejobs.operators import archive, chunks, drift, quality
from wavejobs.plans import adapters as ad
from wavejobs.plans import jobs, registry
from wavejobs.sources import files

SF = "/root/testdata/sf0.001"
REGION = jobs.Region(datetime(2024, 1, 3), datetime(2024, 1, 10))


def write_csv(root, buoy, day, header, rows):
    at = root / buoy / day
    at.mkdir(parents=True, exist_ok=True)
    (at / "waves.csv").write_text("\n".join([",".join(header), *(",".join(map(str, r)) for r in rows)]) + "\n")


@pytest.fixture
def csv_tree(tmp_path):
    root = tmp_path / "raw"
    first = ["Epoch Time", "Latitude (deg)", "Longitude (deg)", "f", "varianceDensity", "a1", "Partition0 Start Frequency (hz)", "Partition1 Mean Directional Spread (deg)"]
    write_csv(root, "Spot-1a", "d1", first, [[1704067200, -60, 10, "0.1;0.3", "1;2", "10;30", 0.05, 33.5], [1704070800, -60.5, 10, "0.1;0.3", "-;4", "11;31", "-", ""]])
    second = ["f", "varianceDensity", "a1", "Epoch Time", "Longitude (deg)", "Latitude (deg)"]
    write_csv(root, "Spot-2b", "d1", second, [["0.1;0.3", "5;6", "1;3", 1704067200, 20, -61], ["-", "-", "-", 1704070800, 20, -61]])
    return str(root)


def test_build_and_merge_archives(spark, csv_tree, tmp_path):
    built = jobs.build_archive(spark, csv_tree, str(tmp_path / "built"), chunk_rows=2)
    rows = files.read_archive(spark, str(tmp_path / "built" / "observations")).orderBy("obs_index").collect()
    assert [(r.trajectory_id, r.obs_index, r.varianceDensity) for r in rows] == [("SPOT-1A", 0, [1.0, 2.0]), ("SPOT-1A", 1, [None, 4.0]), ("SPOT-2B", 2, [5.0, 6.0])]
    assert (rows[0].partition0StartFrequency, rows[0].partition1MeanDirectionalSpread, rows[1].partition0StartFrequency) == (0.05, 33.5, None)
    sizes = {r.trajectory_id: r.rowsize for r in spark.read.parquet(str(tmp_path / "built" / "trajectories")).collect()}
    assert sizes == {"SPOT-1A": 2, "SPOT-2B": 1}
    schema = files.read_archive(spark, str(tmp_path / "built" / "observations")).schema
    assert schema["latitude"].metadata["units"] == "degrees_north" and schema["varianceDensity"].metadata["units"] == "m2 Hz-1"
    assert schema["trajectory_id"].metadata["cf_role"] == "trajectory_id" and schema["partition0StartFrequency"].metadata["units"] == "hz"
    assert schema["a1"].metadata == {"dimensions": ["index", "frequency"], "long_name": "directional Fourier coefficient a1", "units": "1"}
    assert spark.read.parquet(str(tmp_path / "built" / "trajectories")).schema["rowsize"].metadata["sample_dimension"] == "index"
    said = files.read_attributes(spark, str(tmp_path / "built"))
    assert said["Conventions"] == "CF-1.8" and said["featureType"] == "trajectory" and said["creation_date"][:2] == "20" and "title" in said

    new = built.where("trajectory_id = 'SPOT-1A'").withColumn("time", F.expr("time + interval 1 day"))
    new = new.withColumn("frequency", F.array(F.lit(0.1), F.lit(0.2)))
    merged = jobs.merge_archives(built, new.drop("frequency", "varianceDensity", "a1").limit(0), new, str(tmp_path / "merged"), attributes={**said, "note": "kept"})
    again = files.read_attributes(spark, str(tmp_path / "merged"))
    assert again["note"] == "kept" and again["merged_from"] and again["title"] != said["title"] and again["creation_date"] == said["creation_date"]
    rows = merged.orderBy("obs_index").collect()
    assert [r.obs_index for r in rows] == list(range(5)) and {tuple(r.frequency) for r in rows} == {(0.1, 0.2, 0.3)}
    by_time = {(r.trajectory_id, r.time.day): (r.varianceDensity, r.a1) for r in rows if r.time.hour == 0}
    assert by_time["SPOT-1A", 1] == ([1.0, None, 2.0], [10.0, None, 30.0]) and by_time["SPOT-1A", 2] == ([1.0, 2.0, None], [10.0, 30.0, None])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day_files(path):
    return {d.name: sorted((f.name, f.stat().st_mtime_ns) for f in d.iterdir()) for d in path.iterdir() if d.is_dir()}


def test_an_update_rewrites_only_the_days_that_it_touches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    cols = "trajectory_id string, obs_index long, time timestamp, latitude double, longitude double, frequency array<double>, varianceDensity array<double>"

    def frame(*rows):
        return spark.createDataFrame([(i, k, t + timedelta(days=d, hours=h), -50.0, 0.0, f, v) for k, (i, d, h, f, v) in enumerate(rows)], cols)

    path = str(tmp_path / "archive")
    files.write_archive(archive.indexed(frame(*(("A", d, 0, [0.1, 0.2], [1.0, float(d)]) for d in range(5)))), path)
    before = day_files(tmp_path / "archive" / "observations")
    new = frame(("A", 2, 5, [0.2], [9.0]), ("A", 6, 1, [0.2], [7.0]), ("B", 3, 2, [0.1, 0.2], [3.0, 4.0]))
    days = jobs.update_archive(spark, path, new.drop("frequency", "varianceDensity").limit(0), new)
    assert [d.day for d in days] == [4, 7]  # the row of day 2 lies within what is known of A
    after = day_files(tmp_path / "archive" / "observations")
    assert {d for d in after if after[d] != before.get(d)} == {"date=2024-01-04", "date=2024-01-07"} and len(after) == 6
    rows = files.read_archive(spark, f"{path}/observations").orderBy("obs_index").collect()
    assert [(r.trajectory_id, r.time.day, r.obs_index) for r in rows] == [("A", d + 1, d) for d in range(5)] + [("A", 7, 5), ("B", 4, 6)]
    assert rows[5].varianceDensity == [None, 7.0] and rows[6].varianceDensity == [3.0, 4.0] and rows[3].varianceDensity == [1.0, 3.0]
    assert {r.trajectory_id: r.rowsize for r in spark.read.parquet(f"{path}/trajectories").collect()} == {"A": 6, "B": 1}
    # A new frequency changes all arrays, so all days.
    wide = frame(("C", 9, 0, [0.3], [5.0]))
    assert len(jobs.update_archive(spark, path, wide.limit(0), wide)) == 7
    rows = {(r.trajectory_id, r.time.day): r.varianceDensity for r in files.read_archive(spark, f"{path}/observations").collect()}
    assert rows["A", 1] == [1.0, 0.0, None] and rows["C", 10] == [None, None, 5.0] and len(rows) == 8
    assert jobs.update_archive(spark, path, wide.limit(0), wide) == []


def test_days_are_pruned(spark, tmp_path):
    hours = spark.range(96).selectExpr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id) as time", "'A' as trajectory_id", "id as obs_index", "1D as latitude", "2D as longitude", "id * 1D as swh", "1D as pp1d")
    files.write_grid(hours.drop("trajectory_id", "obs_index"), str(tmp_path / "grid"))
    files.write_archive(hours, str(tmp_path / "archive"))
    span = {"start": datetime(2024, 1, 2), "end": datetime(2024, 1, 3)}
    grid = files.read_grid(spark, [str(tmp_path / "grid")], ("swh", "pp1d"), **span)
    obs = files.read_archive(spark, str(tmp_path / "archive" / "observations"), **span)
    assert (grid.count(), obs.count(), obs.columns) == (48, 25, hours.columns)
    for df in (grid, obs):
        assert "PartitionFilters: [isnotnull(date" in plan_of(df) and "(date" in plan_of(df).split("PartitionFilters")[1]


def test_csv_files_in_many_splits_keep_their_headers(spark, tmp_path):
    root = tmp_path / "raw"
    head = ["Epoch Time", "Latitude (deg)", "Processing Source", "f", "varianceDensity"]
    write_csv(root, "Spot-1a", "d1", head, [[1704067200 + 3600 * k, k / 100, '"a, b"' if k % 2 else "-", "0.1;0.2", f"{k};2"] for k in range(800)])
    write_csv(root, "Spot-1a", "d2", [head[i] for i in (3, 0, 4, 1, 2)], [["0.1;0.2", 1704067200 - 60 * k, f"{k};3", -k / 100, "x"] for k in range(700)])
    write_csv(root, "Spot-2b", "d1", ["nothing", "of", "use"], [[1, 2, 3]])
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "4096")
    try:
        got = files.read_csv_tree(spark, str(root)).collect()
    finally:
        spark.conf.unset(key)
    want = {(1704067200 + 3600 * k, k / 100, "a, b" if k % 2 else None, (k, 2.0)) for k in range(800)} | {(1704067200 - 60 * k, -k / 100, "x", (k, 3.0)) for k in range(700)}
    assert {(int(r.time.replace(tzinfo=timezone.utc).timestamp()), r.latitude, r.processingSource, tuple(r.varianceDensity)) for r in got} == want and len(got) == 1500
    write_csv(root, "Spot-3c", "d1", head, [[1704067200, *range(400)], [1704067200]])
    odd = files.read_csv_tree(spark, str(root), drop_missing_spectra=False).where("trajectory_id = 'SPOT-3C'").collect()
    assert sorted((r.latitude is None, r.latitude, r.processingSource) for r in odd) == [(False, 0.0, "1"), (True, None, None)]


def test_new_rows_of_one_time_keep_the_bulk_one(spark):
    cols = "trajectory_id string, obs_index long, time timestamp, latitude double, longitude double, peakPeriod double"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("A", 0, t, -50.0, 0.0, 1.0)], cols)
    bulk = spark.createDataFrame([("B", 1, t, -50.0, 0.0, 2.0), ("B", 0, t, -50.0, 0.0, 3.0)], cols)
    spectral = spark.createDataFrame([("B", 0, t, -50.0, 0.0, 4.0)], cols)
    out = archive.merge(old, bulk, spectral, dedupe_new=True, lat_min=-74, lat_max=-39, lon_min=-180, lon_max=180)
    assert sorted(r.peakPeriod for r in out.collect()) == [1.0, 3.0]


def test_arrays_off_the_axis_stay_and_unlike_ones_are_an_error(spark):
    t = datetime(2024, 1, 1)
    cols = "trajectory_id string, obs_index long, time timestamp, latitude double, longitude double, frequency array<double>, varianceDensity array<double>, wind array<double>, gain array<double>"
    box = {"lat_min": -74, "lat_max": -39, "lon_min": -180, "lon_max": 180}

    def frame(*rows, dims=("index", "frequency")):
        return spark.createDataFrame([(i, k, t, -50.0, 0.0, *r) for k, (i, *r) in enumerate(rows)], cols).withMetadata("gain", {"dimensions": list(dims)})

    old = frame(("A", [0.1, 0.2], [1.0, 2.0], [7.0, 8.0, 9.0], [5.0, 6.0]))
    new = frame(("B", [0.2, 0.3], [3.0, 4.0], [1.0], [7.0, 8.0]), ("C", None, None, [2.0] * 5, None))
    got = {r.trajectory_id: r for r in archive.merge(old, new, new.limit(0), **box).collect()}
    assert (got["A"].wind, got["A"].varianceDensity, got["A"].gain) == ([7.0, 8.0, 9.0], [1.0, 2.0, None], [5.0, 6.0, None])
    assert (got["B"].wind, got["B"].varianceDensity, got["B"].gain) == ([1.0], [None, 3.0, 4.0], [None, 7.0, 8.0])
    assert (got["C"].wind, got["C"].varianceDensity, got["C"].frequency) == ([2.0] * 5, None, None)
    for bad in (frame(("B", [0.2, 0.3], [3.0], None, None)), frame(("B", None, [3.0], None, None)), frame(("B", [0.2], None, None, [1.0, 2.0]))):
        with pytest.raises(Exception, match="frequencies"):
            archive.merge(old, bad, bad.limit(0), **box).collect()
    with pytest.raises(ValueError, match="different dimensions"):
        archive.merge(old, frame(("B", None, None, None, None), dims=("index",)), new.limit(0), **box)
    # By name only: what is spectral is on the axis, what is not stays.
    plain = [d.withMetadata("gain", {}) for d in (old, new)]
    assert archive.on_axis(*plain) == ("varianceDensity",) and set(archive.on_axis(old, new)) == {"varianceDensity", "gain"}


def test_grids_keep_the_whole_last_day(spark, tmp_path):
    hours = spark.range(72).selectExpr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id) as time", "1D as latitude", "2D as longitude", "id * 1D as swh", "1D as pp1d", "2D as Thgt", "3D as Tper")
    hours.write.parquet(str(tmp_path / "grid"))
    grids = files.read_models(spark, {"era5": [str(tmp_path / "grid")], "gfs": [str(tmp_path / "grid")]}, start=datetime(2024, 1, 1), end=datetime(2024, 1, 2))
    assert grids["era5"].count() == 48 and grids["gfs"].columns == ["time", "latitude", "longitude", "Thgt", "Tper"]
    with pytest.raises(ValueError):
        files.read_models(spark, {"other": [str(tmp_path / "grid")]})
    with pytest.raises(ValueError):
        files.read_grid(spark, [str(tmp_path / "grid")], ("swh", "wind"))


def test_bulk_jobs(spark, tmp_path):
    obs = ad.observations(spark, SF)
    era5 = ad.grid(spark, SF)
    grids = {"era5": era5, "gfs": era5.withColumnsRenamed({"swh": "Thgt", "pp1d": "Tper"})}
    kept, bias = jobs.bulk(obs, grids, REGION)
    rows = kept.select("error_era5_swh", "error_gfs_Thgt", "error_era5_pp1d", "error_gfs_Tper", "summary_qc").collect()
    assert rows and all(r[0] == r[1] and r[2] == r[3] and r[4] != 4 for r in rows)
    assert {(r.model, r.model_var) for r in bias.collect()} == {("era5", "swh"), ("era5", "pp1d"), ("gfs", "Thgt"), ("gfs", "Tper")}
    files.write_results(kept, bias, str(tmp_path / "out"), era5)
    assert spark.read.parquet(str(tmp_path / "out" / "model")).count() == era5.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "collocated")).count() == len(rows)
    drifting, none = jobs.bulk_with_drift(obs, {}, REGION)
    assert none is None and {"drifter_u_m_s", "drifter_velocity_qc_flag"} <= set(drifting.columns) and drifting.where("drifter_speed_m_s is not null").count()


def test_spectral_job(spark, tmp_path):
    ad.model_spectra(spark, SF).write.parquet(str(tmp_path / "spectra"))
    model = files.read_spectra(spark, str(tmp_path / "spectra"))
    assert len(model.first().frequency) == 30 and len(model.first().direction) == 24
    matched, by_frequency, heights = jobs.spectral(ad.buoy_spectra(spark, SF), model, ad.points(spark, SF), ad.SOURCE_FREQUENCY)
    files.write_matchup(matched, by_frequency, heights, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out" / "metrics_by_frequency")).orderBy("freq_idx").collect()
    assert [round(r.frequency, 9) for r in rows] == [round(float(f), 9) for f in model_frequency()]
    assert any(r.rmse is None for r in rows) and any(r.log10_rmse is not None for r in rows)
    assert spark.read.parquet(str(tmp_path / "out" / "metrics_hs")).count() == 1


def test_drift_of_whole_trajectories_deals_rows_once_and_equals_the_other_way(spark, monkeypatch):
    written = []
    for module in (quality, drift):
        monkeypatch.setattr(module, "saved", lambda df, name, write=module.saved: written.append(name) or write(df, name))
    whole = registry.QUERIES["drift_velocity"](spark, SF)
    assert not written and whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1
    monkeypatch.setattr(jobs, "WHOLE_ROWS", 10)
    other = registry.QUERIES["drift_velocity"](spark, SF)
    assert written == ["quality-rows", "drift-rows"]
    assert whole.count() > 1000 and sorted(map(str, whole.collect())) == sorted(map(str, other.collect()))


def test_tasks_of_whole_trajectories(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(100).selectExpr("cast(id % 10 as string) as trajectory_id")
    assert chunks.tasks_of_whole(rows, 10) == cores and chunks.tasks_of_whole(rows, 9) is None
    assert chunks.tasks_of_whole(rows, 10, task_rows=1) == cores * -(-100 // cores)
    assert chunks.tasks_of_whole(rows.limit(0), 10) == cores
