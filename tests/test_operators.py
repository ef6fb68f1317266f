"""Hand-worked rows at the edges of the rules."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavejobs.functions import frequency, geo
from wavejobs.functions.parse import semicolon_array
from wavejobs.operators import archive, chunks, collocate, quality, resample, spectra
from wavejobs.sources import files

T0 = datetime(2024, 1, 1)
SCHEMA = "trajectory_id string, obs_index long, time timestamp, latitude double, longitude double, significantWaveHeight double, peakPeriod double"


def track(spark, rows):
    return spark.createDataFrame([("A", i, T0 + timedelta(hours=h), float(lat), float(lon), hs, 5.0) for i, (h, lat, lon, hs) in enumerate(rows)], SCHEMA)


def flags(df, column):
    return [r[0] for r in df.orderBy("time").select(column).collect()]


def test_gross_range_bounds_are_strict(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 15.0, 15.1, 25.0, 25.1, -0.1, None)], "x double")
    assert [r[0] for r in df.select(quality.gross_range(F.col("x"), 0, 15, 0, 25)).collect()] == [1, 1, 3, 3, 4, 4, 9]


def test_spike_and_rate(spark):
    df = track(spark, [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (2, 0, 0, 1.0), (3, 0, 0, None), (4, 0, 0, 9.0), (4, 0, 0, 9.0)])
    assert flags(df.withColumn("q", quality.spike("significantWaveHeight", 2, 4)), "q")[:4] == [2, 1, 2, 9]
    assert flags(df.withColumn("q", quality.rate_of_change("significantWaveHeight", 1.5, 3)), "q") == [2, 3, 3, 9, 1, 4]


def test_stuck_runs(spark):
    df = quality.with_stuck(track(spark, [(h, 0.0, 0.0, 1.0) for h in range(7)] + [(7, 1.0, 0.0, 1.0)]))
    assert flags(df, "stuck_position_qc") == [2, 3, 3, 3, 3, 3, 3, 1]


@pytest.mark.parametrize("pair,want", [((1, 2), 1), ((1, 9), 1), ((2, 9), 1), ((2, 2), 2), ((9, 9), 9), ((3, 9), 3), ((4, 9), 4), ((3, 4), 4)])
def test_summary(spark, pair, want):
    df = spark.createDataFrame([pair], "a_qc int, b_qc int")
    assert quality.with_summary(df).first().summary_qc == want


def test_hourly_ties_and_date_line(spark):
    df = track(spark, [(0.5, 0.0, 179.0, 1.0), (1.5, 1.0, -179.0, None), (3.0, 2.0, -178.0, 4.0)])
    near = resample.hourly(df).orderBy("time").collect()
    assert [(r.time.hour, r.longitude, r.significantWaveHeight) for r in near] == [(1, 179.0, None), (2, -179.0, None), (3, -178.0, 4.0)]
    wrapped = resample.hourly(df, longitude="linear_wrapped").orderBy("time").collect()
    assert wrapped[0].longitude == -180.0 and abs(wrapped[0].latitude - 0.5) < 1e-12


def test_nearest_time_tie_goes_later(spark):
    at = lambda *m: spark.createDataFrame([(T0 + timedelta(minutes=x),) for x in m], "time timestamp")
    got = collocate.nearest_time(at(30, -5, 5000), at(0, 60)).orderBy("time").collect()
    assert [r.model_time for r in got] == [T0, T0 + timedelta(minutes=60), T0 + timedelta(minutes=60)]
    assert collocate.nearest_time(at(30, 31), at(0), 1800).count() == 1


def test_incremental_edges(spark):
    old = track(spark, [(0, 0, 0, 1.0), (5, 0, 0, 1.0)])
    new = track(spark, [(-1, 0, 0, 1.0), (0, 0, 0, 1.0), (3, 0, 0, 1.0), (5, 0, 0, 1.0), (6, 0, 0, 1.0)])
    assert archive.outside_existing(new, archive.time_limits(old)).count() == 2


def geodesic(spark, ends):
    cols = "i int, lon1 double, lat1 double, lon2 double, lat2 double"
    df = spark.createDataFrame([(i, *map(lambda x: None if x is None else float(x), e)) for i, e in enumerate(ends)], cols)
    out = geo.with_geodesic(df, *(F.col(c) for c in ("lon1", "lat1", "lon2", "lat2"))).orderBy("i").collect()
    return [(r.azimuth_deg, r.distance_m) for r in out]


def test_geodesic_of_near_and_nearly_antipodal_points(spark):
    # Published values: a degree of the equator; a quarter meridian twice; pairs for which Vincenty's rounds do not settle.
    known = [
        ((0, 0, 1, 0), 90.0, 111_319.4908), ((10, 50, 10, 50), 0.0, 0.0), ((0, 0, 180, 0), None, 20_003_931.4586), ((0, -90, 77, 90), None, 20_003_931.4586),
        ((0, -30, 179.8, 29.9), 161.890524736, 19_989_832.827610), ((0, 0, 179.7, 0.5), None, 19_944_127.421), ((0, 0, 179.5, 0.5), None, 19_936_288.579),
    ]
    for (azimuth, metres), (_, want, far) in zip(geodesic(spark, [k[0] for k in known]), known):
        assert abs(metres - far) < 2e-3 and (want is None or abs(azimuth - want) < 1e-6)
    assert geodesic(spark, [(0, None, 1, 0), (0, 0, None, 0)]) == [(None, None)] * 2


def test_geodesic_is_the_same_from_either_end_and_continuous(spark):
    rng = np.random.default_rng(6)
    pairs = [(0.0, la, 180 - d, -la + e) for la, d, e in zip(rng.uniform(-80, 80, 60), rng.uniform(-1.5, 1.5, 60), rng.uniform(-1, 1, 60))]
    pairs += [(float(a), float(b), float(c), float(d)) for a, b, c, d in np.column_stack([rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60)])]
    there, back = geodesic(spark, pairs), geodesic(spark, [(c, d, a, b) for a, b, c, d in pairs])
    east = geodesic(spark, [(-a, b, -c, d) for a, b, c, d in pairs])
    for (az, m), (_, m2), (az3, m3) in zip(there, back, east):
        assert m is not None and abs(m - m2) < 1e-3 and abs(m - m3) < 1e-3 and abs(az + az3) % 360 < 1e-6 and 0 <= m <= 20_003_931.46
    # Steps of a hundredth of a degree across the limit of convergence on the equator (179.4 degrees) are no longer than on the equator.
    line = geodesic(spark, [(0, 0, 179 + k / 100, 0) for k in range(101)])
    steps = np.diff([m for _, m in line])
    assert (steps > -1e-3).all() and steps.max() < 1_113.2 and abs(line[0][0] - 90) < 1e-9 and abs(line[-1][0]) < 1e-6 or abs(line[-1][0]) > 179.99


def test_rebin_edges_and_conservation():
    edges = frequency.edges_from_centres([1.0, 2.0, 3.0])
    assert edges.tolist() == [0.5, 1.5, 2.5, 3.5]
    cells = frequency.rebin_weights([1.0, 1.5, 2.0], [0.5, 1.5, 2.5, 9.0])
    assert [[i for i, _ in c] for c in cells] == [[0], [1, 2], []]
    with pytest.raises(ValueError):
        frequency.edges_from_centres([1.0])


def test_parse_and_csv_tree(spark, tmp_path):
    df = spark.createDataFrame([("1;-;;2.5",), ("-",), (None,)], "c string")
    assert [r[0] for r in df.select(semicolon_array(F.col("c"))).collect()] == [[1.0, None, None, 2.5], [], []]
    for name, head, line in (("Spot-a", "Epoch Time,Latitude (deg),f,varianceDensity", "1704067200,1.5,1;2,3;4"), ("Spot-b", "f,Epoch Time,varianceDensity,Other", "1;2,1704067200,-,9")):
        (tmp_path / name / "x").mkdir(parents=True)
        (tmp_path / name / "x" / "d.csv").write_text(f"{head}\n{line}\n")
    got = files.read_csv_tree(spark, str(tmp_path), drop_missing_spectra=False).orderBy("trajectory_id").collect()
    assert [(r.trajectory_id, r.latitude, r.frequency, r.varianceDensity) for r in got] == [("SPOT-A", 1.5, [1.0, 2.0], [3.0, 4.0]), ("SPOT-B", None, [1.0, 2.0], [])]
    assert files.read_csv_tree(spark, str(tmp_path)).count() == 1


def test_nearest_point_anywhere(spark):
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 80.0, 170.0)], "k string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 0.1, 0.0), (2, -60.0, 10.0)], "point_id int, latitude double, longitude double")
    got = {r.k: r.point_id for r in spectra.nearest_point_anywhere(places, points, ["k"]).collect()}
    assert got == {"a": 1, "b": 1}


def test_nearest_point_tree_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for i in range(150)]
    points += [(1000 + i, -40.0 + i % 9 * 0.01, 20.0 + i // 9 * 0.01) for i in range(81)] + [(2000, 90.0, 0.0), (2001, -90.0, 17.0), (2002, 0.0, 180.0), (2003, 0.0, 180.0), (2004, None, 1.0)]
    places = [(f"p{i}", float(np.degrees(np.arcsin(rng.uniform(-1, 1)))), float(rng.uniform(-180, 180))) for i in range(120)] + [("d", 0.0, -180.0), ("n", 89.0, 10.0), ("none", None, 0.0)]
    left = spark.createDataFrame(places, "k string, latitude double, longitude double")
    right = spark.createDataFrame(points, "point_id int, latitude double, longitude double")

    def vector(lat, lon):
        a, b = np.radians(lat), np.radians(lon)
        return np.array([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])

    known = [(i, vector(la, lo)) for i, la, lo in points if la is not None]
    want = {k: min((round(float(np.linalg.norm(vector(la, lo) - v)), 12), i) for i, v in known)[1] for k, la, lo in places if la is not None}
    for found in (spectra.nearest_point_anywhere(left, right, ["k"]), spectra.nearest_in_tree(left, right, ["k"])):
        assert {r.k: r.point_id for r in found.collect()} == want
    assert spectra.nearest_point_anywhere(left, right.limit(0), ["k"]).count() == 0
    assert spectra.nearest_point_anywhere(left.limit(0), right, ["k"]).count() == 0


def test_equally_near_points_go_to_the_smaller_id(spark):
    """A place halfway between two points of one meridian: their distances differ in the last digits of the sines only."""
    places = [(f"p{i}", -66 + 0.4 * i + 0.2, -170 + 1.3 * j) for i in range(40) for j in range(8)]
    points = [(41 * j + i, -66 + 0.4 * i, -170 + 1.3 * j) for i in range(41) for j in range(8)]
    places = [(f"{k}-{n}", la, lo) for n, (k, la, lo) in enumerate(places)]
    left = spark.createDataFrame(places, "k string, latitude double, longitude double")
    right = spark.createDataFrame(points, "point_id int, latitude double, longitude double")
    by_id = {r.point_id: r for r in right.collect()}
    for found in (spectra.nearest_point(left, right, ["k"], 50_000.0), spectra.nearest_in_tree(left, right, ["k"])):
        got = {r.k: by_id[r.point_id] for r in found.collect()}
        assert len(got) == len(places) and all(got[k].latitude < la and got[k].longitude == lo for k, la, lo in places)


def test_models_on_the_same_axes_find_cells_once(spark, monkeypatch):
    hours = track(spark, [(h, 10.5 + 0.3 * h, 20.25, 2.0) for h in range(6)] + [(6, 50.0, 20.0, 1.0)])
    era5 = spark.createDataFrame([(T0, float(a), float(b), a + b / 10, a - b / 10) for a in (10, 11, 12) for b in (20, 21)], "time timestamp, latitude double, longitude double, swh double, pp1d double")
    gfs = era5.withColumnsRenamed({"swh": "Thgt", "pp1d": "Tper"})
    calls, located = [], collocate.Axes.located
    monkeypatch.setattr(collocate.Axes, "located", lambda self, rows, *a: calls.append(1) or located(self, rows, *a))
    both = collocate.model_errors(hours, {"era5": era5, "gfs": gfs})
    assert len(calls) == 1 and set(both.columns) == {*hours.columns, *(f"{a}_{m}_{v}" for m, vs in collocate.MODELS.items() for v in vs for a in ("model_value", "error"))}
    other = collocate.model_errors(hours, {"era5": era5, "gfs": gfs.where("latitude < 12")})
    assert len(calls) == 3
    for r, o in zip(both.orderBy("time").collect(), other.orderBy("time").collect()):
        want = r.latitude + r.longitude / 10 if r.latitude <= 12 else None
        assert r.model_value_era5_swh == (want and pytest.approx(want)) and o.model_value_era5_swh == r.model_value_era5_swh == r.model_value_gfs_Thgt
        assert o.model_value_gfs_Thgt == (r.model_value_gfs_Thgt if r.latitude <= 11 else None)


def wandering(spark, n=400, seed=5):
    """One trajectory over many days, with gaps, still stretches, equal and missing times, nulls; and a short one."""
    rng = np.random.default_rng(seed)
    rows, t, lat = [], T0, 0.0
    for i in range(n):
        t += timedelta(hours=float(rng.choice([0, 0.5, 1, 1, 2, 30])))
        lat += float(rng.choice([0, 0, 0, 0, 0.0001, 0.5]))
        rows.append(("A", i, None if i in (7, 8) else t, None if rng.random() < 0.02 else lat, 0.0, float(rng.normal()), 5.0))
    return spark.createDataFrame([*rows, ("B", 3, T0, 0.0, 0.0, 1.0, 2.0)], SCHEMA).repartition(5)


def test_chunked_windows_equal_windows_over_the_trajectory(spark):
    rows = wandering(spark)
    w = Window.partitionBy("trajectory_id").orderBy("time", "obs_index")
    for hours in (3, 24, 24 * 60):
        near = chunks.with_neighbours(rows, ("latitude", "obs_index"), width_us=hours * 3_600_000_000, whole_rows=400 if hours == 24 * 60 else 0)
        assert (chunks.CHUNK in near.columns) == (hours < 24 * 60)
        near = near.withColumns({"a": F.lag("obs_index").over(w), "b": F.lead("obs_index").over(w)})
        assert near.count() == 401 and near.where("not (_last.obs_index <=> a and _next.obs_index <=> b)").isEmpty()
        ranks = chunks.ranked(rows, hours * 3_600_000_000).withColumn("want", F.row_number().over(Window.orderBy("trajectory_id", "time", "obs_index")))
        assert ranks.count() == 401 and ranks.where("rank <> want").isEmpty()


def test_runs_of_still_rows_reach_over_chunks(spark):
    rows = wandering(spark, 600, seed=9)
    order = sorted((r for r in rows.collect() if r.trajectory_id == "A"), key=lambda r: (r.time is not None, r.time or T0, r.obs_index))
    still, hours = [False], [None]
    for a, b in zip(order, order[1:]):
        still.append(a.latitude is not None and b.latitude is not None and abs(a.latitude - b.latitude) * np.pi / 180 * geo.EARTH_RADIUS_M <= 50)
        hours.append(None if a.time is None or b.time is None else (b.time - a.time).total_seconds() / 3600)
    want, i = {}, 0
    while i < len(order):
        j = i
        while still[i] and j < len(order) and still[j]:
            j += 1
        total = round(sum(h for h in hours[i:j] if h is not None), 9)
        for k in range(i, max(j, i + 1)):
            r = order[k]
            missing = r.latitude is None or r.time is None
            want[r.obs_index] = 9 if missing else 2 if k == 0 else 4 if still[k] and total >= 12 else 3 if still[k] and total >= 6 else 1
        i = max(j, i + 1)
    cut, whole = ({r.obs_index: r.stuck_position_qc for r in quality.with_stuck(rows, whole_rows=n).where("trajectory_id = 'A'").collect()} for n in (599, 600))
    got = cut
    assert cut == whole
    assert got == want and {1, 3, 4, 9} <= set(want.values())


def test_equal_times_are_in_the_order_of_obs_index(spark):
    rows = [("A", i, T0 + timedelta(hours=h), 0.0, 0.0, hs, 5.0) for i, h, hs in ((4, 1, 9.0), (2, 1, 1.0), (1, 0, 1.0), (3, 1, 1.0), (5, 2, 9.0))]
    out = quality.run_all(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("obs_index").collect()
    assert [r.swh_rate_of_change_qc for r in out] == [2, 1, 4, 4, 1] and [r.swh_spike_qc for r in out] == [2, 1, 3, 3, 2]


def test_one_long_trajectory_is_dealt_over_tasks(spark):
    rows = spark.range(3000).selectExpr("'A' as trajectory_id", "id as obs_index", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id) as time", "0D as latitude", "0D as longitude", "1D as significantWaveHeight", "2D as peakPeriod")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        shares = quality.run_all(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(key)
    assert len(shares) == 4 and max(r[1] for r in shares) < 1500


def test_global_order_needs_no_single_task(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = wandering(spark)
    ragged, sizes = archive.to_ragged(rows)
    for df in (ragged, archive.to_observations(ragged, sizes, chunk=50), chunks.thinned(rows)):
        assert "SinglePartition" not in plan(df)


def test_widths_sum_to_the_range():
    e = frequency.model_edges()
    assert np.isclose(frequency.widths(frequency.model_frequency()).sum(), e[-1] - e[0])


def test_geodesic_of_a_pair_does_not_depend_on_its_batch():
    """Velocities are rounded; last digits that change with the layout of rows would turn some of them."""
    rng = np.random.default_rng(3)
    near = np.array([rng.uniform(-180, 180, 2000), rng.uniform(-70, 70, 2000)])
    near = np.vstack([near, near + rng.normal(0, 0.03, near.shape)])
    far = np.array([[0.0, 0.3, 179.3, -0.2]]).T
    alone, together = geo.inverse(*near), geo.inverse(*np.hstack([near, far]))
    assert all(np.array_equal(a, t[:-1]) for a, t in zip(alone, together))
    single = [geo.inverse(*near[:, i : i + 1]) for i in range(300)]
    assert all(np.array_equal(a[:300], np.concatenate(s)) for a, s in zip(alone, zip(*single)))
