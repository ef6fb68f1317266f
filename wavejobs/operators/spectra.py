"""Wave spectra: direction integral, rebinning, nearest point, matchup and metrics."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import radians

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frequency import model_edges, model_frequency, rebin_weights
from ..functions.geo import chord_to_metres, cube_side, unit_vector
from ..sources.shared import saved, small
from .collocate import nearest_time
from .trajectories import ID, TIME

EPS = 1e-10


def direction_integral(d2fd: Column, width_degrees: float = 15.0, null_land: bool = False) -> Column:
    """Per frequency the sum over directions of 10 ** d2fd, null as 0, times the width in radians.

    With ``null_land`` a spectrum without any value is null instead of zeros.
    """
    total = F.transform(
        d2fd,
        lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + F.coalesce(F.pow(F.lit(10.0), x), F.lit(0.0))) * radians(width_degrees),
    )
    if null_land:
        total = F.when(F.exists(d2fd, lambda row: F.exists(row, lambda x: x.isNotNull())), total)
    return total


def rebin(density: Column, source_centres, target_edges) -> Column:
    """Sum of density times source width over target width; a bin without a source centre is null."""
    bins = [
        reduce(lambda a, b: a + b, [F.coalesce(F.get(density, F.lit(i)), F.lit(0.0)) * w for i, w in cell]) if cell else F.lit(None).cast("double")
        for cell in rebin_weights(source_centres, target_edges)
    ]
    return F.when(density.isNotNull(), F.array(*bins))


def rebinned(obs: DataFrame, source_centres, target_edges=None, keep: tuple[str, ...] = ()) -> DataFrame:
    edges = model_edges() if target_edges is None else target_edges
    wanted = [c for c in (ID, TIME, "latitude", "longitude", "processingSource", *keep) if c in obs.columns]
    return obs.select(*dict.fromkeys(wanted), rebin(F.col("varianceDensity"), source_centres, edges).alias("varianceDensity"))


def millimetres(distance_m: str | Column) -> Column:
    """A distance as whole millimetres: what equal distances have in common, whatever the last digits of sines are."""
    return F.floor((F.col(distance_m) if isinstance(distance_m, str) else distance_m) * 1000 + 0.5)


def nearest_point(places: DataFrame, points: DataFrame, keys: list[str], max_distance_m: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, point_id, distance_m and the point's ``carry`` columns of the nearest point within ``max_distance_m`` (inclusive).

    Space is cut into cubes as wide as the longest chord allowed; points are posted in
    their own and the 26 neighbouring cubes, so one equi-join finds every candidate. Distances
    are compared, with each other and the limit, in whole millimetres; ties go to the smaller point_id.
    """
    side = cube_side(max_distance_m)
    x, y, z = unit_vector(F.col("longitude"), F.col("latitude"))
    cube = lambda v, d=0: (F.floor(v / side) + d).cast("long")
    p = points.select("point_id", F.struct(F.lit(0).alias("none"), *carry).alias("carried"), x.alias("px"), y.alias("py"), z.alias("pz"))
    around = F.array(*(F.struct(cube(F.col("px"), a).alias("cube_i"), cube(F.col("py"), b).alias("cube_j"), cube(F.col("pz"), c).alias("cube_k")) for a, b, c in product((-1, 0, 1), repeat=3)))
    p = p.select("*", F.explode(around).alias("q")).select("point_id", "carried", "px", "py", "pz", "q.*")
    o = places.where("latitude is not null and longitude is not null").select(*keys, x.alias("x"), y.alias("y"), z.alias("z"))
    o = o.select("*", cube(F.col("x")).alias("cube_i"), cube(F.col("y")).alias("cube_j"), cube(F.col("z")).alias("cube_k"))
    chord = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2))
    found = o.join(p, ["cube_i", "cube_j", "cube_k"]).withColumn("distance_m", chord_to_metres(chord)).where(millimetres("distance_m") <= millimetres(F.lit(float(max_distance_m))))
    best = found.groupBy(*keys).agg(F.min(F.struct(millimetres("distance_m").alias("mm"), "point_id", "distance_m", "carried")).alias("b"))
    return best.select(*keys, "b.point_id", "b.distance_m", *(F.col(f"b.carried.{c}") for c in carry))


def boxes(points: DataFrame, level: int) -> DataFrame:
    """(cell, parent, b0 … b5): for each cell of a level that holds points the box that they fill.

    The cube around the sphere is halved ``2 * level`` times in each direction; a cell's
    parent is the cell of the level before that holds it.
    """
    n = 4**level
    number = lambda c: F.least(F.floor((F.col(c) + 1) * (n / 2)), F.lit(n - 1))
    ids = [number(c).alias(f"i{k}") for k, c in enumerate(("px", "py", "pz"))]
    rows = points.select(*ids, "px", "py", "pz").groupBy("i0", "i1", "i2").agg(*(f(c) for c in ("px", "py", "pz") for f in (F.min, F.max)))
    rows = rows.toDF("i0", "i1", "i2", *(f"b{k}" for k in range(6)))
    cell = lambda up: F.struct(*(F.floor(F.col(f"i{k}") / up).alias(f"i{k}") for k in range(3)))
    return rows.select(cell(1).alias("cell"), cell(4).alias("parent"), *(f"b{k}" for k in range(6)))


def nearest_in_tree(places: DataFrame, points: DataFrame, keys: list[str], levels: int = 4) -> DataFrame:
    """``keys``, point_id and distance_m of the nearest point, however far, by a tree of cells.

    From the coarsest cells (64 at most) to the finest, a place keeps the cells that may hold
    its nearest point: those that begin no farther off than the far end of the best one.
    Each step is an equi-join of kept cells to their children; points are met in the finest
    cells only. Distances are compared in whole millimetres (a chord of 1.6e-10), so cells
    that far beyond the bound are kept too; ties go to the smaller point_id.
    """
    x, y, z = unit_vector(F.col("longitude"), F.col("latitude"))
    pts = saved(points.where("latitude is not null and longitude is not null").select("point_id", x.alias("px"), y.alias("py"), z.alias("pz")), "tree-points")
    top = [tuple(r.cell) + tuple(r[f"b{k}"] for k in range(6)) for r in boxes(pts, 1).collect()]
    rows = places.where("latitude is not null and longitude is not null").select(*keys, x.alias("x"), y.alias("y"), z.alias("z"))
    if not top:
        return rows.select(*keys, F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(None).cast("double").alias("distance_m")).limit(0)
    first = F.array(*(F.struct(F.struct(*(F.lit(v).cast("long").alias(f"i{k}") for k, v in enumerate(t[:3]))).alias("cell"), *(F.lit(v).alias(f"b{k}") for k, v in enumerate(t[3:]))) for t in top))
    cand = rows.withColumn("c", F.explode(first)).select(*keys, "x", "y", "z", "c.*")
    for level in range(1, levels + 1):
        if level > 1:
            below = saved(boxes(pts, level), "tree-cells")
            cand = cand.withColumnRenamed("cell", "parent").join(small(below, 200_000), "parent").drop("parent")
        sides = [(F.col(c), F.col(f"b{2 * k}"), F.col(f"b{2 * k + 1}")) for k, c in enumerate("xyz")]
        near = reduce(lambda a, b: a + b, [F.pow(F.greatest(lo - v, v - hi, F.lit(0.0)), 2) for v, lo, hi in sides])
        far = reduce(lambda a, b: a + b, [F.pow(F.greatest(F.abs(v - lo), F.abs(v - hi)), 2) for v, lo, hi in sides])
        cand = cand.withColumns({"near": near, "bound": F.min(far).over(Window.partitionBy(*keys))})
        cand = saved(cand.where(F.sqrt("near") <= F.sqrt("bound") + 1e-9).select(*keys, "x", "y", "z", "cell"), "tree-kept")
    n = 4**levels
    number = lambda c: F.least(F.floor((F.col(c) + 1) * (n / 2)), F.lit(n - 1))
    met = pts.withColumn("cell", F.struct(*(number(c).alias(f"i{k}") for k, c in enumerate(("px", "py", "pz"))))).join(cand, "cell")
    chord = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2))
    met = met.withColumn("distance_m", chord_to_metres(chord))
    best = met.groupBy(*keys).agg(F.min(F.struct(millimetres("distance_m").alias("mm"), "point_id", "distance_m")).alias("b"))
    return best.select(*keys, "b.point_id", "b.distance_m")


def nearest_point_anywhere(places: DataFrame, points: DataFrame, keys: list[str], first_radius_m: float = 50_000.0) -> DataFrame:
    """The nearest point without a limit: by neighbouring cubes within the first radius; what is left, if anything is, by a tree of cells."""
    found = saved(nearest_point(places, points, keys, first_radius_m), "nearest-within")
    left = saved(places.where("latitude is not null and longitude is not null").join(found, keys, "left_anti"), "nearest-left")
    return found if left.isEmpty() else found.unionByName(nearest_in_tree(left, points, keys))


PLACE = [ID, TIME, "latitude", "longitude"]


def match_keys(obs: DataFrame, spectra: DataFrame, points: DataFrame, *, tolerance_s: float = 1800.0, max_distance_m: float = 50_000.0) -> DataFrame:
    """A written table of who meets whom: time and place of observations, model_time, point_id, distance_m, model_latitude and model_longitude.

    Only times and places are read, no array: those of ``obs``, the times of ``spectra`` and
    the ``points``. Observations outside the model's period have no row.
    """
    places = saved(obs.select(*PLACE).where("time is not null and latitude is not null and longitude is not null"), "match-places")
    times = saved(spectra.select(TIME).distinct(), "match-times")
    low, high = times.agg(F.min(TIME), F.max(TIME)).first()
    if low is None:
        places = places.limit(0)
    places = places.where(F.col(TIME).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
    when = saved(nearest_time(places, times, tolerance_s), "match-when")
    points = points.select("point_id", F.col("latitude").alias("model_latitude"), F.col("longitude").alias("model_longitude"), "latitude", "longitude")
    near = nearest_point(places.join(small(when), TIME, "left_semi"), points, PLACE, max_distance_m, ("model_latitude", "model_longitude"))
    return saved(near.join(small(when), TIME), "match-keys")


def matchup(binned: DataFrame, spectra: DataFrame, points: DataFrame, *, tolerance_s: float = 1800.0, max_distance_m: float = 50_000.0, null_land: bool = False) -> DataFrame:
    """Observed spectra beside the model's at the nearest time and point.

    Keys are matched and written first (``match_keys``); then the arrays of each side are read
    once, where a key asks for them, and meet in one join. Model spectra are integrated
    before that join, so that one number a frequency is shuffled, not one a direction.
    """
    for df, need in ((binned, (ID, TIME, "latitude", "longitude", "varianceDensity")), (spectra, (TIME, "point_id", "d2fd")), (points, ("point_id", "latitude", "longitude"))):
        if lacking := [c for c in need if c not in df.columns]:
            raise ValueError(f"missing columns {lacking}")
    keys = match_keys(binned, spectra, points, tolerance_s=tolerance_s, max_distance_m=max_distance_m)
    at = ["model_time", "point_id"]
    wanted = saved(keys.select(*at).distinct(), "match-wanted")
    model = spectra.select(F.col(TIME).alias("model_time"), "point_id", "d2fd").join(small(wanted), at, "left_semi")
    model = model.select(*at, direction_integral(F.col("d2fd"), null_land=null_land).alias("varianceDensity_model"))
    obs = binned.select(*PLACE, F.col("varianceDensity").alias("varianceDensity_buoy")).join(small(keys), PLACE)
    return obs.join(model, at).select(
        ID, TIME, "varianceDensity_buoy", "varianceDensity_model",
        F.col("latitude").alias("buoy_latitude"), F.col("longitude").alias("buoy_longitude"),
        "model_latitude", "model_longitude", F.col("distance_m").alias("model_distance_m"), "model_time",
    )


DENSITY = ("mean_spectrum_buoy", "mean_spectrum_model", "bias", "mae", "rmse", "correlation", "relative_bias", "energy_ratio", "scatter_index")
LOGS = ("log10_bias", "log10_rmse", "log10_correlation")


def pairs_by_frequency(m: DataFrame, frequency: np.ndarray | None = None) -> DataFrame:
    """(freq_idx, frequency, x, y): observed and model density, both null unless both are present and not negative."""
    axis = F.array(*map(F.lit, (model_frequency() if frequency is None else frequency).tolist()))
    both = F.arrays_zip(F.col("varianceDensity_buoy").alias("x"), F.col("varianceDensity_model").alias("y"))
    rows = m.select(F.posexplode(both).alias("freq_idx", "p"))
    valid = (F.col("p.x") >= 0) & (F.col("p.y") >= 0)
    return rows.select("freq_idx", F.get(axis, F.col("freq_idx")).alias("frequency"), F.when(valid, F.col("p.x")).alias("x"), F.when(valid, F.col("p.y")).alias("y"))


def frequency_metrics(m: DataFrame, eps: float = EPS) -> DataFrame:
    """Metrics of densities and of their logarithms in one pass, a row for every frequency of the axis."""
    d = F.col("y") - F.col("x")
    rmse, mean_x, mean_y = F.sqrt(F.avg(d * d)), F.avg("x"), F.avg("y")
    above = (F.col("x") > eps) & (F.col("y") > eps)
    a, b = F.when(above, F.log10("x")), F.when(above, F.log10("y"))
    return pairs_by_frequency(m).groupBy("freq_idx", "frequency").agg(
        mean_x.alias("mean_spectrum_buoy"), mean_y.alias("mean_spectrum_model"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"),
        rmse.alias("rmse"), F.corr("x", "y").alias("correlation"),
        F.try_divide(F.avg(d), mean_x).alias("relative_bias"), F.try_divide(mean_y, mean_x).alias("energy_ratio"), F.try_divide(rmse, mean_x).alias("scatter_index"),
        F.avg(b - a).alias("log10_bias"), F.sqrt(F.avg((b - a) * (b - a))).alias("log10_rmse"), F.corr(a, b).alias("log10_correlation"),
    )


def density_metrics(m: DataFrame) -> DataFrame:
    return frequency_metrics(m).select("freq_idx", "frequency", *DENSITY)


def log_metrics(m: DataFrame, eps: float = EPS) -> DataFrame:
    return frequency_metrics(m, eps).select("freq_idx", "frequency", *LOGS)


def with_heights(m: DataFrame, widths: np.ndarray) -> DataFrame:
    """hs_buoy and hs_model: 4 * sqrt(sum of density times width) over bins valid on both sides."""
    both = F.arrays_zip(F.col("varianceDensity_buoy").alias("x"), F.col("varianceDensity_model").alias("y"), F.array(*map(F.lit, widths.tolist())).alias("w"))
    valid = F.filter(both, lambda p: (p.x >= 0) & (p.y >= 0))

    def height(side: str) -> Column:
        return 4 * F.sqrt(F.aggregate(valid, F.lit(0.0), lambda s, p: s + p[side] * p.w))

    return m.withColumns({"hs_buoy": height("x"), "hs_model": height("y")})


def height_metrics(m: DataFrame, widths: np.ndarray) -> DataFrame:
    d = F.col("hs_model") - F.col("hs_buoy")
    return with_heights(m, widths).agg(F.avg(d).alias("hs_bias"), F.avg(F.abs(d)).alias("hs_mae"), F.sqrt(F.avg(d * d)).alias("hs_rmse"), F.corr("hs_buoy", "hs_model").alias("hs_correlation"))
