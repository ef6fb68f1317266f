"""Registered queries over the general test tables, and DuckDB SQL that checks them.

The SQL has other shapes than the Spark plans: as-of joins for the hourly grid, nearest
matches by comparing all pairs, bilinear corners by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frequency import edges_from_centres, model_edges, model_frequency, widths
from ..operators import archive, chunks, collocate, drift, quality, resample, skill, spectra
from ..operators import trajectories as tr
from ..sources import files
from . import adapters as ad
from . import jobs

START, END = datetime(2024, 1, 3), datetime(2024, 1, 28)
BOX = {"lat_min": -67.5, "lat_max": -50.5, "lon_min": -180.0, "lon_max": 180.0}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Times as microseconds and doubles to six decimals, as the SQL has them."""
    out = []
    for c, kind in df.dtypes:
        if kind == "timestamp":
            out.append(F.unix_micros(c).alias(f"{c}_us"))
        elif kind == "double":
            out.append((F.round(c, 6) + 0.0).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns)


OBS = f"obs as ({ad.observations_sql('duckdb')})"
GRID = f"grid as ({ad.grid_sql('duckdb')})"
SUB = f"""{OBS}, inside as (select * from obs where time between timestamp '2024-01-02 23:30:00' and timestamp '2024-01-28 00:30:00'
  and latitude between -67.5 and -50.5 and longitude between -180 and 180), sub as (select * from inside where trajectory_id in (select trajectory_id from inside group by 1 having count(*) > 1))"""


def hourly_cte(longitude: str, source: str = "sub") -> str:
    """hourly: for each full hour the samples before and after it, by as-of joins."""
    if longitude == "nearest":
        lon = "case when a.time = h or f <= 0.5 then a.longitude else b.longitude end"
    else:
        step = "((b.longitude - a.longitude + 180) - 360 * floor((b.longitude - a.longitude + 180) / 360) - 180)"
        x = f"(a.longitude + case when a.time = h then 0 else f * {step} end)"
        lon = f"(({x} + 180) - 360 * floor(({x} + 180) / 360) - 180)"
    value = "case when a.time = h then a.{0} else a.{0} + f * (b.{0} - a.{0}) end as {0}"
    return f"""hrs as (select trajectory_id, unnest(generate_series(date_trunc('hour', min(time) + interval '3599999999 microseconds'), date_trunc('hour', max(time)), interval 1 hour)) as h from {source} group by trajectory_id),
    ab as (select h.trajectory_id, h.h, a as a, b as b, case when a.time <> h.h then (epoch_us(h.h) - epoch_us(a.time))::double / (epoch_us(b.time) - epoch_us(a.time)) end as f
      from hrs h asof join {source} a on h.trajectory_id = a.trajectory_id and h.h >= a.time asof join {source} b on h.trajectory_id = b.trajectory_id and h.h <= b.time),
    hourly as (select trajectory_id, h as time, {value.format("latitude")}, {lon} as longitude, {value.format("significantWaveHeight")}, {value.format("peakPeriod")} from ab)"""


WHOLE = f"{OBS}, sub as (select * from obs)"
NEAREST = f"{WHOLE}, {hourly_cte('nearest')}"
WRAPPED = f"{WHOLE}, {hourly_cte('linear_wrapped')}"
HOURLY_OUT = f"select trajectory_id, epoch_us(time) as time_us, {r('latitude', 'longitude', 'significantWaveHeight', 'peakPeriod')} from hourly"


def subset(spark, sf_dir):
    return tr.subset(ad.observations(spark, sf_dir), START, END, **BOX)


def hourly(spark, sf_dir, longitude="nearest"):
    return resample.hourly(ad.observations(spark, sf_dir), longitude=longitude)


@query(f"with {SUB} select trajectory_id, obs_index, epoch_us(time) as time_us, {r('significantWaveHeight', 'peakPeriod', 'latitude', 'longitude')} from sub")
def subset_trajectories(spark, sf_dir):
    return subset(spark, sf_dir)


NARROW = {"lat_min": -55.0, "lat_max": -54.9, "lon_min": -180.0, "lon_max": 180.0}


@query(f"""with {OBS} select trajectory_id, count(*) as n, round(min(longitude), 6) as longitude_min, round(max(longitude), 6) as longitude_max, round(min(latitude), 6) as latitude_min, round(max(latitude), 6) as latitude_max
from obs where time between timestamp '2024-01-02 23:30:00' and timestamp '2024-01-28 00:30:00' and latitude between -55.0 and -54.9 group by 1 having count(*) = 1""")
def sparse_trajectories(spark, sf_dir):
    return tr.sparse(ad.observations(spark, sf_dir), START, END, **NARROW)


@query(f"with {NEAREST} {HOURLY_OUT}")
def hourly_nearest_lon(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(f"with {WRAPPED} {HOURLY_OUT}")
def hourly_wrapped_lon(spark, sf_dir):
    return hourly(spark, sf_dir, "linear_wrapped")


W = "(partition by trajectory_id order by time)"
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(latitude) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(latitude)) * pow(sin(radians(longitude - lo) / 2), 2))))"
STEPS = f"""steps as (select *, epoch_us(time) - epoch_us(lag(time) over {W}) as dt_us, lag(latitude) over {W} as la, lag(longitude) over {W} as lo, lag(significantWaveHeight) over {W} as hb, lead(significantWaveHeight) over {W} as ha, row_number() over {W} as nth from hourly),
moves as (select *, {HAV} as metres from steps), still as (select *, coalesce(metres <= 50, false) as s from moves),
runs as (select *, sum(case when s = ls then 0 else 1 end) over {W} as run from (select *, lag(s) over {W} as ls from still)),
tests as (select trajectory_id, time, latitude, longitude, significantWaveHeight, peakPeriod,
 case when latitude is null or longitude is null then 9 when latitude < -90 or latitude > 90 or longitude < -180 or longitude > 180 then 4 else 1 end as location_qc,
 case when significantWaveHeight is null then 9 when significantWaveHeight < 0 or significantWaveHeight > 25 then 4 when significantWaveHeight > 15 then 3 else 1 end as swh_gross_range_qc,
 case when peakPeriod is null then 9 when peakPeriod < 1 or peakPeriod > 35 then 4 when peakPeriod < 2 or peakPeriod > 25 then 3 else 1 end as peak_period_gross_range_qc,
 case when significantWaveHeight is null then 9 when hb is null or ha is null then 2 when abs(significantWaveHeight - (hb + ha) / 2) > 4 then 4 when abs(significantWaveHeight - (hb + ha) / 2) > 2 then 3 else 1 end as swh_spike_qc,
 case when significantWaveHeight is null then 9 when dt_us is null then 2 when dt_us <= 0 or abs(significantWaveHeight - hb) / (dt_us / 3.6e9) > 3 then 4 when abs(significantWaveHeight - hb) / (dt_us / 3.6e9) > 1.5 then 3 else 1 end as swh_rate_of_change_qc,
 case when latitude is null or longitude is null then 9 when dt_us is null then 2 when dt_us <= 0 or metres / (dt_us / 1e6) > 3 then 4 when metres / (dt_us / 1e6) > 1.5 then 3 else 1 end as drifter_speed_qc,
 case when latitude is null or longitude is null then 9 when nth = 1 then 2 when s and sum(dt_us) over (partition by trajectory_id, run) >= 43200000000 then 4 when s and sum(dt_us) over (partition by trajectory_id, run) >= 21600000000 then 3 else 1 end as stuck_position_qc from runs)"""
FLAGS = ["location_qc", "swh_gross_range_qc", "peak_period_gross_range_qc", "swh_spike_qc", "swh_rate_of_change_qc", "drifter_speed_qc", "stuck_position_qc"]


def summary_sql(flags: list[str]) -> str:
    every = lambda v: " and ".join(f"{f} = {v}" for f in flags)
    some = lambda v: " or ".join(f"{f} = {v}" for f in flags)
    return f"case when {every(9)} then 9 when {some(4)} then 4 when {some(3)} then 3 when {every(2)} then 2 else 1 end as summary_qc"


TESTED = f"{NEAREST}, {STEPS}, flagged as (select *, {summary_sql(FLAGS)} from tests)"


def flagged(spark, sf_dir):
    return quality.run_all(hourly(spark, sf_dir))


def _one_test(name: str):
    def run(spark, sf_dir):
        return flagged(spark, sf_dir).select(tr.ID, tr.TIME, name)

    return run


for _query, _flag in {
    "qc_gross_range": "swh_gross_range_qc",
    "qc_period_range": "peak_period_gross_range_qc",
    "qc_location": "location_qc",
    "qc_spike": "swh_spike_qc",
    "qc_rate": "swh_rate_of_change_qc",
    "qc_speed": "drifter_speed_qc",
    "qc_stuck": "stuck_position_qc",
    "qc_summary": "summary_qc",
}.items():
    _f = _one_test(_flag)
    _f.__name__ = _query
    query(f"with {TESTED} select trajectory_id, epoch_us(time) as time_us, {_flag} from flagged")(_f)

MEANING = "case flag " + " ".join(f"when {k} then '{v}'" for k, v in quality.MEANINGS.items()) + " end as meaning"


@query(f"with {TESTED}, long as (unpivot (select {', '.join(FLAGS)}, summary_qc from flagged) on columns(*) into name test value flag) select test, flag, {MEANING}, count(*) as count from long group by test, flag")
def qc_flag_counts(spark, sf_dir):
    return quality.flag_counts(flagged(spark, sf_dir))


@query(f"with {TESTED} select trajectory_id, epoch_us(time) as time_us, summary_qc from flagged where summary_qc in (3, 4)")
def qc_failed_or_suspect(spark, sf_dir):
    return quality.failed_or_suspect(flagged(spark, sf_dir)).select(tr.ID, tr.TIME, "summary_qc")


@query(f"with {TESTED} select trajectory_id, epoch_us(time) as time_us, summary_qc from flagged where summary_qc <> 4")
def qc_removed(spark, sf_dir):
    return quality.remove_failed(flagged(spark, sf_dir)).select(tr.ID, tr.TIME, "summary_qc")


MATCH = f"""{NEAREST}, {GRID}, gt as (select distinct time as m from grid), ht as (select distinct time as t from hourly),
near as (select t, m as model_time from (select t, m, row_number() over (partition by t order by abs(epoch_us(t) - epoch_us(m)), m desc) as k from ht, gt where abs(epoch_us(t) - epoch_us(m)) < 400000000000) where k = 1)"""


@query(f"with {MATCH} select epoch_us(t) as time_us, epoch_us(model_time) as model_time_us from near")
def nearest_time(spark, sf_dir):
    return collocate.nearest_time(hourly(spark, sf_dir), ad.grid(spark, sf_dir))


@query(f"with {MATCH} select epoch_us(t) as time_us, epoch_us(model_time) as model_time_us from near where abs(epoch_us(t) - epoch_us(model_time)) <= 3600000000")
def nearest_time_tolerance(spark, sf_dir):
    return collocate.nearest_time(hourly(spark, sf_dir), ad.grid(spark, sf_dir), 3600)


COLLOCATED = f"""{MATCH}, asked as (select h.trajectory_id, h.time, n.model_time, (h.latitude + 70) / 5 as y, (h.longitude + 180) / 5 as x from hourly h join near n on h.time = n.t where h.latitude is not null and h.longitude is not null),
cells as (select *, floor(y) as i, floor(x) as j from asked where y between 0 and 7 and x between 0 and 71),
corners as (select trajectory_id, time, model_time, -70 + 5 * (i + di) as la, -180 + 5 * (j + dj) as lo, (case di when 0 then 1 - (y - i) else y - i end) * (case dj when 0 then 1 - (x - j) else x - j end) as w
 from cells, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(di, dj)),
values_at as (select c.trajectory_id, c.time, case when count(swh) = count(*) then sum(w * swh) end as swh, case when count(pp1d) = count(*) then sum(w * pp1d) end as pp1d
 from corners c left join grid g on g.time = c.model_time and g.latitude = c.la and g.longitude = c.lo where w > 0 group by 1, 2),
errors as (select h.*, v.swh as model_value_era5_swh, v.pp1d as model_value_era5_pp1d, v.swh - h.significantWaveHeight as error_era5_swh, v.pp1d - h.peakPeriod as error_era5_pp1d
 from hourly h left join values_at v on h.trajectory_id = v.trajectory_id and h.time = v.time)"""


@query(f"with {COLLOCATED} select trajectory_id, epoch_us(time) as time_us, {r('swh', 'pp1d')} from values_at")
def bilinear_collocation(spark, sf_dir):
    h, g = hourly(spark, sf_dir), ad.grid(spark, sf_dir)
    points = h.select(tr.ID, tr.TIME, "latitude", "longitude").join(collocate.nearest_time(h, g), tr.TIME)
    return collocate.bilinear(points, g, ["swh", "pp1d"], [tr.ID, tr.TIME])


def errors(spark, sf_dir):
    return collocate.model_errors(hourly(spark, sf_dir), {"era5": ad.grid(spark, sf_dir)})


@query(f"with {COLLOCATED} select trajectory_id, epoch_us(time) as time_us, {r('model_value_era5_swh', 'error_era5_swh', 'model_value_era5_pp1d', 'error_era5_pp1d')} from errors")
def model_errors(spark, sf_dir):
    return errors(spark, sf_dir).select(tr.ID, tr.TIME, *(f"{a}_era5_{v}" for a in ("model_value", "error") for v in ("swh", "pp1d")))


def compared(c: str, low: int, high: int) -> str:
    return f"case when {c} is null then 2 when abs({c}) > {high} then 4 when abs({c}) > {low} then 3 else 1 end"


@query(f"with {COLLOCATED} select trajectory_id, epoch_us(time) as time_us, {compared('error_era5_swh', 2, 4)} as swh_model_qc, {compared('error_era5_pp1d', 4, 8)} as peak_period_model_qc from errors")
def qc_model(spark, sf_dir):
    return quality.run_all(errors(spark, sf_dir), model_can_fail=True).select(tr.ID, tr.TIME, "swh_model_qc", "peak_period_model_qc")


BIAS = f"""{COLLOCATED}, long as (select time, 'era5' as model, 'swh' as model_var, error_era5_swh as error, model_value_era5_swh as mv, significantWaveHeight as dv from errors
 union all select time, 'era5', 'pp1d', error_era5_pp1d, model_value_era5_pp1d, peakPeriod from errors),
bias as (select model, model_var, floor((epoch_us(time) - epoch_us(timestamp '2024-01-03')) / 3600000000)::int as analysis_hour, avg(error) as bias, avg(mv) as model_value, avg(dv) as data_value from long group by 1, 2, 3)"""


@query(f"with {BIAS} select model, model_var, analysis_hour, {r('bias', 'model_value', 'data_value')} from bias")
def bias_by_hour(spark, sf_dir):
    return skill.bias_by_hour(errors(spark, sf_dir), START)


@query(f"""with {BIAS} select model, model_var, round(min(bias), 6) as bias_min, round(max(bias), 6) as bias_max, round(min(model_value), 6) as model_value_min, round(max(model_value), 6) as model_value_max,
case when model_var in ('Thgt', 'swh') then 'm' else 's' end as unit from bias group by 1, 2""")
def display_limits(spark, sf_dir):
    return skill.display_limits(skill.bias_by_hour(errors(spark, sf_dir), START))


@query(f"""with {COLLOCATED}, p as (select significantWaveHeight as x, model_value_era5_swh as y from errors where significantWaveHeight is not null and model_value_era5_swh is not null)
select count(*) as n, round(sqrt(avg((y - x) * (y - x))), 6) as rmse, round(avg(abs(y - x)), 6) as mae, round(avg(abs(y - x)) / avg(abs(x)), 6) as rmae, round(regr_slope(y, x), 6) + 0.0 as slope, round(regr_intercept(y, x), 6) + 0.0 as intercept, round(min(x), 6) as x_min, round(max(x), 6) as x_max from p""")
def pair_skill(spark, sf_dir):
    return skill.pair_skill(errors(spark, sf_dir), "significantWaveHeight", "model_value_era5_swh")


@query(f"with {OBS} select round(min(longitude), 6) as longitude_min, round(max(longitude), 6) as longitude_max, round(min(latitude), 6) as latitude_min, round(max(latitude), 6) as latitude_max, count(*) as n_rows, count(distinct trajectory_id) as n_trajectories from obs")
def extent_summary(spark, sf_dir):
    return tr.extent(ad.observations(spark, sf_dir))


@query(f"""with {OBS} select round(min(longitude) - 2, 6) as longitude_low, round(max(longitude) + 2, 6) as longitude_high, round(min(latitude) - 2, 6) as latitude_low, round(max(latitude) + 2, 6) as latitude_high,
round(avg(longitude), 6) + 0.0 as longitude_centre, round(avg(latitude), 6) + 0.0 as latitude_centre, epoch_us(min(time)) as first_time_us, epoch_us(max(time)) as last_time_us from obs""")
def map_extent(spark, sf_dir):
    return tr.map_extent(ad.observations(spark, sf_dir))


@query(f"with {OBS} select trajectory_id, obs_index, k as rank from (select *, row_number() over (order by trajectory_id, time, obs_index) as k from obs) where (k - 1) % 5 = 0")
def thinned_positions(spark, sf_dir):
    return chunks.thinned(ad.observations(spark, sf_dir)).select(tr.ID, "obs_index", "rank")


@query(f"with {OBS} select trajectory_id, epoch_us(min(time)) as old_start_us, epoch_us(max(time)) as old_end_us from obs group by 1")
def trajectory_limits(spark, sf_dir):
    return archive.time_limits(ad.observations(spark, sf_dir))


@query(f"with {OBS} select trajectory_id, count(*) as rowsize from obs group by 1")
def trajectory_rowsize(spark, sf_dir):
    return archive.row_sizes(ad.observations(spark, sf_dir))


@query(f"with {OBS} select row_number() over (order by trajectory_id, time, obs_index) - 1 as obs_index, epoch_us(time) as time_us, {r('latitude')} from obs")
def obs_to_ragged(spark, sf_dir):
    return archive.to_ragged(ad.observations(spark, sf_dir))[0].select("obs_index", tr.TIME, "latitude")


@query(f"with {OBS} select trajectory_id, row_number() over (order by trajectory_id, time, obs_index) - 1 as obs_index, epoch_us(time) as time_us from obs")
def ragged_to_obs(spark, sf_dir):
    ragged, sizes = archive.to_ragged(ad.observations(spark, sf_dir))
    return archive.to_observations(ragged, sizes, chunk=1000).select(tr.ID, "obs_index", tr.TIME)


@query(f"with {OBS} select trajectory_id, obs_index, epoch_us(time) as time_us from (select *, row_number() over (partition by trajectory_id, time order by obs_index) as k from (select * from obs union all by name select * replace (obs_index + 1000000 as obs_index) from obs where obs_index % 53 = 0)) where k = 1")
def first_per_time(spark, sf_dir):
    obs = ad.observations(spark, sf_dir)
    again = obs.where("obs_index % 53 = 0").withColumn("obs_index", F.col("obs_index") + 1_000_000)
    return tr.first_per_time(obs.unionByName(again)).select(tr.ID, "obs_index", tr.TIME)


OLD = "obs_index % 3 = 0 and time < timestamp '2024-01-16' and cast(substr(trajectory_id, 2) as int) % 5 <> 4"
NEW = f"{OBS}, old as (select * from obs where {OLD}), new as (select * from obs where not ({OLD})), lim as (select trajectory_id, min(time) as a, max(time) as b from old group by 1)"


def parts(spark, sf_dir):
    obs = ad.observations(spark, sf_dir)
    return obs.where(OLD), obs.where(f"not ({OLD})")


@query(f"with {NEW} select n.trajectory_id, n.obs_index from new n left join lim l using (trajectory_id) where l.a is null or n.time < l.a or n.time > l.b")
def incremental_keep(spark, sf_dir):
    old, new = parts(spark, sf_dir)
    return archive.outside_existing(new, archive.time_limits(old)).select(tr.ID, "obs_index")


@query(f"""with {NEW} select trajectory_id, obs_index, epoch_us(time) as time_us, {r('significantWaveHeight')} from old union all
select n.trajectory_id, n.obs_index, epoch_us(n.time), case when n.obs_index % 2 = 0 then round(n.significantWaveHeight, 6) + 0.0 end from new n left join lim l using (trajectory_id)
where (l.a is null or n.time < l.a or n.time > l.b) and n.latitude between -74 and -60""")
def archive_merge(spark, sf_dir):
    old, new = parts(spark, sf_dir)
    bulk, other = new.where("obs_index % 2 = 0"), new.where("obs_index % 2 = 1").drop("significantWaveHeight")
    merged = archive.merge(old, bulk, other, lat_min=-74, lat_max=-60, lon_min=-180, lon_max=180)
    return merged.select(tr.ID, "obs_index", tr.TIME, "significantWaveHeight")


def two_grids(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Existing rows on every second frequency, bulk rows without spectra, spectral rows on all frequencies."""
    b = ad.buoy_spectra(spark, sf_dir)
    b = b.withColumn("a1", F.transform("varianceDensity", lambda v, k: v * 2 + k)).withColumn("b2", F.transform("varianceDensity", lambda v, k: v * 3 - k))
    arrays = ("frequency", "varianceDensity", "a1", "b2")
    old = b.where("trajectory_id like '%0'").withColumns({c: F.filter(c, lambda x, i: i % 2 == 0) for c in arrays})
    bulk = b.where("trajectory_id like '%5'").drop(*arrays)
    return old, bulk, b.where("trajectory_id not like '%0' and trajectory_id not like '%5'")


BUOY = f"buoy as ({ad.buoy_spectra_sql('duckdb')})"
MODEL = f"model as ({ad.model_spectra_sql('duckdb')}), points as ({ad.points_sql('duckdb')})"


@query(f"with {BUOY} select trajectory_id, k::int as freq_idx, round(case when trajectory_id like '%0' and k % 2 = 1 then null else varianceDensity[k + 1] end, 6) + 0.0 as density from buoy, unnest(range(64)) u(k)")
def align_frequency(spark, sf_dir):
    b = ad.buoy_spectra(spark, sf_dir)
    coarse = b.where("trajectory_id like '%0'")
    coarse = coarse.withColumns({c: F.filter(c, lambda x, i: i % 2 == 0) for c in ("frequency", "varianceDensity")})
    fine = b.where("trajectory_id not like '%0'")
    both = fine.unionByName(coarse)
    out = archive.aligned(both, archive.frequency_grid(fine, coarse))
    return out.select(tr.ID, F.posexplode("varianceDensity").alias("freq_idx", "density"))


MERGED_ITEM = "case when trajectory_id like '%0' and k % 2 = 1 then null else {0} end"


@query(f"""with {BUOY}, n as (select * from buoy where trajectory_id not like '%0' and latitude between -90 and 90 and longitude between -180 and 180),
rows_ as (select * from buoy where trajectory_id like '%0' union all select * from n), ix as (select * exclude (obs_index), row_number() over (order by trajectory_id, time) - 1 as obs_index from rows_)
select trajectory_id, obs_index, k::int as freq_idx, round(frequency[k + 1] * 1000, 6) + 0.0 as frequency_mhz, round({MERGED_ITEM.format('varianceDensity[k + 1]')}, 6) + 0.0 as density,
 round({MERGED_ITEM.format('varianceDensity[k + 1] * 2 + k')}, 6) + 0.0 as a1, round({MERGED_ITEM.format('varianceDensity[k + 1] * 3 - k')}, 6) + 0.0 as b2 from ix, unnest(range(64)) u(k) where trajectory_id not like '%5'""")
def archive_merge_spectra(spark, sf_dir):
    merged = archive.merge(*two_grids(spark, sf_dir), lat_min=-90, lat_max=90, lon_min=-180, lon_max=180)
    axis = F.transform("frequency", lambda f: f * 1000)
    items = F.arrays_zip(axis.alias("frequency_mhz"), F.col("varianceDensity").alias("density"), "a1", "b2")
    return archive.indexed(merged).select(tr.ID, "obs_index", F.posexplode(items).alias("freq_idx", "p")).select(tr.ID, "obs_index", "freq_idx", "p.*")


@query(f"""with {BUOY}, n as (select * from buoy where trajectory_id not like '%0' and latitude between -90 and 90 and longitude between -180 and 180), rows_ as (select * from buoy where trajectory_id like '%0' union all select * from n)
select trajectory_id, k::int as item, round(case k when 0 then latitude when 1 then longitude else latitude - longitude end, 6) + 0.0 as wind, round(latitude * 2 + k, 6) + 0.0 as coefficient,
 case when trajectory_id like '%5' then null else 64 end::int as n_density, case when trajectory_id like '%5' then null when trajectory_id like '%0' then 32 else 64 end::bigint as n_coefficients from rows_, unnest(range(3)) u(k)""")
def archive_merge_axis(spark, sf_dir):
    """A merge in which an array of three items is on no axis, and one is on the axis by its metadata only."""
    frames = [d.withColumn("wind", F.array("latitude", "longitude", F.col("latitude") - F.col("longitude"))) for d in two_grids(spark, sf_dir)]
    item = lambda f, k: F.col("latitude") * 2 + k
    frames = [d.withColumn("coefficient", F.transform("frequency", item)).withMetadata("coefficient", {"dimensions": ["index", "frequency"]}) if "frequency" in d.columns else d for d in frames]
    merged = archive.merge(*frames, lat_min=-90, lat_max=90, lon_min=-180, lon_max=180)
    known = F.filter("coefficient", lambda x: x.isNotNull())
    rows = merged.select(tr.ID, "latitude", F.posexplode("wind").alias("item", "wind"), F.when(F.col("varianceDensity").isNotNull(), F.size("varianceDensity")).alias("n_density"), F.when(known.isNotNull(), F.size(known)).cast("long").alias("n_coefficients"))
    return rows.select(tr.ID, "item", "wind", (F.col("latitude") * 2 + F.col("item")).alias("coefficient"), "n_density", "n_coefficients")


CELL = "case when trajectory_id like '%31' then null when k = 5 or k = 9 or varianceDensity[k + 1] is null then null else cast(round(10000 * varianceDensity[k + 1]) as bigint)::double end"


@query(f"with {BUOY} select trajectory_id, count(*)::int as n_items, count(v) as n_values, round(coalesce(sum(v), 0), 6) as total from (select trajectory_id, {CELL} as v from buoy, unnest(range(64)) u(k) where trajectory_id not like '%31') group by 1 union all select trajectory_id, 0, 0, 0.0 from buoy where trajectory_id like '%31'")
def parse_spectra(spark, sf_dir):
    from ..functions.parse import semicolon_array

    item = F.transform("varianceDensity", lambda v, k: F.when(k == 5, "-").when(k == 9, "").otherwise(F.coalesce(F.round(v * 10000).cast("long").cast("string"), F.lit("nan"))))
    cells = ad.buoy_spectra(spark, sf_dir).select(tr.ID, F.when(F.col(tr.ID).like("%31"), "-").otherwise(F.array_join(item, ";")).alias("cell"))
    rows = cells.select(tr.ID, semicolon_array(F.col("cell")).alias("v"))
    known = F.filter("v", lambda x: x.isNotNull())
    return rows.select(tr.ID, F.size("v").alias("n_items"), F.size(known).cast("long").alias("n_values"), F.aggregate(known, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"with {BUOY} select 'varianceDensity' as column_name, count(distinct len(varianceDensity)) as n_lengths, min(len(varianceDensity))::int as shortest, max(len(varianceDensity))::int as longest, count(*) filter (len(varianceDensity) <> len(frequency)) as n_unlike_frequency from buoy")
def spectral_lengths(spark, sf_dir):
    return archive.spectral_lengths(ad.buoy_spectra(spark, sf_dir), ("varianceDensity",))


INTEGRAL = f"{MODEL}, energy as (select time, point_id, f::int as freq_idx, list_sum(list_transform(d2fd[f + 1], lambda x: coalesce(pow(10, x), 0))) * radians(15) as y from model, unnest(range(30)) u(f))"


@query(f"with {INTEGRAL} select epoch_us(time) as time_us, point_id, freq_idx, {r('y')} from energy")
def direction_integral(spark, sf_dir):
    s = ad.model_spectra(spark, sf_dir)
    return s.select(tr.TIME, "point_id", F.posexplode(spectra.direction_integral(F.col("d2fd"))).alias("freq_idx", "y"))


_edges, _source = model_edges(), edges_from_centres(ad.SOURCE_FREQUENCY)
_bins = ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(zip(_edges[:-1].tolist(), _edges[1:].tolist())))
_source_bins = ", ".join(f"({k}, {f!r}, {w!r})" for k, (f, w) in enumerate(zip(ad.SOURCE_FREQUENCY, (_source[1:] - _source[:-1]).tolist())))
REBIN = f"""{BUOY}, bins as (select * from (values {_bins}) b(freq_idx, lo, hi)), src as (select * from (values {_source_bins}) s(k, f, w)),
binned as (select trajectory_id, time, latitude, longitude, b.freq_idx, case when count(s.k) > 0 then sum(coalesce(varianceDensity[s.k + 1], 0) * s.w) / any_value(b.hi - b.lo) end as x
 from buoy cross join bins b left join src s on s.f >= b.lo::double and s.f < b.hi::double group by all)"""


@query(f"with {REBIN} select trajectory_id, freq_idx, {r('x')} from binned")
def frequency_rebin(spark, sf_dir):
    b = spectra.rebinned(ad.buoy_spectra(spark, sf_dir), ad.SOURCE_FREQUENCY)
    return b.select(tr.ID, F.posexplode("varianceDensity").alias("freq_idx", "x"))


CHORD = "sqrt(pow(cos(radians(b.latitude)) * cos(radians(b.longitude)) - cos(radians(p.latitude)) * cos(radians(p.longitude)), 2) + pow(cos(radians(b.latitude)) * sin(radians(b.longitude)) - cos(radians(p.latitude)) * sin(radians(p.longitude)), 2) + pow(sin(radians(b.latitude)) - sin(radians(p.latitude)), 2))"
# As in the queries: nearest by whole millimetres, ties to the smaller point_id.
NEAREST_OF = "select trajectory_id, first(point_id order by mm, point_id) as point_id, min(mm) / 1000 as distance_m from ({}) group by 1"
PAIRS = f"select trajectory_id, point_id, floor(d * 1000 + 0.5) as mm from (select b.trajectory_id, p.point_id, 2 * 6371000.0 * asin(least(1.0, {CHORD} / 2)) as d from buoy b, points p)"
NEAR = f"nearby as ({NEAREST_OF.format(f'select * from ({PAIRS}) where mm <= 50000000')})"


@query(f"with {BUOY}, {MODEL}, {NEAR} select trajectory_id, point_id, round(distance_m, 3) as distance_m from nearby")
def nearest_point(spark, sf_dir):
    out = spectra.nearest_point(ad.buoy_spectra(spark, sf_dir), ad.points(spark, sf_dir), [tr.ID], 50_000.0)
    return out.withColumn("distance_m", spectra.millimetres("distance_m") / 1000)


@query(f"with {BUOY}, {MODEL}, nearby as ({NEAREST_OF.format(PAIRS)}) select trajectory_id, point_id, round(distance_m, 3) as distance_m from nearby")
def nearest_point_unlimited(spark, sf_dir):
    out = spectra.nearest_point_anywhere(ad.buoy_spectra(spark, sf_dir), ad.points(spark, sf_dir), [tr.ID])
    return out.withColumn("distance_m", spectra.millimetres("distance_m") / 1000)


MATCHED = f"""{REBIN}, {INTEGRAL}, {NEAR}, mt as (select distinct time as m from model),
when_ as (select trajectory_id, time, m from (select b.trajectory_id, b.time, m, row_number() over (partition by b.trajectory_id order by abs(epoch_us(b.time) - epoch_us(m)), m desc) as k from buoy b, mt
 where b.time between (select min(m) from mt) and (select max(m) from mt)) where k = 1 and abs(epoch_us(time) - epoch_us(m)) <= 1800000000),
pairs as (select w.trajectory_id, w.time, n.point_id, w.m as model_time, e.freq_idx, b.x, e.y from when_ w join nearby n using (trajectory_id) join binned b using (trajectory_id) join energy e on e.time = w.m and e.point_id = n.point_id and e.freq_idx = b.freq_idx)"""


def matched(spark, sf_dir):
    binned = spectra.rebinned(ad.buoy_spectra(spark, sf_dir), ad.SOURCE_FREQUENCY)
    return spectra.matchup(binned, ad.model_spectra(spark, sf_dir), ad.points(spark, sf_dir))


@query(f"with {MATCHED} select trajectory_id, epoch_us(time) as time_us, epoch_us(model_time) as model_time_us, freq_idx, {r('x', 'y')} from pairs")
def spectral_matchup(spark, sf_dir):
    m = matched(spark, sf_dir)
    both = F.arrays_zip(F.col("varianceDensity_buoy").alias("x"), F.col("varianceDensity_model").alias("y"))
    return m.select(tr.ID, tr.TIME, "model_time", F.posexplode(both).alias("freq_idx", "p")).select(tr.ID, tr.TIME, "model_time", "freq_idx", "p.x", "p.y")


VALID = f"{MATCHED}, valid as (select freq_idx, case when x >= 0 and y >= 0 then x end as x, case when x >= 0 and y >= 0 then y end as y from pairs)"
FREQUENCY = "round(0.03453 * pow(1.1, freq_idx), 6) + 0.0 as frequency"


@query(f"""with {VALID} select freq_idx, {FREQUENCY}, round(avg(x), 6) + 0.0 as mean_spectrum_buoy, round(avg(y), 6) + 0.0 as mean_spectrum_model, round(avg(y - x), 6) + 0.0 as bias, round(avg(abs(y - x)), 6) + 0.0 as mae, round(sqrt(avg((y - x) * (y - x))), 6) + 0.0 as rmse,
round(corr(x, y), 6) + 0.0 as correlation, round(avg(y - x) / avg(x), 6) + 0.0 as relative_bias, round(avg(y) / avg(x), 6) + 0.0 as energy_ratio, round(sqrt(avg((y - x) * (y - x))) / avg(x), 6) + 0.0 as scatter_index from valid group by freq_idx""")
def spectral_metrics(spark, sf_dir):
    return spectra.density_metrics(matched(spark, sf_dir))


@query(f"""with {VALID}, l as (select freq_idx, case when x > 1e-10 and y > 1e-10 then log10(x) end as x, case when x > 1e-10 and y > 1e-10 then log10(y) end as y from valid)
select freq_idx, {FREQUENCY}, round(avg(y - x), 6) + 0.0 as log10_bias, round(sqrt(avg((y - x) * (y - x))), 6) + 0.0 as log10_rmse, round(corr(x, y), 6) + 0.0 as log10_correlation from l group by freq_idx""")
def log_metrics(spark, sf_dir):
    return spectra.log_metrics(matched(spark, sf_dir))


_widths = ", ".join(f"({i}, {w!r})" for i, w in enumerate(widths(model_frequency()).tolist()))


@query(f"""with {MATCHED}, hs as (select trajectory_id, 4 * sqrt(coalesce(sum(x * w) filter (x >= 0 and y >= 0), 0)) as a, 4 * sqrt(coalesce(sum(y * w) filter (x >= 0 and y >= 0), 0)) as b from pairs join (values {_widths}) v(i, w) on freq_idx = i group by trajectory_id)
select round(avg(b - a), 6) + 0.0 as hs_bias, round(avg(abs(b - a)), 6) + 0.0 as hs_mae, round(sqrt(avg((b - a) * (b - a))), 6) + 0.0 as hs_rmse, round(corr(a, b), 6) + 0.0 as hs_correlation from hs""")
def hs_metrics(spark, sf_dir):
    return spectra.height_metrics(matched(spark, sf_dir), widths(model_frequency()))


SECONDS = "(epoch_us({1}) - epoch_us({0})) / 1e6"
PAIR = f"""{WRAPPED}, nb as (select *, lag(time) over {W} as tb, lead(time) over {W} as ta, lag(latitude + longitude) over {W} as pb, lead(latitude + longitude) over {W} as pa from hourly),
g as (select *, {SECONDS.format('tb', 'time')} as db, {SECONDS.format('time', 'ta')} as da from nb),
pr as (select *, case when db between 1e-6 and 10800 and da between 1e-6 and 10800 and pb is not null and pa is not null then 'central'
 when da between 1e-6 and 10800 and pa is not null and latitude + longitude is not null then 'forward' when db between 1e-6 and 10800 and pb is not null and latitude + longitude is not null then 'backward' end as pair from g)"""


@query(f"with {PAIR} select trajectory_id, epoch_us(time) as time_us, pair, round(case pair when 'central' then da + db when 'forward' then da when 'backward' then db end, 6) + 0.0 as dt_s from pr")
def drift_pair(spark, sf_dir):
    return drift.chosen_pair(hourly(spark, sf_dir, "linear_wrapped")).select(tr.ID, tr.TIME, "pair", "dt_s")


def geodesic_sql(rounds: int = 8) -> str:
    """Vincenty's inverse formulae of ``ends``, a fixed number of rounds: d (metres) and az (radians)."""
    flat_, a, b = "(1 / 298.257223563)", "6378137.0", "(6378137.0 * (1 - 1 / 298.257223563))"
    out = f"""g0 as (select *, radians(lo2) - radians(lo1) as turn, radians(lo2) - radians(lo1) as lam, atan((1 - {flat_}) * tan(radians(la1))) as u1, atan((1 - {flat_}) * tan(radians(la2))) as u2 from ends)"""
    for k in range(rounds):
        out += f""",
        s{k} as (select *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs from g{k}),
        t{k} as (select *, atan2(ss, cs) as sg, case when ss > 0 then cos(u1) * cos(u2) * sin(lam) / ss else 0 end as sa from s{k}),
        w{k} as (select *, 1 - sa * sa as ca, case when 1 - sa * sa > 0 then cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) else 0 end as cm, {flat_} / 16 * (1 - sa * sa) * (4 + {flat_} * (4 - 3 * (1 - sa * sa))) as cc from t{k}),
        g{k + 1} as (select * exclude (lam, ss, cs, sg, sa, ca, cm, cc), turn + (1 - cc) * {flat_} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) as lam {", ss, cs, sg, ca, cm" if k + 1 == rounds else ""} from w{k})"""
    return out + f""",
    h as (select *, ca * ({a} * {a} - {b} * {b}) / ({b} * {b}) as k from g{rounds}),
    hh as (select *, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) as big, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) as small from h),
    geo as (select *, case when lo1 = lo2 and la1 = la2 then 0 else {b} * big * (sg - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) end as d,
      case when lo1 = lo2 and la1 = la2 then 0 else atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) end as az from hh)"""


KEPT = f"{WRAPPED}, {STEPS}, flagged as (select *, {summary_sql(FLAGS)} from tests), kept as (select trajectory_id, time, latitude, longitude from flagged where summary_qc <> 4)"
ENDS = f"""{KEPT}, nb as (select *, {', '.join(f"{f}({c}) over {W} as {c[0]}{c[1]}{s}" for f, s in (('lag', 'b'), ('lead', 'a')) for c in ('time', 'latitude', 'longitude'))} from kept),
gaps as (select *, {SECONDS.format('tib', 'time')} as db, {SECONDS.format('time', 'tia')} as da, latitude + longitude is not null as here, lab + lob is not null as was, laa + loa is not null as will from nb),
pr as (select *, case when db between 1e-6 and 10800 and da between 1e-6 and 10800 and was and will then 1 when da between 1e-6 and 10800 and will and here then 2 when db between 1e-6 and 10800 and was and here then 3 end as pair from gaps),
ends as (select trajectory_id, time, pair, case pair when 1 then da + db when 2 then da when 3 then db end as dt, case when pair = 2 then latitude when pair is not null then lab end as la1, case when pair = 2 then longitude when pair is not null then lob end as lo1,
 case when pair = 3 then latitude when pair is not null then laa end as la2, case when pair = 3 then longitude when pair is not null then loa end as lo2 from pr)"""


@query(f"""with {ENDS}, {geodesic_sql()}, sp as (select *, d / dt as speed from geo)
select trajectory_id, epoch_us(time) as time_us, round(case when speed <= 3 then speed * sin(az) end, 6) + 0.0 as drifter_u_m_s, round(case when speed <= 3 then speed * cos(az) end, 6) + 0.0 as drifter_v_m_s,
 round(case when speed <= 3 then speed end, 6) + 0.0 as drifter_speed_m_s, round(case when speed <= 3 then degrees(az) + 360 - 360 * floor((degrees(az) + 360) / 360) end, 3) + 0.0 as drifter_direction_to_deg,
 round(dt, 6) + 0.0 as drifter_velocity_dt_s, round(d, 3) + 0.0 as drifter_velocity_distance_m, case when speed is null then 9 when speed > 3 then 4 else 1 end as drifter_velocity_qc_flag from sp""")
def drift_velocity(spark, sf_dir):
    out = jobs.hourly_with_drift(ad.observations(spark, sf_dir))
    coarse = {c: F.round(c, 3) for c in ("drifter_direction_to_deg", "drifter_velocity_distance_m")}
    return out.withColumns(coarse).select(
        tr.ID, tr.TIME, "drifter_u_m_s", "drifter_v_m_s", "drifter_speed_m_s", "drifter_direction_to_deg", "drifter_velocity_dt_s", "drifter_velocity_distance_m", quality.VELOCITY_FLAG
    )


@query(f"with {BUOY} select trajectory_id, obs_index, round(latitude, 6) + 0.0 as windSpeed, len(varianceDensity)::int as n, round(varianceDensity[3], 6) + 0.0 as third from buoy")
def legacy_names(spark, sf_dir):
    old = ad.buoy_spectra(spark, sf_dir).withColumnsRenamed({"varianceDensity": "variance_density"}).withColumn("u10", F.col("latitude"))
    return archive.normalise_names(old).select(tr.ID, "obs_index", "windSpeed", F.size("varianceDensity").alias("n"), F.get("varianceDensity", F.lit(2)).alias("third"))


@query(f"with {OBS} select trajectory_id, obs_index, epoch_us(time) as time_us from obs where time >= timestamp '2024-01-03' and time < timestamp '2024-01-29'")
def time_subset(spark, sf_dir):
    return tr.subset_time(ad.observations(spark, sf_dir), START, END, end_inclusive_day=True).select(tr.ID, "obs_index", tr.TIME)


@query(f"""with {BUOY} select trajectory_id, epoch_us(time) // 1000000 * 1000000 as time_us, round(case when trajectory_id like '%7' then null else round(latitude, 4) end, 6) + 0.0 as latitude,
 case when trajectory_id like '%4' then null else 'source ' || obs_index end as processingSource, 64::int as n_frequencies, count(v) as n_values, round(coalesce(sum(v), 0), 6) as total
 from (select *, {CELL} as v from buoy, unnest(range(64)) u(k)) where trajectory_id not like '%31' and trajectory_id not like '%2' group by all""")
def parsed_rows(spark, sf_dir):
    """Raw text columns, as a file has them, to typed ones; rows without spectra drop out."""
    b = ad.buoy_spectra(spark, sf_dir)
    item = F.transform("varianceDensity", lambda v, k: F.when(k == 5, "-").when(k == 9, "").otherwise(F.coalesce(F.round(v * 10000).cast("long").cast("string"), F.lit("nan"))))
    name = F.col(tr.ID)
    raw = b.select(
        tr.ID,
        F.unix_seconds(tr.TIME).cast("string").alias(files.TIME_HEADER),
        F.when(name.like("%7"), "bad").otherwise(F.round("latitude", 4).cast("string")).alias("Latitude (deg)"),
        F.when(name.like("%2"), "-").otherwise(F.array_join(F.transform("frequency", lambda f: f.cast("string")), ";")).alias("f"),
        F.when(name.like("%31"), "-").otherwise(F.array_join(item, ";")).alias("varianceDensity"),
        F.when(~name.like("%4"), F.concat(F.lit("source "), "obs_index")).alias("Processing Source"),
        F.lit("x").alias("Unknown header"),
    )
    known = F.filter("varianceDensity", lambda x: x.isNotNull())
    rows = files.parse_raw(raw)
    return rows.select(tr.ID, tr.TIME, "latitude", "processingSource", F.size("frequency").alias("n_frequencies"), F.size(known).cast("long").alias("n_values"), F.aggregate(known, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"with {REBIN} select trajectory_id, b.obs_index, freq_idx, {r('x')} from binned join buoy b using (trajectory_id)")
def rebin_kept(spark, sf_dir):
    b = spectra.rebinned(ad.buoy_spectra(spark, sf_dir), ad.SOURCE_FREQUENCY, keep=("obs_index", "absent"))
    return b.select(tr.ID, "obs_index", F.posexplode("varianceDensity").alias("freq_idx", "x"))


@query(f"""with {COLLOCATED} select trajectory_id, epoch_us(time) as time_us, round(model_value_era5_swh, 6) + 0.0 as model_value_gfs_Thgt, round(error_era5_swh, 6) + 0.0 as error_gfs_Thgt, round(model_value_era5_pp1d, 6) + 0.0 as model_value_gfs_Tper,
 round(error_era5_pp1d, 6) + 0.0 as error_gfs_Tper, {r('error_era5_swh', 'error_era5_pp1d')} from errors""")
def two_models(spark, sf_dir):
    """Two models at once, the second in two sets that lie one after the other."""
    era5 = ad.grid(spark, sf_dir)
    gfs = era5.withColumnsRenamed({"swh": "Thgt", "pp1d": "Tper"})
    middle = F.lit(datetime(2024, 1, 16))
    gfs = collocate.union_grids([gfs.where(F.col(tr.TIME) < middle), gfs.where(F.col(tr.TIME) >= middle)])
    out = collocate.model_errors(hourly(spark, sf_dir), {"era5": era5, "gfs": gfs})
    return out.select(tr.ID, tr.TIME, *(f"{a}_gfs_{v}" for a in ("model_value", "error") for v in ("Thgt", "Tper")), "error_era5_swh", "error_era5_pp1d")


def in_region(sql: str) -> str:
    """A query's SQL over the rows of the region and period instead of all rows."""
    return sql.replace(WHOLE, SUB)


REGION = jobs.Region(START, END, **BOX)
BULK_FLAGS = [*FLAGS, "swh_model_qc", "peak_period_model_qc"]
BULK = f"""{COLLOCATED}, {STEPS}, modelled as (select t.*, {compared('error_era5_swh', 2, 4)} as swh_model_qc, {compared('error_era5_pp1d', 4, 8)} as peak_period_model_qc, error_era5_swh, error_era5_pp1d
 from tests t join errors e on t.trajectory_id = e.trajectory_id and t.time = e.time), flagged as (select *, {summary_sql(BULK_FLAGS)} from modelled)"""


@query(in_region(f"with {BULK} select trajectory_id, epoch_us(time) as time_us, {r('latitude', 'error_era5_swh', 'error_era5_pp1d')}, stuck_position_qc, swh_model_qc, summary_qc from flagged where summary_qc <> 4"))
def bulk_job(spark, sf_dir):
    kept, _ = jobs.bulk(ad.observations(spark, sf_dir), {"era5": ad.grid(spark, sf_dir)}, REGION)
    return kept.select(tr.ID, tr.TIME, "latitude", "error_era5_swh", "error_era5_pp1d", "stuck_position_qc", "swh_model_qc", "summary_qc")


@query(in_region(ORACLES["drift_velocity"]))
def drift_job(spark, sf_dir):
    out, _ = jobs.bulk_with_drift(ad.observations(spark, sf_dir), {}, REGION)
    coarse = {c: F.round(c, 3) for c in ("drifter_direction_to_deg", "drifter_velocity_distance_m")}
    return out.withColumns(coarse).select(
        tr.ID, tr.TIME, "drifter_u_m_s", "drifter_v_m_s", "drifter_speed_m_s", "drifter_direction_to_deg", "drifter_velocity_dt_s", "drifter_velocity_distance_m", quality.VELOCITY_FLAG
    )


@query(ORACLES["hs_metrics"].replace(BUOY, BUOY.replace("buoy as (", "buoy as (select * from (", 1) + " where time between timestamp '2024-01-10' and timestamp '2024-01-10 20:00:00')"))
def spectral_job(spark, sf_dir):
    day = datetime(2024, 1, 10)
    _, _, heights = jobs.spectral(ad.buoy_spectra(spark, sf_dir), ad.model_spectra(spark, sf_dir), ad.points(spark, sf_dir), ad.SOURCE_FREQUENCY, start=day, end=day.replace(hour=20))
    return heights


@query(f"""with {NEW}, all_rows as (select * from old union all select n.* replace (case when n.obs_index % 2 = 0 then n.significantWaveHeight end as significantWaveHeight) from new n left join lim l using (trajectory_id)
where (l.a is null or n.time < l.a or n.time > l.b) and n.latitude between -74 and -39)
select trajectory_id, epoch_us(time) as time_us, row_number() over (order by trajectory_id, time, obs_index) - 1 as obs_index, {r('significantWaveHeight')} from all_rows""")
def merge_job(spark, sf_dir):
    old, new = parts(spark, sf_dir)
    merged = jobs.merge_archives(old, new.where("obs_index % 2 = 0"), new.where("obs_index % 2 = 1").drop("significantWaveHeight"))
    return merged.select(tr.ID, tr.TIME, "obs_index", "significantWaveHeight")
