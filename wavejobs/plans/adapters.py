"""Wave-buoy inputs derived from the general test tables, in Spark and in DuckDB SQL.

Both engines use the same arithmetic, without trigonometry, so inputs agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOURS = {"spark": "cast((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 3600000000D as double)", "duckdb": "((epoch_us(ts) - 1704067200000000) / 3600000000::double)"}
STAMP = {"spark": "timestamp_micros(cast({} as bigint))", "duckdb": "make_timestamp(cast({} as bigint))"}
DAY_10 = 1704844800000000  # 2024-01-10, microseconds


def observations_sql(engine: str) -> str:
    time = "cast(ts as timestamp)" if engine == "spark" else "ts"
    source = "{events}" if engine == "spark" else "events"
    return f"""
    select 'B' || lpad(cast(user_id as varchar(20)), 5, '0') as trajectory_id, event_id as obs_index, {time} as time,
      case when event_id % 97 = 0 then null else value / 15 end as significantWaveHeight,
      case when event_id % 89 = 0 then null else cast(1.05 + (event_id * 13 % 400) / 10.0 as double) end as peakPeriod,
      cast(-66 + user_id % 14 + 0.013 * H * (user_id % 3) + case when event_id % 61 = 0 then 0.5 else 0 end as double) as latitude,
      cast(case when x >= 180 then x - 360 else x end as double) as longitude
    from (select *, cast(178 + user_id % 5 + 0.02 * G * (user_id % 4) as double) as x
      from (select *, case when user_id % 12 = 6 then floor(H / 18) * 18 + least(H - floor(H / 18) * 18, 9) else H end as G
        from (select *, {HOURS[engine]} as H from {source}) a) b) c"""


def grid_sql(engine: str) -> str:
    t = "floor(unix_micros(cast(ts as timestamp)) / 21600000000)" if engine == "spark" else "floor(epoch_us(ts) / 21600000000)"
    source = "{events}" if engine == "spark" else "events"
    many = "explode(sequence({}, {}))" if engine == "spark" else "unnest(range({}, {} + 1))"
    return f"""
    select {STAMP[engine].format("t * 21600000000")} as time, cast(-70 + 5 * i as double) as latitude, cast(-180 + 5 * j as double) as longitude,
      case when (i + j) % 11 = 0 then null else cast(2 + ((3 * t + 5 * i + 7 * j) % 23) / 10.0 as double) end as swh,
      cast(6 + ((t + 2 * i + 3 * j) % 17) / 2.0 as double) as pp1d
    from (select t, i, {many.format(0, 71)} as j from (select t, {many.format(0, 7)} as i from (select distinct cast({t} as bigint) as t from {source}) a) b) c"""


def points_sql(engine: str) -> str:
    source = "{embeddings}" if engine == "spark" else "embeddings"
    return f"""
    select p as point_id, cast(-66 + (p % 40) * 0.4 as double) as latitude, cast(-170 + floor(p / 40) * 1.3 as double) as longitude
    from (select distinct cast(floor(vec_id / 8) as int) as p from {source}) a"""


def model_spectra_sql(engine: str) -> str:
    source = "{embeddings}" if engine == "spark" else "embeddings"
    cell = "case when (f + d + vec_id) % 37 = 0 or vec_id % 41 = 7 then null else cast(-1 - abs(cast(embedding[{}] as double)) * 4 - ((vec_id + 2 * f + 3 * d) % 40) / 10.0 as double) end"
    if engine == "spark":
        lists = f"transform(sequence(0, 29), f -> transform(sequence(0, 23), d -> {cell.format('(f * 24 + d) % 64')}))"
    else:
        lists = f"list_transform(range(30), lambda f: list_transform(range(24), lambda d: {cell.format('(f * 24 + d) % 64 + 1')}))"
    return f"select {STAMP[engine].format(f'{DAY_10} + 10800000000 * (vec_id % 8)')} as time, cast(floor(vec_id / 8) as int) as point_id, {lists} as d2fd from {source}"


def buoy_spectra_sql(engine: str) -> str:
    source = "{embeddings}" if engine == "spark" else "embeddings"
    cell = "case when (vec_id + k) % 29 = 0 then null else cast(embedding[{}] as double) * cast(embedding[{}] as double) end"
    if engine == "spark":
        density = f"transform(sequence(0, 63), k -> {cell.format('k', 'k')})"
        freq = "transform(sequence(0, 63), k -> cast(0.0293 + 0.0078125 * k as double))"
    else:
        density = f"list_transform(range(64), lambda k: {cell.format('k + 1', 'k + 1')})"
        freq = "list_transform(range(64), lambda k: cast(0.0293 + 0.0078125 * k as double))"
    minutes = "((vec_id * 11) % 61 - 30 + case when vec_id % 13 = 0 then 45 else 0 end)"
    return f"""
    select 'S' || cast(vec_id as varchar(20)) as trajectory_id, vec_id as obs_index, {STAMP[engine].format(f'{DAY_10} + 10800000000 * (vec_id % 8) + 60000000 * {minutes}')} as time,
      cast(-66 + (floor(vec_id / 8) % 40) * 0.4 + (vec_id % 5 - 2) * 0.11 + case when vec_id % 17 = 0 then 9 else 0 end as double) as latitude,
      cast(-170 + floor(floor(vec_id / 8) / 40) * 1.3 + (vec_id % 3 - 1) * 0.2 as double) as longitude,
      {freq} as frequency, {density} as varianceDensity
    from {source}"""


SOURCE_FREQUENCY = [0.0293 + 0.0078125 * k for k in range(64)]


def _sql(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, observations_sql("spark"), "events")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, grid_sql("spark"), "events")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, points_sql("spark"), "embeddings")


def model_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, model_spectra_sql("spark"), "embeddings")


def buoy_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, buoy_spectra_sql("spark"), "embeddings")
