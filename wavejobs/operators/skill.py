"""Scores of models against observations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collocate import MODELS
from .trajectories import TIME


def analysis_hour(start: datetime, time: str = TIME) -> Column:
    """Full hours since ``start``; negative before it."""
    return F.floor((F.unix_micros(time) - F.unix_micros(F.lit(start))) / 3_600_000_000).cast("int")


def long_errors(df: DataFrame) -> DataFrame:
    """One row for each model and variable: error, model_value, data_value."""
    rows = [
        F.struct(F.lit(m).alias("model"), F.lit(v).alias("model_var"), F.col(f"error_{m}_{v}").alias("error"), F.col(f"model_value_{m}_{v}").alias("model_value"), F.col(c).alias("data_value"))
        for m, variables in MODELS.items()
        for v, c in variables.items()
        if f"error_{m}_{v}" in df.columns
    ]
    return df.select(TIME, F.explode(F.array(*rows)).alias("x")).select(TIME, "x.*")


def bias_by_hour(df: DataFrame, start: datetime) -> DataFrame:
    rows = long_errors(df).withColumn("analysis_hour", analysis_hour(start))
    return rows.groupBy("model", "model_var", "analysis_hour").agg(F.avg("error").alias("bias"), F.avg("model_value").alias("model_value"), F.avg("data_value").alias("data_value"))


def display_limits(bias: DataFrame) -> DataFrame:
    unit = F.when(F.col("model_var").isin("Thgt", "swh"), "m").otherwise("s")
    both = bias.groupBy("model", "model_var").agg(*(f(c).alias(f"{c}_{n}") for c in ("bias", "model_value") for n, f in (("min", F.min), ("max", F.max))))
    return both.withColumn("unit", unit)


def pair_skill(df: DataFrame, x: str, y: str) -> DataFrame:
    """Skill and linear trend of y over x on rows that have both."""
    d = F.col("y") - F.col("x")
    mae = F.avg(F.abs(d))
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    return rows.agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        mae.alias("mae"),
        F.try_divide(mae, F.avg(F.abs("x"))).alias("rmae"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    )
