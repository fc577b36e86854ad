"""Column-wise features that need no fitting, or a bound that the caller has fitted."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Periods of the cyclical parts.
PERIODS = {"month": 12, "day": 31, "dayofweek": 7, "dayofyear": 366, "hour": 24, "minute": 60, "second": 60, "quarter": 4, "week": 52}
BASIC_PARTS = ("year", "month", "day", "dayofweek", "quarter", "week", "is_weekend")


def date_part(column: Column, part: str) -> Column:
    day = column.cast("date")
    make = {
        "year": lambda: F.year(column), "month": lambda: F.month(column), "day": lambda: F.dayofmonth(column), "dayofweek": lambda: F.weekday(column), "quarter": lambda: F.quarter(column),
        "week": lambda: F.weekofyear(column), "is_weekend": lambda: (F.weekday(column) >= 5).cast("int"), "dayofyear": lambda: F.dayofyear(column), "hour": lambda: F.hour(column), "minute": lambda: F.minute(column),
        "second": lambda: F.second(column).cast("int"), "is_month_start": lambda: (F.dayofmonth(column) == 1).cast("int"), "is_month_end": lambda: (day == F.last_day(day)).cast("int"),
        "is_quarter_start": lambda: (day == F.trunc(day, "quarter")).cast("int"), "is_quarter_end": lambda: (day == F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)).cast("int"), "epoch_days": lambda: F.unix_date(day),
    }
    return make[part]()


def decompose_date(df: DataFrame, column: str, parts: Iterable[str] | None = None) -> tuple[DataFrame, list[str]]:
    """column_part for each part, and the parts; by default an hour is among them if some value is not at midnight, which is to be frozen from training."""
    if parts is None:
        timed = df.agg(F.bool_or((F.hour(column) != 0) | (F.minute(column) != 0) | (F.second(column) != 0)).alias("t")).first()["t"]
        parts = [*BASIC_PARTS, *(["hour"] if timed else [])]
    parts = list(parts)
    return df.withColumns({f"{column}_{p}": date_part(F.col(column), p) for p in parts}), parts


def cyclical(df: DataFrame, column: str, part: str | None = None, period: float | None = None) -> DataFrame:
    """Sine and cosine of a date part or of a number; a number's period is its range and one more unless it is given."""
    value = date_part(F.col(column), part).cast("double") if part else F.col(column).cast("double")
    if period is None:
        if part:
            period = PERIODS[part]
        else:
            ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
            period = (ends["b"] - ends["a"] + 1) if ends["a"] is not None else 1
    name = f"{column}_{part}" if part else column
    turn = F.lit(2 * math.pi / period) * value
    return df.withColumns({f"{name}_sin": F.sin(turn), f"{name}_cos": F.cos(turn)})


def ratio(df: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """a / b, null where b is 0."""
    return df.withColumn(name or f"{a}_over_{b}", F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")))


def interaction(df: DataFrame, columns: list[str], numeric: bool, name: str | None = None) -> DataFrame:
    """The product of numbers, else the crossed levels joined by a bar."""
    made = F.col(columns[0]).cast("double")
    for c in columns[1:]:
        made = made * F.col(c).cast("double")
    return df.withColumn(name or "_x_".join(columns), made if numeric else F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")) for c in columns]))


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interactions: bool = True) -> DataFrame:
    """Powers 2 to degree (at most 3) and the pairwise products."""
    out = {f"{c}_pow{k}": F.pow(F.col(c).cast("double"), F.lit(float(k))) for c in columns for k in range(2, min(degree, 3) + 1)}
    if interactions:
        out |= {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for i, a in enumerate(columns) for b in columns[i + 1 :]}
    return df.withColumns(out)


def log_transform(df: DataFrame, column: str, signed: bool | None = None) -> DataFrame:
    """log1p, or with its sign where the column has negative values; which one is to be frozen from training."""
    if signed is None:
        low = df.agg(F.min(column).alias("m")).first()["m"]
        signed = low is not None and low < 0
    x = F.col(column).cast("double")
    return df.withColumn(f"{column}_log", F.signum(x) * F.log1p(F.abs(x)) if signed else F.log1p(x))


def sqrt_transform(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.withColumn(f"{column}_sqrt", F.signum(x) * F.sqrt(F.abs(x)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along the great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def geo_distance(df: DataFrame, lat: str, lon: str, to: tuple[str, str] | tuple[float, float] | None = None, name: str = "distance_km") -> tuple[DataFrame, tuple]:
    """Distance to another pair of columns, to a point, or to the training centroid, which is returned."""
    if to is None:
        row = df.agg(F.avg(lat).alias("a"), F.avg(lon).alias("b")).first()
        to = (row["a"], row["b"])
    there = [F.col(x) if isinstance(x, str) else F.lit(x).cast("double") for x in to]
    return df.withColumn(name, haversine(F.col(lat), F.col(lon), *there)), to


def text_length(df: DataFrame, column: str) -> DataFrame:
    """Characters and words; null has none."""
    x = F.coalesce(F.col(column), F.lit(""))
    return df.withColumns({f"{column}_chars": F.length(x).cast("long"), f"{column}_words": F.regexp_count(x, F.lit(r"\S+")).cast("long")})
