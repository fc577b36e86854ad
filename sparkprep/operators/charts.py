"""The data behind charts: small tables from aggregates over all rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.quantiles import column_quantiles
from sparkprep.functions.tables import digest, to_long
from sparkprep.operators.profile import fences


def histogram(df: DataFrame, column: str, bins: int = 40, by: str | None = None) -> DataFrame:
    """bin 1..bins, lower, upper, n (for each class of ``by``); the last bin holds the maximum."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    rows = df.where(x.isNotNull()).join(F.broadcast(ends), how="cross")
    width = (F.col("b") - F.col("a")) / bins
    k = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins), (F.floor((x - F.col("a")) / width) + 1))).otherwise(1).cast("int")
    out = rows.groupBy(*([by] if by else []), k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return out.select(*([by] if by else []), "bin", (F.col("a") + (F.col("bin") - 1) * width).alias("lower"), (F.col("a") + F.col("bin") * width).alias("upper"), "n")


def box_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, q1, median, q3, whisker_low, whisker_high (the ends inside 1.5 spreads), n_outside."""
    bounds = F.broadcast(fences(df, columns))
    medians = column_quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    rows = df.join(bounds, how="cross").withColumns({f"m{i}": F.lit(medians[c][0]).cast("double") for i, c in enumerate(columns)})
    aggs, fields = [], {}
    for i, c in enumerate(columns):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        inside = (F.col(c) >= a - 1.5 * (b - a)) & (F.col(c) <= b + 1.5 * (b - a))
        aggs += [F.max(a).alias(f"qa{i}"), F.max(f"m{i}").alias(f"qm{i}"), F.max(b).alias(f"qb{i}"), F.min(F.when(inside, F.col(c).cast("double"))).alias(f"lo{i}"), F.max(F.when(inside, F.col(c).cast("double"))).alias(f"hi{i}"), F.count_if(~inside).alias(f"o{i}")]
        fields[c] = {"q1": F.col(f"qa{i}"), "median": F.col(f"qm{i}"), "q3": F.col(f"qb{i}"), "whisker_low": F.col(f"lo{i}"), "whisker_high": F.col(f"hi{i}"), "n_outside": F.col(f"o{i}")}
    return to_long(rows.agg(*aggs), fields)


def bar(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """label, n: the commonest values with "(missing)"."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)


def missingness(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, n_missing, fraction, worst first."""
    names = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    long = to_long(one, {c: {"n_missing": F.col(f"m{i}"), "fraction": F.try_divide(F.col(f"m{i}"), F.col("n"))} for i, c in enumerate(names)})
    return long.orderBy(F.desc("n_missing"), "column")


def heat_map(df: DataFrame, columns: list[str], target: str | None = None, most: int = 16) -> DataFrame:
    """a, b, r of both halves and the diagonal; the columns most correlated with the target, else those of most spread, if there are too many."""
    from sparkprep.operators.associate import pearson_pairs

    if len(columns) > most:
        if target:
            strong = pearson_pairs(df, [*columns, target]).where((F.col("a") == target) | (F.col("b") == target)).select(F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("c"), F.abs("r").alias("r"))
            columns = [r["c"] for r in strong.orderBy(F.desc_nulls_last("r"), "c").limit(most).collect()]
        else:
            row = df.agg(*[F.abs(F.try_divide(F.stddev_samp(c), F.avg(c))).alias(c) for c in columns]).first().asDict()
            columns = sorted(columns, key=lambda c: (-(row[c] or 0), c))[:most]
    half = pearson_pairs(df, columns).select("a", "b", "r")
    same = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(same)


def line(df: DataFrame, time: str, value: str, step: str = "day", statistic: str = "mean") -> DataFrame:
    """t, value: one point a step."""
    make = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[statistic]
    return df.groupBy(F.date_trunc(step, time).alias("t")).agg(make(value).alias("value")).orderBy("t")


def forecast_against_actual(df: DataFrame, time: str, actual: str, predicted: str, step: str | None = None) -> DataFrame:
    """t, actual, predicted in order of time, of the rows that have a time; with a step the means of each, which bounds the points by the span."""
    rows = df.where(F.col(time).isNotNull()).select((F.date_trunc(step, time) if step else F.col(time)).alias("t"), F.col(actual).cast("double").alias("actual"), F.col(predicted).cast("double").alias("predicted"))
    return (rows.groupBy("t").agg(F.avg("actual").alias("actual"), F.avg("predicted").alias("predicted")) if step else rows).orderBy("t", "actual", "predicted")


def scatter(df: DataFrame, x: str, y: str, key: str, most: int = 6000, seed: int = 0) -> DataFrame:
    """x, y of at most so many rows, drawn by digest."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(digest(key, seed), key).limit(most).select(x, y)
