"""Profile statistics: each operator returns one long table, most of them from a single wide aggregate."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.quantiles import column_quantiles, group_medians
from sparkprep.functions.tables import durable, known, numeric_columns, string_columns, to_long

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _hashable(df: DataFrame, column: str) -> Column:
    """Maps and nested values are counted by their JSON text."""
    nested = isinstance(df.schema[column].dataType, T.MapType | T.ArrayType | T.StructType)
    return F.to_json(column) if nested else F.col(column)


def value_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, whole, real, text, n: how often each value is in each column, nulls left out; and in a row of no column the number of rows.

    One explode to narrow cells and one shuffle, in which counts are added up in the tasks first,
    whatever the number of columns; cells have their column's number, names are put on afterwards. Whole numbers are told apart as such, other numbers as doubles, all else as text.
    """
    names = known(df, columns)
    cells = [F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("whole"), F.lit(None).cast("double").alias("real"), F.lit(None).cast("string").alias("text"))]
    for k, c in enumerate(names, 1):
        kind = df.schema[c].dataType
        whole, real = isinstance(kind, T.IntegralType), isinstance(kind, T.DoubleType | T.FloatType)
        cells.append(F.struct(
            F.lit(k).alias("k"), (F.col(c).cast("long") if whole else F.lit(None).cast("long")).alias("whole"), (F.col(c).cast("double") if real else F.lit(None).cast("double")).alias("real"),
            (F.lit(None).cast("string") if whole or real else _hashable(df, c).cast("string")).alias("text"),
        ))
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    counted = long.where("k = 0 or whole is not null or real is not null or text is not null").groupBy("k", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))
    named = F.array(F.lit(None).cast("string"), *map(F.lit, names))
    return counted.select(F.get(named, F.col("k")).alias("column"), "whole", "real", "text", "n")


def _by_column(counts: DataFrame, names: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """column, n_rows and the aggregates of its counts: a row a name, also of a column without values."""
    one = counts.agg(F.coalesce(F.sum(F.when(F.col("column").isNull(), F.col("n"))), F.lit(0)).alias("n_rows"))
    each = one.select(F.explode(F.array(*map(F.lit, names))).alias("column"), "n_rows")
    got = counts.where("column is not null").groupBy(F.col("column").alias("_c")).agg(*[v.alias(k) for k, v in aggregates.items()])
    return each.join(got, F.col("column") == F.col("_c"), "left").drop("_c")


def column_counts(df: DataFrame, columns: Iterable[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """column, n_rows, n_missing, missing_fraction, n_distinct, cardinality_ratio, is_constant; ``counts`` are the value counts, if they are at hand."""
    names = known(df, columns)
    got = _by_column(value_counts(df, names) if counts is None else counts, names, {"v": F.sum("n"), "d": F.count(F.lit(1))})
    n, v, d = F.col("n_rows"), F.coalesce("v", F.lit(0)), F.coalesce("d", F.lit(0))
    return got.select(
        "column", "n_rows", (n - v).alias("n_missing"), F.coalesce(F.try_divide(n - v, n), F.lit(0.0)).alias("missing_fraction"),
        d.alias("n_distinct"), F.coalesce(F.try_divide(d, v), F.lit(0.0)).alias("cardinality_ratio"), (d <= 1).alias("is_constant"),
    )


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Sample skewness G1 from Spark's population form; null below three values, 0 without spread."""
    return F.when(n >= 3, F.coalesce(F.nullif(g1, F.lit(float("nan"))) * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis G2 from Spark's population form; null below four values."""
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.nullif(g2, F.lit(float("nan"))) + 6), F.lit(0.0)))


def moments(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, n, mean, std, variance, minimum, maximum, skew, kurtosis, zero_fraction, negative_fraction; adjusted moments."""
    names = [c for c in known(df, columns) if c in numeric_columns(df)]
    aggs, fields = [], {}
    for i, c in enumerate(names):
        x = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.skewness(x).alias(f"g{i}"), F.kurtosis(x).alias(f"k{i}"), F.avg((x == 0).cast("double")).alias(f"z{i}"), F.avg((x < 0).cast("double")).alias(f"neg{i}"),
        ]
        n = F.col(f"n{i}")
        std = F.when(n == 1, 0.0).otherwise(F.col(f"s{i}"))
        fields[c] = {
            "n": n, "mean": F.col(f"m{i}"), "std": std, "variance": std * std, "minimum": F.col(f"lo{i}"), "maximum": F.col(f"hi{i}"),
            "skew": adjusted_skew(n, F.col(f"g{i}")), "kurtosis": adjusted_kurtosis(n, F.col(f"k{i}")), "zero_fraction": F.col(f"z{i}"), "negative_fraction": F.col(f"neg{i}"),
        }
    return to_long(df.agg(*aggs), fields)


def _quantile_rows(counts: DataFrame, probabilities: Iterable[float]) -> DataFrame:
    """column, n, p, q: quantiles by linear interpolation, a row each.

    Counts run up in a global order of (column, value), and the one or two values at each
    wanted rank are picked by a join with the few ranks, so no task holds a column.
    """
    from sparkprep.functions.tables import global_running

    numbers = counts.where("whole is not null or real is not null").select("column", F.coalesce(F.col("whole").cast("double"), "real").alias("v"), "n").groupBy("column", "v").agg(F.sum("n").alias("n"))
    numbers = durable(numbers)  # sampled for its ranges, dealt to them and added up
    run = global_running(numbers, [F.col("column"), F.col("v")], {"_upto": F.col("n")})
    earlier = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # a row a column
    ends = numbers.groupBy(F.col("column").alias("_c")).agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    wanted = ends.select("_c", "_n", "_before", ps.alias("p")).withColumn("_rank", (F.col("_n") - 1) * F.col("p")).withColumn("_low", F.floor("_rank"))
    upto = F.col("_upto") - F.col("_before")
    hits = run.join(F.broadcast(wanted), (F.col("column") == F.col("_c")) & (upto - F.col("n") <= F.col("_low") + 1) & (F.col("_low") < upto))  # a row a column and probability
    pick = lambda at: F.max(F.when((upto - F.col("n") <= at) & (at < upto), F.col("v")))
    found = hits.groupBy("column", F.col("_n").alias("n"), "p", (F.col("_rank") - F.col("_low")).alias("part")).agg(pick(F.col("_low")).alias("a"), pick(F.col("_low") + 1).alias("b"))
    return found.select("column", "n", "p", (F.col("a") + F.col("part") * (F.coalesce("b", "a") - F.col("a"))).alias("q"))


def quantiles(df: DataFrame, columns: Iterable[str] | None = None, probabilities: tuple[float, ...] = QUANTILES, found: dict[str, list] | None = None) -> DataFrame:
    """column, q01.. with linear interpolation; exact, and no task holds a column's values. ``found`` are the columns' quantiles, if they are at hand."""
    names = [c for c in known(df, columns) if c in numeric_columns(df)]
    found = column_quantiles(df, {c: F.col(c) for c in names}, probabilities) if found is None else found
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in names], ", ".join(["column string", *[f"q{round(p * 100):02d} double" for p in probabilities]]))


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Numbers that are neither whole nor floating as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in names if isinstance(df.schema[c].dataType, T.DecimalType)})


def quantiles_by_rank(df: DataFrame, column: str, probabilities: tuple[float, ...] = QUANTILES) -> DataFrame:
    """probability, value of one column."""
    return _quantile_rows(value_counts(_numbers(df, [column]), [column]), probabilities).select(F.col("p").alias("probability"), F.col("q").alias("value"))


def fences(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """One row of n, q1, q3 per column index, as n{i}, a{i}, b{i}."""
    found = column_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75])
    ends = [x for i, c in enumerate(columns) for x in (F.lit(found[c][0]).cast("double").alias(f"a{i}"), F.lit(found[c][1]).cast("double").alias(f"b{i}"))]
    return df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).select("*", *ends)


def iqr_outliers(df: DataFrame, columns: Iterable[str] | None = None, multiplier: float = 1.5, quartiles: dict[str, tuple] | None = None) -> DataFrame:
    """column, lower, upper, n_outliers, outlier_fraction. Below four values none; without spread the bounds are the quartiles and nothing is outside.

    One scan counts what is outside; ``quartiles`` (25 and 75 %) are taken if they are at hand.
    """
    names = [c for c in known(df, columns) if c in numeric_columns(df)]
    ends = column_quantiles(df, {c: F.col(c) for c in names}, (0.25, 0.75)) if quartiles is None else quartiles
    aggs, bounds = [], {}
    for i, c in enumerate(names):
        x, (a, b) = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), ends[c]
        reach = multiplier * (b - a) if a is not None and b > a else 0.0
        bounds[c] = (None, None) if a is None else (a - reach, b + reach)
        aggs += [F.count(x).alias(f"n{i}"), (F.count_if((x < bounds[c][0]) | (x > bounds[c][1])) if reach else F.lit(0).cast("long")).alias(f"o{i}")]
    row = df.agg(*aggs).first() if names else None
    out = []
    for i, c in enumerate(names):
        n, o = row[f"n{i}"], row[f"o{i}"]
        some = n >= 4
        out.append((c, *(bounds[c] if some else (None, None)), o if some else 0, o / n if some else 0.0))
    return df.sparkSession.createDataFrame(out, "column string, lower double, upper double, n_outliers long, outlier_fraction double")


def top_values(df: DataFrame, columns: Iterable[str] | None = None, k: int = 12) -> DataFrame:
    """column, place, value, n, share of the non-null rows; ties by value. All columns are counted in one shuffle."""
    names = known(df, columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _hashable(df, c).cast("string").alias("value")) for c in names]))
    counted = df.select(cells.alias("c")).select("c.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("column").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    label = F.substring(F.regexp_replace("value", "\n", " "), 1, 100)
    return top.join(totals, "column").select("column", "place", label.alias("value"), "n", (F.col("n") / F.col("total")).alias("share"))


def near_zero_variance(df: DataFrame, columns: Iterable[str] | None = None, ratio: float = 19.0, unique: float = 0.10) -> DataFrame:
    """column, frequency_ratio, unique_ratio, near_zero_variance."""
    names = known(df, columns)
    top = top_values(df, names, k=2)
    ones = top.groupBy("column").agg(F.max(F.when(F.col("place") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("place") == 2, F.col("n"))).alias("n2"))
    counts = column_counts(df, names)
    numbers = moments(df, names).select("column", "std", "mean") if any(c in numeric_columns(df) for c in names) else None
    joined = counts.join(ones, "column", "left")
    joined = joined.join(numbers, "column", "left") if numbers is not None else joined.withColumn("std", F.lit(None).cast("double")).withColumn("mean", F.lit(None).cast("double"))
    frequency = F.try_divide(F.col("n1"), F.col("n2"))
    flat = (F.col("std") == 0) | (F.abs(F.try_divide(F.col("std"), F.col("mean"))) < 1e-4)
    near = (F.col("n_distinct") <= 1) | ((frequency > ratio) & (F.col("cardinality_ratio") < unique)) | F.coalesce(flat, F.lit(False))
    return joined.select("column", frequency.alias("frequency_ratio"), F.col("cardinality_ratio").alias("unique_ratio"), F.coalesce(near, F.lit(False)).alias("near_zero_variance"))


def string_statistics(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, mean_length, max_length, mean_tokens, n_blank, n_untrimmed."""
    names = [c for c in known(df, columns) if c in string_columns(df)]
    aggs, fields = [], {}
    for i, c in enumerate(names):
        x = F.col(c)
        aggs += [
            F.avg(F.length(x)).alias(f"a{i}"), F.max(F.length(x)).cast("long").alias(f"b{i}"), F.avg(F.regexp_count(x, F.lit(r"\S+"))).alias(f"t{i}"),
            F.count_if(~x.rlike(r"\S")).alias(f"k{i}"), F.count_if(x.rlike(r"^\s|\s$") & x.rlike(r"\S")).alias(f"u{i}"),
        ]
        fields[c] = {"mean_length": F.col(f"a{i}"), "max_length": F.col(f"b{i}"), "mean_tokens": F.col(f"t{i}"), "n_blank": F.col(f"k{i}"), "n_untrimmed": F.col(f"u{i}")}
    return to_long(df.agg(*aggs), fields)


def temporal_statistics(df: DataFrame, column: str) -> DataFrame:
    """minimum, maximum, span_days, n_stamps, modal_step_seconds, n_gaps, frequency of one time column.

    A gap is a step between neighbouring distinct stamps of more than 1.5 modal steps.
    """
    from sparkprep.functions.tables import global_running

    stamps = df.where(F.col(column).isNotNull()).select(F.unix_micros(F.col(column).cast("timestamp")).alias("t")).distinct()
    numbered = global_running(stamps, [F.col("t")], {}, number="k")
    steps = numbered.alias("x").join(numbered.select((F.col("k") + 1).alias("k"), F.col("t").alias("p")), "k").select(((F.col("t") - F.col("p")) / 1e6).alias("step"))
    modal = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col("step")).alias("less"))).alias("m")).select((-F.col("m.less")).alias("modal_step_seconds"))
    gaps = steps.join(F.broadcast(modal), how="cross").agg(F.count_if(F.col("step") > 1.5 * F.col("modal_step_seconds")).alias("n_gaps"), F.max("modal_step_seconds").alias("modal_step_seconds"))
    ends = stamps.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n_stamps"))
    s = F.col("modal_step_seconds")
    code = F.when(s == 1, "s").when(s == 60, "min").when(s == 3600, "h").when(s == 86400, "D").when(s == 604800, "W").when(s.between(28 * 86400, 31 * 86400), "MS").when(s.between(90 * 86400, 92 * 86400), "QS").when(s.between(365 * 86400, 366 * 86400), "YS")
    return ends.join(F.broadcast(gaps), how="cross").select(
        F.timestamp_micros("lo").alias("minimum"), F.timestamp_micros("hi").alias("maximum"), ((F.col("hi") - F.col("lo")) / 86400e6).alias("span_days"), "n_stamps", "modal_step_seconds", "n_gaps", code.alias("frequency")
    )


def table_overview(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, n_duplicates (first excluded), n_missing_cells, missing_fraction."""
    cells = [F.count_if(F.col(c).isNull()) for c in df.columns]
    missing = sum(cells[1:], cells[0])
    keys = [_hashable(df, c) for c in df.columns]
    groups = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("d"))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_missing_cells"))
    return one.join(F.broadcast(groups), how="cross").select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.coalesce("d", F.lit(0)).cast("long").alias("n_duplicates"), "n_missing_cells",
        F.coalesce(F.try_divide(F.col("n_missing_cells"), F.col("n_rows") * len(df.columns)), F.lit(0.0)).alias("missing_fraction"),
    )


def number_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, n, n_numeric, numeric_fraction, mixed (some but not all parse), stored_as_text (at least 90 % parse once commas are gone)."""
    names = [c for c in known(df, columns) if c in string_columns(df)]
    aggs, fields = [], {}
    for i, c in enumerate(names):
        aggs += [F.count(c).alias(f"n{i}"), F.count(F.regexp_replace(F.trim(c), ",", "").try_cast("double")).alias(f"p{i}")]
        n, p = F.col(f"n{i}"), F.col(f"p{i}")
        fraction = F.coalesce(F.try_divide(p, n), F.lit(0.0))
        fields[c] = {"n": n, "n_numeric": p, "numeric_fraction": fraction, "mixed": (p > 0) & (p < n), "stored_as_text": fraction >= 0.9}
    return to_long(df.agg(*aggs), fields)


def class_counts(df: DataFrame, target: str, max_classes: int = 50) -> DataFrame:
    """label, n, share, imbalance (largest over smallest class); the largest classes, ties by label."""
    counted = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"), (F.max("n") / F.min("n")).alias("imbalance"))
    return counted.join(F.broadcast(total), how="cross").select("label", "n", (F.col("n") / F.col("total")).alias("share"), "imbalance", (F.col("imbalance") > 3).alias("imbalanced")).orderBy(F.desc("n"), "label").limit(max_classes)


def profile_report(df: DataFrame, target: str | None = None, top: int = 12) -> dict[str, DataFrame]:
    """The whole profile: table (one row), columns (with their kinds), top (commonest values), correlations (of numbers) and target."""
    from sparkprep.operators.associate import pearson_pairs

    numbers = numeric_columns(df)
    out = {"table": table_overview(df), "columns": profile_table(df).join(infer_kinds(df), "column", "left"), "top": top_values(df, k=top)}
    if len(numbers) > 1:
        out["correlations"] = pearson_pairs(df, numbers)
    if target:
        out["target"] = target_summary(df, target)
    return out


def target_summary(df: DataFrame, target: str, max_classes: int = 50) -> DataFrame:
    """Of a continuous target its moments and quantiles in one row, else its classes."""
    if target in numeric_columns(df) and df.where(F.col(target).isNotNull()).select(target).distinct().limit(max_classes + 1).count() > max_classes:
        plain = _numbers(df, [target])
        return moments(plain, [target]).join(quantiles(plain, [target]), "column")
    return class_counts(df, target, max_classes)


def profile_table(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: counts, moments, quantiles and outliers where the column is numeric, string statistics where it is text.

    Only distinct values take a shuffle, of counts by value; moments, quantiles and outliers are scans.
    """
    names = known(df, columns)
    numbers, texts = [c for c in names if c in numeric_columns(df)], [c for c in names if c in string_columns(df)]
    plain = _numbers(df, numbers)
    out = column_counts(plain, names)
    if numbers:
        found = column_quantiles(plain, {c: F.col(c) for c in numbers}, QUANTILES)
        ends = {c: (q[QUANTILES.index(0.25)], q[QUANTILES.index(0.75)]) for c, q in found.items()}
        for part in (moments(plain, numbers).drop("n"), quantiles(plain, numbers, found=found), iqr_outliers(plain, numbers, quartiles=ends)):
            out = out.join(part, "column", "left")
    return out.join(string_statistics(df, texts), "column", "left") if texts else out


def group_statistics(df: DataFrame, by: list[str], columns: list[str], statistics: Iterable[str]) -> DataFrame:
    """Group aggregates by their usual names, as ``column_statistic``."""
    make = {
        "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "nunique": F.count_distinct,
        "skew": lambda c: adjusted_skew(F.count(c), F.skewness(c)),
    }
    wanted = list(statistics)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[make[s](F.col(c)).alias(f"{c}_{s}") for c in columns for s in wanted if s != "median"])
    if "median" in wanted:
        middle = group_medians(df, by, {f"{c}_median": F.col(c) for c in columns}).withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)})
        same = functools.reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
        out = out.join(middle, same)
    return out.select(*by, *[f"{c}_{s}" for c in columns for s in wanted])


def infer_kinds(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, kind, reason: what each column holds, by its type, counts, patterns and name.

    Kinds: numeric_continuous, numeric_discrete, categorical_nominal, categorical_ordinal,
    boolean, datetime, text, geo, identifier, constant, unknown. The aggregates are a
    row a column; the ladder over them runs on the driver.
    """
    from sparkprep.functions.tables import TIMES
    from sparkprep.functions.text import datetime_likeness, name_hints, semantic_types, vocabulary_of

    names = known(df, columns)
    counts = {r["column"]: r for r in column_counts(df, names).collect()}
    numbers, texts = [c for c in names if c in numeric_columns(df)], [c for c in names if c in string_columns(df)]
    shape = {r["column"]: r for r in moments(df, numbers).collect()} if numbers else {}
    whole = df.agg(*[F.bool_and(F.col(c) == F.floor(F.col(c))).alias(c) for c in numbers]).first().asDict() if numbers else {}
    words = {r["column"]: r for r in string_statistics(df, texts).collect()} if texts else {}
    patterns = {r["column"]: r["semantic_type"] for r in semantic_types(df, texts).collect()} if texts else {}
    dates = {r["column"]: r["is_datetime"] for r in datetime_likeness(df, texts).collect()} if texts else {}
    rows = []
    for c in names:
        n, hints, kind = counts[c], name_hints(c), df.schema[c].dataType
        unique = n["cardinality_ratio"] >= 0.999 and n["n_rows"] - n["n_missing"] >= 20
        if n["n_missing"] == n["n_rows"]:
            found = ("unknown", "no values")
        elif n["is_constant"]:
            found = ("constant", "one value")
        elif isinstance(kind, T.BooleanType):
            found = ("boolean", "type")
        elif isinstance(kind, TIMES):
            found = ("datetime", "type")
        elif c in numbers:
            low, high = shape[c]["minimum"], shape[c]["maximum"]
            if n["n_distinct"] == 2 and (low, high) == (0.0, 1.0):
                found = ("boolean", "0 and 1")
            elif "geo" in hints and -180 <= low and high <= 180:
                found = ("geo", "named like a coordinate and in its range")
            elif whole[c] and (unique or "identifier" in hints and n["cardinality_ratio"] > 0.9):
                found = ("identifier", "whole numbers, one a row")
            elif "date" in hints and whole[c] and 1e8 < low and high < 1e13:
                found = ("datetime", "seconds or milliseconds")
            elif whole[c]:
                found = ("numeric_discrete", "whole numbers")
            else:
                found = ("numeric_continuous", "fractions")
        elif c in texts:
            vocabulary = vocabulary_of(df, c)[0] if n["n_distinct"] <= 64 else None
            if patterns[c] == "uuid" or unique and words[c]["mean_tokens"] < 3 and patterns[c] not in ("number", "currency", "percentage"):
                found = ("identifier", patterns[c] or "one a row")
            elif dates[c]:
                found = ("datetime", "looks and parses like dates")
            elif patterns[c] in ("number", "currency", "percentage"):
                found = ("numeric_continuous", patterns[c])
            elif vocabulary == "boolean":
                found = ("boolean", "words for yes and no")
            elif vocabulary == "ordinal" or "ordinal" in hints:
                found = ("categorical_ordinal", "a known scale" if vocabulary else "named like a scale")
            elif words[c]["mean_tokens"] >= 5 and n["cardinality_ratio"] > 0.5:
                found = ("text", "many words, few repeats")
            else:
                found = ("categorical_nominal", "few words or many repeats")
        else:
            found = ("unknown", kind.simpleString())
        rows.append((c, *found))
    return df.sparkSession.createDataFrame(rows, "column string, kind string, reason string")
