"""Fitted encoders, scalers and selectors.

``fit_*`` looks at training rows only and returns plain values or a mapping frame;
the matching function applies them, so scoring never fits again. A mapping has a
row a level and is joined, not broadcast by hand: Spark broadcasts it by its size.
"""

from __future__ import annotations

from collections.abc import Iterable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.quantiles import column_quantiles, grid_quantiles

MISSING_LEVEL = "__MISSING__"


def level(column: str) -> Column:
    """A value as a level: its text, with null as a level of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LEVEL))


def look_up(df: DataFrame, column: str, mapping: DataFrame, value: str, name: str, default: object = None) -> DataFrame:
    """mapping (level, value) on each row; levels not in it get the default."""
    keyed = mapping.select(F.col("level").alias("_level"), F.col(value).alias("_value"))
    joined = df.withColumn("_key", level(column)).join(keyed, F.col("_key") == F.col("_level"), "left")
    return joined.withColumn(name, F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")).drop("_key", "_level", "_value")


def fit_levels(df: DataFrame, column: str, max_levels: int = 50, min_frequency: float | None = None) -> list[str]:
    """The commonest levels, nulls read as the mode; ``min_frequency`` is a count from 1 on and a share below."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    if min_frequency:
        least = min_frequency if min_frequency >= 1 else min_frequency * df.count()
        counted = counted.where(F.col("n") >= least)
    return [r["level"] for r in counted.orderBy(F.desc("n"), "level").limit(max_levels).collect()]


def one_hot(df: DataFrame, column: str, levels: list[str], infrequent: bool = True) -> DataFrame:
    """column=level as 0 and 1; null counts as the commonest level; other values go to "infrequent", or are all zeros."""
    x = F.coalesce(F.col(column).cast("string"), F.lit(levels[0] if levels else MISSING_LEVEL))
    out = {f"{column}={v}": (x == v).cast("int") for v in levels}
    if infrequent:
        out[f"{column}=infrequent"] = (~x.isin(*levels)).cast("int") if levels else F.lit(1)
    return df.withColumns(out)


def ordinal(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Place among the levels; -1 for the missing and the unseen."""
    return df.withColumn(f"{column}_ordinal", F.coalesce(F.array_position(F.array(*map(F.lit, levels)), F.col(column).cast("string")) - 1, F.lit(-1)).cast("long"))


def fit_target_means(train: DataFrame, column: str, target: str, smoothing: float = 10.0) -> tuple[DataFrame, float]:
    """(level, encoded) of all training rows, and the prior."""
    prior = train.agg(F.avg(target).alias("p")).first()["p"]
    sums = train.groupBy(level(column).alias("level")).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    return sums.select("level", ((F.col("s") + smoothing * F.lit(prior)) / (F.col("n") + smoothing)).alias("encoded")), prior


def fit_target_folds(train: DataFrame, column: str, target: str, fold: str, smoothing: float = 10.0) -> tuple[DataFrame, dict[str, float]]:
    """((fold, level, value), fold -> prior): each fold's level means over the other folds, and those over all rows as fold -1."""
    y = F.col(target).cast("double")
    by = train.where(y.isNotNull()).groupBy(level(column).alias("level"), F.col(fold).alias("fold")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    sums = {r["fold"]: (r["s"], r["n"]) for r in by.groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}  # a row a fold
    s, n = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    whole = s / n if n else 0.0
    priors = {-1: whole} | {f: (s - a) / (n - b) if n > b else whole for f, (a, b) in sums.items()}
    prior = F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])
    total = by.groupBy("level").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    value = lambda a, b, f: (a + smoothing * F.element_at(prior, f)) / (b + smoothing)
    others = by.join(total, "level").where("tn > n").select("fold", "level", value(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"), F.col("fold")).alias("value"))
    # a level that a fold's rows do not hold is coded by all of its rows there, which are all of other folds
    absent = total.crossJoin(F.broadcast(train.sparkSession.createDataFrame([(f,) for f in sums], "fold int"))).join(by.select("level", "fold"), ["level", "fold"], "left_anti") if sums else None  # a row a fold
    out = others.unionByName(total.select(F.lit(-1).alias("fold"), "level", value(F.col("ts"), F.col("tn"), F.lit(-1)).alias("value")))
    if absent is not None:
        out = out.unionByName(absent.select("fold", "level", value(F.col("ts"), F.col("tn"), F.col("fold")).alias("value")))
    return out, {str(f): p for f, p in priors.items()}


def target_encode_out_of_fold(train: DataFrame, column: str, target: str, fold: str, smoothing: float = 10.0) -> DataFrame:
    """column_target: each row's level mean over the other folds, drawn to their mean; a level unseen there gets that mean."""
    keyed = train.withColumn("_key", level(column))
    by = keyed.groupBy("_key", F.col(fold).alias("_f")).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    totals = by.groupBy(F.col("_key").alias("_k")).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = by.groupBy(F.col("_f").alias("_ff")).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    whole = folds.agg(F.sum("fs").alias("as_"), F.sum("fn").alias("an"))
    prior = folds.join(F.broadcast(whole), how="cross").select("_ff", ((F.col("as_") - F.col("fs")) / (F.col("an") - F.col("fn"))).alias("prior"))  # a row a fold
    table = by.join(totals, F.col("_key") == F.col("_k")).join(F.broadcast(prior), F.col("_f") == F.col("_ff"))
    rest_s, rest_n = F.col("ts") - F.col("s"), F.col("tn") - F.col("n")
    table = table.select(F.col("_key").alias("_k2"), F.col("_f").alias("_f2"), ((rest_s + smoothing * F.col("prior")) / (rest_n + smoothing)).alias(f"{column}_target"))
    return keyed.join(table, (F.col("_key") == F.col("_k2")) & (F.col(fold) == F.col("_f2"))).drop("_key", "_k2", "_f2")


def fit_frequencies(train: DataFrame, column: str, normalize: bool = True) -> DataFrame:
    """(level, frequency) as shares or counts; null is a level."""
    counted = train.groupBy(level(column).alias("level")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if not normalize:
        return counted.withColumnRenamed("n", "frequency")
    total = counted.agg(F.sum("n").alias("t"))
    return counted.join(F.broadcast(total), how="cross").select("level", (F.col("n") / F.col("t")).alias("frequency"))


def frequency_encode(df: DataFrame, column: str, frequencies: DataFrame) -> DataFrame:
    return look_up(df, column, frequencies, "frequency", f"{column}_frequency", 0.0)


def hash_bucket(column: str, n: int = 8) -> Column:
    """The first eight hex digits of the md5 of the level, modulo n (2 to 256)."""
    return F.conv(F.substring(F.md5(level(column)), 1, 8), 16, 10).cast("long") % min(256, max(2, n))


def hash_encode(df: DataFrame, column: str, n: int = 8, expand: bool = True) -> DataFrame:
    bucket = hash_bucket(column, n)
    return df.withColumns({f"{column}_hash_{k}": (bucket == k).cast("int") for k in range(n)}) if expand else df.withColumn(f"{column}_hash", bucket)


def fit_bins(train: DataFrame, column: str, n: int = 5, strategy: str = "quantile") -> list[float]:
    """Inner edges: by quantile (repeats removed), of equal width, or half way between the centres of one-dimensional k-means."""
    n = min(50, max(2, n))
    x = F.col(column).cast("double")
    if strategy == "quantile":
        row = column_quantiles(train, {"x": x}, [k / n for k in range(n + 1)])["x"]
        return sorted(set(row))[1:-1] if row[0] is not None else []
    if strategy == "uniform":
        a, b = train.agg(F.min(x), F.max(x)).first()
        return [] if a is None or a == b else [a + (b - a) * k / n for k in range(1, n)]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["_x"], outputCol="features").transform(train.where(x.isNotNull()).select(x.alias("_x")))
    centres = sorted(float(v[0]) for v in KMeans(k=n, seed=7).fit(rows).clusterCenters())
    return [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]


def bin_codes(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """column_bin: how many inner edges are at or below the value."""
    code = F.lit(0)
    for e in edges:
        code = code + (F.col(column) >= F.lit(float(e))).cast("int")
    return df.withColumn(f"{column}_bin", code)


def fit_scaler(train: DataFrame, columns: Iterable[str], method: str = "standard") -> dict[str, dict[str, float]]:
    """Fill, centre and scale of each column: standard (population spread), minmax or robust. No spread scales by 1; nulls are filled by the median."""
    names = list(columns)
    holes = train.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(names)]).first()
    holed = [c for i, c in enumerate(names) if holes[f"c{i}"] < holes["n"]]
    # new rows may have nulls where training rows have none
    medians = column_quantiles(train, {c: F.col(c) for c in names}, [0.5])
    fills = {c: medians[c][0] if medians[c][0] is not None else 0.0 for c in names}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) if c in holed else F.col(c).cast("double") for c in names}
    aggs = []
    for i, x in enumerate(filled.values()):
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = train.agg(*aggs).first()
    quartiles = column_quantiles(train, filled, [0.25, 0.5, 0.75]) if method == "robust" else {}
    out = {}
    for i, c in enumerate(names):
        q = quartiles.get(c) or [0.0, 0.0, 0.0]
        q = [0.0, 0.0, 0.0] if q[0] is None else q
        centre, scale = {"standard": (row[f"m{i}"], row[f"s{i}"]), "minmax": (row[f"a{i}"], (row[f"b{i}"] or 0) - (row[f"a{i}"] or 0)), "robust": (q[1], q[2] - q[0])}[method]
        out[c] = {"fill": fills[c], "centre": centre or 0.0, "scale": scale or 1.0}
    return out


def scale(df: DataFrame, fitted: dict[str, dict[str, float]]) -> DataFrame:
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(f["fill"])) - F.lit(f["centre"])) / F.lit(f["scale"]) for c, f in fitted.items() if c in df.columns})


def fit_quantile_grid(train: DataFrame, column: str, n: int = 1000) -> list[float]:
    """Values at n + 1 even probabilities."""
    return grid_quantiles(train, F.col(column), n)


def quantile_transform(df: DataFrame, column: str, grid: list[float], normal: bool = True) -> DataFrame:
    """column_quantile: place on the grid by interpolation (the mean from left and right where values repeat), as a normal score or in 0..1."""
    at, edge = np.linspace(0, 1, len(grid)), np.array(grid, dtype=float)
    share = np.concatenate([np.geomspace(1e-7, 0.01, 2000)[:-1], np.linspace(0.01, 0.99, 20_001), (1 - np.geomspace(1e-7, 0.01, 2000)[::-1])[1:]])
    score = np.array([NormalDist().inv_cdf(float(u)) for u in share]) if normal else share

    def place(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        p = 0.5 * (np.interp(v, edge, at) - np.interp(-v, -edge[::-1], -at[::-1]))
        if normal:  # by interpolation on a fine table of normal scores
            p = np.interp(np.clip(p, 1e-7, 1 - 1e-7), share, score)
        return pd.Series(np.where(np.isnan(v), np.nan, p))

    made = F.pandas_udf(place, "double")(F.col(column).cast("double"))
    return df.withColumn(f"{column}_quantile", F.when(F.col(column).isNotNull(), made))


def fit_power(train: DataFrame, column: str, rounds: int = 3) -> dict[str, float]:
    """Box-Cox where all values are above 0, else Yeo-Johnson; the exponent of greatest likelihood on a grid that narrows each round, one aggregate a round."""
    x = F.col(column).cast("double")
    low = train.agg(F.min(x)).first()[0]
    boxcox = low is not None and low > 0
    lo, hi, best = -3.0, 3.0, 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * k / 24 for k in range(25)]
        aggs = [F.count(x).alias("n"), (F.sum(F.log(x)) if boxcox else F.sum(F.signum(x) * F.log1p(F.abs(x)))).alias("j")]
        aggs += [F.var_pop(_power(x, g, boxcox)).alias(f"v{i}") for i, g in enumerate(grid)]
        row = train.agg(*aggs).first()
        import math

        score = [(-row["n"] / 2 * math.log(row[f"v{i}"]) + (g - 1) * row["j"] if row[f"v{i}"] else -math.inf) for i, g in enumerate(grid)]
        best = grid[score.index(max(score))]
        step = (hi - lo) / 24
        lo, hi = best - step, best + step
    stats = train.agg(F.avg(_power(x, best, boxcox)).alias("m"), F.stddev_pop(_power(x, best, boxcox)).alias("s")).first()
    return {"lambda": best, "boxcox": float(boxcox), "mean": stats["m"] or 0.0, "std": stats["s"] or 1.0}


def _power(x: Column, g: float, boxcox: bool) -> Column:
    if boxcox:
        return F.log(x) if abs(g) < 1e-9 else (F.pow(x, F.lit(g)) - 1) / g
    up = F.log1p(x) if abs(g) < 1e-9 else (F.pow(x + 1, F.lit(g)) - 1) / g
    down = -F.log1p(-x) if abs(g - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - g)) - 1) / (2 - g)
    return F.when(x >= 0, up).otherwise(down)


def power_transform(df: DataFrame, column: str, fitted: dict[str, float]) -> DataFrame:
    x = F.col(column).cast("double")
    return df.withColumn(f"{column}_power", (_power(x, fitted["lambda"], bool(fitted["boxcox"])) - fitted["mean"]) / fitted["std"])


def anova_f(df: DataFrame, columns: Iterable[str], label: str) -> DataFrame:
    """column, f: between over within mean squares of the classes, from one grouped aggregate."""
    names = list(columns)
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[a for i, c in enumerate(names) for a in (F.count(c).alias(f"n{i}"), F.sum(F.col(c).cast("double")).alias(f"s{i}"), F.sum(F.pow(F.col(c).cast("double"), 2)).alias(f"q{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i, c in enumerate(names)])
    long = by.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")
    t = long.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return t.select("column", F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("f"))


def regression_f(df: DataFrame, columns: Iterable[str], target: str) -> DataFrame:
    """column, f: r2 / (1 - r2) * (n - 2) of each column with the target."""
    from sparkprep.functions.tables import correlation, to_long

    aggs, fields = [], {}
    for i, c in enumerate(columns):
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        aggs += [correlation(F.col(c), F.col(target)).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        fields[c] = {"f": F.try_divide(r2 * (F.col(f"n{i}") - 2), 1 - r2)}
    return to_long(df.agg(*aggs), fields)


def select_k_best(scores: DataFrame, k: int = 20) -> list[str]:
    return [r["column"] for r in scores.where("f is not null and not isnan(f)").orderBy(F.desc("f"), "column").limit(k).collect()]


def low_variance_columns(df: DataFrame, columns: Iterable[str], threshold: float = 0.0) -> list[str]:
    """Columns whose population variance is not above the threshold."""
    names = list(columns)
    row = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"v{i}"] is None or row[f"v{i}"] <= threshold]


def pca(df: DataFrame, columns: list[str], n_components: int, name: str = "pca"):  # noqa: ANN201
    """(df with name_1.., fitted pipeline): centred, scaled, with each component's largest loading positive."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = max(1, min(n_components, len(columns)))
    stages = [VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_p")]
    fitted = Pipeline(stages=stages).fit(df)
    load = fitted.stages[2].pc.toArray()
    sign = [1.0 if load[abs(load[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = fitted.transform(df).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({f"{name}_{j + 1}": F.col("_p")[j] * sign[j] for j in range(k)}).drop("_v", "_s", "_p"), fitted


def truncated_svd(df: DataFrame, columns: list[str], n_components: int, name: str = "svd") -> tuple[DataFrame, list[list[float]]]:
    """(df with name_1.., components): right singular vectors of the uncentred matrix, from its Gram matrix in one aggregate, so the driver holds columns x columns numbers."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(x), len(x)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(gram)
    parts = vectors[:, np.argsort(-values)[: max(1, min(n_components, len(x)))]].T
    parts = [p if p[abs(p).argmax()] >= 0 else -p for p in parts]
    out = {f"{name}_{k + 1}": sum([F.lit(float(w)) * v for w, v in zip(p[1:], x[1:], strict=True)], F.lit(float(p[0])) * x[0]) for k, p in enumerate(parts)}
    return df.withColumns(out), [p.tolist() for p in parts]


def fit_projection(train: DataFrame, columns: list[str], n_components: int, centred: bool) -> dict:
    """centre, scale and components of the columns, nulls read as the mean, from one aggregate: principal components of standardised columns, else right singular vectors."""
    means = train.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = [means[f"m{i}"] for i in range(len(columns))]
    x = [F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(m if centred else 0.0) for c, m in zip(columns, mean, strict=True)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(x), len(x)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    scale = np.sqrt(np.diag(gram) / max(1, row["n"] - 1)) if centred else np.ones(len(x))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    parts = vectors[:, np.argsort(-values)[: max(1, min(n_components, len(x)))]].T
    parts = [p if p[abs(p).argmax()] >= 0 else -p for p in parts]
    return {"centre": mean, "scale": scale.tolist(), "components": [p.tolist() for p in parts], "centred": centred}


def project(df: DataFrame, columns: list[str], centre: list[float], scale: list[float], components: list[list[float]], name: str) -> DataFrame:
    """name_1..: the columns on the components, as one expression each."""
    offset = centre if name == "pca" else [0.0] * len(columns)
    x = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(o)) / F.lit(s) for c, m, o, s in zip(columns, centre, offset, scale, strict=True)]
    return df.withColumns({f"{name}_{k + 1}": sum((F.lit(w) * v for w, v in zip(p[1:], x[1:], strict=True)), F.lit(p[0]) * x[0]) for k, p in enumerate(components)})


def group_profile(df: DataFrame, by: str, column: str, statistics: Iterable[str], train: DataFrame | None = None) -> DataFrame:
    """Group statistics on each row: from training rows by a join, or over all rows by a window. A group not seen is null."""
    from sparkprep.operators.profile import group_statistics

    if train is None:
        over = Window.partitionBy(level(by))
        make = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
        return df.withColumns({f"{column}_by_{by}_{s}": make[s](column).over(over) for s in statistics})
    stats = group_statistics(train.withColumn("_by", level(by)), ["_by"], [column], statistics)
    stats = stats.withColumnsRenamed({f"{column}_{s}": f"{column}_by_{by}_{s}" for s in statistics})
    return df.withColumn("_key", level(by)).join(stats, F.col("_key") == F.col("_by"), "left").drop("_key", "_by")
