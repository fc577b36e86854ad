"""Metrics of scored tables (label, prediction, score), each from one or two aggregates. What cannot be computed is null."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.quantiles import column_quantiles, group_medians
from sparkprep.functions.tables import durable, global_running, sample_rows, with_row_id

#: Metrics for which less is better.
LOWER_IS_BETTER = {"log_loss", "brier_score", "rmse", "mse", "mae", "median_absolute_error", "max_error", "mape", "smape", "davies_bouldin", "noise_fraction", "ece"}
ALIASES = {"auc": "roc_auc", "roc auc": "roc_auc", "f1_score": "f1", "ap": "average_precision", "pr_auc": "average_precision", "logloss": "log_loss", "mcc": "matthews_corrcoef", "kappa": "cohen_kappa", "r2_score": "r2", "root_mean_squared_error": "rmse", "mean_absolute_error": "mae", "mean_squared_error": "mse", "brier": "brier_score"}
DEFAULTS = {"binary": "roc_auc", "multiclass": "f1_macro", "regression": "rmse", "clustering": "silhouette", "anomaly": "score_separation", "forecasting": "rmse"}


def metric_name(name: str) -> str:
    key = name.strip().lower().replace("-", "_")
    return ALIASES.get(key, key)


def better(name: str, a: float, b: float) -> bool:
    """Whether a is better than b."""
    return a < b if metric_name(name) in LOWER_IS_BETTER else a > b


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Iterable[str] = ()) -> DataFrame:
    """label, prediction, n."""
    return df.groupBy(*by, F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """One row (a group): accuracy, balanced accuracy, macro / weighted / micro precision, recall, F1, binary ones if a positive class is given, Matthews, Cohen.

    All from the confusion counts: the rows are read once.
    """
    by = list(by)
    cells = confusion(df, label, prediction, by)
    rows = cells.groupBy(*by, F.col("label").alias("c")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(*by, F.col("prediction").alias("c")).agg(F.sum("n").alias("called"))
    k = rows.join(cols, [*by, "c"], "full").na.fill(0, ["actual", "hit", "called"])
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    k = k.withColumn("p", z(F.col("hit"), F.col("called"))).withColumn("r", z(F.col("hit"), F.col("actual"))).withColumn("f", z(2 * F.col("hit"), F.col("called") + F.col("actual")))
    n, hit = F.sum("actual"), F.sum("hit")
    weighted = lambda c: z(F.sum(F.col(c) * F.col("actual")), F.sum("actual"))
    aggs = [
        n.alias("n"), z(hit, n).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, F.col("r"))).alias("balanced_accuracy"),
        F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"), F.avg("f").alias("f1_macro"),
        weighted("p").alias("precision_weighted"), weighted("r").alias("recall_weighted"), weighted("f").alias("f1_weighted"), z(hit, n).alias("f1_micro"),
        F.sum((F.col("actual") * F.col("called")).cast("double")).alias("_pt"), F.sum(F.pow(F.col("actual"), F.lit(2))).alias("_tt"), F.sum(F.pow(F.col("called"), F.lit(2))).alias("_pp"), hit.cast("double").alias("_h"),
    ]
    if positive is not None:
        one = F.col("c") == F.lit(str(positive))
        aggs += [F.coalesce(F.max(F.when(one, F.col(x))), F.lit(0.0)).alias(name) for x, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))]
    out = (k.groupBy(*by) if by else k).agg(*aggs)
    size = F.col("n").cast("double")
    matthews = z(F.col("_h") * size - F.col("_pt"), F.sqrt((size * size - F.col("_pp")) * (size * size - F.col("_tt"))))
    kappa = z(F.col("_h") / size - F.col("_pt") / (size * size), 1 - F.col("_pt") / (size * size))
    return out.withColumn("matthews_corrcoef", matthews).withColumn("cohen_kappa", kappa).drop("_pt", "_tt", "_pp", "_h")


def score_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """score, n, positives, and their running counts from the highest score down: what ROC, PR and average precision are made of."""
    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    return global_running(counted, [F.col("score").desc()], {"upto": F.col("n"), "hits": F.col("positives")})


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row roc_auc (ties half), average_precision."""
    curve = score_curve(df, label, score)
    total = curve.agg(F.sum("positives").cast("double").alias("all_p"), F.sum("n").cast("double").alias("all_n"))
    c = curve.join(F.broadcast(total), how="cross")
    negatives = F.col("n") - F.col("positives")
    below = (F.col("all_n") - F.col("all_p")) - (F.col("upto") - F.col("hits"))  # negatives of lower score
    return c.agg(
        F.try_divide(F.sum(F.col("positives") * (below + negatives / 2)), F.max(F.col("all_p") * (F.col("all_n") - F.col("all_p")))).alias("roc_auc"),
        F.sum(F.try_divide(F.col("positives"), F.col("all_p")) * F.col("hits") / F.col("upto")).alias("average_precision"),
    )


def one_vs_rest(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One row roc_auc_ovr, roc_auc_ovr_weighted, average_precision_macro; scores maps a class to its column. All classes go through one curve."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(col).cast("double").alias("s"), (F.col(label).cast("string") == k).cast("long").alias("y")) for k, col in scores.items()]))
    long = df.where(F.col(label).isNotNull()).select(cells.alias("e")).select("e.*")
    counted = long.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    run = global_running(counted, [F.col("c"), F.col("s").desc()], {"_u": F.col("n"), "_h": F.col("p")})
    base = run.groupBy("c").agg(F.max("_u").alias("mu"), F.max("_h").alias("mh"), F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    r = run.join(F.broadcast(base), "c").withColumn("upto", F.col("_u") - (F.col("mu") - F.col("all_n"))).withColumn("hits", F.col("_h") - (F.col("mh") - F.col("all_p")))
    below = (F.col("all_n") - F.col("all_p")) - (F.col("upto") - F.col("hits"))
    each = r.groupBy("c").agg(
        F.try_divide(F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2)), F.max((F.col("all_p") * (F.col("all_n") - F.col("all_p"))).cast("double"))).alias("auc"),
        F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("hits") / F.col("upto")).alias("ap"), F.max("all_p").alias("all_p"),
    )
    return each.agg(F.avg("auc").alias("roc_auc_ovr"), F.try_divide(F.sum(F.col("auc") * F.col("all_p")), F.sum("all_p")).alias("roc_auc_ovr_weighted"), F.avg("ap").alias("average_precision_macro"))


def probability_metrics(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-15) -> DataFrame:
    """One row log_loss, brier_score; null if a score is outside 0..1."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    clipped = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    sound = F.min(p) >= 0, F.max(p) <= 1
    loss = F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped)))
    return df.agg(F.when(sound[0] & sound[1], loss).alias("log_loss"), F.when(sound[0] & sound[1], F.avg((p - y) * (p - y))).alias("brier_score"))


def class_probability_metrics(df: DataFrame, label: str, scores: dict[str, str], eps: float = 1e-15) -> DataFrame:
    """One row log_loss, brier_score over several classes; scores maps a class to its column. Null if a score is outside 0..1."""
    y = F.col(label).cast("string")
    p = {k: F.col(c).cast("double") for k, c in scores.items()}
    own, square, sound = F.lit(None).cast("double"), F.lit(0.0), F.lit(True)
    for k, v in p.items():
        own = F.when(y == k, v).otherwise(own)
        square = square + F.pow(v - (y == k).cast("double"), F.lit(2.0))
        sound = sound & v.between(0, 1)
    ok = F.bool_and(sound)
    return df.where(y.isNotNull()).agg(F.when(ok, F.avg(-F.log(F.greatest(F.least(own, F.lit(1 - eps)), F.lit(eps))))).alias("log_loss"), F.when(ok, F.avg(square)).alias("brier_score"))


def top_class(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """confidence and hit of each row's likeliest class, the first of equals: what calibration takes of several classes."""
    best = F.array_max(F.array(*[F.struct(F.col(c).cast("double").alias("p"), F.lit(-i).alias("first"), F.lit(k).alias("k")) for i, (k, c) in enumerate(scores.items())]))
    return df.withColumn("_best", best).select(F.col("_best.p").alias("confidence"), (F.col("_best.k") == F.col(label).cast("string")).cast("int").alias("hit"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Iterable[str] = ()) -> DataFrame:
    """One row (a group): rmse, mse, mae, r2, explained_variance, median_absolute_error, max_error, mape, smape."""
    by = list(by)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull()).select(*by, y.alias("y"), (y - p).alias("e"), p.alias("p"))
    scale = (rows.groupBy(*by) if by else rows).agg(F.avg(F.abs("y")).alias("_scale"))
    rows = rows.join(F.broadcast(scale), by) if by else rows.join(F.broadcast(scale), how="cross")
    usable = F.abs("y") > F.greatest(F.lit(1e-12), 1e-6 * F.col("_scale"))
    e, size = F.abs("e"), F.abs("y") + F.abs("p")
    mse = F.avg(F.col("e") * F.col("e"))
    out = (rows.groupBy(*by) if by else rows).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(e).alias("mae"),
        (1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("y") * F.count("y"))).alias("r2"), (1 - F.try_divide(F.var_pop("e"), F.var_pop("y"))).alias("explained_variance"),
        F.max(e).alias("max_error"),
        F.when(F.count_if(usable) >= 0.5 * F.count(F.lit(1)), F.avg(F.when(usable, e / F.abs("y")))).alias("mape"), F.avg(F.coalesce(F.try_divide(2 * e, size), F.lit(0.0))).alias("smape"),
    )
    names = [*by, "n", "rmse", "mse", "mae", "r2", "explained_variance", "median_absolute_error", "max_error", "mape", "smape"]
    if not by:
        return out.withColumn("median_absolute_error", F.lit(column_quantiles(rows, {"e": e}, [0.5])["e"][0]).cast("double")).select(*names)
    middle = group_medians(rows, by, {"median_absolute_error": e}).withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)})
    same = functools.reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    return out.join(middle, same).select(*names)


def clustering_metrics(df: DataFrame, features: list[str], cluster: str, noise: int = -1, silhouette_rows: int = 10_000, block: int = 2048) -> DataFrame:
    """One row noise_fraction, n_clusters, calinski_harabasz, davies_bouldin, silhouette.

    The first four come from centroid aggregates over all rows; the silhouette is the
    exact Euclidean one of at most ``silhouette_rows`` rows drawn by a digest of their
    number, copies among them, which meet in pairs of blocks.
    """
    x = [F.col(f).cast("double") for f in features]
    inside = df.where(F.col(cluster) != noise)
    centres = inside.groupBy(F.col(cluster).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in x]).alias("c"))
    here = F.array(*x)
    dist2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t)
    spread = inside.select(F.col(cluster).alias("k"), here.alias("v")).join(F.broadcast(centres), "k").groupBy("k").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sum(dist2(F.col("v"), F.col("c"))).alias("w"), F.avg(F.sqrt(dist2(F.col("v"), F.col("c")))).alias("s"))
    centre = inside.agg(F.array(*[F.avg(v) for v in x]).alias("m"), F.count(F.lit(1)).alias("all_n"))
    ch = spread.join(F.broadcast(centre), how="cross").agg(F.sum(F.col("n") * dist2(F.col("c"), F.col("m"))).alias("b"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("kk"), F.max("all_n").alias("all_n"))
    ch = ch.select(F.col("kk").alias("n_clusters"), F.try_divide(F.col("b") / (F.col("kk") - 1), F.col("w") / (F.col("all_n") - F.col("kk"))).alias("calinski_harabasz"))
    other = spread.select(F.col("k").alias("k2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    db = spread.join(other, F.col("k") != F.col("k2")).groupBy("k").agg(F.max(F.try_divide(F.col("s") + F.col("s2"), F.sqrt(dist2(F.col("c"), F.col("c2"))))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))  # pairs of clusters
    noise_row = df.agg(F.avg((F.col(cluster) == noise).cast("double")).alias("noise_fraction"))
    numbered = with_row_id(inside.select(F.col(cluster).alias("k"), here.alias("v")), "id")
    drawn = durable(sample_rows(numbered, silhouette_rows, "id"))
    blocks = max(1, -(-drawn.count() // block))
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = drawn.withColumn("x", own).withColumn("y", every).withColumn("left", F.lit(True)).unionByName(drawn.withColumn("y", own).withColumn("x", every).withColumn("left", F.lit(False)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "k": [], "k2": [], "d": [], "n": []})
        av, bv = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        ks, at = np.unique(b["k"].to_numpy(), return_inverse=True)
        of = np.eye(len(ks))[at]
        d = np.concatenate([np.sqrt(((av[i : i + 128, None, :] - bv[None]) ** 2).sum(2)) @ of for i in range(0, len(av), 128)])
        n = of.sum(0)[None, :] - (a["k"].to_numpy()[:, None] == ks[None, :]) * a["id"].isin(b["id"]).to_numpy()[:, None]  # not the row itself
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(ks)), "k": np.repeat(a["k"].to_numpy(), len(ks)), "k2": np.tile(ks, len(a)), "d": d.ravel(), "n": n.ravel()})

    types = dict(drawn.dtypes)
    two = dealt.groupBy("x", "y").applyInPandas(meet, f"id {types['id']}, k {types['k']}, k2 {types['k']}, d double, n double")
    mean = two.groupBy("id", "k", "k2").agg(F.try_divide(F.sum("d"), F.sum("n")).alias("d")).groupBy("id", "k").agg(F.max(F.when(F.col("k") == F.col("k2"), F.col("d"))).alias("a"), F.min(F.when(F.col("k") != F.col("k2"), F.col("d"))).alias("b"))
    sil = mean.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))
    return noise_row.join(ch, how="cross").join(db, how="cross").join(sil, how="cross")


def anomaly_metrics(df: DataFrame, outlier: str, score: str, label: str | None = None) -> DataFrame:
    """One row outlier_fraction, mean_score, score_separation (inliers' mean less outliers'); with labels precision, recall, F1, and roc_auc and average_precision of low scores for outliers."""
    out = F.col(outlier).cast("boolean")
    aggs = [F.avg(out.cast("double")).alias("outlier_fraction"), F.avg(score).alias("mean_score"), (F.avg(F.when(~out, F.col(score))) - F.avg(F.when(out, F.col(score)))).alias("score_separation")]
    if label:
        y = F.col(label).cast("boolean")
        hit, called, actual = F.count_if(out & y), F.count_if(out), F.count_if(y)
        aggs += [F.coalesce(F.try_divide(a, b), F.lit(0.0)).alias(n) for a, b, n in ((hit, called, "precision"), (hit, actual, "recall"), (2 * hit, called + actual, "f1"))]
    one = df.agg(*aggs)
    if not label:
        return one
    ranked = ranking_metrics(df.select(F.col(label).cast("int").alias("label"), (-F.col(score)).alias("score")))
    return one.join(F.broadcast(ranked), how="cross")  # a row each


def calibration(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy: equal bins, the first closed at its left end, the others open there."""
    bucket = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.col(score) * bins))).cast("int")
    return df.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """One row ece, band: good to 0.05, fair to 0.10."""
    t = calibration(df, label, score, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))
    return t.withColumn("band", F.when(F.col("ece") <= 0.05, "good").when(F.col("ece") <= 0.10, "fair").otherwise("poor"))


