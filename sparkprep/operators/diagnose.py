"""Diagnostics of a scored table and of a fitted model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.quantiles import column_quantiles
from sparkprep.functions.tables import correlation, durable, global_running, spread
from sparkprep.operators.metrics import LOWER_IS_BETTER, classification_metrics, metric_name


def fit_verdict(train: float, held_out: float, metric: str) -> str:
    """overfitting, underfitting or good from a metric on both parts."""
    name = metric_name(metric)
    gap = held_out - train if name in LOWER_IS_BETTER else train - held_out
    if gap >= 0.02 and gap / max(abs(train), 1e-12) >= 0.15:
        return "overfitting"
    if name in ("r2", "explained_variance") and train < 0.20 or name not in LOWER_IS_BETTER and name not in ("r2", "explained_variance") and train < 0.60:
        return "underfitting"
    return "good"


def two_sided_p(z: Column) -> Column:
    """Chance of a normal value at least as far from 0 as z, by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 2e-7)."""
    u = F.abs(z) / 2**0.5
    k = 1 / (1 + 0.3275911 * u)
    return k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-u * u)


def residual_statistics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mean, std, mean and greatest absolute, population skew and kurtosis, bias over std, normality K2 and p, correlation of absolute residual and prediction and its p.

    p of the correlation is that of Student's t taken as normal after Wallace's transformation (off by under 0.001 from 20 rows on).
    """
    e, p = F.col(label).cast("double") - F.col(prediction).cast("double"), F.col(prediction).cast("double")
    t = df.agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.avg(F.abs(e)).alias("mean_absolute"), F.max(F.abs(e)).alias("max_absolute"),
        F.skewness(e).alias("skew"), F.kurtosis(e).alias("kurtosis"), correlation(F.abs(e), p).alias("spread_correlation"),
    )
    n = F.col("n").cast("double")
    # D'Agostino's transformed skewness and kurtosis
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    zs = 1 / F.sqrt(F.log(F.sqrt(w2))) * F.log(y / alpha + F.sqrt(y * y / (alpha * alpha) + 1))
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("kurtosis") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    zk = ((1 - 2 / (9 * a)) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    k2 = F.when(n >= 20, zs * zs + zk * zk)
    r, free = F.col("spread_correlation"), n - 2
    t2 = free * r * r / F.greatest(1 - r * r, F.lit(1e-300))
    z = F.sqrt(free * F.log1p(t2 / free)) * (8 * free + 1) / (8 * free + 3)
    t = t.withColumn("spread_p", F.when(n > 2, two_sided_p(z)))
    return t.withColumn("bias_ratio", F.try_divide("mean", "std")).withColumn("normality_k2", k2).withColumn("normality_p", F.exp(-F.col("normality_k2") / 2))


def worst_predictions(df: DataFrame, label: str, prediction: str, key: str, confidence: str | None = None, k: int = 5, context: Iterable[str] = ()) -> DataFrame:
    """The k largest absolute residuals, or the k most confident misses."""
    if confidence:
        bad = df.where(F.col(label) != F.col(prediction)).select(key, label, prediction, F.col(confidence).alias("badness"), *context)
    else:
        bad = df.select(key, label, prediction, F.abs(F.col(label) - F.col(prediction)).alias("badness"), *context)
    return bad.orderBy(F.desc("badness"), key).limit(k)


def fairness_slices(df: DataFrame, attribute: str, label: str, prediction: str, metric: str = "accuracy", top: int = 12, least: int = 25) -> DataFrame:
    """value, n, metric, delta to the whole, of the largest slices."""
    whole = classification_metrics(df, label, prediction).select(F.col(metric).alias("_all"))
    parts = classification_metrics(df.withColumn("value", F.coalesce(F.col(attribute).cast("string"), F.lit("__MISSING__"))), label, prediction, by=["value"])
    joined = parts.where(F.col("n") >= least).join(F.broadcast(whole), how="cross")
    return joined.select("value", "n", metric, (F.col(metric) - F.col("_all")).alias("delta")).orderBy(F.desc("n"), "value").limit(top)


def _first_digits(share: float) -> str:
    """The least 13 hexadecimal digits whose number h has (h + 0.5) / 2 ** 52 >= share in doubles. A digest begins with no less than these, compared as text, just where its share is no less."""
    h = int(share * 2**52)
    while (h + 0.5) / 2**52 >= share:
        h -= 1
    while (h + 0.5) / 2**52 < share:
        h += 1
    return f"{h:013x}"


def bootstrap_intervals(df: DataFrame, label: str, prediction: str, key: str, resamples: int = 300, seed: int = 0) -> DataFrame:
    """metric, low, high: 95 % intervals of accuracy and, for labels 0 and 1, of precision, recall and F1 by Poisson resampling.

    A row's weight in a replicate is a Poisson(1) draw from a digest of its key, so all
    replicates are one grouped aggregate and no sample is ever drawn. Only counts by
    replicate leave a task.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("rep"), F.lit(":"), F.col(key).cast("string")))
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        term /= k + 1
        weight = weight + (F.col("_h") >= _first_digits(total)).cast("int")
    y, p = F.col(label).cast("string"), F.col(prediction).cast("string")
    flags = [(y == p).alias("hit"), (y == "1").alias("actual"), (p == "1").alias("called")]
    rows = spread(df.select(key, *flags)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_h", drawn).withColumn("w", weight)
    add = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(0))
    c = rows.groupBy("rep").agg(F.sum("w").alias("n"), add(F.col("hit")).alias("h"), add(F.col("actual") & F.col("called")).alias("tp"), add(F.col("called")).alias("pp"), add(F.col("actual")).alias("p"))
    each = {"accuracy": (F.col("h"), F.col("n")), "precision": (F.col("tp"), F.col("pp")), "recall": (F.col("tp"), F.col("p")), "f1": (2 * F.col("tp"), F.col("pp") + F.col("p"))}
    long = c.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(a, b).alias("value")) for m, (a, b) in each.items()])).alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def permuted(n: int, seed: str) -> Callable[[Column], Column]:
    """A permutation of 0..n-1 by formula: a keyed scrambling of as many bits as n has, walked on from values beyond n until one is inside."""
    bits = max(2, (n - 1).bit_length())
    half, mask = bits // 2 + bits % 2, (1 << bits) - 1
    keys = [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8], "big") & mask for k in range(8)]

    def scramble(x: np.ndarray) -> np.ndarray:
        for multiplier, shift in zip(keys[::2], keys[1::2], strict=True):
            x = (x * np.uint64(multiplier | 1) + np.uint64(shift)) & np.uint64(mask)  # modulo 2 ** 64 keeps the low bits right
            x ^= x >> np.uint64(half)
        return x

    def run(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in numbers:
            x = scramble(part.to_numpy().astype(np.uint64))
            while (out := x >= np.uint64(n)).any():
                x[out] = scramble(x[out])
            yield pd.Series(x.astype(np.int64))

    return F.pandas_udf(run, "long")


def permutation_importance(df: DataFrame, features: Iterable[str], key: str, score: Callable[[DataFrame], float], repeats: int = 5, higher_is_better: bool = True) -> DataFrame:
    """feature, importance (normalised to 1), std: the fall of the score when a column is shuffled.

    Rows are numbered once, by key. A repeat is one join: each row meets the row that a permutation of the
    numbers, a formula, moves to it, and a feature's score takes that row's value of the feature.
    """
    names, base = list(features), score(df)
    placed = durable(global_running(df, [F.col(key)], {}, number="_at"))
    n = placed.count()
    drops: dict[str, list[float]] = {f: [] for f in names}
    for r in range(repeats):
        moved = placed.select((F.col("_at") - 1).alias("_from"), *[F.col(f).alias(f"_moved{i}") for i, f in enumerate(names)]).withColumn("_to", permuted(n, str(r))(F.col("_from")) + 1)
        met = durable(placed.join(moved.drop("_from"), F.col("_at") == F.col("_to")))
        for i, f in enumerate(names):
            value = score(met.withColumn(f, F.col(f"_moved{i}")).select(*df.columns))
            drops[f].append(base - value if higher_is_better else value - base)
    found = []
    for f, fell in drops.items():
        mean = sum(fell) / len(fell)
        found.append((f, max(0.0, mean), (sum((x - mean) ** 2 for x in fell) / len(fell)) ** 0.5))
    total = sum(x[1] for x in found) or 1.0
    return df.sparkSession.createDataFrame([(f, m / total, s) for f, m, s in found], "feature string, importance double, std double").orderBy(F.desc("importance"), "feature")


def native_importances(model, names: list[str], sources: dict[str, str] | None = None) -> list[tuple[str, float]]:  # noqa: ANN001
    """(column, share) of a fitted model's own importances or absolute coefficients, encoded columns added up by their source column."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(stage, "featureImportances"):
        values = stage.featureImportances.toArray()
    elif hasattr(stage, "coefficientMatrix"):
        values = abs(stage.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = abs(stage.coefficients.toArray())
    by: dict[str, float] = {}
    for n, v in zip(names, values, strict=False):
        by[(sources or {}).get(n, n)] = by.get((sources or {}).get(n, n), 0.0) + float(v)
    total = sum(by.values()) or 1.0
    return sorted(((n, v / total) for n, v in by.items()), key=lambda x: (-x[1], x[0]))


def partial_dependence(df: DataFrame, model, feature: str, prediction: str = "prediction", points: int = 30) -> DataFrame:  # noqa: ANN001
    """value, mean_prediction over a grid of the feature's range between its 1st and 99th percentile."""
    ends = column_quantiles(df, {feature: F.col(feature)}, [0.01, 0.99])[feature]
    grid = F.array(*[F.lit(ends[0] + (ends[1] - ends[0]) * k / (points - 1)) for k in range(points)])
    rows = df.withColumn("_value", F.explode(grid)).withColumn(feature, F.col("_value"))
    return model.transform(rows).groupBy(F.col("_value").alias("value")).agg(F.avg(prediction).alias("mean_prediction")).orderBy("value")


def what_if(df: DataFrame, model, features: list[str], key: str, prediction: str = "prediction") -> DataFrame:  # noqa: ANN001
    """feature, moved_to, before, after: the row nearest the medians with one feature at its 10th or 90th percentile."""
    names = features[:3]
    q = column_quantiles(df, {f: F.col(f) for f in names}, [0.1, 0.5, 0.9])
    far = F.lit(0.0)
    for f in names:
        lo, mid, hi = q[f]
        far = far + F.abs(F.col(f) - mid) / ((hi - lo) or 1.0)
    typical = df.orderBy(far, key).limit(1)
    before = model.transform(typical).select(F.col(prediction).alias("before"))
    out = None
    for f in names:
        for k, tag in ((0, "p10"), (2, "p90")):
            one = model.transform(typical.withColumn(f, F.lit(q[f][k]).cast(df.schema[f].dataType))).select(F.lit(f).alias("feature"), F.lit(tag).alias("moved_to"), F.col(prediction).alias("after"))
            out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(before), how="cross").select("feature", "moved_to", "before", "after")


def learning_curve(df: DataFrame, make: Callable, score: Callable[[DataFrame], float], key: str, n_folds: int = 3, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 0) -> DataFrame:
    """share, train_score, test_score: means over folds on nested samples by a digest of the key."""
    from sparkprep.operators.models import predict
    from sparkprep.operators.split import fold_parts, folds

    dealt = spread(folds(df, "random", key, n_folds, seed=seed).withColumn("_u", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(1000)) / 1000))
    rows = []
    for share in shares:
        train_scores, test_scores = [], []
        for k in range(n_folds):
            train, test = fold_parts(dealt, k)
            part = train.where(F.col("_u") < share)
            model = make().fit(part)
            train_scores.append(float(score(predict(model, part))))
            test_scores.append(float(score(predict(model, test))))
        rows.append((share, sum(train_scores) / n_folds, sum(test_scores) / n_folds))
    return df.sparkSession.createDataFrame(rows, "share double, train_score double, test_score double")
