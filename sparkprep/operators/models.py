"""Model families on Spark ML behind one table, candidates, search and scoring."""

from __future__ import annotations

import itertools
import json
import random
import time
import warnings
from collections.abc import Callable, Iterable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import spread
from sparkprep.operators.metrics import better
from sparkprep.operators.neural import NeuralRegressor

#: Families whose penalties or distances depend on the scale of the features.
SCALED = {"ridge", "lasso", "elastic_net", "logistic", "linear", "svm", "neural_network", "kmeans", "gaussian_mixture"}


def estimator(family: str, task: str, n_features: int = 0, n_classes: int = 2, seed: int = 0, **p) -> Estimator:  # noqa: ANN003
    """An unfitted Spark ML estimator reading ``features`` and ``label``."""
    classify = task in ("binary", "multiclass")
    weight = {"weightCol": p["weight"]} if p.get("weight") else {}
    if family == "linear":
        return C.LogisticRegression(**weight) if classify else R.LinearRegression(fitIntercept=p.get("fit_intercept", True), solver="auto", **weight)
    if family in ("ridge", "lasso", "elastic_net", "logistic"):
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic_net": p.get("l1_ratio", 0.5), "logistic": 0.0}[family]
        if classify:
            return C.LogisticRegression(regParam=p.get("reg", 1e-3), elasticNetParam=mix, maxIter=p.get("max_iter", 100), **weight)
        return R.LinearRegression(regParam=p.get("alpha", {"ridge": 1e-2}.get(family, 1e-3)), elasticNetParam=mix, **weight)
    if family == "decision_tree":
        kw = {"maxDepth": p.get("max_depth", 8), "minInstancesPerNode": p.get("min_samples_leaf", 5), "seed": seed} | weight
        return C.DecisionTreeClassifier(**kw) if classify else R.DecisionTreeRegressor(**kw)
    if family == "random_forest":
        kw = {"numTrees": p.get("n_estimators", 100), "maxDepth": p.get("max_depth", 10), "featureSubsetStrategy": p.get("max_features", "auto"), "seed": seed} | weight
        return C.RandomForestClassifier(**kw) if classify else R.RandomForestRegressor(**kw)
    if family in ("gradient_boosting", "hist_gradient_boosting", "xgboost", "lightgbm", "catboost"):
        kw = {"maxIter": p.get("n_estimators", 50), "stepSize": p.get("learning_rate", 0.1), "maxDepth": p.get("max_depth", 5), "subsamplingRate": p.get("subsample", 1.0), "seed": seed}
        if task == "multiclass":
            return C.OneVsRest(classifier=C.GBTClassifier(**kw))
        return C.GBTClassifier(**kw, **weight) if classify else R.GBTRegressor(**kw, **weight)
    if family == "svm":
        one = C.LinearSVC(regParam=p.get("reg", 1e-2), **weight)
        return C.OneVsRest(classifier=one) if task == "multiclass" else one
    if family == "naive_bayes":
        return C.NaiveBayes(modelType="gaussian", **weight)
    if family == "neural_network":
        if not classify:
            return NeuralRegressor(hiddenLayers=list(p.get("hidden_layer_sizes", (128, 64))), maxIter=p.get("max_iter", 20), stepSize=p.get("learning_rate", 0.01), seed=seed, weightCol=p.get("weight"))
        return C.MultilayerPerceptronClassifier(layers=[n_features, *p.get("hidden_layer_sizes", (128, 64)), n_classes], seed=seed, maxIter=p.get("max_iter", 100))
    if family == "kmeans":
        return K.KMeans(k=p.get("n_clusters", 3), seed=seed)
    if family == "gaussian_mixture":
        return K.GaussianMixture(k=p.get("n_clusters", 3), seed=seed)
    raise ValueError(f"no such family: {family}")


def pipeline(family: str, task: str, features: list[str], n_classes: int = 2, seed: int = 0, **p) -> Pipeline:  # noqa: ANN003
    """Assembly, scaling by spread where the family needs it, estimator."""
    scaled = family in SCALED and not (family == "neural_network" and task == "regression")  # that one scales by itself, by the rows that it learns from
    stages: list = [VectorAssembler(inputCols=features, outputCol="_raw" if scaled else "features", handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=False))
    return Pipeline(stages=[*stages, estimator(family, task, len(features), n_classes, seed, **p)])


def baseline(train: DataFrame, target: str, task: str) -> float:
    """The share of the positive class, or the mean: one aggregate."""
    return train.agg(F.avg(F.col(target).cast("double"))).first()[0]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with prediction and, where the model has them, p_0.. probabilities or m_0.. margins."""
    out = model.transform(df)
    for raw, tag in (("probability", "p"), ("rawPrediction", "m")):
        if raw in out.columns:
            size = model.stages[-1].numClasses if hasattr(model.stages[-1], "numClasses") else 2
            out = out.withColumns({f"{tag}_{k}": vector_to_array(raw)[k] for k in range(size)})
            break
    return out.drop("_raw", "features", "rawPrediction", "probability")


Scorer = Callable[[DataFrame], float]


def fit_candidates(train: DataFrame, validation: DataFrame, candidates: Iterable[dict], features: list[str], task: str, metric: str, score: Scorer, n_classes: int = 2, seed: int = 0) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """(results, models). A candidate that fails is a row with its error; the rest go on. Results: family, score, seconds, n_features, error."""
    rows, models = [], {}
    train, validation = spread(train), spread(validation)
    for c in candidates:
        family, began = c["family"], time.time()
        try:
            if family == "baseline":
                value = baseline(train, "label", task)
                scored = validation.withColumns({"prediction": F.lit(float(value >= 0.5) if task == "binary" else value), "p_1": F.lit(value)})
            else:
                models[family] = pipeline(family, task, features, n_classes, seed, **{k: v for k, v in c.items() if k not in ("family", "weighted")}).fit(train)
                scored = predict(models[family], validation)
            rows.append((family, float(score(scored)), time.time() - began, len(features), None))
        except Exception as error:  # noqa: BLE001  a candidate's failure is a result
            rows.append((family, None, time.time() - began, len(features), str(error)[:200]))
    return train.sparkSession.createDataFrame(rows, "family string, score double, seconds double, n_features int, error string"), models


def leaderboard(results: DataFrame, metric: str) -> DataFrame:
    """rank, family, score...: better first by the metric's direction, failures last; the baseline and the winner are marked."""
    order = F.col("score").asc_nulls_last() if better(metric, 0.0, 1.0) else F.col("score").desc_nulls_last()
    from pyspark.sql import Window

    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(order, "family")))  # a row a candidate
    return ranked.withColumns({"is_baseline": F.col("family") == "baseline", "is_winner": (F.col("rank") == 1) & F.col("score").isNotNull()})


def cross_validate(df: DataFrame, make: Callable[[], Pipeline], score: Scorer, n: int, strategy: str = "random") -> list[float]:
    """A score a fold, the whole preparation fitted anew in each. A fold that fails is warned of and left out; if all do, that is an error."""
    from sparkprep.operators.split import fold_parts

    out, failed = [], None
    for k in range(1 if strategy == "temporal" else 0, n):
        train, test = fold_parts(df, k, strategy)
        try:
            out.append(float(score(predict(make().fit(train), test))))
        except Exception as error:  # noqa: BLE001  one fold's failure does not end the others
            failed = error
            warnings.warn(f"fold {k} failed: {str(error)[:200]}", stacklevel=2)
    if failed is not None and not out:
        raise failed
    return out


SPACES: dict[str, dict[str, list]] = {
    "logistic": {"reg": [1e-4, 1e-3, 1e-2, 1e-1]}, "ridge": {"alpha": [1e-4, 1e-2, 1.0]}, "lasso": {"alpha": [1e-4, 1e-3, 1e-2]}, "elastic_net": {"alpha": [1e-3, 1e-2], "l1_ratio": [0.2, 0.5, 0.8]},
    "decision_tree": {"max_depth": [4, 8, 12], "min_samples_leaf": [1, 5, 20]}, "random_forest": {"n_estimators": [50, 100], "max_depth": [6, 10]}, "gradient_boosting": {"n_estimators": [20, 50], "learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
}


def search(df: DataFrame, family: str, task: str, features: list[str], metric: str, score: Scorer, method: str = "grid", space: dict[str, list] | None = None, n_trials: int = 20, n_folds: int = 3, seed: int = 0, strategy: str = "random", key: str | None = None) -> tuple[dict, DataFrame]:
    """(best parameters, trials). grid tries up to 400 points, else a sample; random draws n_trials (at most 200); halving keeps the best third on three times the rows.

    Folds are read from ``fold`` and taken by ``strategy``. Shares of the rows would break an order in
    time, so with temporal folds halving is a random search. Shares are drawn by a digest of ``key``, else of the features.
    """
    method = "random" if method == "halving" and strategy == "temporal" else method
    space = SPACES.get(family, {}) if space is None else space
    points = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())] or [{}]
    draw = random.Random(seed)
    if method != "grid" or len(points) > 400:
        points = draw.sample(points, min(len(points), 400 if method == "grid" else min(200, n_trials)))
    rows: list[tuple] = []
    df = spread(df)

    def trial(p: dict, part: DataFrame) -> float | None:
        try:
            values = cross_validate(part, lambda: pipeline(family, task, features, seed=seed, **p), score, n_folds, strategy)
        except Exception as error:  # noqa: BLE001  a point that cannot be fitted is a trial without a score
            warnings.warn(f"{p} failed: {str(error)[:200]}", stacklevel=2)
            values = []
        value = sum(values) / len(values) if values else None
        rows.append((json.dumps(p, sort_keys=True), value))
        return value

    if method == "halving":
        for share in (9, 3, 1):
            part = df if share == 1 else df.where(F.pmod(F.xxhash64(*([key] if key else features), F.lit(seed)), F.lit(share)) == 0)
            tried = [(v, json.dumps(p, sort_keys=True), p) for p in points if (v := trial(p, part)) is not None]
            tried.sort(key=lambda t: (t[0] if better(metric, 0.0, 1.0) else -t[0], t[1]))
            points = [p for _, _, p in tried[: max(1, -(-len(tried) // 3))]] if share > 1 else [t[2] for t in tried]
        best = points[0] if points else {}
    else:
        tried = [(v, json.dumps(p, sort_keys=True), p) for p in points if (v := trial(p, df)) is not None]
        tried.sort(key=lambda t: (t[0] if better(metric, 0.0, 1.0) else -t[0], t[1]))
        best = tried[0][2] if tried else {}
    return best, df.sparkSession.createDataFrame(rows, "parameters string, score double")


def final_fit(train: DataFrame, validation: DataFrame, family: str, task: str, features: list[str], **p) -> PipelineModel:  # noqa: ANN003
    """Fitted on both parts."""
    return pipeline(family, task, features, **p).fit(train.unionByName(validation))


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """The fitted pipeline and beside it a row of what it needs: input columns, target, labels, seed."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession

    row = SparkSession.active().read.json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["metadata"])
