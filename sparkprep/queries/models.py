"""Split, model, diagnostic, history, chart and source queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from sparkprep.functions.tables import align, capped, read, shared_folder, spread
from sparkprep.operators import associate as A
from sparkprep.operators import charts as K
from sparkprep.operators import clean as C
from sparkprep.operators import diagnose as Q
from sparkprep.operators import forecast as N
from sparkprep.operators import history as R
from sparkprep.operators import metrics as G
from sparkprep.operators import models as M
from sparkprep.operators import neighbours as NB
from sparkprep.operators import profile as P
from sparkprep.operators import quality as L
from sparkprep.operators import split as V
from sparkprep.plans import prepare
from sparkprep.queries.base import Book
from sparkprep.queries.measures import DS, MI, scored
from sparkprep.sources import readers
from sparkprep.streaming import score as Z

book = Book()


def orders(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")


def scratch(spark, name: str) -> str:  # noqa: ANN001
    """A new folder where all executors see it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


book.add(
    "v2_temporal_split",
    lambda s, d: V.temporal_split(orders(s, d), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split"),
    """SELECT o_orderkey, CASE WHEN k > n - round(n * 0.2) THEN 'test' WHEN k > n - round(n * 0.2) - round(n * 0.15) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders)""",
)
book.add(
    "v3_grouped_split",
    lambda s, d: V.grouped_split(orders(s, d), "o_custkey", digest=F.md5(F.col("o_custkey").cast("string"))).select("o_orderkey", "split"),
    """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR), o_custkey) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
  SELECT o_orderkey, CASE WHEN k <= ceil(n * 0.2) THEN 'test' WHEN k <= ceil(n * 0.2) + ceil(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM orders JOIN g USING (o_custkey)""",
)
book.add(
    "v4_stratified_split",
    lambda s, d: V.stratified_split(orders(s, d), "o_orderstatus", "o_orderkey", digest=F.md5(F.col("o_orderkey").cast("string"))).select("o_orderkey", "split"),
    """SELECT o_orderkey, CASE WHEN k > n - round(n * 0.2) THEN 'test' WHEN k > n - round(n * 0.2) - round(n * 0.15) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
#: A number between 0 and 1 by digest of an order, and an order's part by it, as the operators draw them.
UNIT = "(('0x' || substr(md5('0:' || {key}::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
RANDOM = f"(SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.35 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, {UNIT.format(key='o_orderkey')} AS u FROM orders))"
STRATIFIED = """(SELECT *, CASE WHEN k > n - round(n * 0.2) THEN 'test' WHEN k > n - round(n * 0.2) - round(n * 0.15) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0:' || o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders))"""
book.add("v5_random_split", lambda s, d: V.random_split(orders(s, d), "o_orderkey").select("o_orderkey", "split"), f"SELECT o_orderkey, split FROM {RANDOM}")


def driven(spark, sf_dir):  # noqa: ANN001, ANN201
    made, how = V.split(orders(spark, sf_dir).unionByName(orders(spark, sf_dir).where("o_orderkey % 3 = 0")), "classification", "o_orderstatus", "o_orderkey")
    return made.select("o_orderkey", "split", F.lit(how["strategy"]).alias("strategy"))


book.add("v1_v6_u2_split", driven, f"SELECT o_orderkey, split, 'stratified' AS strategy FROM {STRATIFIED}")


def sized(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sizes of a split by the three order states, which cannot be cut to the shares asked for, and whether that is noted."""
    made, how = V.split(orders(spark, sf_dir), "regression", "o_totalprice", "o_orderkey", group="o_orderstatus")
    return made.sparkSession.createDataFrame([(how["strategy"], k, how["sizes"].get(k, 0), any(note.startswith(k) for note in how["notes"])) for k in ("test", "validation")], "strategy string, part string, n long, noted boolean")


book.add(
    "v6_size_deviation",
    sized,
    """WITH g AS (SELECT o_orderstatus, row_number() OVER (ORDER BY md5('0:' || o_orderstatus), o_orderstatus) AS k, count(*) OVER () AS groups, c FROM (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1)),
  p AS (SELECT CASE WHEN k <= ceil(groups * 0.2) THEN 'test' WHEN k <= ceil(groups * 0.2) + ceil(groups * 0.15) THEN 'validation' ELSE 'train' END AS part, c FROM g)
  SELECT 'grouped' AS strategy, w.part, coalesce(sum(c), 0)::BIGINT AS n, abs(coalesce(sum(c), 0) / (SELECT count(*) FROM orders) - any_value(share)) > 0.1 * any_value(share) AS noted FROM (VALUES ('test', 0.2), ('validation', 0.15)) w(part, share) LEFT JOIN p ON p.part = w.part GROUP BY ALL""",
)
book.add("u3_disjoint_groups", lambda s, d: V.shared_groups(V.random_split(orders(s, d), "o_orderkey"), "o_custkey"), f"SELECT o_custkey, count(DISTINCT split) AS parts FROM {RANDOM} GROUP BY 1 HAVING count(DISTINCT split) > 1")
book.add("u3_v3_groups_stay_together", lambda s, d: V.shared_groups(V.grouped_split(orders(s, d), "o_custkey"), "o_custkey"), "SELECT o_custkey, count(DISTINCT o_custkey) AS parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1")


def sealed(spark, sf_dir):  # noqa: ANN001, ANN201
    """The train rows' mean, from their profile, as the forecast of the test rows."""
    holdout = V.Holdout(orders(spark, sf_dir), "classification", "o_orderstatus", "o_orderkey")
    mean = holdout.profile(["o_totalprice"]).first()["mean"]
    return holdout.finish(lambda test: G.regression_metrics(test.withColumn("guess", F.lit(mean)), "o_totalprice", "guess").select("n", "rmse", "mae", F.lit(mean).alias("train_mean")))


book.add(
    "v7_sealed_holdout",
    sealed,
    f"SELECT count(*) AS n, sqrt(avg((o_totalprice - m) ** 2)) AS rmse, avg(abs(o_totalprice - m)) AS mae, max(m) AS train_mean FROM {STRATIFIED}, (SELECT avg(o_totalprice) AS m FROM {STRATIFIED} WHERE split = 'train') WHERE split = 'test'",
    "rmse mae train_mean",
)
book.add("v8_label_encode", lambda s, d: V.label_encode(orders(s, d), "o_orderstatus")[0].select("o_orderkey", "label_index"), "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS label_index FROM orders")
book.add(
    "v9_temporal_folds",
    lambda s, d: V.folds(orders(s, d), "temporal", "o_orderkey", time="o_orderdate").select("o_orderkey", "fold"),
    "SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 5 / (count(*) OVER ())::DOUBLE)::INT AS fold FROM orders",
)
book.add(
    "v9_stratified_folds",
    lambda s, d: V.folds(orders(s, d), "stratified", "o_orderkey", label="o_orderstatus").select("o_orderkey", "fold"),
    "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderstatus NULLS FIRST, md5('0:' || o_orderkey::VARCHAR), o_orderkey) - 1) % 5)::INT AS fold FROM orders",
)
for _strategy, _key in (("grouped", "o_custkey"), ("random", "o_orderkey")):
    book.add(f"v9_{_strategy}_folds", lambda s, d, w=_strategy: V.folds(orders(s, d), w, "o_orderkey", group="o_custkey").select("o_orderkey", "fold"), f"SELECT o_orderkey, floor({UNIT.format(key=_key)} * 5)::INT AS fold FROM orders")
book.add(
    "v8_many_classes",
    lambda s, d: V.label_encode(orders(s, d), "o_orderdate")[0].select("o_orderkey", "label_index"),
    "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderdate) - 1)::INT AS label_index FROM orders",
)
book.add("a20_class_counts", lambda s, d: V.partition_sizes(orders(s, d), ["o_orderstatus"]), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
book.add("u1_union_parts", lambda s, d: (t := V.random_split(orders(s, d), "o_orderkey")).where("split = 'train'").unionByName(t.where("split = 'validation'")).unionByName(t.where("split = 'test'")).select("o_orderkey"), "SELECT o_orderkey FROM orders")


def labelled(spark, sf_dir):  # noqa: ANN001, ANN201
    """Customers with a label that their numbers tell in part, a fold each."""
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_acctbal / 1000 AS x1", "c_nationkey * 1.0D AS x2", "c_custkey % 5 AS fold", "CAST((c_acctbal / 1000 + c_custkey % 7 > 6) AS DOUBLE) AS label", "c_acctbal * 2 + c_nationkey AS y")


def accuracy(df) -> float:  # noqa: ANN001
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


book.add("n1_baseline", lambda s, d: s.createDataFrame([(M.baseline(labelled(s, d), y, t), t) for y, t in (("label", "binary"), ("y", "regression"))], "base double, task string"), "SELECT avg((c_acctbal / 1000 + c_custkey % 7 > 6)::INT) AS base, 'binary' AS task FROM customer UNION ALL SELECT avg(c_acctbal * 2 + c_nationkey), 'regression' FROM customer", "base")
book.add(
    "n2_linear_regression",
    lambda s, d: M.pipeline("linear", "regression", ["x1"]).fit(t := labelled(s, d).withColumn("label", F.col("y"))).transform(t).select("key", "prediction"),
    "SELECT c_custkey AS key, a + b * c_acctbal / 1000 AS prediction FROM customer, (SELECT regr_slope(c_acctbal * 2 + c_nationkey, c_acctbal / 1000) AS b, regr_intercept(c_acctbal * 2 + c_nationkey, c_acctbal / 1000) AS a FROM customer)",
    "prediction",
)


def _regressed(extra: str) -> str:
    return f"SELECT c_custkey AS key, a + b * c_acctbal / 1000 AS prediction FROM customer, (SELECT regr_slope(c_acctbal * 2 + c_nationkey, c_acctbal / 1000) AS b, regr_intercept(c_acctbal * 2 + c_nationkey, c_acctbal / 1000) AS a FROM customer WHERE {extra})"


def refitted(spark, sf_dir):  # noqa: ANN001, ANN201
    """Fitted on two parts, saved, read again and applied to all rows."""
    t = labelled(spark, sf_dir).withColumn("label", F.col("y"))
    path = scratch(spark, "model")
    M.save_model(M.final_fit(t.where("fold in (1, 2)"), t.where("fold = 3"), "linear", "regression", ["x1"]), path, {"target": "y", "features": ["x1"]})
    model, about = M.load_model(path)
    return M.predict(model, t).select("key", "prediction", F.lit(about["target"]).alias("target"))


book.add("n20_s17_n23_final_fit_saved", refitted, f"SELECT *, 'y' AS target FROM ({_regressed('c_custkey % 5 IN (1, 2, 3)')})", "prediction")


def penalised(spark, sf_dir):  # noqa: ANN001, ANN201
    t = spread(labelled(spark, sf_dir).withColumn("label", F.col("y")))
    made = None
    for family in ("ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting", "decision_tree"):
        scored = M.predict(M.pipeline(family, "regression", ["x1", "x2"]).fit(t.where("fold != 0")), t.where("fold = 0"))
        one = G.regression_metrics(scored, "y", "prediction").select(F.lit(family).alias("family"), "n", "r2")
        made = one if made is None else made.unionByName(one)
    return made


book.add("n3_regressors", penalised)
book.add("n11_neural_network", lambda s, d: M.predict(M.pipeline("neural_network", "binary", ["x1", "x2"], hidden_layer_sizes=(8,), max_iter=50).fit((t := labelled(s, d)).where("fold != 0")), t.where("fold = 0")).select("key", "label", "prediction"))


def curved(spark, sf_dir):  # noqa: ANN001, ANN201
    """How far a network's error on customers it was not trained on is below the mean's, and below a line's, on a bent target."""
    t = labelled(spark, sf_dir).withColumn("label", F.pow(F.col("x1") - 4.5, F.lit(2.0)) + F.col("x2") / 5)
    t = spread(t)
    train, test = t.where("fold != 0"), t.where("fold = 0")
    mean = train.agg(F.avg("label")).first()[0]
    out = None
    for family, options in (("neural_network", {"hidden_layer_sizes": (32, 16), "max_iter": 30}), ("linear", {})):
        p = M.predict(M.pipeline(family, "regression", ["x1", "x2"], **options).fit(train), test)
        one = p.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("label") - mean, F.lit(2.0))).alias("mean_mse"), F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2.0))).alias("mse"))
        one = one.select(F.lit(family).alias("family"), "n", "mean_mse", (F.col("mse") < 0.1 * F.col("mean_mse")).alias("below_a_tenth"))
        out = one if out is None else out.unionByName(one)
    return out


_CURVE = "(SELECT c_custkey % 5 AS fold, (c_acctbal / 1000 - 4.5) ** 2 + c_nationkey / 5 AS label FROM customer)"
book.add(
    "n11_neural_regression",
    curved,
    f"SELECT family, n, mean_mse, family = 'neural_network' AS below_a_tenth FROM (SELECT count(*) AS n, avg((label - (SELECT avg(label) FROM {_CURVE} WHERE fold != 0)) ** 2) AS mean_mse FROM {_CURVE} WHERE fold = 0), (VALUES ('neural_network'), ('linear')) f(family)",
    "mean_mse",
)


def native(spark, sf_dir):  # noqa: ANN001, ANN201
    t = labelled(spark, sf_dir).withColumn("label", F.col("y"))
    return spark.createDataFrame(Q.native_importances(M.pipeline("linear", "regression", ["x1", "x2"]).fit(t), ["x1", "x2"]), "feature string, share double")


book.add(
    "q9_native_importances",
    native,
    "SELECT f AS feature, w / sum(w) OVER () AS share FROM (SELECT 'x1' AS f, 2000 * stddev_samp(c_acctbal / 1000) AS w FROM customer UNION ALL SELECT 'x2', stddev_samp(c_nationkey::DOUBLE) FROM customer)",
    "share",
)


def shortlisted(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = []
    for table, task in (("customer", "binary"), ("orders", "multiclass"), ("part", "regression"), ("events", "anomaly")):
        t = read(spark, sf_dir, table)
        rows += [(table, i, x["family"]) for i, x in enumerate(L.shortlist_models(task, t.count(), len(t.columns)))]
    return spark.createDataFrame(rows, "source string, place int, family string")


_CLASSIFY = "(0, 'baseline'), (1, 'logistic'), (2, 'random_forest'), (3, 'gradient_boosting')"
book.add(
    "l8_shortlist_models",
    shortlisted,
    f"""SELECT source, place, family FROM (VALUES ('customer'), ('orders')) x(source), (VALUES {_CLASSIFY}) t(place, family) UNION ALL SELECT 'customer', 4, 'naive_bayes' FROM customer HAVING count(*) < 2000 UNION ALL SELECT 'orders', 4, 'naive_bayes' FROM orders HAVING count(*) < 2000
  UNION ALL SELECT 'part', place, family FROM (VALUES (0, 'baseline'), (1, 'ridge'), (2, 'random_forest'), (3, 'gradient_boosting')) t(place, family) UNION ALL SELECT 'events', place, family FROM (VALUES (0, 'isolation_forest'), (1, 'local_outlier_factor')) t(place, family)""",
)


def candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    df = labelled(spark, sf_dir)
    names = [{"family": f} for f in ("baseline", "logistic", "ridge", "decision_tree", "random_forest", "gradient_boosting", "svm", "naive_bayes", "no_such")]
    results, _ = M.fit_candidates(df.where("fold != 0"), df.where("fold = 0"), names, ["x1", "x2"], "binary", "accuracy", accuracy)
    return M.leaderboard(results, "accuracy").select("rank", "family", "score", "is_baseline", "is_winner")


book.add("n3_n18_t3_candidates", candidates)
book.add("n9_j5_nearest_neighbours", lambda s, d: NB.nearest(t := labelled(s, d), t.where("key % 50 = 0"), "key", ["x1", "x2"], 3), """WITH t AS (SELECT c_custkey AS key, c_acctbal / 1000 AS a, c_nationkey * 1.0::DOUBLE AS b FROM customer)
  SELECT q.key AS query, row_number() OVER (PARTITION BY q.key ORDER BY sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2), t.key)::INT AS place, t.key AS id, sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2) AS distance FROM t, t q WHERE q.key % 50 = 0 QUALIFY place <= 3""", "distance")  # fmt: skip
book.add("n9_knn", lambda s, d: NB.knn_predict((t := labelled(s, d)).where("fold != 0"), t.where("fold = 0"), "key", ["x1", "x2"], "label", 5, scaled=False), """WITH t AS (SELECT c_custkey AS key, c_acctbal / 1000 AS a, c_nationkey * 1.0::DOUBLE AS b, (c_acctbal / 1000 + c_custkey % 7 > 6)::INT::DOUBLE AS y FROM customer),
  n AS (SELECT q.key, t.y FROM t, t q WHERE q.key % 5 = 0 AND t.key % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2), t.key) <= 5)
  SELECT key, y AS prediction FROM n GROUP BY key, y QUALIFY row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, y) = 1""", "prediction")  # fmt: skip
_SPREAD = "s AS (SELECT stddev_pop(c_acctbal / 1000) AS sa, stddev_pop(c_nationkey::DOUBLE) AS sb FROM customer WHERE c_custkey % 5 <> 0)"
book.add(
    "n19_scaled_neighbours",
    lambda s, d: NB.knn_predict((t := labelled(s, d)).where("fold != 0"), t.where("fold = 0"), "key", ["x1", "x2"], "y", 3, classify=False),
    f"""WITH {_SPREAD}, t AS (SELECT c_custkey AS key, c_acctbal / 1000 / sa AS a, c_nationkey / sb AS b, c_acctbal * 2 + c_nationkey AS y FROM customer, s),
  n AS (SELECT q.key, t.y FROM t, t q WHERE q.key % 5 = 0 AND t.key % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY round((q.a - t.a) ** 2 + (q.b - t.b) ** 2, 12), t.key) <= 3)
  SELECT key, avg(y) AS prediction FROM n GROUP BY key""",
    "prediction",
)
for _family in ("kmeans", "gaussian_mixture"):
    book.add(f"n12_{_family}", lambda s, d, f=_family: M.predict(M.pipeline(f, "clustering", ["x1", "x2"]).fit(t := labelled(s, d)), t).select("key", F.col("prediction").alias("cluster")))
book.add("n13_dbscan", lambda s, d: NB.dbscan(labelled(s, d), "key", ["x1", "x2"], 0.05, 3, scaled=False), """WITH RECURSIVE t AS (SELECT c_custkey AS key, c_acctbal / 1000 AS a, c_nationkey * 1.0::DOUBLE AS b FROM customer),
  l AS (SELECT x.key AS x, y.key AS y FROM t x JOIN t y ON x.b = y.b AND abs(x.a - y.a) <= 0.0501 AND (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.05 * 0.05::DOUBLE),
  core AS (SELECT x AS key FROM l GROUP BY x HAVING count(*) >= 3), e AS (SELECT x, y FROM l WHERE x IN (FROM core) AND y IN (FROM core)),
  reach AS (SELECT key, key AS low FROM core UNION SELECT e.x, r.low FROM reach r JOIN e ON e.y = r.key WHERE r.low < e.x),
  c AS (SELECT key, min(low) AS cluster FROM reach GROUP BY key), b AS (SELECT l.x AS key, arg_min(c.cluster, c.key) AS near FROM l JOIN c ON c.key = l.y GROUP BY l.x)
  SELECT t.key, coalesce(c.cluster, b.near, -1) AS cluster FROM t LEFT JOIN c USING (key) LEFT JOIN b USING (key)""")  # fmt: skip
book.add("n14_isolation_forest", lambda s, d: NB.isolation_forest(t := labelled(s, d), t, "key", ["x1", "x2"]))
book.add("n15_local_outlier_factor", lambda s, d: NB.local_outlier_factor((t := labelled(s, d)).where("fold != 0"), t.where("fold = 0"), "key", ["x1", "x2"], 10, scaled=False), """WITH t AS (SELECT c_custkey AS key, c_acctbal / 1000 AS a, c_nationkey * 1.0::DOUBLE AS b FROM customer), r AS (SELECT * FROM t WHERE key % 5 <> 0),
  own AS (SELECT q.key AS q, r.key AS id, sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2) AS d FROM r q JOIN r ON q.key <> r.key QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2), r.key) <= 10),
  kd AS (SELECT q AS id, max(d) AS kd FROM own GROUP BY q), lrd AS (SELECT q AS id, 1 / greatest(avg(greatest(d, kd)), 1e-12) AS lrd FROM own JOIN kd USING (id) GROUP BY q),
  near AS (SELECT q.key AS key, r.key AS id, sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2) AS d FROM t q, r WHERE q.key % 5 = 0 QUALIFY row_number() OVER (PARTITION BY q.key ORDER BY sqrt((q.a - r.a) ** 2 + (q.b - r.b) ** 2), r.key) <= 10)
  SELECT key, avg(lrd) * greatest(avg(greatest(d, kd)), 1e-12) AS lof FROM near JOIN kd USING (id) JOIN lrd USING (id) GROUP BY key""", "lof")  # fmt: skip


def daily(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("value"))


SEASONAL = """WITH t AS (SELECT event_type, date_trunc('day', ts) AS day, sum(value) AS value FROM events GROUP BY ALL), l AS (SELECT event_type, 7 - row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS slot, value FROM t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 7)
  SELECT m.event_type, step::INT AS step, coalesce(l.value, m.v) AS forecast FROM (SELECT event_type, avg(value) AS v FROM t GROUP BY 1) m, range(1, 11) r(step) LEFT JOIN l ON l.event_type = m.event_type AND l.slot = (step - 1) % 7"""
book.add("n16_seasonal_naive", lambda s, d: N.seasonal_naive(daily(s, d), "event_type", "day", "value", 7, 10), SEASONAL, "forecast")
book.add("n16_season_from_step", lambda s, d: N.seasonal_naive(daily(s, d), "event_type", "day", "value", None, 10), SEASONAL, "forecast")
book.add("n17_exponential_smoothing", lambda s, d: N.exponential_smoothing(daily(s, d), "event_type", "day", "value", 7, 5))
book.add("n17_theta", lambda s, d: N.theta(daily(s, d), "event_type", "day", "value", 5))


book.add("n22_temporal_search", lambda s, d: M.search(labelled(s, d), "logistic", "binary", ["x1", "x2"], "accuracy", accuracy, "halving", n_trials=2, n_folds=5, strategy="temporal")[1])
for _name, _method in (("n21_v10_search", "grid"), ("n22_halving", "halving")):
    book.add(_name, lambda s, d, m=_method: M.search(labelled(s, d), "logistic", "binary", ["x1", "x2"], "accuracy", accuracy, m)[1])
book.add(
    "q5_residuals",
    lambda s, d: Q.residual_statistics(scored(s, d), "y", "yhat"),
    f"""WITH moments AS (SELECT count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, avg(abs(e)) AS mean_absolute, max(abs(e)) AS max_absolute, corr(abs(e), yhat) AS spread_correlation, avg(e) / stddev_samp(e) AS bias_ratio,
  avg((e - m) ** 3) / (avg((e - m) ** 2) ** 1.5) AS skew, avg((e - m) ** 4) / (avg((e - m) ** 2) ** 2) - 3 AS kurtosis FROM (SELECT y - yhat AS e, yhat, avg(y - yhat) OVER () AS m FROM {DS})),
  a AS (SELECT *, n::DOUBLE AS c FROM moments),
  b AS (SELECT *, skew / sqrt(6 * (c - 2) / ((c + 1) * (c + 3))) AS y, 3 * (c ** 2 + 27 * c - 70) * (c + 1) * (c + 3) / ((c - 2) * (c + 5) * (c + 7) * (c + 9)) AS b2,
    (kurtosis + 3 - 3 * (c - 1) / (c + 1)) / sqrt(24 * c * (c - 2) * (c - 3) / ((c + 1) ** 2 * (c + 3) * (c + 5))) AS x,
    6 * (c ** 2 - 5 * c + 2) / ((c + 7) * (c + 9)) * sqrt(6 * (c + 3) * (c + 5) / (c * (c - 2) * (c - 3))) AS b1,
    sqrt((c - 2) * ln(1 + spread_correlation ** 2 / (1 - spread_correlation ** 2))) * (8 * (c - 2) + 1) / (8 * (c - 2) + 3) / sqrt(2) AS u FROM a),
  e AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / b1 ** 2)) AS q, 1 / (1 + 0.3275911 * u) AS k FROM b),
  g AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS zs, (1 - 2 / (9 * q) - cbrt((1 - 2 / q) / (1 + x * sqrt(2 / (q - 4))))) / sqrt(2 / (9 * q)) AS zk FROM e)
  SELECT n, mean, std, mean_absolute, max_absolute, spread_correlation, bias_ratio, skew, kurtosis, zs ** 2 + zk ** 2 AS normality_k2, exp(-(zs ** 2 + zk ** 2) / 2) AS normality_p,
    (0.254829592 * k - 0.284496736 * k ** 2 + 1.421413741 * k ** 3 - 1.453152027 * k ** 4 + 1.061405429 * k ** 5) * exp(-(u * u)) AS spread_p FROM g""",
    "mean std mean_absolute max_absolute spread_correlation bias_ratio skew kurtosis normality_k2 normality_p spread_p",
)
book.add(
    "q4_fairness_slices",
    lambda s, d: Q.fairness_slices(scored(s, d), "o_orderpriority", "label", "prediction"),
    f"SELECT o_orderpriority AS value, count(*) AS n, avg((label = prediction)::INT) AS accuracy, avg((label = prediction)::INT) - (SELECT avg((label = prediction)::INT) FROM {DS}) AS delta FROM {DS} GROUP BY 1",
    "accuracy delta",
)
book.add(
    "q7_worst_predictions",
    lambda s, d: Q.worst_predictions(scored(s, d).withColumn("yhat", F.round("yhat", 2)), "y", "yhat", "o_orderkey", k=5, context=["o_orderpriority"]),
    f"SELECT o_orderkey, y, round(yhat, 2) AS yhat, abs(y - round(yhat, 2)) AS badness, o_orderpriority FROM {DS} ORDER BY badness DESC, o_orderkey LIMIT 5",
    "y yhat badness",
)
_DRAW = "(('0x' || substr(md5('0:' || rep::VARCHAR || ':' || o_orderkey::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"
_POISSON = [sum(0.36787944117144233 / math.factorial(j) for j in range(k + 1)) for k in range(8)]
book.add(
    "q3_bootstrap",
    lambda s, d: Q.bootstrap_intervals(scored(s, d), "label", "prediction", "o_orderkey"),
    f"""WITH w AS (SELECT rep, label, prediction, {' + '.join(f'(u >= {t!r}::DOUBLE)::INT' for t in _POISSON)} AS w FROM (SELECT rep, label, prediction, {_DRAW} AS u FROM {DS}, range(1, 301) r(rep))),
  c AS (SELECT rep, sum(w) AS n, sum(w) FILTER (label = prediction) AS h, coalesce(sum(w) FILTER (label = 1 AND prediction = 1), 0) AS tp, coalesce(sum(w) FILTER (prediction = 1), 0) AS pp, coalesce(sum(w) FILTER (label = 1), 0) AS p FROM w GROUP BY rep),
  m AS (SELECT 'accuracy' AS metric, h / n::DOUBLE AS v FROM c UNION ALL SELECT 'precision', tp / pp::DOUBLE FROM c UNION ALL SELECT 'recall', tp / p::DOUBLE FROM c UNION ALL SELECT 'f1', 2 * tp / (pp + p)::DOUBLE FROM c)
  SELECT metric, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM m GROUP BY metric""",
    "low high",
)
book.add("q8_permutation_importance", lambda s, d: Q.permutation_importance(scored(s, d).select("o_orderkey", "score", "label", "yhat"), ["score", "yhat"], "o_orderkey", lambda t: accuracy(t.withColumn("prediction", (F.col("score") > 0.5).cast("int")))))


def dependence(spark, sf_dir):  # noqa: ANN001, ANN201
    df = labelled(spark, sf_dir).withColumn("label", F.col("y"))
    return Q.partial_dependence(df, M.pipeline("linear", "regression", ["x1", "x2"]).fit(df), "x1")


book.add(
    "q10_partial_dependence",
    dependence,
    """SELECT a + (b - a) * k / 29 AS value, 2000 * (a + (b - a) * k / 29) + m AS mean_prediction FROM range(30) r(k), (SELECT quantile_cont(c_acctbal / 1000, 0.01) AS a, quantile_cont(c_acctbal / 1000, 0.99) AS b, avg(c_nationkey) AS m FROM customer)""",
    "value mean_prediction",
)


def probes(spark, sf_dir):  # noqa: ANN001, ANN201
    df = labelled(spark, sf_dir).withColumn("label", F.col("y"))
    return Q.what_if(df, M.pipeline("linear", "regression", ["x1", "x2"]).fit(df), ["x1", "x2"], "key")


book.add(
    "q11_what_if",
    probes,
    """WITH t AS (SELECT c_custkey AS key, c_acctbal / 1000 AS a, c_nationkey * 1.0::DOUBLE AS b FROM customer), q AS (SELECT quantile_cont(a, 0.1) AS a1, quantile_cont(a, 0.5) AS a5, quantile_cont(a, 0.9) AS a9, quantile_cont(b, 0.1) AS b1, quantile_cont(b, 0.5) AS b5, quantile_cont(b, 0.9) AS b9 FROM t),
  y AS (SELECT a, b FROM t, q ORDER BY abs(a - a5) / (a9 - a1) + abs(b - b5) / (b9 - b1), key LIMIT 1)
  SELECT feature, moved_to, 2000 * a + b AS before, CASE feature WHEN 'x1' THEN 2000 * CASE moved_to WHEN 'p10' THEN a1 ELSE a9 END + b ELSE 2000 * a + CASE moved_to WHEN 'p10' THEN b1 ELSE b9 END END AS after
  FROM y, q, (VALUES ('x1'), ('x2')) f(feature), (VALUES ('p10'), ('p90')) m(moved_to)""",
    "before after",
)
FLAWED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, 1 AS one, CAST(o_custkey AS {text}) AS code, o_totalprice * 2 AS twice, o_totalprice, o_orderstatus FROM {orders}"
FD = f"({FLAWED.format(text='VARCHAR', orders='orders')})"


def _findings_sql() -> str:
    """Each rule on each column that it can be about."""
    numbers, texts = ["o_orderkey", "price", "one", "twice", "o_totalprice"], ["code", "o_orderstatus"]
    out = []

    def rule(code: str, column: str, severity: str, source: str, when: str) -> None:
        named = f"'{column}'" if column else "NULL::VARCHAR"
        out.append(f"SELECT '{code}' AS code, {named} AS \"column\", {severity} AS severity FROM ({source}) WHERE {when}")

    for c in numbers + texts:
        n = f"SELECT count(*) AS n, count({c}) AS v, count(DISTINCT {c}) AS d, (count(*) - count({c})) / count(*)::DOUBLE AS m FROM {FD}"
        rule("all_missing_column", c, "'high'", n, "m >= 1 AND n > 0")
        rule("high_missingness", c, "CASE WHEN m >= 0.9 THEN 'critical' WHEN m >= 0.5 THEN 'high' WHEN m >= 0.2 THEN 'medium' ELSE 'low' END", n, "m >= 0.05 AND m < 1")
        rule("constant_column", c, "'medium'", n, "d <= 1 AND m < 1")
        if c in texts:
            rule("high_cardinality_categorical", c, "'medium'", n, "d >= 50 AND d < 0.95 * v")
            rule("identifier_column", c, "'low'", n, "d >= 0.999 * v AND n >= 20")
            t = f"SELECT count(*) AS n, count({c}) AS v, count(try_cast(replace(trim({c}), ',', '') AS DOUBLE)) AS p, count(*) FILTER (NOT regexp_matches({c}, '\\S')) AS b, count(*) FILTER (regexp_matches({c}, '^\\s|\\s$') AND regexp_matches({c}, '\\S')) AS u FROM {FD}"
            rule("numeric_stored_as_text", c, "'medium'", t, "p >= 0.9 * v AND v > 0")
            rule("mixed_types", c, "'medium'", t, "p > 0 AND p < v AND p < 0.9 * v")
            rule("blank_strings", c, "'low'", t, "b >= 0.01 * n")
            rule("untrimmed_strings", c, "'low'", t, "u >= 0.01 * n")
            continue
        k = f"SELECT CASE WHEN var_pop({c}) = 0 THEN 0 ELSE abs(skewness({c})) END AS k FROM {FD}"
        rule("skewed_numeric", c, "CASE WHEN k >= 5 THEN 'medium' ELSE 'low' END", k, "k >= 2")
        o = f"SELECT count(*) FILTER (b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) / count({c})::DOUBLE AS f FROM {FD}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {FD})"
        rule("outlier_heavy", c, "'medium'", o, "f >= 0.10")
        z = f"SELECT max(n) FILTER (k = 1) AS n1, max(n) FILTER (k = 2) AS n2, count(*) AS d, sum(n) AS v, any_value(s) AS s, any_value(a) AS a FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS k FROM {FD} WHERE {c} IS NOT NULL GROUP BY {c}), (SELECT stddev_samp({c}) AS s, avg({c}) AS a FROM {FD})"
        rule("near_zero_variance", c, "'low'", z, "d > 1 AND (n1 > 19 * n2 AND d < 0.1 * v OR s = 0 OR abs(s / a) < 1e-4)")
        for e in numbers[numbers.index(c) + 1 :]:
            rule("collinear_features", f"{c},{e}", "'low'", f"SELECT CASE WHEN var_pop({c}) > 0 AND var_pop({e}) > 0 THEN abs(corr({c}, {e})) END AS r FROM {FD}", "round(r, 2) >= 0.95")
    w = f"SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {FD})) AS d, count(*) FILTER (price IS NULL) / (7.0 * count(*)) AS m FROM {FD}"
    rule("duplicate_rows", "", "CASE WHEN d >= 0.2 * n THEN 'high' WHEN d >= 0.05 * n THEN 'medium' ELSE 'low' END", w, "d > 0")
    rule("tiny_dataset", "", "'high'", w, "n < 50")
    rule("small_dataset", "", "'medium'", w, "n >= 50 AND n < 200")
    rule("more_features_than_rows", "", "'high'", w, "7 >= n")
    rule("wide_dataset", "", "'medium'", w, "7 > 0.5 * n AND 7 < n")
    rule("missing_cells", "", "'low'", w, "m >= 0.05")
    y = f"SELECT count(*) AS k, min(n) AS least, max(n) / min(n)::DOUBLE AS i FROM (SELECT o_orderstatus, count(*) AS n FROM {FD} WHERE o_orderstatus IS NOT NULL GROUP BY 1)"
    rule("target_missing_values", "o_orderstatus", "'high'", f"SELECT count(*) AS n FROM {FD} WHERE o_orderstatus IS NULL", "n > 0")
    rule("target_constant", "o_orderstatus", "'critical'", y, "k <= 1")
    rule("target_single_row_class", "o_orderstatus", "'high'", y, "k <= 50 AND least = 1")
    rule("target_rare_class", "o_orderstatus", "'medium'", y, "k <= 50 AND least > 1 AND least < 10")
    rule("target_imbalanced", "o_orderstatus", "CASE WHEN i > 10 THEN 'high' ELSE 'medium' END", y, "k <= 50 AND i > 3")
    return " UNION ALL ".join(out)


book.add("l4_quality_findings", lambda s, d: L.quality_findings(s.sql(FLAWED.format(text="STRING", orders="{orders}"), orders=read(s, d, "orders")), "o_orderstatus").select("code", "column", "severity"), _findings_sql())
_OUT = "(SELECT count(*) FILTER (b > a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) / count({c})::DOUBLE AS f, count(DISTINCT {c}) AS d, skewness({c}) AS k, min({c}) AS low FROM orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders))"
_DECIDED = [
    "SELECT 'drop_duplicate_rows' AS decision, '' AS columns FROM orders HAVING count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM orders))", "SELECT 'drop_rows_missing_target', 'o_orderstatus' FROM orders HAVING count(*) >= 0",
    "SELECT unnest(['date_decompose', 'cyclical_encode']), 'o_orderdate' FROM (SELECT count(DISTINCT o_orderdate) AS d FROM orders) WHERE d > 1",
    "SELECT CASE WHEN d <= 15 THEN 'one_hot_encode' ELSE 'frequency_encode' END, 'o_orderpriority' FROM (SELECT count(DISTINCT o_orderpriority) AS d, count(*) AS n FROM orders) WHERE d > 1 AND d < 0.95 * n",
    "SELECT 'drop_correlated', 'o_orderkey,o_custkey,o_totalprice' FROM orders HAVING count(*) >= 0",
]
for _c in ("o_orderkey", "o_custkey", "o_totalprice"):
    _o = _OUT.format(c=_c)
    _DECIDED += [f"SELECT 'clip_outliers', '{_c}' FROM {_o} WHERE f > 0.02 AND d > 1", f"SELECT 'log_transform', '{_c}' FROM {_o} WHERE k > 1.5 AND low >= 0 AND d > 1", f"SELECT CASE WHEN f > 0.02 THEN 'robust_scale' ELSE 'standard_scale' END, '{_c}' FROM {_o} WHERE d > 1"]
book.add("l5_l6_recommendations", lambda s, d: s.createDataFrame([(x["action"], ",".join(x["columns"])) for x in L.recommend_cleaning(orders(s, d), "o_orderstatus")] + [(x["op"], ",".join(x["columns"])) for x in L.recommend_features(orders(s, d), "o_orderstatus")], "decision string, columns string"), " UNION ALL ".join(_DECIDED))
TASK = """SELECT '{c}' AS target, CASE WHEN k > 50 OR f AND k > 2 OR {number} AND k > 20 THEN 'regression' WHEN k <= 2 THEN 'binary' ELSE 'multiclass' END AS task FROM (SELECT count(DISTINCT {c}) AS k, {fraction} AS f FROM {t})"""
book.add(
    "l7_infer_task",
    lambda s, d: s.createDataFrame([(c, L.infer_task(read(s, d, t), c)["task"]) for t, c in (("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("orders", "o_custkey"), ("labels", "toxic"), ("part", "p_size"), ("documents", "lang"))], "target string, task string"),
    " UNION ALL ".join(TASK.format(t=t, c=c, number=str(number).lower(), fraction=f"coalesce(bool_or({c} <> floor({c})), false)" if number else "false") for t, c, number in (("orders", "o_orderstatus", False), ("orders", "o_totalprice", True), ("orders", "o_custkey", True), ("labels", "toxic", True), ("part", "p_size", True), ("documents", "lang", False))),
)


def prepared(spark, sf_dir):  # noqa: ANN001, ANN201
    """Cleaning and features fitted on four folds and replayed on the fifth."""
    df = orders(spark, sf_dir).withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).withColumn("y", (F.col("o_orderstatus") == "F").cast("double"))
    plan = prepare.Preparation(
        [{"action": "impute_missing", "columns": ["price"], "strategy": "median"}, {"action": "clip_outliers", "columns": ["price"], "lower": "1000", "upper": "300000"}],
        [{"op": "frequency_encode", "columns": ["o_orderpriority"]}],
        "y",
    )
    return plan.fit(df.where("o_orderkey % 5 != 0")).transform(df.where("o_orderkey % 5 = 0")).select("o_orderkey", "price", "o_orderpriority_frequency")


book.add(
    "c1_c16_e13_preparation",
    prepared,
    """WITH t AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders), m AS (SELECT quantile_cont(p, 0.5) AS md FROM t WHERE o_orderkey % 5 <> 0),
  f AS (SELECT o_orderpriority, count(*) / (sum(count(*)) OVER ())::DOUBLE AS q FROM t WHERE o_orderkey % 5 <> 0 GROUP BY 1)
  SELECT o_orderkey, least(300000, greatest(1000, coalesce(p, md))) AS price, q AS o_orderpriority_frequency FROM t JOIN f USING (o_orderpriority), m WHERE o_orderkey % 5 = 0""",
    "price o_orderpriority_frequency",
)


#: A date in six forms by the order's key, and what does not parse.
SAID = "CASE o_orderkey % 7 WHEN 0 THEN concat(' ', date_format(o_orderdate, 'yyyy-MM-dd'), ' ') WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 4 THEN date_format(o_orderdate, 'dd MMM yyyy') WHEN 5 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE 'never' END"


def parsed_again(spark, sf_dir):  # noqa: ANN001, ANN201
    """Dates of many forms, days first, seconds and an unparsable column: fitted, and replayed on other rows as a batch and as a stream."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(SAID).alias("said"), F.col("o_orderdate").cast("timestamp").cast("long").cast("string").alias("seconds"), F.lit("none").alias("none"))
    model = prepare.Preparation([{"action": "parse_datetime", "columns": ["said", "none"], "dayfirst": "true"}, {"action": "parse_datetime", "columns": ["seconds"], "unit": "s"}]).fit(df.where("o_orderkey % 5 != 0"))
    new, base = df.where("o_orderkey % 5 = 0"), scratch(spark, "dates")
    new.repartition(3, "o_orderkey").write.parquet(f"{base}/in")
    Z.score_stream(Z.read_stream(spark, f"{base}/in", new), model, f"{base}/out", f"{base}/state").awaitTermination()
    both = model.transform(new).withColumn("how", F.lit("batch")).unionByName(spark.read.parquet(f"{base}/out").withColumn("how", F.lit("stream")))
    return both.select("how", "o_orderkey", F.date_format("said", "yyyy-MM-dd").alias("said"), F.date_format("seconds", "yyyy-MM-dd").alias("seconds"), "none")


book.add(
    "c16_parse_replay",
    parsed_again,
    "SELECT how, o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS said, strftime(o_orderdate, '%Y-%m-%d') AS seconds, 'none' AS none FROM orders, (SELECT unnest(['batch', 'stream']) AS how) WHERE o_orderkey % 5 = 0",
)


def codes_of_new_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """Held-out rows as they are, without labels, with labels turned over, and with a column more: a row each, coded by the training rows alone."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    model = prepare.Preparation((), [{"op": "target_encode", "columns": ["o_orderpriority"]}, {"op": "ordinal_encode", "columns": ["o_orderpriority"]}], "y").fit(o.where("o_orderkey % 5 != 0"))
    new = o.where("o_orderkey % 5 = 0")
    ways = {"as they are": new, "absent": new.drop("y"), "turned": new.withColumn("y", 1 - F.col("y")), "more": new.withColumn("more", F.lit(1))}
    made = [model.transform(t).select(F.lit(way).alias("way"), "o_orderkey", "o_orderpriority_target", "o_orderpriority_ordinal") for way, t in ways.items()]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


book.add(
    "e13_held_out_codes",
    codes_of_new_rows,
    """WITH o AS (SELECT *, (o_orderstatus = 'F')::DOUBLE AS y FROM orders), t AS (SELECT * FROM o WHERE o_orderkey % 5 <> 0), p AS (SELECT avg(y) AS p FROM t),
  m AS (SELECT o_orderpriority, (sum(y) + 10 * any_value(p)) / (count(*) + 10) AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM t, p GROUP BY 1)
  SELECT way, o_orderkey, v AS o_orderpriority_target, k AS o_orderpriority_ordinal FROM o JOIN m USING (o_orderpriority), (SELECT unnest(['as they are', 'absent', 'turned', 'more']) AS way) WHERE o_orderkey % 5 = 0""",
    "o_orderpriority_target",
)


def moved_model(spark, sf_dir):  # noqa: ANN001, ANN201
    """A preparation with tables, saved and loaded again: it reads its own tables only."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = prepare.Preparation((), [{"op": "group_aggregate", "columns": ["o_totalprice"], "by": "o_custkey", "statistics": ["mean", "median"]}, {"op": "ordinal_encode", "columns": ["o_custkey"]}]).fit(o)
    path = scratch(spark, "preparation")
    model.save(path)
    again = prepare.PreparationModel.load(path)
    return again.transform(o).select("o_orderkey", F.col("o_totalprice_by_o_custkey_mean").alias("mean"), F.col("o_totalprice_by_o_custkey_median").alias("median"), F.col("o_custkey_ordinal").alias("code"))


book.add(
    "s17_moved_preparation",
    moved_model,
    "SELECT o_orderkey, avg(o_totalprice) OVER w AS mean, quantile_cont(o_totalprice, 0.5) OVER w AS median, dense_rank() OVER (ORDER BY o_custkey::VARCHAR) - 1 AS code FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "mean median",
)


def streamed(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same preparation on a stream of the parts."""
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    model = prepare.Preparation([{"action": "clip_outliers", "columns": ["p_size"], "lower": "5", "upper": "40"}], [{"op": "frequency_encode", "columns": ["p_brand"]}]).fit(df)
    base = scratch(spark, "stream")
    df.repartition(4, "p_partkey").write.parquet(f"{base}/in")
    query = Z.score_stream(Z.read_stream(spark, f"{base}/in", df, files_per_batch=2), model, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


book.add("z1_stream_scoring", streamed, "SELECT p_partkey, greatest(5, least(40, p_size))::INT AS p_size, p_brand, count(*) OVER (PARTITION BY p_brand) / (count(*) OVER ())::DOUBLE AS p_brand_frequency FROM part", "p_brand_frequency")


def runs(spark, sf_dir):  # noqa: ANN001, ANN201
    """A row a customer and priority, as if each were an experiment."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("family")).agg(F.max("o_totalprice").alias("score"), F.min(F.when(F.col("o_custkey") % 2 == 0, "rmse").otherwise("r2")).alias("metric"), F.min("o_orderstatus").alias("project"))


RUNS = "(SELECT o_custkey AS run_id, o_orderpriority AS family, max(o_totalprice) AS score, CASE WHEN o_custkey % 2 = 0 THEN 'rmse' ELSE 'r2' END AS metric, min(o_orderstatus) AS project FROM orders GROUP BY ALL)"
book.add("t4_best_runs", lambda s, d: R.best_runs(runs(s, d), 20, project="F"), f"SELECT * FROM {RUNS} WHERE project = 'F' ORDER BY CASE WHEN metric = 'rmse' THEN -score ELSE score END DESC, run_id, family LIMIT 20", "score")
book.add("t5_events_after", lambda s, d: R.events_after(read(s, d, "events").select("event_id", "event_type"), 9900, "event_id"), "SELECT event_id, event_type FROM events WHERE event_id > 9900")


def appended(spark, sf_dir):  # noqa: ANN001, ANN201
    path = scratch(spark, "events")
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    R.append_once(spark, path, e.where("event_id % 2 = 0"), ["event_id"])
    R.append_once(spark, path, e, ["event_id"])
    R.append_once(spark, path, e.where("event_id % 3 = 0"), ["event_id"])
    return spark.read.parquet(path)


book.add("s18_j4_append_once", appended, "SELECT event_id, event_type FROM events")


def recorded(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same experiments recorded twice, the second time with more."""
    folder = scratch(spark, "history")
    t = runs(spark, sf_dir)
    R.record(spark, folder, "experiments", t.where("run_id % 3 != 0"))
    R.record(spark, folder, "experiments", t.withColumn("score", F.when(F.col("run_id") % 3 == 0, F.col("score")).otherwise(-1.0)))
    R.record(spark, folder, "runs", t.select("run_id", "project").dropDuplicates(["run_id"]))
    return R.history(spark, folder, "experiments").join(R.history(spark, folder, "runs").select("run_id"), "run_id")


book.add("s18_run_tables", recorded, f"SELECT * FROM {RUNS}", "score")


def fingerprints(spark, sf_dir):  # noqa: ANN001, ANN201
    made = None
    for name, target in (("orders", "o_orderstatus"), ("customer", "c_mktsegment"), ("part", "p_type"), ("events", "event_type")):
        one = R.fingerprint(read(spark, sf_dir, name), name, "classification", target, "random_forest", ("one_hot_encode", "log_transform"))
        made = one if made is None else made.unionByName(one)
    return made


book.add("r1_a21_fingerprints", lambda s, d: fingerprints(s, d).select("run_id", "n_rows", "n_columns", "n_numeric", "n_text", "n_time"), " UNION ALL ".join(f"SELECT '{t}' AS run_id, count(*) AS n_rows, {c}::BIGINT AS n_columns, {n}::BIGINT AS n_numeric, {x}::BIGINT AS n_text, {w}::BIGINT AS n_time FROM {t}" for t, c, n, x, w in (("orders", 6, 3, 2, 1), ("customer", 5, 3, 2, 0), ("part", 6, 3, 3, 0), ("events", 6, 3, 2, 1))))
book.add("r2_r3_j6_similar_runs", lambda s, d: R.recommend_from_history(R.similar_runs((f := fingerprints(s, d)).where("run_id = 'orders'"), f)))
book.add(
    "k1_histogram",
    lambda s, d: K.histogram(orders(s, d), "o_totalprice", 20, "o_orderstatus"),
    """SELECT o_orderstatus, k AS bin, a + (k - 1) * w AS lower, a + k * w AS upper, count(*) AS n FROM (SELECT o_orderstatus, a, w, least(20, floor((o_totalprice - a) / w) + 1)::INT AS k FROM orders, (SELECT min(o_totalprice) AS a, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)) GROUP BY ALL""",
    "lower upper",
)
book.add(
    "k2_box_summary",
    lambda s, d: K.box_summary(read(s, d, "customer"), ["c_acctbal"]),
    """SELECT 'c_acctbal' AS "column", max(a) AS q1, max(m) AS median, max(b) AS q3, min(c_acctbal) FILTER (c_acctbal BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS whisker_low, max(c_acctbal) FILTER (c_acctbal BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS whisker_high,
  count(*) FILTER (c_acctbal NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS n_outside FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS b FROM customer)""",
    "q1 median q3 whisker_low whisker_high",
)
book.add("k3_bar", lambda s, d: K.bar(orders(s, d).withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))), "p"), "SELECT coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, '(missing)') AS label, count(*) AS n FROM orders GROUP BY 1")
book.add("k3_missingness", lambda s, d: K.missingness(orders(s, d).withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))), ["p", "o_custkey"]), "SELECT 'p' AS \"column\", count(*) FILTER (o_orderkey % 7 = 0) AS n_missing, avg((o_orderkey % 7 = 0)::INT) AS fraction FROM orders UNION ALL SELECT 'o_custkey', 0, 0 FROM (SELECT 1)", "fraction")
book.add("k4_heat_map", lambda s, d: K.heat_map(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]), "SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE r END AS r FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), (VALUES ('l_quantity'), ('l_extendedprice')) x(a), (VALUES ('l_quantity'), ('l_extendedprice')) y(b)", "r")
book.add("k5_line", lambda s, d: K.line(orders(s, d), "o_orderdate", "o_totalprice", "month").select(F.date_format("t", "yyyy-MM").alias("month"), "value"), "SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1", "value")
book.add(
    "k5_forecast_against_actual",
    lambda s, d: K.forecast_against_actual(scored(s, d).join(orders(s, d).select("o_orderkey", "o_orderdate"), "o_orderkey"), "o_orderdate", "y", "yhat", "month").select(F.date_format("t", "yyyy-MM").alias("month"), "actual", "predicted"),
    f"SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(y) AS actual, avg(yhat) AS predicted FROM {DS} s JOIN (SELECT o_orderkey AS k, o_orderdate FROM orders) o ON o.k = s.o_orderkey GROUP BY 1",
    "actual predicted",
)
book.add("k5_scatter", lambda s, d: K.scatter(orders(s, d), "o_custkey", "o_totalprice", "o_orderkey"), "SELECT o_custkey, o_totalprice FROM orders ORDER BY md5('0:' || o_orderkey::VARCHAR), o_orderkey LIMIT 6000", "o_totalprice")
book.add("s4_flatten", lambda s, d: readers.flatten(read(s, d, "events").select("event_id", F.struct(F.col("user_id").alias("id"), F.struct("event_type", "value").alias("last")).alias("user"))), "SELECT event_id, user_id AS \"user.id\", event_type AS \"user.last.event_type\", value AS \"user.last.value\" FROM events", "user.last.value")
book.add("s4_json_text", lambda s, d: read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
book.add("s5_parquet_columns", lambda s, d: readers.read_parquet(s, f"{d}/lineitem.parquet", ["l_returnflag", "no_such"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
book.add("s7_sql_over_files", lambda s, d: readers.query_files(s, "SELECT n_name, count(*) AS n FROM c JOIN n ON c_nationkey = n_nationkey GROUP BY n_name", c=f"{d}/customer.parquet", n=f"{d}/nation.parquet"), "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
book.add("s11_row_cap", lambda s, d: (t := capped(orders(s, d).select("o_orderkey"), 100, ["o_orderkey"]))[0].withColumn("truncated", F.lit(t[1])), "SELECT o_orderkey, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 100")
book.add(
    "s12_s16_schema",
    lambda s, d: readers.describe_schema(read(s, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))).toDF(*readers.normalise_headers([" o_orderkey ", "", "a", "a", "a_2", "z"]))).select("column", "type", "nullable"),
    """WITH n AS (UNPIVOT (SELECT count(*) > count(o_orderkey) AS o_orderkey, count(*) > count(o_custkey) AS o_custkey, count(*) > count(o_orderstatus) AS o_orderstatus, count(*) > count(o_totalprice) AS o_totalprice, count(*) > count(o_orderdate) AS o_orderdate,
    count(*) > count(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END) AS o_orderpriority FROM orders) ON COLUMNS(*) INTO NAME c VALUE nullable)
  SELECT CASE c WHEN 'o_custkey' THEN 'column_1' WHEN 'o_orderstatus' THEN 'a' WHEN 'o_totalprice' THEN 'a_3' WHEN 'o_orderdate' THEN 'a_2' WHEN 'o_orderpriority' THEN 'z' ELSE c END AS "column",
    CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'INTEGER' THEN 'int' WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type, nullable FROM (DESCRIBE orders) d JOIN n ON d.column_name = n.c""",
)
book.add(
    "s15_structural_validation",
    lambda s, d: s.createDataFrame(readers.validate(read(s, d, "orders").selectExpr("o_orderkey AS `Unnamed: 0`", "CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END AS code", "CASE WHEN o_totalprice < 0 THEN o_orderstatus END AS hollow", "o_orderpriority")), "level string, message string"),
    """SELECT 'warning' AS level, 'column hollow is empty' AS message FROM orders HAVING count(*) FILTER (o_totalprice < 0) = 0 UNION ALL SELECT 'warning', 'column ' || column_name || ' looks like an exported index' FROM (DESCRIBE SELECT o_orderkey AS "Unnamed: 0", o_custkey FROM orders) WHERE regexp_full_match(lower(column_name), '(unnamed: ?\\d+|index|_c0|column_0)')
  UNION ALL SELECT 'warning', 'column code mixes numbers and text' FROM orders HAVING count(*) FILTER (o_orderkey % 17 = 0) BETWEEN 1 AND count(*) - 1""",
)
book.add(
    "s3_records",
    lambda s, d: readers.extract_records(read(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("records"))),
    "SELECT o_orderkey, o_totalprice FROM orders",
    "o_totalprice",
)
book.add(
    "j3_align",
    lambda s, d: align(orders(s, d).select("o_orderkey", "o_orderstatus"), V.random_split(orders(s, d), "o_orderkey").where("split != 'train'").select("o_orderkey", "split", F.lit("x").alias("o_orderstatus")), "o_orderkey"),
    f"SELECT o_orderkey, o_orderstatus, CASE WHEN split <> 'train' THEN split END AS split FROM {RANDOM}",
)


def text_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    path = scratch(spark, "csv")
    read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.options(sep=";", header="true").csv(path)
    return readers.read_delimited(spark, path)[0]


book.add("s1_delimited_text", text_round_trip, "SELECT c_custkey::INT AS c_custkey, c_mktsegment, c_acctbal FROM customer", "c_acctbal")


def quoted_line_ends(spark, sf_dir):  # noqa: ANN001, ANN201
    """Records over two lines, doubled quotes, and records of a field too many; the number of malformed records on each row."""
    path = scratch(spark, "quoted")
    record = F.concat(F.col("c_custkey"), F.lit(',"'), F.col("c_mktsegment"), F.lit('\nsays ""'), F.col("c_nationkey"), F.lit('"", and",'), F.col("c_acctbal"), F.when(F.col("c_custkey") % 10 == 3, ",more").otherwise(""))
    read(spark, sf_dir, "customer").select(record.alias("value")).write.text(path)
    rows, bad = readers.read_delimited(spark, path, header=False)
    return rows.toDF("c_custkey", "said", "c_acctbal").withColumn("bad", F.lit(bad).cast("long"))


book.add(
    "s1_quoted_line_ends",
    quoted_line_ends,
    """SELECT c_custkey::INT AS c_custkey, c_mktsegment || chr(10) || 'says "' || c_nationkey || '", and' AS said, c_acctbal, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) AS bad FROM customer WHERE c_custkey % 10 <> 3""",
    "c_acctbal",
)


def json_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    path = scratch(spark, "json")
    read(spark, sf_dir, "customer").select("c_custkey", F.struct("c_mktsegment", "c_acctbal").alias("c")).write.json(path)
    return readers.read_json(spark, path)[0]


book.add("s2_json_lines", json_round_trip, "SELECT c_custkey, c_mktsegment AS \"c.c_mktsegment\", c_acctbal AS \"c.c_acctbal\" FROM customer", "c.c_acctbal")


book.add(
    "x7_infer_kinds",
    lambda s, d: P.infer_kinds(read(s, d, "orders")).select("column", "kind"),
    """SELECT c AS "column", CASE WHEN d <= 1 THEN 'constant' WHEN u AND n >= 20 AND d >= 0.999 * n THEN 'identifier' WHEN u THEN 'numeric_discrete' ELSE 'numeric_continuous' END AS kind FROM (
  SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, count(*) AS n, true AS u FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(*), true FROM orders
  UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), count(*), bool_and(o_totalprice = floor(o_totalprice)) FROM orders)
  UNION ALL SELECT c, CASE WHEN d <= 1 THEN 'constant' WHEN t THEN 'text' WHEN w THEN 'identifier' ELSE 'categorical_nominal' END FROM (
  SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS d, avg(len(regexp_extract_all(o_orderstatus, '\\S+'))) >= 5 AND count(DISTINCT o_orderstatus) > 0.5 * count(*) AS t, count(DISTINCT o_orderstatus) >= 0.999 * count(*) AND count(*) >= 20 AS w FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), avg(len(regexp_extract_all(o_orderpriority, '\\S+'))) >= 5 AND count(DISTINCT o_orderpriority) > 0.5 * count(*), count(DISTINCT o_orderpriority) >= 0.999 * count(*) AND count(*) >= 20 FROM orders)
  UNION ALL SELECT 'o_orderdate', CASE WHEN count(o_orderdate) = 0 THEN 'unknown' WHEN count(DISTINCT o_orderdate) <= 1 THEN 'constant' ELSE 'datetime' END FROM orders""",
)
book.add("q6_learning_curve", lambda s, d: Q.learning_curve(labelled(s, d).drop("fold"), lambda: M.pipeline("logistic", "binary", ["x1", "x2"]), accuracy, "key"))
book.add("c13_knn_imputation", lambda s, d: C.knn_impute(read(s, d, "customer").selectExpr("c_custkey", "c_nationkey * 1.0D AS nation", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS balance"), ["nation", "balance"], "c_custkey").select("c_custkey", "balance"), """WITH t AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS b FROM customer),
  f AS (SELECT q.k, avg(t.b) AS b FROM (SELECT q.k AS qk, t.k AS tk FROM t q JOIN t ON q.b IS NULL AND t.b IS NOT NULL AND q.k <> t.k QUALIFY row_number() OVER (PARTITION BY q.k ORDER BY abs(q.n - t.n), t.k) <= 5) m JOIN t q ON q.k = m.qk JOIN t ON t.k = m.tk GROUP BY q.k)
  SELECT t.k AS c_custkey, coalesce(t.b, f.b) AS balance FROM t LEFT JOIN f ON f.k = t.k""", "balance")
book.add("c14_iterative_imputation", lambda s, d: C.iterative_impute(read(s, d, "part").selectExpr("p_partkey", "p_retailprice", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS size"), ["p_retailprice", "size"]).select("p_partkey", "size"))


def target_report(spark, sf_dir):  # noqa: ANN001, ANN201
    df = orders(spark, sf_dir)
    return A.target_report(spark, A.target_associations(df, "o_orderstatus", ["o_totalprice", "o_orderpriority"]), "o_orderstatus")


_BINNED = f"(SELECT o_orderstatus, len(list_filter(edges, lambda e: o_totalprice >= e)) AS bin FROM orders, (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [{', '.join(str(k / 20) for k in range(21))}])))[2:-2] AS edges FROM orders))"
book.add(
    "a22_target_report",
    lambda s, d: target_report(s, d).withColumn("value", F.round("value", 6)),
    f"""SELECT a, 'o_orderstatus' AS b, method, round(value, 6) AS value FROM (
  SELECT 'o_orderpriority' AS a, 'mutual_information' AS method, normalised AS value FROM ({MI.format(a="o_orderpriority", b="o_orderstatus", t="orders")}) UNION ALL SELECT 'o_totalprice', 'mutual_information', normalised FROM ({MI.format(a="bin", b="o_orderstatus", t=_BINNED)})
  UNION ALL SELECT 'o_totalprice', 'eta', sqrt(greatest(0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw))) FROM (SELECT sum(n) AS n, count(*) AS k, sum(n * (m - (SELECT avg(o_totalprice) FROM orders)) ** 2) AS ssb, sum(w) AS ssw FROM (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w FROM orders GROUP BY o_orderstatus))
  UNION ALL SELECT 'o_orderpriority', 'cramers_v', sqrt(greatest(0, phi - (k - 1) * (r - 1) / (n - 1)) / least(r - (r - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1)) FROM (SELECT max(n) AS n, sum((o - na * nb / n) ** 2 / (na * nb / n)) / max(n) AS phi, count(DISTINCT x) AS r, count(DISTINCT y) AS k
    FROM (SELECT *, sum(o) OVER (PARTITION BY x) AS na, sum(o) OVER (PARTITION BY y) AS nb, sum(o) OVER () AS n FROM (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*)::DOUBLE AS o FROM orders GROUP BY ALL))))""",
    "value",
)
book.add("p5_p6_initial_features", lambda s, d: s.createDataFrame([(c, why, prepare.default_treatment(o, [c])[c]) for o in [orders(s, d)] for c, why in prepare.initial_features(o, "o_orderstatus", ["o_orderkey"])], "column string, reason string, treatment string"), """SELECT 'o_orderkey' AS "column", 'identifier' AS reason, 'pass' AS treatment FROM orders HAVING count(*) >= 0 UNION ALL SELECT 'o_custkey', '', 'pass' FROM orders HAVING count(*) >= 0 UNION ALL SELECT 'o_totalprice', '', 'pass' FROM orders HAVING count(*) >= 0
  UNION ALL SELECT c, r, CASE WHEN d <= 1 THEN 'drop' WHEN d <= 50 THEN 'one_hot' ELSE 'exclude' END FROM (SELECT 'o_orderdate' AS c, 'raw time' AS r, count(DISTINCT o_orderdate) AS d FROM orders UNION ALL SELECT 'o_orderstatus', 'target', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', '', count(DISTINCT o_orderpriority) FROM orders)""")
