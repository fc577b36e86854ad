"""Operators without SQL, against numbers worked out by hand or in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import text as X
from sparkprep.functions.tables import allocate, durable, sample_rows, with_row_id
from sparkprep.operators import clean as C
from sparkprep.operators import diagnose as Q
from sparkprep.operators import encode as E
from sparkprep.operators import metrics as G
from sparkprep.operators import models as M
from sparkprep.operators import neighbours as NB
from sparkprep.operators import quality as L
from sparkprep.operators import split as V
from sparkprep.operators import windows as W
from sparkprep.plans import prepare
from sparkprep.sources import readers


def test_metric_vectors(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 2.5), (4.0, 4.5)], "label double, prediction double")
    row = G.regression_metrics(df).first()
    assert row["mae"] == row["rmse"] == 0.5
    names = {"auc": "roc_auc", "RMSE": "rmse", "mcc": "matthews_corrcoef"}
    assert {k: G.metric_name(k) for k in names} == names
    assert G.better("rmse", 1, 2) and G.better("r2", 2, 1)


def test_knn_imputation_takes_the_near_rows(spark):
    rows = [(i, float(i), float(i * 10)) for i in range(8)] + [(99, 3.1, None)]
    df = spark.createDataFrame(rows, "key int, a double, b double")
    got = C.knn_impute(df, ["a", "b"], "key", k=2).where("key = 99").first()["b"]
    assert got == pytest.approx(35.0)


def test_knn_imputation_has_all_rows_of_a_large_table_as_donors(spark):
    df = spark.range(60_000).selectExpr("id AS key", "double(id) AS a", "CASE WHEN id % 1500 = 700 THEN NULL ELSE id * 10.0D END AS b")
    got = C.knn_impute(df, ["a", "b"], "key", k=2)
    assert got.count() == 60_000
    holes = got.where("key % 1500 = 700").collect()
    assert len(holes) == 40 and all(r["b"] == pytest.approx(r["key"] * 10) for r in holes)


def test_encoders_in_a_preparation_keep_all_levels(spark):
    df = spark.range(21_000).selectExpr("id", "concat('u', id % 10500) AS user", "double(id % 10500 = 7) AS y")
    model = prepare.Preparation([], [{"op": "frequency_encode", "columns": ["user"]}, {"op": "target_encode", "columns": ["user"]}], "y").fit(df)
    out = model.transform(df.union(spark.sql("SELECT -1L, 'new', 0D")).drop("y"))  # new rows do not have the target
    _, prior = E.fit_target_means(df, "user", "y")
    for r in out.collect():
        assert r["user_frequency"] == pytest.approx(0.0 if r["id"] < 0 else 1 / 10500)
        assert r["user_target"] == pytest.approx(prior if r["id"] < 0 else (2 * (r["id"] % 10500 == 7) + 10 * prior) / 12)
    assert out.count() == 21_001


def test_label_encode_has_all_classes(spark):
    df = spark.range(21_000).selectExpr("id", "lpad(id % 10500, 6, '0') AS c")
    out, classes = V.label_encode(df, "c")
    assert len(classes) == 10_500 and all(r["label_index"] == r["id"] % 10500 for r in out.collect())
    out, classes = V.label_encode(df.selectExpr("id", "id % 10500 AS c"), "c")
    assert len(classes) == 10_500 and all(r["label_index"] == r["c"] for r in out.collect())


def test_silhouette_counts_copies_and_more_than_2000_rows(spark):
    r = np.random.RandomState(4)
    rows = [(float(k * 5), 0.0, k) for k in (0, 1) for _ in range(300)] + [(float(a), float(b), int(k)) for a, b, k in zip(r.normal(size=1800) * 3, r.normal(size=1800), r.randint(0, 3, 1800), strict=True)]
    got = G.clustering_metrics(spark.createDataFrame([*rows, (9.0, 9.0, -1)], "a double, b double, k int"), ["a", "b"], "k", block=700).first()["silhouette"]
    x, k = np.array([p[:2] for p in rows]), np.array([p[2] for p in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    mean = np.stack([d[:, k == c].sum(1) / ((k == c).sum() - (k == c)) for c in range(3)], axis=1)
    a = mean[np.arange(len(k)), k]
    b = np.where(np.arange(3)[None] == k[:, None], np.inf, mean).min(1)
    assert got == pytest.approx(np.mean((b - a) / np.maximum(a, b)))


def test_outlier_queries_score_every_row(spark, sf):
    from sparkprep import queries

    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert queries.queries()["n14_isolation_forest"](spark, sf).count() == n
    assert queries.queries()["n15_local_outlier_factor"](spark, sf).count() > 10
    assert -1 <= queries.queries()["g8_silhouette"](spark, sf).first()["silhouette"] <= 1


def test_a_late_time_of_day_gives_the_hour_feature(spark):
    df = spark.range(0, 12_000, 1, 1).selectExpr("timestamp_seconds(id * 86400 + IF(id = 11999, 3600, 0)) AS at")
    frozen, notes = prepare.fit_features(df, [{"op": "date_decompose", "columns": ["at"]}])
    assert not notes and "hour" in frozen[0]["parts"]


def test_iterative_imputation_follows_the_line(spark):
    rows = [(float(i), 2.0 * i + 1 if i % 5 else None) for i in range(40)]
    out = C.iterative_impute(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 3).collect()
    assert max(abs(r["b"] - (2 * r["a"] + 1)) for r in out) < 0.5


def test_quantile_and_power_transforms(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.RandomState(1).lognormal(0, 1, 400)], "x double")
    grid = E.fit_quantile_grid(df, "x", 100)
    z = np.array([r["x_quantile"] for r in E.quantile_transform(df, "x", grid).collect()])
    assert abs(np.median(z)) < 0.05
    fitted = E.fit_power(df, "x")
    assert abs(fitted["lambda"]) < 0.15  # a logarithm makes it normal
    p = np.array([r["x_power"] for r in E.power_transform(df, "x", fitted).collect()])
    assert abs(p.mean()) < 1e-6 and abs(p.std() - 1) < 1e-6


def test_pca_and_svd(spark):
    x = np.random.RandomState(2).normal(size=(200, 1)) @ np.array([[1.0, 2.0, -1.0]]) + np.random.RandomState(3).normal(size=(200, 3)) * 0.01
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out, fitted = E.pca(df, ["a", "b", "c"], 2)
    assert fitted.stages[2].explainedVariance[0] > 0.99 and "pca_2" in out.columns
    _, parts = E.truncated_svd(df, ["a", "b", "c"], 1)
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    assert np.allclose(np.abs(parts[0]), np.abs(v), atol=1e-6)


def test_splits_keep_groups_and_shares(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert V.shared_groups(V.grouped_split(orders, "o_custkey"), "o_custkey").isEmpty()
    out, how = V.split(orders, "classification", "o_orderstatus", "o_orderkey")
    sizes = {r["split"]: r["n"] for r in V.partition_sizes(out).collect()}
    assert how["strategy"] == "stratified" and abs(sizes["test"] / sum(sizes.values()) - 0.2) < 0.01
    again = V.split(orders.repartition(7), "classification", "o_orderstatus", "o_orderkey")[0]
    assert out.select("o_orderkey", "split").exceptAll(again.select("o_orderkey", "split")).isEmpty()


def test_row_ids_and_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") * 37 % 101).alias("a"), F.col("id").alias("b"))
    one, two = (with_row_id(x).collect() for x in (df, df.repartition(5)))
    assert sorted(one) == sorted(two)
    assert sample_rows(df, 20, "b").collect() == sample_rows(df.repartition(3), 20, "b").collect()
    assert allocate(["a", "a_2"], "a") == "a_3"


def test_dbscan_lof_and_forest_find_what_is_planted(spark):
    state = np.random.RandomState(4)
    rows = [(i, *map(float, state.normal([0, 0] if i < 60 else [10, 10], 0.3))) for i in range(120)] + [(500, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "key long, x double, y double")
    found = {r["key"]: r["cluster"] for r in NB.dbscan(df, "key", ["x", "y"], 0.8, 4, scaled=False).collect()}
    assert found[500] == -1 and len({found[i] for i in range(60)}) <= 2 and found[0] != found[119]
    assert NB.isolation_forest(df, df, "key", ["x", "y"], 50).orderBy(F.desc("score")).first()["key"] == 500
    lof = {r["key"]: r["lof"] for r in NB.local_outlier_factor(df.where("key != 500"), df, "key", ["x", "y"], 10).collect()}
    assert lof[500] > 3 > lof[5]


def test_models_beat_the_baseline_and_round_trip(spark, tmp_path):
    state = np.random.RandomState(5)
    rows = [(float(a), float(b), float(a + b > 0)) for a, b in state.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    hit = lambda t: t.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    results, models = M.fit_candidates(df, df, [{"family": "baseline"}, {"family": "logistic"}, {"family": "no_such"}], ["a", "b"], "binary", "accuracy", hit)
    board = M.leaderboard(results, "accuracy").collect()
    assert board[0]["family"] == "logistic" and board[0]["is_winner"] and board[-1]["error"]
    M.save_model(models["logistic"], str(tmp_path / "m"), {"target": "label"})
    again, meta = M.load_model(str(tmp_path / "m"))
    assert meta["target"] == "label" and hit(M.predict(again, df)) == hit(M.predict(models["logistic"], df))
    assert L.grade(0.95, 0.5, "roc_auc") == "A" and L.grade(0.4, 0.5, "roc_auc") == "F" and L.grade(5, 10, "rmse") == "A"
    assert Q.fit_verdict(0.99, 0.70, "accuracy") == "overfitting" and Q.fit_verdict(0.5, 0.5, "accuracy") == "underfitting"


def test_bootstrap_covers_the_accuracy(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10 != 0).cast("int").alias("label"), F.lit(1).alias("prediction"))
    got = {r["metric"]: (r["low"], r["high"]) for r in Q.bootstrap_intervals(df, "label", "prediction", "id", 100).collect()}
    for metric, value in (("accuracy", 0.9), ("precision", 0.9), ("f1", 1.8 / 1.9)):
        low, high = got[metric]
        assert low < value < high and high - low < 0.05
    assert got["recall"] == (1.0, 1.0)


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("\ufeffid;name;price;name\n1;x;1.234,5;a\n2;y;2.000,0;b\n", encoding="utf-8")
    df, bad = readers.read_delimited(spark, str(p), thousands=".", decimal=",")
    assert bad == 0 and [r["price"] for r in df.orderBy("id").collect()] == [1234.5, 2000.0] and len(set(df.columns)) == 4
    j = tmp_path / "b.json"
    j.write_text('{"meta": 1, "data": [{"a": {"b": 1}}, {"a": {"b": 2}}]}')
    out, _ = readers.read_json(spark, str(j))
    assert sorted(r["a.b"] for r in out.collect()) == [1, 2]
    lines = tmp_path / "c.jsonl"
    lines.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    out, bad = readers.read_json(spark, str(lines))
    assert bad == 1 and out.count() == 2
    assert readers.infer_kind("s3://b/x.parquet") == "parquet" and readers.infer_kind("y.csv.gz") == "csv" and readers.infer_kind("jdbc:postgresql://h/d") == "sql"
    assert readers.spark_uri("s3://b/k") == "s3a://b/k" and readers.spark_uri("https://acc.blob.core.windows.net/c/k") == "abfss://c@acc.dfs.core.windows.net/k"
    assert readers.guarded("schema.t") == "SELECT * FROM schema.t"
    for bad_sql in ("DROP TABLE t", "SELECT 1; DELETE FROM t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError):
            readers.guarded(bad_sql)
    assert readers.normalise_headers([" a ", "a", "", "a_2"]) == ["a", "a_3", "column_2", "a_2"]
    assert ("error", "no rows") in readers.validate(spark.createDataFrame([], "a int, b int"))


def test_text_recognition(spark):
    assert X.name_tokens("customerID_lastSeenAt2") == ["customer", "id", "last", "seen", "at", "2"]
    assert "post_outcome" in X.name_hints("churn_reason") and "identifier" in X.name_hints("account_uuid")
    df = spark.createDataFrame([("Yes",), ("no",)], "v string")
    assert X.vocabulary_of(df, "v") == ("boolean", ["no", "yes"])
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry banana"), (3, "apple cherry")], "id int, t string")
    terms, _ = X.tfidf_terms(docs, "t", stop_words=())
    norm = X.tfidf(docs, "t", "id", terms, stop_words=()).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in norm)


def test_plan_runs_in_safe_order_and_replays(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), " A " if i % 2 else "b", i % 2) for i in range(40)], "id int, x double, c string, y int")
    plan = [{"action": "impute_missing", "columns": ["x"], "strategy": "mean"}, {"action": "normalise_categories", "columns": ["c", "nowhere"]}, {"action": "impute_missing", "columns": ["y"], "strategy": "mean"}]
    out, frozen, notes = prepare.clean(df, plan, target="y")
    assert [s["do"] for s in frozen] == ["normalise", "fill", "fill"] and frozen[2]["fills"] == {} and any("nowhere" in n for n in notes)
    assert {r["c"] for r in out.collect()} == {"a", "b"}
    new = spark.createDataFrame([(1, None, "A", 0)], "id int, x double, c string, y int")
    assert prepare.replay(new, frozen).first()["x"] == pytest.approx(df.agg(F.avg("x")).first()[0])
    with pytest.raises(ValueError):
        prepare.replay(new.drop("x"), frozen)
    assert prepare.coerce("[1, 2]") == [1, 2] and prepare.coerce("none") is None and prepare.coerce("True") is True


def test_preparation_model_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], float(i % 2)) for i in range(20)], "x double, c string, y double")
    model = prepare.Preparation([{"action": "clip_outliers", "columns": ["x"], "lower": 2, "upper": 9}], [{"op": "one_hot_encode", "columns": ["c"]}, {"op": "target_encode", "columns": ["c"]}], "y").fit(df)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = prepare.PreparationModel.load(str(tmp_path / "p"))
    assert sorted(again.transform(df).collect()) == sorted(model.transform(df).collect())


def test_a_label_by_chance_does_not_leak_into_its_encoding(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.concat(F.lit("u"), F.col("id")).alias("user"), (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("long") % 2).cast("double").alias("y"))
    model = prepare.Preparation([], [{"op": "target_encode", "columns": ["user"]}], "y").fit(df)
    trained = prepare.Preparation([], [{"op": "target_encode", "columns": ["user"]}], "y").fit_transform(df)[1]
    assert abs(trained.agg(F.corr("y", "user_target")).first()[0] or 0.0) < 0.1
    mean = df.agg(F.avg("y")).first()[0]
    fresh = model.transform(df.drop("y").limit(50)).collect()
    y = {r["user"]: r["y"] for r in df.collect()}
    assert all(r["user_target"] == pytest.approx((y[r["user"]] + 10 * mean) / 11) for r in fresh)
    assert "user_target" not in prepare.Preparation([], [{"op": "target_encode", "columns": ["user"]}], "y", "temporal").fit(df).transform(df).columns


def test_fills_along_an_order_are_replaced_in_a_preparation(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i)) for i in range(1, 12)], "key int, x double")
    model = prepare.Preparation([{"action": "impute_missing", "columns": ["x"], "strategy": "forward_fill"}, {"action": "drop_duplicate_rows", "columns": []}], []).fit(df)
    assert not model.getOrDefault("notes") and {r["x"] for r in model.transform(df).where("key % 3 = 0").collect()} == {df.agg(F.percentile("x", F.lit(0.5))).first()[0]}


@pytest.mark.parametrize(("table", "target"), [("orders", "o_orderstatus"), ("customer", "c_acctbal"), ("part", "p_brand"), ("events", "event_type"), ("supplier", "s_acctbal"), ("lineitem", "l_returnflag")])
def test_all_that_is_recommended_runs(spark, sf, table, target):
    df = spark.read.parquet(f"{sf}/{table}.parquet").limit(400)
    times = [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))]
    df = durable(df.withColumns({c: F.when(F.xxhash64(c) % 5 != 0, F.col(c)) for c in times}))
    cleaned, frozen, notes = prepare.clean(df, L.recommend_cleaning(df, target), target)
    cleaned = durable(cleaned)
    assert not notes and cleaned.count()
    assert all(cleaned.where(F.col(c).isNull()).count() == 0 for c in times)
    steps, notes = prepare.fit_features(cleaned, L.recommend_features(cleaned, target, "regression" if target.endswith("acctbal") else "multiclass"), target)
    assert not notes and steps
    made, names = prepare.apply_features(prepare.replay(df, frozen), steps)
    assert names and made.select(*[F.col(f"`{n}`") for n in names]).first() is not None


def test_post_steps_of_a_feature_plan(spark):
    state = np.random.RandomState(3)
    x = state.normal(size=(200, 3))
    rows = [(i, float(a), float(2 * a + 1e-3 * b), float(c), float(3 * c + a), "word alpha" if i % 2 else "word thing") for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "key int, a double, b double, c double, y double, t string")
    base = [{"op": "standard_scale", "columns": ["a", "b", "c"]}]
    assert prepare.apply_features(df, prepare.fit_features(df, [*base, {"op": "drop_correlated"}], "y")[0])[1] in (["a_scaled", "c_scaled"], ["b_scaled", "c_scaled"])
    assert prepare.apply_features(df, prepare.fit_features(df, [*base, {"op": "select_k_best", "k": 1}], "y")[0])[1] == ["c_scaled"]
    made, names = prepare.apply_features(df, prepare.fit_features(df, [{"op": "pca", "n_components": 2}, *base], "y")[0])
    z = (x2 := np.array([r[1:4] for r in rows])) - x2.mean(0)
    z /= z.std(0, ddof=1)
    load = np.linalg.svd(z, full_matrices=False)[2][0]
    got = np.array([r["pca_1"] for r in made.orderBy("key").collect()])
    assert names == ["pca_1", "pca_2"] and abs(np.corrcoef(got, z @ load)[0, 1]) == pytest.approx(1.0)
    made, names = prepare.apply_features(df, prepare.fit_features(df, [{"op": "tfidf", "columns": ["t"]}, {"op": "quantile_transform", "columns": ["a"]}])[0])
    row = made.orderBy("key").first()
    # terms in order: alpha, thing, word; a length of 1 a row
    assert names[:3] == ["t_tfidf_0", "t_tfidf_1", "t_tfidf_2"] and row["t_tfidf_0"] == 0 and row["t_tfidf_1"] ** 2 + row["t_tfidf_2"] ** 2 == pytest.approx(1.0) and "a_quantile" in names


def test_a_plan_makes_at_most_600_columns(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(50)], [f"x{k}" for k in range(2)])
    wide = df.withColumns({f"z{k}": F.col("x0") * k for k in range(650)})
    frozen, notes = prepare.fit_features(wide, [{"op": "sqrt_transform", "columns": [f"z{k}" for k in range(650)]}])
    assert len(prepare.apply_features(wide, frozen)[1]) == 600 and notes


def test_the_holdout_is_read_once(spark, sf):
    holdout = V.Holdout(spark.read.parquet(f"{sf}/orders.parquet"), "classification", "o_orderstatus", "o_orderkey")
    seen = {r["o_orderkey"] for r in holdout.open.select("o_orderkey").collect()}
    test = {r["o_orderkey"] for r in holdout.finish(lambda t: t.select("o_orderkey")).collect()}
    assert test and not seen & test
    with pytest.raises(RuntimeError):
        holdout.finish(lambda t: t)


def test_windows_without_a_group_are_those_of_one_group(spark):
    from sparkprep.operators import windows as W

    df = spark.createDataFrame([(i, None if i % 4 == 1 else float((i * 37) % 23)) for i in range(60)], "t int, x double").repartition(7)
    one = df.withColumn("g", F.lit("g"))
    made = [
        lambda d, g: W.lag_features(d, "x", [1, 5, 19], ["t"], g), lambda d, g: W.rolling_features(d, "x", [2, 9], ["mean", "median", "max"], ["t"], g, 1), lambda d, g: W.diff_features(d, "x", [1, 3], ["t"], g, 2),
        lambda d, g: W.expanding_features(d, "x", ["mean", "std", "skew", "kurt", "min", "sum", "count"], ["t"], g, 1), lambda d, g: C.directional_fill(d, ["x"], ["t"], g, True), lambda d, g: C.interpolate(d, ["x"], ["t"], g),
    ]
    for make in made:
        a, b = make(df, []).orderBy("t").collect(), make(one, ["g"]).drop("g").orderBy("t").collect()
        assert len(a) == len(b) == 60
        for x, y in zip(a, b, strict=True):
            assert all(u == v or u is not None and v is not None and u == pytest.approx(v, abs=1e-9) for u, v in zip(x, y, strict=True))


def test_profile_of_odd_columns(spark):
    from sparkprep.operators import profile as P

    df = spark.createDataFrame([(1, None, None, "a"), (2, None, 2.5, "a"), (9007199254740993, None, 4.0, None), (9007199254740992, None, 2.5, "b")], "big long, hollow double, x double, s string")
    got = {r["column"]: r for r in P.profile_table(df).collect()}
    assert got["big"]["n_distinct"] == 4 and got["hollow"]["n_missing"] == 4 and got["hollow"]["q50"] is None and got["hollow"]["is_constant"]
    assert got["x"]["q50"] == 2.5 and got["x"]["q75"] == pytest.approx(3.25) and got["s"]["n_distinct"] == 2
    empty = {r["column"]: r for r in P.profile_table(df.where("big < 0")).collect()}
    assert len(empty) == 4 and empty["x"]["n_rows"] == 0 and empty["x"]["n_outliers"] == 0


def test_a_cluster_without_a_checkpoint_folder_is_an_error():
    from types import SimpleNamespace

    from sparkprep.functions.tables import shared_folder

    class Conf:
        def get(self, key):
            return None

    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(getConf=Conf, master="spark://host:7077")))


def test_a_late_line_tells_the_encoding(spark, tmp_path):
    lines = ["id;name", *[f"{i};plain" for i in range(80)], "80;caf\u00e9"]
    (tmp_path / "late.csv").write_bytes("\n".join(lines).encode("latin1"))
    rows, bad = readers.read_delimited(spark, str(tmp_path / "late.csv"))
    assert bad == 0 and rows.where("id = 80").first()["name"] == "caf\u00e9" and rows.count() == 81


def test_a_fold_that_fails_is_told(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), i % 3) for i in range(30)], "x double, label double, fold int")

    def score(t):
        if t.where("fold = 1").count():
            raise ValueError("no")
        return 1.0

    with pytest.warns(UserWarning, match="fold 1 failed"):
        assert M.cross_validate(df, lambda: M.pipeline("logistic", "binary", ["x"]), score, 3) == [1.0, 1.0]
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        M.cross_validate(df.where("fold = 1"), lambda: M.pipeline("logistic", "binary", ["x"]), lambda t: score(df), 1)


def test_jdbc_reads_slices_and_refuses_changes(spark):
    url = "jdbc:derby:memory:readers;create=true"
    spark.range(100).selectExpr("CAST(id AS INT) AS k", "CAST(id * 2 AS DOUBLE) AS v").write.jdbc(url, "numbers")
    got = readers.read_sql(spark, url, 'SELECT "k", "v" FROM numbers WHERE "k" < 50', partition={"column": "k", "lower": 0, "upper": 50, "number": 4})
    assert got.count() == 50 and got.rdd.getNumPartitions() == 4 and got.agg(F.sum("v")).first()[0] == sum(2 * i for i in range(50))
    assert readers.read_sql(spark, url, 'SELECT "k" FROM numbers', max_rows=7).count() == 7
    with pytest.raises(ValueError):
        readers.read_sql(spark, url, "DELETE FROM numbers")


@pytest.mark.parametrize("shape", ["random", "rising", "middle_first", "ties", "holes", "empty"])
def test_expanding_median_without_a_group(spark, shape):
    r = np.random.default_rng(5)
    n = 0 if shape == "empty" else 600
    far = np.where(np.arange(n) % 2 == 0, 1e6, -1e6) + np.arange(n)
    values = {"random": r.normal(size=n), "rising": np.arange(n) * 1.5, "middle_first": np.where(np.arange(n) < 150, r.normal(size=n), far), "ties": r.integers(0, 3, n).astype(float), "holes": np.where(r.random(n) < 0.6, np.nan, r.normal(size=n)), "empty": r.normal(size=n)}[shape]
    rows = [(int(i), None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t long, v double").repartition(5)
    for shift in (0, 2) if shape == "holes" else (0,):
        got = {x["t"]: x["v_expanding_median"] for x in W.expanding_features(df, "v", ["median"], ["t"], (), shift).collect()}
        assert len(got) == n
        for i in range(n):
            seen = values[: max(0, i - shift + 1)]
            seen = seen[~np.isnan(seen)]
            assert got[i] == (pytest.approx(float(np.median(seen))) if len(seen) else None)


def test_expanding_median_sends_each_range_few_values(spark):
    """At most its own size and two buckets: no task gets all that precedes it."""
    df = spark.range(8000).select("id", F.rand(3).alias("v"))
    plan = W.expanding_features(df, "v", ["median"], ["id"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = W.in_ranges(df, [F.col("id")])
        sizes = [x["count"] for x in W._median_candidates(dealt.select("_range", "_at", F.col("v").alias("_x"))).groupBy("_of").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count() == 8000 and max(sizes) < 8000 / 16 * 4


@pytest.mark.parametrize("group", [[], ["g"]])
def test_interpolation_reads_a_part_once(spark, group):
    df = spark.createDataFrame([(i, "g", None if i % 3 else float(i)) for i in range(20)], "t int, g string, x double")
    made = C.interpolate(df, ["x"], ["t"], group)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan  # such a frame is read anew for every row
    assert [r["x"] for r in made.orderBy("t").collect()] == [min(float(i), 18.0) for i in range(20)]


def test_knn_imputation_of_equal_rows_meets_few_donors(spark, monkeypatch):
    rows = [(i, float(i % 4) if i % 11 else None, float(i % 3), None if i % 5 == 0 else float(i * 7 % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    met, plain = [], C._near_donors
    monkeypatch.setattr(C, "_near_donors", lambda p, h, *a: met.append((p.count(), h.count())) or plain(p, h, *a))
    got = C.knn_impute(df, ["a", "b", "c"], "k", 3, block=20).orderBy("k").collect()
    assert met[1][0] <= 72 and met[1][1] <= 18  # of 400 rows, and of 72 and 29 with the same holes
    assert met[0] == (400, 8)  # the rows of a rarer pattern meet all
    for (key, *v), r in zip(rows, got, strict=True):
        for j in range(3):
            if v[j] is None:
                far = sorted((np.sqrt(sum((x - y) ** 2 for x, y in zip(v, w) if x is not None and y is not None) * 3 / s), o, w[j]) for o, *w in rows if w[j] is not None and (s := sum(x is not None and y is not None for x, y in zip(v, w))))
                assert r[j + 1] == pytest.approx(sum(t[2] for t in far[:3]) / 3)
