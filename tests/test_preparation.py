"""Preparations: training rows out of fold, other rows by the full map alone, date parsing replayed as fitted, models that travel."""

import shutil

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sparkprep.functions import tables
from sparkprep.operators import models as M
from sparkprep.plans import prepare


@pytest.fixture(scope="module")
def rows(spark):
    chance = (F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("long") % 2).cast("double")
    return spark.range(2400).select(F.col("id").alias("key"), F.concat(F.lit("u"), F.col("id") % 1200).alias("user"), chance.alias("y"), F.lit("c").alias("unused"))


def codes(df):
    return {r["key"]: r["user_target"] for r in df.select("key", "user_target").collect()}


def test_labels_and_other_columns_do_not_move_the_codes_of_new_rows(rows):
    train, new = rows.where("key < 2000"), rows.where("key >= 2000")
    model = prepare.Preparation([], [{"op": "target_encode", "columns": ["user"]}], "y").fit(train)
    plain = codes(model.transform(new.drop("y")))
    for other in (new, new.withColumn("y", 1 - F.col("y")), new.withColumn("y", F.lit(None).cast("double")), new.drop("unused"), new.withColumn("more", F.lit(1)), new.withColumn(prepare.FOLD, F.lit(0))):
        assert codes(model.transform(other)) == plain


def test_training_rows_are_coded_out_of_fold_whatever_their_columns(rows):
    for df in (rows, rows.drop("unused"), rows.withColumn("more", F.lit(1))):
        model, trained = prepare.Preparation([], [{"op": "target_encode", "columns": ["user"]}], "y").fit_transform(df)
        assert trained.columns == [*df.columns, "user_target"] and trained.count() == 2400
        assert abs(trained.agg(F.corr("y", "user_target")).first()[0]) < 0.1
        assert model.transform(df).agg(F.corr("y", "user_target")).first()[0] > 0.3  # the full map holds each row's own label


def test_a_pipeline_trains_on_codes_out_of_fold_and_scores_by_the_model(rows, tmp_path):
    made = prepare.Prepared(prepare.Preparation([], [{"op": "target_encode", "columns": ["user"]}], "y"), lambda names: M.pipeline("logistic", "binary", names))
    model = made.fit(rows.withColumn("label", F.col("y")))
    assert abs(model.stages[-1].coefficients[0]) < 2.0  # nothing to learn from codes that hold no label
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert {r["key"]: r["prediction"] for r in again.transform(rows).collect()} == {r["key"]: r["prediction"] for r in model.transform(rows).collect()}


FORMS = [" 2024-01-02 ", "2024/03/04", "05-06-2024", "20240708", "07 Jan 2024", "2024-01-02 03:04:05", "2024-01-02T03:04:05", "03/04/2024", "25/12/2024", "never", None]


@pytest.mark.parametrize("dayfirst", [False, True])
def test_dates_are_replayed_as_they_were_fitted(spark, dayfirst):
    df = spark.createDataFrame([(i, t, "no date", str(1_700_000_000 + i)) for i, t in enumerate(FORMS)], "id int, d string, text string, s string")
    decisions = [{"action": "parse_datetime", "columns": ["d", "text"], "dayfirst": str(dayfirst)}, {"action": "parse_datetime", "columns": ["s"], "unit": "s"}]
    fitted, frozen, _ = prepare.clean(df, decisions)
    again = prepare.replay(df, frozen)
    assert sorted(again.collect()) == sorted(fitted.collect()) and again.dtypes == fitted.dtypes
    assert dict(again.dtypes)["text"] == "string"
    got = {r["id"]: r["d"] for r in again.collect()}
    assert (got[7].month, got[7].day) == ((4, 3) if dayfirst else (3, 4)) and got[8].month == 12 and got[9] is None
    assert sum(v is None for v in got.values()) == 2
    one = prepare.replay(df.where("id = 9"), frozen)  # a batch in which nothing parses has the same types
    assert one.dtypes == fitted.dtypes and one.first()["d"] is None


def test_a_saved_model_needs_nothing_outside_its_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prepare, "MOST_FROZEN", 10)
    folder = tmp_path / "shared"
    written = lambda df: (df.write.parquet(path := f"{folder}/t{len(list(folder.glob('*')))}"), path)[1]
    folder.mkdir()
    monkeypatch.setattr(prepare, "written", written)
    df = spark.range(300).selectExpr("id", "concat('u', id % 40) AS user", "concat('g', id % 7) AS grp", "double(id % 3) AS y")
    plan = [{"op": "target_encode", "columns": ["user"]}, {"op": "frequency_encode", "columns": ["user"]}, {"op": "ordinal_encode", "columns": ["user"]}, {"op": "group_aggregate", "columns": ["y"], "by": "grp"}]
    model = prepare.Preparation([], plan[:3], "y").fit(df)
    want = sorted(model.transform(df).collect())
    model.save(str(tmp_path / "model"))
    with pytest.raises(ValueError, match="elsewhere"):
        prepare.PreparationModel.load(str(tmp_path / "model")).write().overwrite().save(str(tmp_path / "model"))
    shutil.rmtree(folder)
    shutil.move(tmp_path / "model", tmp_path / "moved")
    assert sorted(prepare.PreparationModel.load(str(tmp_path / "moved")).transform(df).collect()) == want


def test_ordinal_codes_have_no_bound(spark):
    df = spark.range(6000).selectExpr("id", "CASE WHEN id >= 0 THEN lpad(id % 3000, 5, '0') END AS c")
    model = prepare.Preparation([], [{"op": "ordinal_encode", "columns": ["c"]}], "").fit(df)
    out = model.transform(df.union(spark.sql("SELECT -1L, CAST(NULL AS STRING)")).union(spark.sql("SELECT -2L, 'new'")))
    assert out.where("c_ordinal != CASE WHEN id < 0 THEN -1 ELSE id % 3000 END").count() == 0 and dict(out.dtypes)["c_ordinal"] == "bigint"


def test_a_fault_in_a_plan_is_noted_and_a_failing_job_is_raised(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, "a")], "x double, c string")
    assert len(prepare.clean(df, [{"action": "no such thing", "columns": ["x"]}])[2]) == 1

    def fails(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(prepare.C, "strip_whitespace", fails)
    with pytest.raises(RuntimeError):
        prepare.clean(df, [{"action": "strip_whitespace", "columns": ["c"]}])


def test_features_are_projected_from_the_profile(spark):
    df = spark.range(300).selectExpr("id AS key", "'x' AS same", "double(md5(string(id)) < '8') AS label", "id * 37 % 101 * 1.5D AS value", "double(md5(string(id)) < '8') * 3 + 1 AS leak", "concat('u', id) AS user")
    got = dict(prepare.profiled_features(df, "label"))
    assert got == {"key": "identifier", "same": "constant", "label": "target", "value": "", "leak": "leakage", "user": "identifier"}


def test_modes_of_all_columns(spark):
    rows = [(1, 2.5, "b", None, True), (1, 2.5, "a", None, False), (2, 1.5, "a", None, True), (2, None, "b", None, None)]
    df = spark.createDataFrame(rows, "i int, d double, s string, n string, t boolean")
    assert prepare.C.modes(df, df.columns) == {"i": 1, "d": 2.5, "s": "a", "n": None, "t": True}
