"""Target associations of all features at once against the measures one by one, their number of jobs, and permutation importance by formula against a brute force."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions.tables import global_running
from sparkprep.operators import associate as A
from sparkprep.operators import clean as C
from sparkprep.operators import diagnose as Q
from sparkprep.operators import split as V


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x = float(r.normal())
        rows.append((i, x if i % 7 else None, float(r.integers(0, 3)), float("abc".index("abc"[i % 3])), "pqr"[i % 3] if i % 5 else None, f"u{i}", "yes" if x + r.normal() > 0 else "no", x * 2 + float(r.normal()) if i % 11 else None, None))
    return spark.createDataFrame(rows, "key int, x double, few double, cyc double, word string, many string, label string, y double, none double").repartition(3)


def test_associations_with_classes(mixed):
    got = {a["column"]: a["coefficients"] for a in A.target_associations(mixed, "label", ["x", "few", "cyc", "word", "many", "none"])}
    assert set(got) == {"x", "few", "cyc", "word"}
    for c in ("x", "few", "cyc"):
        auc = A.single_auc(mixed.withColumn("_y", (F.col("label") == "yes").cast("int")), c, "_y").first()["auc"]
        want = {"mutual_information": A.mutual_information(A.discretise(mixed, c), c, "label").first()["normalised"], "eta": A.correlation_ratio(mixed, "label", c).first()["eta"], "auc": 2 * abs(auc - 0.5)}
        assert got[c] == pytest.approx(want), c
    assert got["word"] == pytest.approx({"mutual_information": A.mutual_information(mixed, "word", "label").first()["normalised"], "cramers_v": A.cramers_v(mixed, "word", "label").first()["v"]})


def test_associations_with_a_number(mixed):
    got = {a["column"]: a["coefficients"] for a in A.target_associations(mixed, "y", ["x", "few", "word", "many", "none"], "regression")}
    assert set(got) == {"x", "few", "word"}
    for c in ("x", "few"):
        info = A.mutual_information(A.discretise(A.discretise(mixed, c), "y"), c, "y").first()["mi"]
        want = {"pearson": abs(A.pearson_pairs(mixed, [c, "y"]).first()["r"]), "spearman": abs(A.spearman(mixed, c, "y").first()["rho"]), "mutual_information": (1 - np.exp(-2 * info)) ** 0.5}
        assert got[c] == pytest.approx(want), c
    assert got["word"] == pytest.approx({"eta": A.correlation_ratio(mixed, "word", "y").first()["eta"]})


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_the_number_of_jobs_does_not_grow_with_the_features(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("string").alias("label"), *[((F.col("id") * (i + 3)) % 97).cast("double").alias(f"f{i}") for i in range(40)])
    few, many = (jobs(spark, lambda n=n: A.target_associations(df, "label", [f"f{i}" for i in range(n)])) for n in (4, 40))
    assert many <= few + 2  # a range may be sampled once more


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations_by_formula(spark, n):
    got = sorted(spark.range(n).select("id", Q.permuted(n, "s")("id").alias("to")).collect())
    assert sorted(r["to"] for r in got) == list(range(n))
    if n == 1000:
        to = np.array([r["to"] for r in got])
        assert abs(np.corrcoef(np.arange(n), to)[0, 1]) < 0.15 and len(set(np.diff(to))) > 500
        assert [r["to"] for r in sorted(spark.range(n).select("id", Q.permuted(n, "t")("id").alias("to")).collect())] != to.tolist()


def test_permutation_importance_equals_a_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(1000 - i, float(r.normal()), float(r.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "key int, a double, b double").repartition(4)
    score = lambda t: t.agg(F.avg(((F.col("a") + 0.1 * F.col("b") > 0) == (F.col("key") % 2 == 0)).cast("double"))).first()[0]
    got = {x["feature"]: (x["importance"], x["std"]) for x in Q.permutation_importance(df, ["a", "b"], "key", score, 3).collect()}
    rows.sort()
    key, cols = np.array([x[0] for x in rows]), {"a": np.array([x[1] for x in rows]), "b": np.array([x[2] for x in rows])}
    plain = lambda c: float(np.mean((c["a"] + 0.1 * c["b"] > 0) == (key % 2 == 0)))
    drops = {}
    for f in ("a", "b"):
        drops[f] = []
        for k in range(3):
            to = np.array([x["to"] for x in sorted(spark.range(500).select("id", Q.permuted(500, str(k))("id").alias("to")).collect())])
            moved = np.empty(500)
            moved[to] = cols[f]
            drops[f].append(plain(cols) - plain(cols | {f: moved}))
    total = sum(max(0.0, np.mean(d)) for d in drops.values()) or 1.0
    for f, d in drops.items():
        assert got[f] == pytest.approx((max(0.0, float(np.mean(d))) / total, float(np.std(d))))


def test_chance_of_a_normal_value(spark):
    z = [0.0, 0.3, 1.0, 1.959964, 3.0, 5.0]
    got = [r["p"] for r in spark.createDataFrame([(v,) for v in z], "z double").select(Q.two_sided_p(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(v / 2**0.5) for v in z], abs=2e-7)


def test_split_sizes_are_noted():
    assert V.size_deviations({"train": 65, "test": 20, "validation": 15}, {"test": 0.2, "validation": 0.15}) == []
    assert V.size_deviations({"train": 60, "test": 25, "validation": 15}, {"test": 0.2, "validation": 0.0}) == ["test has 25.0% of the rows, 20.0% were wanted"]
    assert len(V.size_deviations({}, {"test": 0.2, "validation": 0.15})) == 2


def test_times_are_filled_along_the_order(spark):
    rows = [(1, None, None), (2, "2024-01-05", "a"), (3, None, "b"), (4, "2024-01-05", None), (5, None, "b"), (6, "2024-02-01", "b")]
    df = spark.createDataFrame(rows, "k int, day string, v string").withColumn("day", F.col("day").cast("date"))
    got, fills = C.impute_by_type(df, ["day", "v"], ["k"])
    assert [(str(r["day"]), r["v"]) for r in got.orderBy("k").collect()] == [("2024-01-05", "b"), ("2024-01-05", "a"), ("2024-01-05", "b"), ("2024-01-05", "b"), ("2024-01-05", "b"), ("2024-02-01", "b")]
    assert fills == {"v": "b"}


@pytest.mark.parametrize("share", [0.36787944117144233, 0.7357588823428847, 0.9999, 0.25])
def test_digests_are_compared_as_text_where_numbers_would_be(share):
    from sparkprep.operators.diagnose import _first_digits

    least = int(_first_digits(share), 16)
    assert (least + 0.5) / 2**52 >= share > (least - 0.5) / 2**52 and len(_first_digits(share)) == 13


def test_rows_of_one_task_are_dealt_over_the_cores(spark):
    from sparkprep.functions.tables import SPREAD_ROWS, spread

    one = spark.range(0, 3 * SPREAD_ROWS, 1, 1)
    assert spread(one).rdd.getNumPartitions() == 3 and spread(one).count() == 3 * SPREAD_ROWS
    assert spread(one.limit(5)).rdd.getNumPartitions() == 1 and spread(one.limit(0)).count() == 0


def test_associations_derive_their_rows_once_to_count_and_once_to_write(spark):
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(400).selectExpr("id * 2D AS x", "double(id % 7) AS z", "id * 1D AS y").mapInArrow(pass_on, "x double, z double, y double")
    got = {a["column"]: a["coefficients"]["spearman"] for a in A.target_associations(df, "y", ["x", "z"], "regression")}
    assert seen.value <= 2 * 400
    assert got["x"] == pytest.approx(1) and got["z"] == pytest.approx(abs(A.spearman(df, "z", "y").first()["rho"]))


def test_ranks_of_features_with_and_without_holes(spark):
    df = spark.range(500).selectExpr("double(id * 37 % 101) AS whole", "CASE WHEN id % 3 > 0 THEN double(id * 11 % 17) END AS holed", "5D AS same", "CASE WHEN id % 4 > 0 THEN -0.5D * (id * 37 % 101) * (id % 5) END AS few", "CASE WHEN id % 10 > 0 THEN double(id * 53 % 29) END AS y")
    got = {a["column"]: a["coefficients"] for a in A.target_associations(df, "y", ["whole", "holed", "same", "few"], "regression")}
    assert "spearman" not in got["same"]
    for c in ("whole", "holed", "few"):
        assert got[c]["spearman"] == pytest.approx(abs(A.spearman(df, c, "y").first()["rho"])), c


def test_each_range_of_a_global_order_is_a_task_of_its_own(spark):
    run = global_running(spark.range(4000).selectExpr("id * 37 % 4001 AS v"), [F.col("v")], {"upto": F.col("v")}, partitions=8)
    tasks = run.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("upto").alias("upto")).collect()
    assert len(tasks) == 8 and max(r["n"] for r in tasks) < 2 * 4000 / 8
    assert max(r["upto"] for r in tasks) == run.agg(F.sum("v")).first()[0]
