"""Exact neighbours by pivots against all pairs; how much is compared; ties, copies and empty sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import neighbours as NB


def brute(rows, queries, k, exclude_self=False):
    out = {}
    for qi, qv in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(qv)) ** 2).sum())), i) for i, v in rows if not (exclude_self and i == qi))
        out[qi] = d[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["place"])):
        out.setdefault(r["query"], []).append((r["distance"], r["id"]))
    return out


@pytest.mark.parametrize(("block", "kind"), [(4096, "spread"), (32, "spread"), (16, "copies"), (8, "line")])
def test_nearest_equals_all_pairs(spark, block, kind):
    r = np.random.default_rng(1)
    x = {"spread": lambda: r.normal(size=(400, 3)).round(2), "copies": lambda: np.repeat(r.integers(0, 3, (40, 3)), 10, axis=0).astype(float), "line": lambda: np.column_stack([np.arange(400.0), np.zeros(400), np.zeros(400)])}[kind]()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [(i, v) for i, v in rows if i % 4 == 0] + [(1000, [50.0, 50.0, 50.0])]
    make = lambda t: spark.createDataFrame([(i, *map(float, v)) for i, v in t], "key long, a double, b double, c double").repartition(3)
    for self_out in (False, True):
        got, want = found(NB.nearest(make(rows), make(queries), "key", ["a", "b", "c"], 5, self_out, block)), brute(rows, queries, 5, self_out)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]] and [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]])


def test_fewer_rows_than_asked_for_and_none(spark):
    one = spark.createDataFrame([(1, 0.0)], "key long, a double")
    many = spark.createDataFrame([(i, float(i)) for i in range(3)], "key long, a double")
    assert found(NB.nearest(one, many, "key", ["a"], 5)) == {0: [(0.0, 1)], 1: [(1.0, 1)], 2: [(2.0, 1)]}
    assert NB.nearest(one.limit(0), many, "key", ["a"], 5).count() == 0 == NB.nearest(many, one.limit(0), "key", ["a"], 5).count()


@pytest.mark.parametrize("block", [4096, 64])
def test_rows_equally_far_after_scaling_go_by_id(spark, block):
    r = np.random.default_rng(3)
    cents = r.integers(-99_985, 999_980, 40)
    cents = np.concatenate([cents, *(np.repeat(cents + side * step, 3) for step in (176, 1421, 2832) for side in (-1, 1))])  # equally far on both sides, in copies
    ids = r.permutation(len(cents))
    df = spark.createDataFrame([(int(i), c / 100 / 1000, float(i)) for i, c in zip(ids, cents.tolist(), strict=True)], "key long, a double, y double").repartition(3)
    queries = df.where(F.col("key").isin(ids[:40].tolist()))
    rows = df.where(~F.col("key").isin(ids[:40].tolist()))
    want = {int(q): [int(i) for _, i in sorted((abs(c - cq), i) for c, i in zip(cents[40:], ids[40:], strict=True))[:3]] for cq, q in zip(cents[:40], ids[:40], strict=True)}
    scaled = NB._scaled(rows, ["a"], queries)
    got = found(NB.nearest(*scaled, "key", ["a"], 3, block=block, digits=NB.TIE_DIGITS))
    assert {q: [i for _, i in near] for q, near in got.items()} == want
    means = {r["key"]: r["prediction"] for r in NB.knn_predict(rows, queries, "key", ["a"], "y", 3, classify=False).collect()}
    assert means == pytest.approx({q: sum(near) / 3 for q, near in want.items()})


@pytest.mark.parametrize("block", [4096, 64])
def test_nearly_equal_distances_are_told_by_differences(spark, block):
    r = np.random.default_rng(4)
    cents, nation = r.integers(-99_985, 999_980, 40), r.integers(0, 25, 40)
    sides = [(c + side * step, n) for c, n in zip(cents.tolist(), nation.tolist(), strict=True) for step in (176, 1421) for side in (-1, 1) for _ in range(6)]
    make = lambda t: spark.createDataFrame([(i, *v) for i, v in t], "key long, a double, b double").repartition(3)
    rows = list(zip(r.permutation(len(sides)).tolist(), [(c / 100 / 1000, float(n)) for c, n in sides], strict=True))
    queries = [(i, (c / 100 / 1000, float(n))) for i, (c, n) in enumerate(zip(cents.tolist(), nation.tolist(), strict=True))]
    got, want = found(NB.nearest(make(rows), make(queries), "key", ["a", "b"], 5, block=block)), brute(rows, queries, 5)
    assert {q: [i for _, i in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in want.items()}


def test_most_blocks_are_never_looked_at(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 1e4).alias("a"), (F.col("o_custkey") / 100.0).alias("b"))
    seen = []
    real = NB._visits

    def visits(asking, bounds, pivots, radii, parts):
        out = real(asking, bounds, pivots, radii, parts)
        seen.append((out.count() + asking.count(), asking.count() * sum(parts.values())))
        return out

    monkeypatch.setattr(NB, "_visits", visits)
    NB.nearest(o, o.where("key % 10 = 0"), "key", ["a", "b"], 5, block=256).count()
    assert seen and seen[0][0] < seen[0][1] / 3, seen


def brute_clusters(rows, eps, least):
    x = np.array([v for _, v in rows])
    ids = [i for i, _ in rows]
    near = [set(np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps).tolist()) for p in x]
    core = [len(n) >= least for n in near]
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, others in enumerate(near):
        for b in others:
            if core[a] and core[b]:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for a in range(len(x)):
        if core[a]:
            low[find(a)] = min(low.get(find(a), ids[a]), ids[a])
    out = {}
    for a in range(len(x)):
        seen = sorted((ids[b], b) for b in near[a] if core[b])
        out[ids[a]] = low[find(a)] if core[a] else low[find(seen[0][1])] if seen else -1
    return out


@pytest.mark.parametrize(("dims", "eps", "least"), [(1, 0.05, 4), (2, 0.2, 5), (3, 0.5, 4), (5, 0.9, 4)])
def test_dbscan_equals_a_brute_force(spark, monkeypatch, dims, eps, least):
    monkeypatch.setattr(NB, "CELL_BLOCK", 7)
    r = np.random.default_rng(dims)
    x = np.concatenate([r.normal(size=(150, dims)), r.normal(size=(60, dims)) * 0.05 + 2.0, np.full((20, dims), -2.0), np.full((3, dims), 9.0)])
    rows = [(int(i) + 5, v.tolist()) for i, v in zip(r.permutation(len(x)), x, strict=True)]
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *v) for i, v in rows], ", ".join(["key long", *[f"{n} double" for n in names]])).repartition(3)
    got = {r["key"]: r["cluster"] for r in NB.dbscan(df, "key", names, eps, least, scaled=False).collect()}
    assert got == brute_clusters(rows, eps, least)


def test_dbscan_of_very_dense_cells_makes_no_pairs(spark):
    df = spark.range(120_000).selectExpr("id AS key", "CASE WHEN id % 2 = 0 THEN 0.001 * (id % 97) ELSE 0.4 + 0.001 * (id % 89) END AS a", "0.0D AS b").unionByName(spark.sql("SELECT 999999L AS key, 50.0D AS a, 50.0D AS b"))
    got = {(r["cluster"], r["n"]) for r in NB.dbscan(df, "key", ["a", "b"], 0.35, 5, scaled=False).groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 120_000), (-1, 1)}
