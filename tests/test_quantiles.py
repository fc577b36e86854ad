"""Exact quantiles by narrowing, on a grid and in groups, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import quantiles as Q


@pytest.fixture(scope="module")
def numbers(spark):
    r = np.random.default_rng(3)
    n = 3000
    cols = {
        "flat": r.normal(size=n), "ties": r.integers(0, 4, n).astype(float), "one": np.full(n, 2.5), "wide": np.exp(r.normal(size=n) * 60), "far": np.where(r.random(n) < 0.002, 1e300, r.random(n)),
        "signs": np.concatenate([-(10.0 ** r.integers(-300, 300, n // 2)), 10.0 ** r.integers(-300, 300, n - n // 2)]),
    }
    rows = [tuple(float(v[i]) for v in cols.values()) + (None if i % 3 else float(i), None, float("nan") if i % 5 else float(i), i % 7 if i % 11 else None, "hot" if i % 3 else f"g{i % 50}") for i in range(n)]
    names = [*cols, "holes", "none", "nan", "g", "h"]
    return cols, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names[:-2]) + ", g int, h string").repartition(5)


@pytest.mark.parametrize(("bins", "few"), [(2048, 20_000), (16, 50), (3, 1)])
def test_quantiles_by_narrowing(numbers, monkeypatch, bins, few):
    cols, df = numbers
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "FEW", few)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    names = list(cols) if bins > 3 else ["flat", "ties", "one"]
    got = Q.column_quantiles(df, {c: F.col(c) for c in [*names, "holes", "none", "nan"]}, ps)
    for c in names:
        assert got[c] == pytest.approx(np.quantile(cols[c], ps).tolist(), rel=1e-12), c
    assert got["holes"] == pytest.approx(np.quantile(np.arange(0, 3000, 3), ps).tolist())
    assert got["nan"] == pytest.approx(np.quantile(np.arange(0, 3000, 5), ps).tolist())
    assert got["none"] == [None] * len(ps)


def test_quantiles_on_a_grid(numbers):
    cols, df = numbers
    for c in ("flat", "ties", "one"):
        assert Q.grid_quantiles(df, F.col(c), 1000) == pytest.approx(np.quantile(cols[c], np.arange(1001) / 1000).tolist())
    assert Q.grid_quantiles(df, F.col("none"), 10) == []


def test_medians_of_groups(numbers):
    _, df = numbers
    got = {(r["g"], r["h"]): (r["a"], r["b"], r["c"]) for r in Q.group_medians(df, ["g", "h"], {"a": F.col("flat"), "b": F.col("holes"), "c": F.col("none")}).collect()}
    pdf = df.select("g", "h", "flat", "holes").toPandas()
    want = pdf.groupby(["g", "h"], dropna=False)[["flat", "holes"]].median()
    assert len(got) == len(want)
    for (g, h), row in want.iterrows():
        a, b, c = got[None if np.isnan(g) else int(g), h]
        assert a == pytest.approx(row["flat"]) and c is None and (b is None if np.isnan(row["holes"]) else b == pytest.approx(row["holes"]))
