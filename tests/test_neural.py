"""Regression by a network: gradients by differences, learning, saving, odd rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sparkprep.operators import models as M
from sparkprep.operators.neural import gradient


def test_gradient_by_differences():
    r, sizes = np.random.default_rng(1), [3, 4, 2, 1]
    flat = r.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 2 + 1)
    x, y, w = r.normal(size=(7, 3)), r.normal(size=7), r.random(7)

    def loss(f):
        from sparkprep.operators.neural import _forward, _layers

        return 0.5 * np.sum(w * (_forward(x, _layers(f, sizes))[-1][:, 0] - y) ** 2) / w.sum()

    got = gradient(flat, sizes, x, y, w)
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def bent(spark):
    r = np.random.default_rng(3)
    return spark.createDataFrame([(float(a), float(b), float(1000 + 50 * abs(a) + 10 * a * b)) for a, b in r.normal(size=(3000, 2))], "a double, b double, label double")


def test_shards_learn_what_a_line_cannot(spark, bent, tmp_path):
    stages = dict(features=["a", "b"], hidden_layer_sizes=(24, 12), max_iter=12)
    pipe = M.pipeline("neural_network", "regression", **stages)
    pipe.getStages()[-1]._set(rowsPerShard=700)  # four shards
    model = pipe.fit(bent)
    error = lambda m: M.predict(m, bent).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2.0)))).first()[0]
    spread = bent.agg(F.var_pop("label")).first()[0]
    assert error(model) < 0.1 * spread < error(M.pipeline("linear", "regression", ["a", "b"]).fit(bent))
    model.write().save(str(tmp_path / "m"))
    assert error(PipelineModel.load(str(tmp_path / "m"))) == pytest.approx(error(model))


def test_odd_rows(spark, bent):
    odd = spark.createDataFrame([(float("nan"), 1.0, 5.0), (1.0, float("inf"), 5.0), (1.0, 1.0, None)], bent.schema)
    pipe = M.pipeline("neural_network", "regression", ["a", "b"], hidden_layer_sizes=(4,), max_iter=2)
    got = M.predict(pipe.fit(bent.limit(200).unionByName(odd)), odd).collect()
    assert got[0]["prediction"] is None and got[1]["prediction"] is None and np.isfinite(got[2]["prediction"])
    with pytest.raises(ValueError, match="no rows"):
        pipe.fit(bent.limit(0))
    assert M.predict(pipe.fit(bent.limit(50).withColumn("b", F.lit(1.0))), bent.limit(0)).count() == 0
