"""Heads against loops: what a trained one predicts by its own weights, and which of several is kept."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import heads


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4))
    y = np.argmax(x[:, :3] + 0.1 * rng.normal(size=(400, 3)), 1)
    df = spark.createDataFrame([(v.tolist(), int(k), i) for i, (v, k) in enumerate(zip(x, y))], "features array<double>, label int, id int")
    return df.where("id < 250"), df.where("id >= 250")


def scored(model, df):
    return [(r.v, r.label, int(r.prediction)) for r in model.transform(df.withColumn("v", F.col("features")).select("v", "label", array_to_vector("features").alias("features"))).select("v", "label", "prediction").collect()]


def test_linear_head_is_its_weights(rows):
    train, held = rows
    model, reached = heads.train_head(train, held, 3)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    got = scored(model, held)
    for v, _, said in got:
        assert said == max(range(3), key=lambda k: sum(a * c for a, c in zip(w[k], v)) + b[k])
    assert reached == pytest.approx(sum(y == said for _, y, said in got) / len(got)) and reached > 0.9


def test_hidden_head_is_its_weights(rows):
    train, held = rows
    model, reached = heads.train_head(train, held, 3, mlp=True, rounds=(60,))
    flat = model.weights.toArray()
    first, bias1, second, bias2 = flat[: 4 * 32].reshape(4, 32), flat[128:160], flat[160 : 160 + 96].reshape(32, 3), flat[256:]
    got = scored(model, held)
    for v, _, said in got:
        hidden = [1 / (1 + math.exp(-(sum(v[i] * first[i, j] for i in range(4)) + bias1[j]))) for j in range(32)]
        assert said == max(range(3), key=lambda k: sum(h * second[j, k] for j, h in enumerate(hidden)) + bias2[k])
    assert reached == pytest.approx(sum(y == said for _, y, said in got) / len(got)) and reached > 0.85


def test_best_of_several_rounds_is_kept(rows):
    train, held = rows
    each = [heads.train_head(train, held, 3, rounds=(n,))[1] for n in (1, 20)]
    assert heads.train_head(train, held, 3, rounds=(1, 20))[1] == max(each)
    assert heads.accuracy(held.select(F.col("label").alias("prediction"), "label").limit(0)) == 0
