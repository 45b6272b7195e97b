from __future__ import annotations

import math
import random

import pytest

from priorline.models.estimators import Logistic, Trees, mirrored


def rows(spark, n: int = 600):
    rng = random.Random(3)
    made = []
    for i in range(n):
        x = rng.gauss(0, 1)
        made.append((i, x, 1.0, int(rng.random() < 1 / (1 + math.exp(-(1.5 * x + 0.4)))), 0.5 ** (i / 100)))
    return spark.createDataFrame(made, "id int, x double, side double, y int, w double")


def test_a_paired_model_is_fair_to_both_sides(spark):
    frame = rows(spark)
    model = Logistic(("x", "side"), intercept=False).fit(mirrored(frame, ("x", "side")))
    own = {r.id: r.p for r in model.predict(frame).collect()}
    other = {r.id: r.p for r in model.predict(mirrored(frame, ("x", "side")).filter("side < 0")).collect()}
    assert all(own[i] + other[i] == pytest.approx(1, abs=1e-6) for i in own)
    assert sum(own.values()) / len(own) > 0.52


def test_weights_count_rows(spark):
    """A row of weight two is two rows."""
    frame = rows(spark, 200)
    doubled = frame.unionByName(frame.filter("id % 2 = 0"))
    weighted = frame.selectExpr("id", "x", "side", "y", "IF(id % 2 = 0, 2.0D, 1.0D) AS w")
    one, two = Logistic(("x",), weight="w").fit(weighted), Logistic(("x",)).fit(doubled)
    assert one.model.coefficients[0] / one.scaling.stats["x"][2] == pytest.approx(two.model.coefficients[0] / two.scaling.stats["x"][2], rel=0.05)


def test_trees_learn_a_step(spark):
    frame = rows(spark).selectExpr("id", "x", "CAST(x > 0.3 AS INT) AS y")
    got = Trees(("x",), rounds=3).fit(frame).predict(frame).collect()
    assert all((r.p > 0.5) == bool(r.y) for r in got if abs(r.x - 0.3) > 0.1)
