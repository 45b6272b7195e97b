from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from priorline.operators import metrics, similarity
from priorline.operators.replay import replay
from priorline.queries import metrics as queries
from priorline.queries import models, ratings


def test_nearest_goes_over_all_templates_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    vectors = [[rng.random() for _ in range(8)] for _ in range(200)]
    templates = spark.createDataFrame([(i % 7, v) for i, v in enumerate([*vectors, *vectors[:20]])], "label long, embedding array<double>")
    wanted = [(i, [rng.random() for _ in range(8)]) for i in range(30)]
    asked = spark.createDataFrame(wanted, "vec_id long, embedding array<double>")
    monkeypatch.setattr(similarity, "MOST_TEMPLATE_BYTES", 100)
    monkeypatch.setattr(similarity, "BLOCK_TEMPLATE_BYTES", 2000, raising=False)
    got = {r.vec_id: (r.label, r.best, r.margin) for r in similarity.nearest(asked, templates).collect()}
    for i, q in wanted:
        best: dict[int, float] = {}
        for k, v in enumerate([*vectors, *vectors[:20]]):
            score = 1 - sum(abs(a - b) for a, b in zip(q, v, strict=True)) / 8
            best[k % 7] = max(best.get(k % 7, 0.0), score)
        first, second = sorted(best, key=lambda x: (-best[x], x))[:2]
        assert got[i] == (first, pytest.approx(best[first]), pytest.approx(best[first] - best[second]))


def test_the_registered_bootstrap_draws_the_default_iterations(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, i // 3, rng.randint(0, 1), rng.random()) for i in range(90)]
    frame = spark.createDataFrame(rows, "match_id long, series_id long, y int, p double")
    monkeypatch.setattr(queries, "scored", lambda *_: frame)
    want = metrics.bootstrap_interval(metrics.cluster_losses(frame, "series_id"), iterations=1000).collect()
    assert queries.bootstrap_interval(spark, "").collect() == want


def test_the_model_of_ratings_folds_them_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, datetime(1995, 1, 1) + timedelta(days=i), *rng.sample(range(6), 2), "A", "1", rng.randint(0, 1), i) for i in range(1000)]
    m = spark.createDataFrame(rows, "match_id long, ts timestamp_ntz, blue int, red int, league string, tier string, blue_win int, series_id long")
    runs = spark.sparkContext.accumulator(0)

    def counted(contests):
        made = replay(contests).coalesce(1)

        def run(batches):
            runs.add(1)
            yield from batches

        return made.mapInArrow(run, made.schema)

    for module in (models, ratings):
        monkeypatch.setattr(module, "matches", lambda *_: m)
    monkeypatch.setattr(models, "replay", counted)
    assert {r.split: r.n for r in models.model_elo_only(spark, "").collect()} == {"train": 365, "validation": 366, "test": 269}
    assert runs.value == 1
    spark.catalog.clearCache()
