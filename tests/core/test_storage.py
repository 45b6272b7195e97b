from __future__ import annotations

import hashlib
import random

import pytest

from priorline.operators import metrics, storage


def test_runs_are_recorded_once(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert storage.runs(spark, folder).count() == 0
    storage.record_run(spark, folder, "r1", "in.jsonl", "abc", 5, 2)
    with pytest.raises(ValueError):
        storage.record_run(spark, folder, "r1", "in.jsonl", "abc", 5, 2)
    storage.record_run(spark, folder, "r2", "in.csv", "def", 0, 0)
    rows = {r.run_id: (r.source, r.n_accepted, r.n_rejected) for r in storage.runs(spark, folder).collect()}
    assert rows == {"r1": ("in.jsonl", 5, 2), "r2": ("in.csv", 0, 0)}


def test_upserts_keep_the_last_value(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", None, 3)], "k string, v int, at int")
    assert {r.k: r.v for r in storage.upserted(rows, "k", "at").collect()} == {"a": None, "b": 2}


def test_file_digests(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"one")
    (tmp_path / "two.bin").write_bytes(b"\0\1")
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in storage.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"one.bin": hashlib.sha256(b"one").hexdigest(), "two.bin": hashlib.sha256(b"\0\1").hexdigest()}


def test_auc_over_cells_is_the_share_of_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5, 1.0, 0.0]), rng.randint(0, 1)) for _ in range(400)] + [("one", 0.3, 1)]
    got = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, p double, y int"), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([p for x, p, y in rows if x == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got["one"] is None
