from __future__ import annotations

from collections import Counter

import corpus_pipeline


def test_pipeline_stages_over_a_small_corpus(spark, frame, words, tmp_path):
    item = " ".join(words(30, 4000))
    rows = [(i, " ".join(words(60 + i % 50, 7000 + i)), "en", "abc"[i % 3]) for i in range(1500)]
    rows += [(2000 + i, rows[i][1], "en", "a") for i in range(10)]
    rows += [(3000, "too short", "en", "a"), (3001, None, None, None), (3002, " ".join(words(50, 9000)) + " " + item, "en", "b")]
    frame(rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    ids = set(range(1500))
    assert set(left["quality"]) == ids | {2000 + i for i in range(10)} | {3002}
    assert set(left["near_dedup"]) == ids | {3002}
    assert set(left["decontamination"]) == ids
    assert set(left["mixing"]) <= ids and max(left["mixing"].values()) <= 3
    assert left["sharding"] == left["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(left["sharding"].values())


def test_stages_over_awkward_rows(spark, frame, words, awkward, tmp_path):
    """Repeated rows, rows without doc_id, nulls and an empty table in every stage."""
    text = " ".join(words(60, 1))
    rows = [*awkward, (500, text), (500, text), (None, text), (None, text), (500, " ".join(words(60, 2))), (501, text)]
    spark.createDataFrame([(1, None), (2, ""), (3, " ".join(words(12, 9)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(rows)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got[500, text] == 1 and got[None, text] == got[501, text] == 0 and got[500, " ".join(words(60, 2))] == 1
    assert sum(got[d, "same text here"] for d in (7, 8, None)) == 1 and max(got.values()) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame([]), str(tmp_path)).count() == 0
        kept = stage(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
        assert {(r.doc_id, r.text) for r in kept} <= {(r[0], r[1]) for r in rows}
