"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from priorline import catalog
from priorline.session import build_session

HEADLINE = (
    "pit_counts", "pit_league_prior", "pit_form", "pit_synergy", "pit_player_champion", "pit_continuity", "pit_provenance", "asof_prior",
    "elo_team", "latent_design", "latent_features", "split_rolling", "metric_breakdowns", "metric_roc_auc", "quarantine_split", "series_validate", "release_gates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
