"""Command line: lists and runs queries, and ingests files. Everything prints one JSON document."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from priorline import catalog
from priorline.session import build_session


def _counts(rejected) -> dict[str, int]:
    return {r["reason"]: r["n"] for r in rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason").collect()}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="priorline")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    run = verbs.add_parser("run", help="run a query and write it, or show its first rows")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    for verb, what in (("ingest", "canonical JSON Lines"), ("ingest-tabular", "twelve-row CSV"), ("ingest-snapshot", "a snapshot document")):
        own = verbs.add_parser(verb, help=f"read {what}, write accepted and rejected rows")
        own.add_argument("path")
        own.add_argument("out")
    given = parser.parse_args(arguments)
    if given.verb == "list":
        print(json.dumps(sorted(catalog.queries())))
        return 0
    spark = build_session("priorline")
    if given.verb == "run":
        rows = catalog.queries()[given.name](spark, given.tables)
        if given.out:
            rows.write.mode("errorifexists").parquet(given.out)
            print(json.dumps({"query": given.name, "out": given.out, "rows": spark.read.parquet(given.out).count()}))
        else:
            print(json.dumps({"query": given.name, "rows": [json.loads(x) for x in rows.limit(given.rows).toJSON().collect()]}))
        return 0
    if given.verb == "ingest":
        from priorline.sources.canonical import append_matches, read_jsonl

        accepted, rejected = read_jsonl(spark, given.path)
        append_matches(accepted, f"{given.out}/matches")
    elif given.verb == "ingest-tabular":
        from priorline.sources.tabular import games, read_csv, with_series

        accepted, rejected = games(read_csv(spark, given.path))
        accepted, late = with_series(accepted)
        rejected = rejected.unionByName(late)
        accepted.write.mode("errorifexists").parquet(f"{given.out}/games")
    else:
        from priorline.sources.snapshot import games, read_snapshot

        accepted, rejected = games(read_snapshot(spark, given.path))
        accepted.write.mode("errorifexists").parquet(f"{given.out}/games")
    rejected.write.mode("append").parquet(f"{given.out}/quarantine")
    print(json.dumps({"accepted": accepted.count(), "rejected": _counts(rejected)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
