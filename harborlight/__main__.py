"""Command line: python -m harborlight FOLDER run PHASE | refit CUTOFF | runs."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from harborlight.config import Config
from harborlight.plans import phases


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="harborlight", description="From raw complaints to alerts.")
    p.add_argument("folder", help="where the tables lie, on the session's file system")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run one phase")
    run.add_argument("phase", choices=[*phases.PHASES])
    run.add_argument("--cutoff", help="only what was known before this date")
    run.add_argument("--source", help="the raw CSV, for load")
    run.add_argument("--control", action="store_true", help="signals with permuted clusters")
    refit = sub.add_parser("refit", help="groups, clusters and signals before a cutoff")
    refit.add_argument("cutoff")
    runs = sub.add_parser("runs", help="list runs, the latest first")
    runs.add_argument("-n", type=int, default=20)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("harborlight").getOrCreate()
    work = phases.Work(spark, args.folder.rstrip("/"), Config())
    if args.command == "runs":
        for r in work.registry.records()[: args.n]:
            print(f"{r['run_id']:<45} {r['status']:<8} {r.get('rows', '-'):>12}  {r['config'][:8]}  {json.dumps(r['params'], sort_keys=True)} {r.get('error', '')}")
        return 0
    if args.command == "refit":
        done = phases.refit(work, args.cutoff)
    else:
        options = {"source": args.source} if args.phase == "load" else {"control": args.control} if args.phase == "signals" else {}
        done = [phases.run_phase(work, args.phase, args.cutoff, **options)]
    for r in done:
        print(json.dumps(r))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
