"""Steps in order, each with its status and time; the command line runs queries over a folder, checks its tables, exports its objects, and publishes it as a snapshot."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Step:
    name: str
    status: str
    seconds: float
    error: str = ""


def run_steps(steps: Sequence[tuple[str, Callable[[], object]]]) -> list[Step]:
    """Runs until a step fails; those after it are skipped."""
    done: list[Step] = []
    for name, work in steps:
        if done and done[-1].status != "passed":
            done.append(Step(name, "skipped", 0.0))
            continue
        began = time.perf_counter()
        try:
            work()
            done.append(Step(name, "passed", round(time.perf_counter() - began, 3)))
        except Exception as e:  # the report names it, and the exit code tells
            done.append(Step(name, "failed", round(time.perf_counter() - began, 3), f"{type(e).__name__}: {e}"[:500]))
    return done


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="upkeep", description="Runs queries over a folder of tables.")
    parser.add_argument("command", choices=("run", "validate-input", "export", "publish"))
    parser.add_argument("folder")
    parser.add_argument("--out", help="folder for the results, Parquet; for export the folder of tables and manifests, for publish the managed folder")
    parser.add_argument("--kind", choices=("csv", "parquet"), default="csv", help="files of exported objects")
    parser.add_argument("--queries", nargs="*", default=["val_row_counts", "mart_fleet_week", "validation_gate"])
    args = parser.parse_args(argv)
    if args.command in ("export", "publish") and not args.out:
        parser.error(f"{args.command} needs --out")

    from pyspark.sql import SparkSession

    from upkeep.operators.contracts import require_publishable
    from upkeep.plans import audit, catalogue, decisions, planning, registry, validation_plans
    from upkeep.sources.files import require_inputs
    from upkeep.sources.fleet import Fleet

    spark = SparkSession.builder.appName("upkeep").getOrCreate()
    steps: list[tuple[str, Callable[[], object]]] = [("inputs", lambda: require_inputs(spark, args.folder, [f"{t}.parquet" for t in audit.CONTRACTS])), ("contracts", lambda: audit.require_contracts(spark, args.folder))]
    if args.command == "run":
        known = {k: v for p in (catalogue, audit, decisions, planning, validation_plans, registry) for k, v in p.QUERIES.items()}
        for name in args.queries:
            steps.append((name, lambda name=name: (lambda df: df.write.mode("overwrite").parquet(f"{args.out}/{name}") if args.out else df.write.format("noop").mode("overwrite").save())(known[name](spark, args.folder))))
    if args.command == "export":
        steps += [("gates", lambda: audit.require_gates(Fleet(spark, args.folder))), ("contract gate", lambda: require_publishable(registry.checks(Fleet(spark, args.folder)))), ("export", lambda: registry.export_run(spark, args.folder, args.out, args.kind))]
    if args.command == "publish":
        steps.append(("publish", lambda: registry.publish(spark, args.folder, args.out)))
    found = run_steps(steps)
    print(json.dumps([asdict(s) for s in found], indent=1))
    return 0 if all(s.status == "passed" for s in found) else 1


if __name__ == "__main__":
    sys.exit(main())
