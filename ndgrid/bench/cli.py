"""``python -m ndgrid.bench.cli list | run NAME [KEY=VALUE ...] | sweep NAME [KEY=VALUE ...]``.

A sweep runs each point in a process of its own, unless ``--here`` is given; a point that fails is reported and the
others go on.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from pyspark.sql import SparkSession

from ndgrid.bench import benches, harness  # noqa: F401
from ndgrid.bench.registry import REGISTRY


def session(cores: str = "*") -> SparkSession:
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _measure(name: str, given: dict, args: argparse.Namespace) -> dict:
    from ndgrid.runtime import clean_shared

    spark = session(args.cores)
    try:
        return harness.run(spark, REGISTRY[name], given, warmups=args.warmups, repetitions=args.reps)
    finally:
        clean_shared(spark)


def _apart(name: str, given: dict, args: argparse.Namespace) -> dict:
    """The same in a new process, whose last line is the row."""
    words = [f"{k}={v}" for k, v in given.items()]
    command = [sys.executable, "-m", "ndgrid.bench.cli", "run", name, *words, "--json", "--cores", args.cores, "--warmups", str(args.warmups), "--reps", str(args.reps)]
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError((done.stderr.strip().splitlines() or ["no message"])[-1])
    return json.loads(done.stdout.strip().splitlines()[-1])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ndgrid.bench")
    parser.add_argument("what", choices=["list", "run", "sweep"])
    parser.add_argument("name", nargs="?")
    parser.add_argument("given", nargs="*", metavar="KEY=VALUE")
    parser.add_argument("--warmups", type=int, default=harness.WARMUPS)
    parser.add_argument("--reps", type=int, default=harness.REPETITIONS)
    parser.add_argument("--cores", default="*")
    parser.add_argument("--out", help="a file of JSON lines to append to")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--here", action="store_true")
    args = parser.parse_args(argv)
    if args.what == "list":
        print(harness.render_table([{"bench": b.name, **{k: f"{v} {list(b.sweep[k])}" if k in b.sweep else v for k, v in b.params.items()}} for b in REGISTRY.values()]))
        return 0
    if args.name not in REGISTRY:
        parser.error(f"there is no benchmark {args.name!r}; there are {', '.join(REGISTRY)}")
    bench, given = REGISTRY[args.name], dict(x.split("=", 1) for x in args.given)
    rows, failed = [], 0
    for point in [bench.resolve(given)] if args.what == "run" else bench.points(given):
        try:
            row = (_measure if args.what == "run" or args.here else _apart)(args.name, point, args)
        except Exception as e:  # one point's failure is reported, and a sweep goes on
            if args.what == "run":
                raise
            row, failed = {"bench": args.name, **point, "failed": str(e)[:200]}, failed + 1
        rows.append(row)
        if args.out:
            harness.write_jsonl(row, args.out)
    print("\n".join(map(json.dumps, rows)) if args.json else harness.render_table(rows))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
