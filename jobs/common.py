"""What the jobs share: config files, logs, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(defaults: dict, path: str | None) -> dict:
    """``defaults`` with what a JSON file sets; names it does not know are refused."""
    found = {}
    if path:
        with open(path) as f:
            found = json.load(f)
    unknown = sorted(set(found) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return {**defaults, **found}


def beside(file: str) -> str:
    """The config file that lies beside a job's module."""
    return os.path.splitext(os.path.abspath(file))[0] + ".json"


def command_line(about: str, paths: list[str], config: str, job: Callable) -> int:
    """Read paths and config from the command line, run the job in a session of its own, print its counts as JSON."""
    parser = argparse.ArgumentParser(description=about)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=config)
    parser.add_argument("--verbose", action="store_true")
    args = parser.parse_args()
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(about).getOrCreate()
    try:
        print(json.dumps(job(spark, *[getattr(args, n) for n in paths], config=args.config)))
    finally:
        spark.stop()
    return 0
