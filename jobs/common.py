"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, read by Spark so that it may lie anywhere; keys that it leaves out are not there."""
    row = spark.read.option("multiLine", True).json(path).first()
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None} if row else {}


def main(name: str, about: str, paths: dict[str, str], run: Callable[..., dict], args: list[str] | None = None) -> int:
    """Parses the paths and the configuration, and makes and stops the session: only command lines do."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("config", help="JSON file of settings")
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    asked = vars(parser.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **{p: asked[p] for p in paths}, **settings(spark, asked["config"]))
    finally:
        spark.stop()
    return 0
