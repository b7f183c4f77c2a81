"""What both jobs share: settings, the command line, reading a table that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def settings(name: str, path: str | None = None) -> dict:
    """The settings beside the job's module, or those of another file; a name that the job doesn't know is an error."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if path:
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - set(own):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        own |= given
    return own


def there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table of that path, or None if nothing has been written to it yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def main(name: str, run: Callable[..., dict], paths: dict[str, str]) -> None:
    """Runs the job with the paths of the command line, in a session that only this starts and ends."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="a JSON file with settings that differ from those beside the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **{path: getattr(args, path) for path in paths}, config=settings(name, args.config))
    finally:
        spark.stop()
