"""Makes the package importable in Python workers, wherever the session runs."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the executors once per application, and fixes the session zone.

    The archive is staged beside the driver only; executors fetch it from Spark's file server.
    """
    app = spark.sparkContext.applicationId
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    staged = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}-{app}", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(staged)
    _SHIPPED.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, preceded by :func:`ship`."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
