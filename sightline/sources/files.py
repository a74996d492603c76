"""Seeds, exports and copies."""

from __future__ import annotations

import hashlib
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def seed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A typed CSV dictionary with header."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def export_parquet(df: DataFrame, folder: str, name: str, export_date: str, run_id: str, files: int | None = None) -> str:
    """Writes a table under <folder>/<name>/export_date=.../<name>_<run_id>.parquet; never overwrites.

    ``files`` = 1 gives the single file of a small mart; by default the table's own partitions stay.
    """
    path = f"{folder.rstrip('/')}/{name}/export_date={export_date}/{name}_{run_id}.parquet"
    (df if files is None else df.coalesce(files)).write.mode("errorifexists").parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """Writes a table as CSV with header; never overwrites."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def copy_once(source: Path, target: Path) -> list[str]:
    """Copies landed files that the target lacks or holds empty; existing ones stay untouched."""
    done = []
    for p in sorted(source.rglob("*.json")):
        q = target / p.relative_to(source)
        if not q.exists() or q.stat().st_size == 0:
            q.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(p, q)
            done.append(str(q.relative_to(target)))
    return done


def sha256(path: Path) -> str:
    """Digest of a file for the extract log."""
    return hashlib.sha256(path.read_bytes()).hexdigest()
