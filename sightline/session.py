"""Session factory and the few helpers every operator needs from a session."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sightline", cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", master: str | None = None, shared: str | None = None) -> SparkSession:
    """Session with the settings the engine expects (UTC, ANSI, AQE).

    ``shared`` is the folder that all executors see. Outside local mode it is required, unless
    the cluster's configuration already names ``spark.checkpoint.dir``.
    """
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master)
    if shared or master.startswith("local["):
        builder = builder.config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="sightline-"))
    session = (
        builder
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    shared_dir(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A session in local mode that names none gets a private folder (its executor is the driver);
    anywhere else a missing setting is an error, never a folder of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"sightline-{spark.sparkContext.applicationId}")


_WRITTEN: dict[str, list[str]] = {}


def cut_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Materialise a frame that is read more than once, as a Parquet table in the shared folder.

    The lineage is cut, so a lost executor costs a read, not a recomputation; columns stay
    prunable. The table is deleted when the application ends, or by :func:`drop_tables`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(drop_tables, spark)
    _WRITTEN[app].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut_table` wrote for this application; results that read them must be written before."""
    if spark.sparkContext._jsc is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def small_list(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a reference list on the driver; one of more than ``most`` rows is an error, never cut."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound or join it as a table")
    return rows


def bounded_broadcast(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast hint only after the row count is proven to be within the bound.

    Beyond the bound the frame is returned as it is and Spark shuffles the join.
    """
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).take(max_rows + 1)) <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan yields fewer partitions than that; else untouched.

    For operators whose work per row outweighs moving it: a small or badly written file would
    otherwise be one task. Large inputs have more splits than cores and aren't shuffled. Only
    for plain scans: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
