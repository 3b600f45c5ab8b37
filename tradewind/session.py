"""Session helpers: a tuned session for local use, the shared work folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}
_LOCAL_BASE: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "tradewind", partitions: int = 8) -> SparkSession:
    """A local session with the settings every query relies on (UTC, AQE, skew join)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (as in tests) falls back to a fresh folder of this machine; on
    a cluster, where executors could not see it, the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="tradewind-")
    return _LOCAL_BASE[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path no earlier run has used, so write-once sinks never collide."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tradewind/{app}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, key: str, build) -> DataFrame:
    """A stage table shared by several queries of one application.

    ``build`` runs once per application and ``key``; later callers scan the written table, the way
    a scheduled job would read the output of the stage before it.
    """
    slot = (spark.sparkContext.applicationId, key)
    if slot in _STAGED:
        try:
            return spark.read.parquet(_STAGED[slot])
        except AnalysisException:
            # The shared folder was cleaned between two queries: build the stage again.
            del _STAGED[slot]
    path = fresh_path(spark, "stage")
    build().write.mode("errorifexists").parquet(path)
    _STAGED[slot] = path
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a table stored in fewer splits than there are cores one task per core; any other is left alone.

    Spark cuts a table of any size up to cores x 128 MB into about as many splits as there are cores, so asking
    for more would shuffle all of it for nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
