"""Sessions, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", **conf) -> SparkSession:
    """A session with the settings that the library expects; a cluster's own settings win."""
    builder = SparkSession.builder.appName(name)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir`` of the session; a folder of this machine is
    set only where that is unset and the session runs on this machine alone, as
    in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return named or context.getCheckpointDir().rsplit("/", 1)[0]


def new_folder(spark: SparkSession, kind: str) -> str:
    """Path of a folder below the shared one that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df``, computed once and read back from Parquet files in the shared folder: less to write than ``cut``, and only the columns in use are read."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in several parts for each core: reading a page takes far longer than moving it, and few bytes may hold many pages."""
    conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
    return df.repartition(max(4 * context.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions", "200"))), *by)


def free_name(df: DataFrame, kind: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while kind.lower() in taken:
        kind += "_"
    return kind
