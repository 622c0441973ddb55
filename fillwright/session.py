"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fillwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting switched on.

    ``spark.sql.shuffle.partitions`` is left alone: on a cluster give a large
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` and let AQE
    merge the small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only when the session runs in local mode and
    names none; on a cluster the setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        # local-cluster has executors with folders of their own, as a cluster has
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fillwright-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


# The paths stored since the innermost ``stored_tables_dropped`` began.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote below the shared one."""
    if not path.startswith(scratch_dir(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def stored_tables_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables that operators stored inside it.

    Results made inside still read from those tables: write them inside as well.
    Also an error ends the block; a session that dies leaves its tables.
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in owned:
            drop_folder(spark, path)


def write_through(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage, so values that depend on how a scan was split (row
    positions) are fixed once and a lost executor cannot change them. Parquet
    rather than ``checkpoint()`` because a second pass then reads only the
    columns it needs. The table stays until ``stored_tables_dropped`` ends, if
    one is open, and else for the cluster's own clean-up.
    """
    path = f"{scratch_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
