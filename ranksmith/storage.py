"""Shared storage for checkpoints, fitted models and copies of tables.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
local session that names none gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

# Temporary folders of local sessions, by application.
_local: dict[str, str] = {}

# Where copies go while a job owns them.
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; the context is left as it is."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="ranksmith-")
    return _local[context.applicationId]


def checkpoint_dir(spark: SparkSession) -> str:
    """The same folder, set on the context if none was: for training, which cuts its lineage there."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the checkpoint folder, or in its owner's part of that."""
    return f"{_owner.get() or _scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ranksmith"


@contextmanager
def owned(spark: SparkSession, label: str) -> Iterator[str]:
    """Put all copies made inside into one folder, which is yielded. Its owner removes it when done.

    When the body fails, nobody will own the copies, so they go at once.
    """
    folder = f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    token = _owner.set(folder)
    try:
        yield folder
    except BaseException:
        remove(spark, folder)
        raise
    finally:
        _owner.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every copy this application wrote. Tables and models built on them end here."""
    remove(spark, _scratch_root(spark))


def written(table: DataFrame, label: str, by: str | None = None, path: str | None = None) -> DataFrame:
    """The table as a parquet copy in the shared folder.

    Later steps read the copy: the work behind it is neither planned nor run again, also
    not after an executor is lost. With ``by``, readers of one value skip the other values' files.
    """
    spark = table.sparkSession
    path = path or scratch_path(spark, label)
    writer = table.write if by is None else table.hint("rebalance", by).write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(table.schema).parquet(path).select(*[F.col(f"`{c}`") for c in table.columns])
