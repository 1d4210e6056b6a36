"""Session helpers: the shared checkpoint folder, written tables and their lifetime, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a folder of its own; on a cluster a
    machine-local folder would not survive the loss of an executor, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldcal-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Size of the row groups of written tables, the smallest part that a task can read.
ROW_GROUP_BYTES = 4 << 20
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scratch scopes", default=())


def _remove(spark: SparkSession, paths: Sequence[str]) -> None:
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(configuration).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables ``stored`` inside are removed at the end, but those stored with ``keep``.

    For operators of several steps: what the returned DataFrame reads is kept, the steps before it are not. Kept tables belong
    to the scope around this one, if there is one.
    """
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        _remove(spark, paths)


def stored(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    For tables that many passes read, such as training rows: later passes scan only the
    columns they need and never repeat the work before, also after an executor was lost.
    The table goes with the ``scratch_scope`` around it, with ``keep`` with the one around that. Its row groups are small, so that
    a table written by few tasks is read by many.
    """
    path = scratch_path(df.sparkSession, name)
    scopes = _SCOPES.get()[:-1] if keep else _SCOPES.get()
    if scopes:
        scopes[-1].append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_lookup(
    big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", max_rows: int = 20_000
) -> DataFrame:
    """Join a per-key lookup table, broadcast only when its row count has been checked.

    The lookup is fetched once with a limit of ``max_rows + 1``. When it fits it becomes a
    local table and is broadcast; otherwise the plain join is planned and adaptive
    execution splits skewed keys.
    """
    rows = lookup.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        local = big.sparkSession.createDataFrame(rows, lookup.schema)
        return big.join(F.broadcast(local), list(on), how)
    return big.join(lookup, list(on), how)
