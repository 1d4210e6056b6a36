"""Written tables between the steps of an operator."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fieldcal.session import stored

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as each query ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go as soon as it is written.

    The table replaces the shuffle files for all later steps, so an operator of many steps needs the disk of its largest
    step and of what it has written, not of all its shuffles. Inside a ``scratch_scope`` the table goes with it, unless ``keep``.
    """
    with shuffle_files_removed(df.sparkSession):
        return stored(df, name, keep)
