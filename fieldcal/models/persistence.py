"""Readers and writers by which the calibration estimator and its models live in ML pipelines and validators.

Both keep the metadata of every ML stage (class, uid, params) next to what is theirs: the estimator its options,
the model its featurizer, its fitted part and one JSON line.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import SparkSession


class StageWriter(MLWriter):
    """Writes the metadata of a stage with its ``options``, then what ``parts(path, spark)`` writes.

    A path that exists is an error, unless ``overwrite()`` was called; then nothing of the old stage stays.
    """

    def __init__(self, stage: Any, options: dict[str, Any] | None = None, parts: Any = None):
        super().__init__()
        self.stage, self.options, self.parts = stage, options or {}, parts

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata={"options": self.options})
        if self.parts is not None:
            self.parts(path, spark)


class StageReader(MLReader):
    """Makes a stage by ``make(options, path, spark)`` and gives it the uid and the params it was written with."""

    def __init__(self, make: Any):
        super().__init__()
        self.make = make

    def load(self, path: str) -> Any:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.make(metadata["options"], path, spark)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage
