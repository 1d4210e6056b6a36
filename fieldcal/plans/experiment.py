"""One experiment from its run line to its record: seed, training, scores, model, ledger, failures."""

from __future__ import annotations

import time
import traceback
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.models.training import CalibrationEstimator, CalibrationModel, train_zones
from fieldcal.operators.metrics import METRICS
from fieldcal.sources.files import append_ledger, seed_at
from fieldcal.sources.results import failure_log, nest_results, write_results


@dataclass
class Outcome:
    """What a run leaves behind: scores by zone and split, settings tried with their errors, and the model."""

    scores: DataFrame
    tried: list[tuple[dict[str, Any], float]]
    model: CalibrationModel


def run_experiment(
    line: str, zones: DataFrame, main_zone: str, options: Mapping[str, Any], seeds: DataFrame, seed_index: int, key: Sequence[str],
    out: str, run_id: str, zone: str = "zone", zone_names: Sequence[str] = (), keys: Mapping[str, str] | None = None,
    data: str | None = None, timestamps: str | None = None, **training: Any,
) -> Outcome | None:
    """Run one line of an experiment plan and write its traces below ``out``.

    ``options`` are those of :class:`CalibrationEstimator`, without the seed, which is entry ``seed_index`` of the seed
    list. A run that ends well leaves a nested score record (``results``, in folders by ``keys``, run and seed), its model and a
    ledger line; one that fails leaves a row in ``failures`` and returns None, so that other runs go on. The same run again
    replaces its record and model. ``data`` and ``timestamps`` name the files that ``zones`` came from, for the record.
    """
    spark = zones.sparkSession
    try:
        estimator = CalibrationEstimator(**options, seed=seed_at(seeds, seed_index))
        start = time.monotonic()
        model, tried, scores = train_zones(zones, main_zone, estimator, key, zone=zone, **training)
        model.save(f"{out}/models/{run_id}/{seed_index}", spark)
        minutes = (time.monotonic() - start) / 60
        metric = F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"), F.col(f"{m}_sum_back").alias("score_sum_cocal")) for m in METRICS
        ]))
        long = scores.select(F.col(zone).alias("zone"), "split", metric)
        wide = long.groupBy("zone", "metric").pivot("split", ["train", "test"]).agg(
            *[F.first(c).alias(c) for c in ("score", "score_sum_cocal")]
        )
        record = nest_results(wide.withColumn("run_id", F.lit(run_id)), list(zone_names), ["run_id"]).withColumns(
            {
                "seed": F.lit(estimator.seed), "seed_index": F.lit(seed_index), "execution_time_in_minutes": F.lit(minutes),
                "selected_features": F.array(*[F.lit(c) for c in [*estimator.categorical, *estimator.numeric]]),
                "data": F.lit(data).cast("string"), "timestamps": F.lit(timestamps).cast("string"),
                **{name: F.lit(value) for name, value in (keys or {}).items()},
            }
        )
        write_results(record, f"{out}/results", list(keys or {}))
        append_ledger(spark.createDataFrame([(line,)], "value string").coalesce(1), f"{out}/completed_{run_id}")
        return Outcome(scores, tried, model)
    except Exception:
        failed = spark.createDataFrame([(line, traceback.format_exc())], "arguments string, error string").coalesce(1)
        failure_log(failed, "arguments", "error").write.mode("append").json(f"{out}/failures")
        return None
