"""Whole experiments: two runs of a plan, one of which fails, read back from the files they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcal.catalog.registry import LINE_KEY, pairs, query, rounded, table
from fieldcal.operators.ranktests import contingency_counts
from fieldcal.operators.reshape import union_tables
from fieldcal.plans.experiment import run_experiment
from fieldcal.plans.scoring import score_file
from fieldcal.session import scratch_path, stored
from fieldcal.sources.files import read_lines, seed_table, write_csv
from fieldcal.sources.results import flatten_results, read_results

_ZONES = ["A", "N", "R"]
#: What each guard says.
_GUARD_WORDS = {
    "existing target": "already exists", "negative distance": "must be a non-negative number", "empty source": "no CSV rows found",
    "outcome not 0 or 1": "non-binary values",
}
_GOOD, _BAD = "model;linear;seed_index;3", "model;linear;seed_index;999"
_PARTS = [("r2", "1 - avg(pow(truth - prediction, 2)) / var_pop({t})"), ("mae", "avg(abs(truth - prediction))"),
          ("mse", "avg(pow(truth - prediction, 2))"), ("rmse", "sqrt(avg(pow(truth - prediction, 2)))")]


def _scores_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT 'score' AS part, zone || '|{m}|' || split || '_score{end}' AS name, round({e.format(t=t)}, 6) AS value FROM s GROUP BY zone, split"
        for m, e in _PARTS
        for end, t in (("", "truth"), ("_sum_cocal", "truth + raw"))
    )


@query(
    f"""WITH seeds AS (SELECT n_nationkey * 1000 + 7 AS seed, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation),
    p AS (SELECT *, l_extendedprice / 2003 AS truth, l_quantity AS raw, l_returnflag AS zone,
          md5((SELECT seed FROM seeds WHERE i = 3) || '|' || {" || '|' || ".join(LINE_KEY)}) AS key FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY key) AS r, count(*) OVER (PARTITION BY zone) AS n FROM p),
    parts AS (SELECT *, CASE WHEN zone <> 'A' OR r <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k),
    f AS (SELECT regr_slope(truth, raw) AS a, regr_intercept(truth, raw) AS b FROM parts WHERE split = 'train'),
    s AS (SELECT parts.*, a * raw + b AS prediction FROM parts, f)
    {_scores_sql()}
    UNION ALL SELECT 'seed', '3', seed::DOUBLE FROM seeds WHERE i = 3
    UNION ALL SELECT 'minutes known', 'plan', 1 UNION ALL SELECT 'data', 'lines.csv', NULL UNION ALL SELECT 'timestamps', 'times.csv', NULL
    UNION ALL SELECT 'feature', 'raw', NULL
    UNION ALL SELECT 'ledger', '{_GOOD}', NULL FROM range(2) UNION ALL SELECT 'failure', '{_BAD}', NULL"""
)
def experiment_trace(spark, sf_dir):
    """Records, ledger and failures of three runs: one, the same again, and one that asks for a seed the list does not have.

    The run done twice has two ledger lines and one record.
    """
    out, seed_file = scratch_path(spark, "experiment"), scratch_path(spark, "seeds")
    numbers = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 1000 + 7).cast("string").alias("value"))
    numbers.orderBy("n_nationkey").select("value").coalesce(1).write.text(seed_file)
    seeds = seed_table(read_lines(spark, seed_file))
    rows = stored(pairs(spark, sf_dir).select(*LINE_KEY, "truth", "raw", "zone"), "training")
    options = {"model": "linear", "target": "truth", "numeric": ["raw"], "key": LINE_KEY, "scaling": "robust"}
    for line, index in ((_GOOD, 3), (_GOOD, 3), (_BAD, 999)):
        run_experiment(
            line, rows, "A", options, seeds, index, LINE_KEY, out, "plan", zone_names=_ZONES, keys={"scaling": "robust"}, data="lines.csv",
            timestamps="times.csv",
        )
    records = read_results(spark, f"{out}/results", _ZONES, multi_line=False)
    scores = flatten_results(records, _ZONES).where("score is not null")
    nothing = F.lit(None).cast("double")
    found = [
        scores.select(F.lit("score").alias("part"), F.concat_ws("|", "zone", "metric", "kind").alias("name"), F.col("score").alias("value")),
        records.select(F.lit("seed").alias("part"), F.col("seed_index").cast("string").alias("name"), F.col("seed").cast("double").alias("value")),
        records.select(F.lit("minutes known").alias("part"), F.col("run_id").alias("name"), (F.col("execution_time_in_minutes") > 0).cast("double").alias("value")),
        records.select(F.lit("feature").alias("part"), F.explode("selected_features").alias("name"), nothing.alias("value")),
        *[records.select(F.lit(c).alias("part"), F.col(c).alias("name"), nothing.alias("value")) for c in ("data", "timestamps")],
        read_lines(spark, f"{out}/completed_plan").select(F.lit("ledger").alias("part"), F.col("value").alias("name"), nothing.alias("value")),
        spark.read.json(f"{out}/failures").select(F.lit("failure").alias("part"), F.col("arguments").alias("name"), nothing.alias("value")),
    ]
    return rounded(union_tables(found))


@query(
    """SELECT * FROM (VALUES ('existing target', 'already exists'), ('negative distance', 'must be a non-negative number'),
      ('empty source', 'no CSV rows found'), ('outcome not 0 or 1', 'non-binary values')) g(guard, message), (SELECT count(*) AS regions FROM region), (SELECT count(*) AS labels FROM labels)"""
)
def guards_raise(spark, sf_dir):
    """Every guard on inputs and outputs fails with its own words; the counts say which rows it was tried on."""
    regions, labels = table(spark, sf_dir, "region"), table(spark, sf_dir, "labels")
    taken, empty = scratch_path(spark, "taken"), scratch_path(spark, "empty")
    write_csv(regions, taken)
    regions.limit(0).write.csv(empty, header=True)
    tests = {
        "existing target": lambda: write_csv(regions, taken),
        "negative distance": lambda: score_file(spark, taken, f"{taken}-out", -1.0),
        "empty source": lambda: score_file(spark, empty, f"{empty}-out", 1.0),
        "outcome not 0 or 1": lambda: contingency_counts(
            labels.select((F.col("quality") + 2).alias("x"), F.lit("a").alias("g")), "x", "g", "a", "b"
        ).collect(),
    }

    def told(action, words: str) -> str:
        """The words, if the action fails with them; else what it failed with."""
        try:
            action()
        except Exception as error:
            return words if words in str(error) else str(error)[:200]
        return "nothing"

    rows = [(name, told(action, _GUARD_WORDS[name])) for name, action in tests.items()]
    counts = {"regions": F.lit(regions.count()), "labels": F.lit(labels.count())}
    return spark.createDataFrame(rows, "guard string, message string").withColumns({k: c.cast("long") for k, c in counts.items()})
