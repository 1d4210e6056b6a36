"""Queries on metrics, baselines, summaries and run analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcal.catalog.registry import (
    EVENT_READINGS_SQL,
    MODEL_PREDICTIONS_SQL,
    PAIRS_SQL,
    SAMPLES_SQL,
    SCORES_SQL,
    SQL_METRICS,
    event_readings,
    lines,
    model_predictions,
    pairs,
    query,
    rounded,
    samples,
    scores,
    sql_rounded,
    table,
)
from fieldcal.models.baseline import (
    grouped_prediction,
    median_of_delta,
    median_of_target,
    offsets_with_total,
    raw_prediction,
    shifted_prediction,
)
from fieldcal.operators.eda import (
    capitalized_categories,
    correlation_matrix,
    density_by_category,
    describe,
    distinct_values,
    histogram,
    null_counts,
    score_summary,
    sign_check,
)
from fieldcal.operators.metrics import linear_scaling, metric_columns, regression_metrics
from fieldcal.operators.ordering import exact_split
from fieldcal.operators.reshape import cap_rows, union_tables
from fieldcal.plans.analysis import (
    best_model_table,
    boxplot_scores,
    capped_score_table,
    ensemble_columns,
    ensemble_quantiles,
    learning_curve,
    map_layers,
    median_scores,
    seed_quantiles,
    zone_mean_std,
)

_METRICS_SQL = ", ".join(f"round({e}, 6) AS {m}" for m, e in SQL_METRICS.items())


def _sum_back_sql(raw: str) -> str:
    e = f"((truth + {raw}) - (prediction + {raw}))"
    parts = {
        "r2": f"1 - avg(pow({e}, 2)) / var_pop(truth + {raw})", "mae": f"avg(abs({e}))", "mse": f"avg(pow({e}, 2))",
        "rmse": f"sqrt(avg(pow({e}, 2)))",
    }
    return ", ".join(f"round({x}, 6) AS {m}_sum_back" for m, x in parts.items())


@query(f"WITH {MODEL_PREDICTIONS_SQL} SELECT zone, model, count(*) AS n, {_METRICS_SQL} FROM model_predictions GROUP BY zone, model")
def regression_metric_table(spark, sf_dir):
    p = model_predictions(pairs(spark, sf_dir))
    return rounded(regression_metrics(p, "truth", "prediction", ["zone", "model"]))


@query(
    f"WITH {MODEL_PREDICTIONS_SQL} SELECT zone, count(*) AS n, {_METRICS_SQL}, {_sum_back_sql('raw')} "
    "FROM model_predictions WHERE model = 'linear' GROUP BY zone"
)
def metrics_sum_back(spark, sf_dir):
    p = model_predictions(pairs(spark, sf_dir)).where("model = 'linear'")
    return rounded(regression_metrics(p, "truth", "prediction", ["zone"], raw="raw"))


@query(
    f"""WITH {MODEL_PREDICTIONS_SQL} SELECT zone, model, round(covar_samp(truth, prediction) / (var_pop(prediction) + 1e-12), 6) AS slope,
    round(avg(truth) - covar_samp(truth, prediction) / (var_pop(prediction) + 1e-12) * avg(prediction), 6) AS intercept
    FROM model_predictions GROUP BY zone, model"""
)
def linear_rescale(spark, sf_dir):
    return rounded(linear_scaling(model_predictions(pairs(spark, sf_dir)), "truth", "prediction", ["zone", "model"]))


# ---------------------------------------------------------------- baselines


def _score_baseline(df):
    return rounded(regression_metrics(df, "truth", "prediction", ["zone", "split"]))


def _baseline_sql(offset: str) -> str:
    return (
        f"WITH {PAIRS_SQL}, o AS (SELECT {offset} AS o FROM pairs WHERE split = 'train'), "
        "scored AS (SELECT pairs.*, raw + o AS prediction FROM pairs, o) "
        f"SELECT zone, split, count(*) AS n, {_METRICS_SQL} FROM scored GROUP BY zone, split"
    )


@query(_baseline_sql("0 * max(raw)"))
def baseline_raw(spark, sf_dir):
    return _score_baseline(raw_prediction(pairs(spark, sf_dir), "raw"))


@query(_baseline_sql("median(truth)"))
def baseline_median(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return _score_baseline(shifted_prediction(p, "raw", median_of_target(p.where("split = 'train'"), "truth")))


@query(_baseline_sql("median(truth - raw)"))
def baseline_median_delta(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return _score_baseline(shifted_prediction(p, "raw", median_of_delta(p.where("split = 'train'"), "truth", "raw")))


@query(
    f"""WITH {PAIRS_SQL}, train AS (SELECT * FROM pairs WHERE split = 'train' AND l_linenumber < 5),
    g AS (SELECT l_linestatus, l_linenumber, median(truth - raw) AS o FROM train GROUP BY ALL),
    f AS (SELECT median(truth - raw) AS o FROM train),
    scored AS (SELECT pairs.*, raw + coalesce(g.o, f.o) AS prediction FROM pairs LEFT JOIN g USING (l_linestatus, l_linenumber), f)
    SELECT zone, split, count(*) AS n, {_METRICS_SQL} FROM scored GROUP BY zone, split"""
)
def unseen_group_fallback(spark, sf_dir):
    p = pairs(spark, sf_dir)
    train = p.where("split = 'train' and l_linenumber < 5")
    groups = ["l_linestatus", "l_linenumber"]
    offsets, total = offsets_with_total(train, "truth", "raw", groups)
    return _score_baseline(grouped_prediction(p, "raw", offsets, groups, total))


# ---------------------------------------------------------------- summaries


@query(
    f"""WITH {SAMPLES_SQL} SELECT method, count(*) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
    round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max,
    round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM samples GROUP BY method"""
)
def score_summary_by_group(spark, sf_dir):
    return rounded(score_summary(samples(spark, sf_dir), "value", ["method"]))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM lineitem"""
        for c in _NUMBERS
    )
)
def describe_table(spark, sf_dir):
    return rounded(describe(lines(spark, sf_dir), _NUMBERS))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS value, event_type FROM events)
    SELECT 'event_id' AS "column", 'bigint' AS type, count(*) AS rows, count(*) FILTER (event_id IS NULL) AS nulls FROM e
    UNION ALL SELECT 'value', 'double', count(*), count(*) FILTER (value IS NULL) FROM e
    UNION ALL SELECT 'event_type', 'string', count(*), count(*) FILTER (event_type IS NULL) FROM e"""
)
def null_count_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") <= 100, F.col("value")).alias("value"), "event_type"
    )
    return null_counts(e)


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        + ("1.0::DOUBLE" if a == b else f"round(corr({min(a, b)}, {max(a, b)}), 6)")
        + " AS r FROM lineitem"
        + (" HAVING count(*) > 0" if a == b else "")
        for a in _NUMBERS
        for b in _NUMBERS
    )
    + ")"
)
def correlation_table(spark, sf_dir):
    return rounded(correlation_matrix(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query(
    "WITH "
    + ", ".join(
        f"e{i} AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem), "
        f"h{i} AS (SELECT least(29, floor(({c} - lo) / (hi - lo) * 30))::INTEGER AS bin, count(*) AS n FROM lineitem, e{i} GROUP BY 1)"
        for i, c in enumerate(_NUMBERS)
    )
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", b.bin::INTEGER AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS "left", coalesce(n, 0) AS n
        FROM range(30) b(bin) LEFT JOIN h{i} USING (bin), e{i}"""
        for i, c in enumerate(_NUMBERS)
    )
)
def histogram_30(spark, sf_dir):
    return rounded(histogram(lines(spark, sf_dir), _NUMBERS, 30))


@query(
    """WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
                  FROM events GROUP BY event_type),
    g AS (SELECT event_type, n, h, greatest(lo - 3 * h, 0) AS lo, (hi + 3 * h - greatest(lo - 3 * h, 0)) / 199 AS step FROM s),
    p AS (SELECT g.*, i.grid::INTEGER AS grid, g.lo + g.step * i.grid AS x FROM g, range(200) i(grid))
    SELECT p.event_type, p.grid, round(p.x, 6) AS x,
           round(sum(exp(-pow((p.x - e.value) / p.h, 2) / 2)) / (p.n * p.h * sqrt(2 * pi())), 9) AS density
    FROM p JOIN events e USING (event_type) GROUP BY p.event_type, p.grid, p.x, p.n, p.h"""
)
def kde_by_category(spark, sf_dir):
    d = density_by_category(table(spark, sf_dir, "events"), "event_type", "value")
    return d.select("event_type", "grid", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("SELECT bool_or(s_acctbal < 0) AS s_acctbal, bool_or(s_suppkey < 0) AS s_suppkey FROM supplier")
def sign_check_table(spark, sf_dir):
    return sign_check(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_suppkey"])


@query("SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL")
def distinct_categories(spark, sf_dir):
    return distinct_values(table(spark, sf_dir, "events"), "event_type")


@query(
    """SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS "C mktsegment" FROM customer"""
)
def capitalized_header(spark, sf_dir):
    return capitalized_categories(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


# ---------------------------------------------------------------- ensembles and runs

_ROW_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice"


@query(
    f"""WITH {MODEL_PREDICTIONS_SQL}
    SELECT o_orderkey, round(quantile_cont(prediction, 0.25), 6) AS q1, round(median(prediction), 6) AS median,
           round(quantile_cont(prediction, 0.75), 6) AS q3,
           round(quantile_cont(prediction, 0.75) - quantile_cont(prediction, 0.25), 6) AS iqr
    FROM (SELECT o_orderkey, m.seed, o_totalprice / 1000 + (o_custkey * m.seed) % 17 AS prediction
          FROM orders, range(1, 31) m(seed)) GROUP BY o_orderkey"""
)
def ensemble_quantile_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    runs = o.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(30))))
    runs = runs.withColumn("prediction", F.col("o_totalprice") / 1000 + (F.col("o_custkey") * F.col("seed")) % 17)
    return rounded(ensemble_quantiles(runs, ["o_orderkey"]))


@query(
    f"""WITH {PAIRS_SQL},
    v AS (SELECT {_ROW_SQL}, l_shipdate, truth, list_sort([raw, raw * 1.1::DOUBLE - 2, raw * 0.5::DOUBLE + 13, truth * 0.7::DOUBLE + raw * 0.3::DOUBLE]) AS p FROM pairs)
    SELECT {_ROW_SQL}, l_shipdate, round(truth, 6) AS truth, round(p[2] + (p[3] - p[2]) * 0.5::DOUBLE, 6) AS median,
           round(p[1] + (p[2] - p[1]) * 0.75::DOUBLE, 6) AS q1, round(p[3] + (p[4] - p[3]) * 0.25::DOUBLE, 6) AS q3,
           round((p[3] + (p[4] - p[3]) * 0.25::DOUBLE) - (p[1] + (p[2] - p[1]) * 0.75::DOUBLE), 6) AS iqr FROM v"""
)
def ensemble_line_data(spark, sf_dir):
    raw, truth = F.col("raw"), F.col("truth")
    models = [raw, raw * 1.1 - 2.0, raw * 0.5 + 13.0, truth * 0.7 + raw * 0.3]
    line = ensemble_columns(pairs(spark, sf_dir), models)
    kept = line.select(*_ROW_SQL.split(", "), "l_shipdate", "truth", "median", "q1", "q3", "iqr")
    return rounded(kept).orderBy("l_shipdate")


@query(
    f"""WITH {SCORES_SQL} SELECT zone, model, metric, split, round(quantile_cont(score, 0.25), 6) AS q1, round(median(score), 6) AS median,
    round(quantile_cont(score, 0.75), 6) AS q3 FROM scores GROUP BY zone, model, metric, split"""
)
def seed_quantile_table(spark, sf_dir):
    """Of every zone; a zone and model together stand for the model of the library's table."""
    s = scores(spark, sf_dir)
    named = s.withColumn("model", F.concat_ws("|", "zone", "model")).drop("zone")
    parts = F.split("model", r"\|")
    return rounded(seed_quantiles(named).withColumn("zone", parts[0]).withColumn("model", parts[1]))


@query(
    f"""WITH {PAIRS_SQL}, g AS (
      SELECT seed_index, split, (l_linenumber // 2 * 400)::INTEGER AS n_train_records, avg(abs(truth - raw)) AS score FROM pairs GROUP BY ALL)
    SELECT n_train_records, split, CASE WHEN n_train_records = 0 THEN 'max' ELSE n_train_records::VARCHAR END AS label,
      round(quantile_cont(score, 0.25), 6) AS q1, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3
    FROM g GROUP BY n_train_records, split"""
)
def learning_curve_table(spark, sf_dir):
    sized = pairs(spark, sf_dir).withColumn("n_train_records", (F.floor(F.col("l_linenumber") / 2) * 400).cast("int"))
    per_run = sized.groupBy("seed_index", "split", "n_train_records").agg(
        F.avg(F.abs(F.col("truth") - F.col("raw"))).alias("score")
    )
    return rounded(learning_curve(per_run))


_MEDIANS_SQL = f"""{SCORES_SQL},
medians AS (SELECT zone, metric, model, split, round(median(score), 2) AS score FROM scores GROUP BY zone, metric, model, split)"""


@query(f"WITH {_MEDIANS_SQL} SELECT zone, metric, model, split, score FROM medians")
def median_score_table(spark, sf_dir):
    return median_scores(scores(spark, sf_dir)).select("zone", "metric", "model", "split", "score")


@query(
    f"""WITH {_MEDIANS_SQL}
    SELECT zone, metric, model, CASE model WHEN 'cocal_only' THEN 'COCAL Only' WHEN 'linear' THEN 'Linear'
           WHEN 'random_forest' THEN 'Random Forest' WHEN 'gradient_boosting' THEN 'Gradient Boosting' ELSE 'MLP' END AS label,
           score, score = CASE WHEN metric = 'r2' THEN max(score) OVER w ELSE min(score) OVER w END AS best
    FROM medians WHERE split = 'test' WINDOW w AS (PARTITION BY zone, metric)"""
)
def best_models(spark, sf_dir):
    return best_model_table(scores(spark, sf_dir))


@query(
    f"""WITH {MODEL_PREDICTIONS_SQL} SELECT zone, round(avg(raw), 4) AS raw_mean, round(stddev_pop(raw), 4) AS raw_std,
    round(avg(truth), 4) AS truth_mean, round(stddev_pop(truth), 4) AS truth_std, round(avg(prediction), 4) AS prediction_mean,
    round(stddev_pop(prediction), 4) AS prediction_std FROM model_predictions WHERE model = 'linear' GROUP BY zone"""
)
def zone_mean_std_table(spark, sf_dir):
    p = model_predictions(pairs(spark, sf_dir)).where("model = 'linear'")
    return zone_mean_std(p, ["raw", "truth", "prediction"])


@query(
    f"""WITH {SCORES_SQL} SELECT zone, model, split, array_to_string(list_transform(list(score ORDER BY seed_index), lambda s: round(s, 3)), ',') AS scores,
    round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS q1, round(median(score), 6) AS median,
    round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std
    FROM scores WHERE metric = 'mae' AND (split = 'test' OR zone = 'A') GROUP BY zone, model, split"""
)
def boxplot_data(spark, sf_dir):
    box = boxplot_scores(scores(spark, sf_dir), "A")
    return rounded(
        box.withColumn("scores", F.array_join(F.transform("scores", lambda s: F.round(s, 3).cast("string")), ","))
    )


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY md5('5|' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders),
    p AS (SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split,
                 o_totalprice / 5000 AS truth, (o_custkey % 90)::DOUBLE AS raw FROM s),
    c AS (SELECT split, CASE WHEN truth = 0 AND split = 'train' THEN 1e-8::DOUBLE ELSE truth END AS truth, raw AS prediction FROM p WHERE truth <= 60 AND raw <= 70)
    SELECT split, count(*) AS n, {_METRICS_SQL} FROM c GROUP BY split"""
)
def capped_scores(spark, sf_dir):
    from fieldcal.functions.measure import replace_zero

    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 5000).alias("truth"), (F.col("o_custkey") % 90).cast("double").alias("raw")
    )
    split = exact_split(o, ["o_orderkey"], 0.3, 5).withColumn(
        "truth", F.when(F.col("split") == "train", replace_zero(F.col("truth"))).otherwise(F.col("truth"))
    )
    return rounded(regression_metrics(cap_rows(split, "truth", 60.0, "raw", 70.0), "truth", "raw", ["split"]))


@query(
    f"""WITH {MODEL_PREDICTIONS_SQL},
    c AS (SELECT * FROM model_predictions WHERE truth <= 40 AND raw <= 35),
    w AS (SELECT model, seed_index, split, {", ".join(f"{e} AS {m}" for m, e in SQL_METRICS.items())} FROM c GROUP BY ALL),
    l AS ({" UNION ALL ".join(f"SELECT model, split, '{m}' AS metric, {m} AS score FROM w" for m in SQL_METRICS)})
    SELECT model, metric, split, round(quantile_cont(score, 0.25), 6) AS q1, round(median(score), 6) AS median,
           round(quantile_cont(score, 0.75), 6) AS q3 FROM l GROUP BY model, metric, split"""
)
def capped_score_quartiles(spark, sf_dir):
    p = model_predictions(pairs(spark, sf_dir))
    return rounded(capped_score_table(p, "truth", 40.0, "raw", 35.0))


@query(
    f"""WITH {EVENT_READINGS_SQL},
    m AS (SELECT device, radians(lon) * 6378137 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y, lon, lat, val, gps_alt FROM event_readings)
    SELECT 'points' AS layer, device, round(x, 4) AS a, round(y, 4) AS b, round(val, 4) AS c, round(gps_alt, 4) AS d FROM m
    UNION ALL SELECT 'scale', NULL, round(least(min(val), min(gps_alt)), 4), round(greatest(max(val), max(gps_alt)), 4), NULL, NULL FROM m
    UNION ALL SELECT 'boxes', device, round(x0 - dx * 0.05::DOUBLE, 4), round(x1 + dx * 0.05::DOUBLE, 4), round(y0 - dy * 0.05::DOUBLE, 4), round(y1 + dy * 0.05::DOUBLE, 4)
      FROM (SELECT device, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, coalesce(nullif(max(x) - min(x), 0), 1) AS dx,
            coalesce(nullif(max(y) - min(y), 0), 1) AS dy FROM m GROUP BY device)
    UNION ALL SELECT 'hull box', device, round(min(x), 4), round(min(y), 4), round(max(x), 4), round(max(y), 4) FROM m GROUP BY device"""
)
def map_points(spark, sf_dir):
    """All four layers in one table; of the hulls the box, which must be that of their points."""
    layers = map_layers(event_readings(spark, sf_dir), "device", "lon", "lat", ["val", "gps_alt"])

    def layer(df, name, device, *cells):
        values = [(F.lit(None).cast("double") if c is None else F.col(c).cast("double")).alias(n) for c, n in zip(cells, "abcd")]
        return df.select(F.lit(name).alias("layer"), device.alias("device"), *values)

    box = layers["hulls"].groupBy("device").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    scale, boxes = layers["scale"], layers["boxes"]
    no_device = F.lit(None).cast("string")
    parts = [
        layer(layers["points"], "points", F.col("device"), "x", "y", "val", "gps_alt"),
        layer(scale, "scale", no_device, *scale.columns[:2], None, None),
        layer(boxes, "boxes", F.col("device"), "x_min", "x_max", "y_min", "y_max"),
        layer(box, "hull box", F.col("device"), "x0", "y0", "x1", "y1"),
    ]
    return rounded(union_tables(parts), 4)


_STATISTICS = {
    "count": "count({c})::DOUBLE", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})::DOUBLE",
    "q1": "quantile_cont({c}::DOUBLE, 0.25)", "median": "quantile_cont({c}::DOUBLE, 0.5)", "q3": "quantile_cont({c}::DOUBLE, 0.75)",
    "max": "max({c})::DOUBLE",
}


def _report_sql() -> str:
    def part(report, column, statistic, value, rest=""):
        return f"SELECT '{report}' AS report, {column} AS \"column\", {statistic} AS statistic, round({value}, 6) AS value FROM lineitem {rest}"

    parts = [part("describe", f"'{c}'", f"'{n}'", e.format(c=c)) for c in _NUMBERS for n, e in _STATISTICS.items()]
    parts += [part("signs", f"'{c}'", "'negative'", f"bool_or({c} < 0)::INTEGER::DOUBLE") for c in _NUMBERS]
    parts += [part("correlation", f"'{a}'", f"'{b}'", "1.0::DOUBLE" if a == b else f"corr({a}, {b})", "GROUP BY ()") for a in _NUMBERS for b in _NUMBERS]
    parts += [part("nulls", f"'{c}'", "'nulls'", f"count(*) FILTER ({c} IS NULL)::DOUBLE") for c in _NUMBERS]
    for c in _NUMBERS:
        counted = (
            f"(SELECT least(29, floor(({c} - lo) / (hi - lo) * 30))::INTEGER AS bin, count(*) AS n FROM lineitem, "
            f"(SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem) GROUP BY 1)"
        )
        parts.append(
            f"SELECT 'histogram', '{c}', 'bin ' || b.bin, coalesce(n, 0)::DOUBLE FROM range(30) b(bin) LEFT JOIN {counted} h ON h.bin = b.bin"
        )
    return " UNION ALL ".join(parts)


@query(_report_sql())
def eda_report_rows(spark, sf_dir):
    """Every row of the report's tables, but for the density, which has a query of its own."""
    from fieldcal.operators.eda import eda_report

    report = eda_report(lines(spark, sf_dir), _NUMBERS)

    def long(name, column, statistic, value, df=None):
        df = report[name] if df is None else df
        return df.select(F.lit(name).alias("report"), column.alias("column"), statistic.alias("statistic"), value.cast("double").alias("value"))

    described = report["describe"].withColumn("count", F.col("count").cast("double"))
    described = described.unpivot(["column"], [c for c in described.columns if c != "column"], "statistic", "value")
    signs = report["signs"].unpivot([], list(_NUMBERS), "column", "negative")
    nulls = report["nulls"].where(F.col("column").isin(list(_NUMBERS)))
    rows = [
        long("describe", F.col("column"), F.col("statistic"), F.col("value"), described),
        long("signs", F.col("column"), F.lit("negative"), F.col("negative").cast("int"), signs),
        long("correlation", F.col("column_a"), F.col("column_b"), F.col("r")),
        long("nulls", F.col("column"), F.lit("nulls"), F.col("nulls"), nulls),
        long("histogram", F.col("column"), F.concat(F.lit("bin "), F.col("bin")), F.col("n")),
    ]
    return rounded(union_tables(rows))
