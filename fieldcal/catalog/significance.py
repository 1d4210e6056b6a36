"""Queries on rank-based and contingency tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcal.catalog.registry import (
    MODELS,
    PAIRS_SQL,
    SAMPLES_SQL,
    SCORES_SQL,
    pairs,
    query,
    rounded,
    samples,
    scores,
    table,
)
from fieldcal.operators.ranktests import (
    chi_square_2x2,
    contingency_counts,
    fisher_2x2,
    holm_winners,
    kruskal_wallis,
    mann_whitney_pairs,
    sample_names,
    wilcoxon_signed_rank,
)
from fieldcal.plans.analysis import significance_marks, zone_comparison

def _normal_tail_sql(z: str) -> str:
    """P(Z > z) by Simpson's rule over the next 12 deviations."""
    return (
        f"(SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({z} + i * 0.003::DOUBLE, 2) / 2))"
        " * 0.001::DOUBLE / sqrt(2 * pi()) FROM range(4001) r(i))"
    )


# Critical values of the normal law for 0.05/1, 0.05/2, 0.05/3, 0.05/4, one-sided.
_Z = [1.6448536269514722, 1.9599639845400545, 2.128045234184984, 2.241402727604947]


@query(
    f"""WITH {SAMPLES_SQL},
    r AS (SELECT zone, method, value, rank() OVER (PARTITION BY zone ORDER BY value) AS r, count(*) OVER (PARTITION BY zone, value) AS t,
                 count(*) OVER (PARTITION BY zone) AS n FROM samples),
    m AS (SELECT zone, method, any_value(n) AS n, count(*) AS k, avg(r + (t - 1) / 2) AS mean_rank, sum((t * t - 1)::DOUBLE) AS tie FROM r GROUP BY zone, method),
    h AS (SELECT zone, any_value(n) AS n, 12 / (any_value(n)::DOUBLE * (any_value(n) + 1)) * sum(k * pow(mean_rank - (n + 1) / 2, 2)) AS h,
                 sum(tie) AS tie, count(*) AS k FROM m GROUP BY zone)
    SELECT zone, n, round(h / (1 - tie / (pow(n, 3) - n)), 6) AS h, (k - 1)::INTEGER AS df,
           round(exp(-h / (1 - tie / (pow(n, 3) - n)) / 2) * (1 + h / (1 - tie / (pow(n, 3) - n)) / 2), 6) AS p_value,
           h / (1 - tie / (pow(n, 3) - n)) > 9.487729036781154 AS significant FROM h"""
)
def kruskal_h(spark, sf_dir):
    return rounded(kruskal_wallis(samples(spark, sf_dir), "value", "method", _priorities(spark, sf_dir), keys=["zone"]))


def _priorities(spark, sf_dir):
    return sample_names(table(spark, sf_dir, "orders"), "o_orderpriority")


def _pairs_sql(source: str, extra: str) -> str:
    """All ordered pairs: rank sum of the first sample inside the joined pair."""
    return f"""{extra},
    names AS (SELECT DISTINCT zone, method FROM {source}),
    joined AS (SELECT a.zone, a.method, b.method AS other, s.method AS own, s.value
               FROM names a JOIN names b ON a.zone = b.zone AND a.method <> b.method
               JOIN {source} s ON s.zone = a.zone AND s.method IN (a.method, b.method)),
    ranked AS (SELECT *, rank() OVER p + (count(*) OVER (PARTITION BY zone, method, other, value) - 1) / 2 AS r,
               count(*) OVER (PARTITION BY zone, method, other, value) AS t FROM joined
               WINDOW p AS (PARTITION BY zone, method, other ORDER BY value)),
    sums AS (SELECT zone, method, other, (count(*) FILTER (own = method))::DOUBLE AS n1, (count(*) FILTER (own = other))::DOUBLE AS n2,
             sum(r) FILTER (own = method) AS r1, sum((t * t - 1)::DOUBLE) AS tie FROM ranked GROUP BY zone, method, other),
    us AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM sums)"""


_SPREAD = "sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1))))"


@query(
    f"""WITH {_pairs_sql("samples", SAMPLES_SQL)}
    SELECT zone, method, other, n1, n2, round(u1, 1) AS u1, round(greatest(u1, n1 * n2 - u1), 1) AS u,
           round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / {_SPREAD}, 6) AS z,
           round(least(1, 2 * {_normal_tail_sql(f"(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / {_SPREAD}")}), 6) AS p_value,
           (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / {_SPREAD} > 1.959963984540054 AS significant FROM us"""
)
def mannwhitney_u(spark, sf_dir):
    p = mann_whitney_pairs(samples(spark, sf_dir), "value", "method", _priorities(spark, sf_dir), keys=["zone"])
    return p.select(
        "zone", "method", "other", "n1", "n2", F.round("u1", 1).alias("u1"), F.round("u", 1).alias("u"),
        F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), "significant",
    )


def _holm_sql(source: str, extra: str) -> str:
    critical = "CASE partners - i + 1 " + " ".join(f"WHEN {j} THEN {z}::DOUBLE" for j, z in enumerate(_Z, 1)) + " END"
    return f"""{_pairs_sql(source, extra)},
    zs AS (SELECT *, (n1 * n2 - u1 - n1 * n2 / 2 - 0.5) / {_SPREAD} AS z FROM us),
    stepped AS (SELECT *, row_number() OVER (PARTITION BY zone, method ORDER BY z DESC) AS i,
                count(*) OVER (PARTITION BY zone, method) AS partners FROM zs),
    winners AS (SELECT zone, method, max(partners) AS partners, bool_and(z >= {critical}) AS holm, bool_or(z > {_Z[0]}) AS any_significant
                FROM stepped GROUP BY zone, method)"""


@query(f"WITH {_holm_sql('samples', SAMPLES_SQL)} SELECT zone, method, partners, holm, any_significant FROM winners")
def holm_matrix(spark, sf_dir):
    p = mann_whitney_pairs(samples(spark, sf_dir), "value", "method", _priorities(spark, sf_dir), "less", ["zone"])
    return holm_winners(p, ["zone"]).drop("method_order")


_MAE_SQL = f"{SCORES_SQL}, mae AS (SELECT zone, model AS method, score AS value FROM scores WHERE metric = 'mae' AND split = 'test')"


@query(
    f"""WITH {_holm_sql('mae', _MAE_SQL)},
    firsts AS (SELECT zone, arg_min(method, list_position({MODELS!r}, method)) AS method FROM winners WHERE holm GROUP BY zone)
    SELECT w.zone, w.method AS model, holm, holm OR any_significant AS marked, w.method IS NOT DISTINCT FROM f.method AS first_holm
    FROM winners w LEFT JOIN firsts f USING (zone)"""
)
def boxplot_marks(spark, sf_dir):
    return significance_marks(scores(spark, sf_dir), MODELS)


def _signed_sql(source: str, keys: str) -> str:
    return f"""
    d AS (SELECT {keys}, x - y AS d FROM {source} WHERE x - y <> 0),
    r AS (SELECT {keys}, d, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2 AS r,
          count(*) OVER (PARTITION BY {keys}, abs(d)) AS t FROM d),
    s AS (SELECT {keys}, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS t_plus, coalesce(sum(r) FILTER (d < 0), 0) AS t_minus,
          sum((t * t - 1)::DOUBLE) AS tie FROM r GROUP BY {keys}),
    z AS (SELECT *, (t_plus - n::DOUBLE * (n + 1) / 4) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - tie / 2) / 24) AS z FROM s)
    SELECT {keys}, n, t_plus, least(t_plus, t_minus) AS statistic, round(z, 6) AS z,
           round(least(1, 2 * {_normal_tail_sql("abs(z)")}), 6) AS p_value, abs(z) > 1.959963984540054 AS significant FROM z"""


@query(f"WITH {PAIRS_SQL}, v AS (SELECT zone, truth AS x, raw AS y FROM pairs), {_signed_sql('v', 'zone')}")
def wilcoxon_signed(spark, sf_dir):
    return rounded(wilcoxon_signed_rank(pairs(spark, sf_dir), "truth", "raw", ["zone"]))


@query(
    f"""WITH {PAIRS_SQL}, v AS (
      SELECT zone, 'raw' AS first, 'truth' AS second, raw AS x, truth AS y FROM pairs
      UNION ALL SELECT zone, 'truth', 'model', truth, raw * 0.5::DOUBLE + 13 FROM pairs
      UNION ALL SELECT zone, 'raw', 'model', raw, raw * 0.5::DOUBLE + 13 FROM pairs), {_signed_sql('v', 'zone, first, second')}"""
)
def zone_comparison_tests(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("model", F.col("raw") * 0.5 + 13.0)
    return rounded(zone_comparison(p, "raw", "truth", "model"))


def _outcomes(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lab.join(d.select("doc_id", "lang"), "doc_id").select(
        F.when(F.col("lang") == "en", "en").otherwise("other").alias("group"), "quality", "toxic"
    )


_COUNTS_SQL = """
c AS (SELECT (count(*) FILTER (lang = 'en' AND {x} = 1)) AS s_a, (count(*) FILTER (lang = 'en' AND {x} = 0)) AS f_a,
             (count(*) FILTER (lang <> 'en' AND {x} = 1)) AS s_b, (count(*) FILTER (lang <> 'en' AND {x} = 0)) AS f_b
      FROM labels JOIN documents USING (doc_id)),
n AS (SELECT *, (s_a + f_a + s_b + f_b)::DOUBLE AS n FROM c)"""


@query(
    f"""WITH {_COUNTS_SQL.format(x="quality")},
    t AS (SELECT *, pow(n, 3) * pow(greatest(abs(s_a::DOUBLE * f_b - f_a::DOUBLE * s_b) / n - 0.5, 0), 2)
      / ((s_a + f_a)::DOUBLE * (s_b + f_b) * (s_a + s_b) * (f_a + f_b)) AS x FROM n)
    SELECT s_a, f_a, s_b, f_b, round(x, 6) AS chi2, round(2 * {_normal_tail_sql("sqrt(x)")}, 6) AS p_value, x > 3.841458820694124 AS significant,
           x > 3.841458820694124 AND s_a / (s_a + f_a) > s_b / (s_b + f_b) AS first_better FROM t"""
)
def chi2_2x2(spark, sf_dir):
    counts = contingency_counts(_outcomes(spark, sf_dir), "quality", "group", "en", "other")
    return rounded(chi_square_2x2(counts))


_LOG_P = "lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma({x} + 1) - lgamma(r - {x} + 1) - lgamma(k - {x} + 1) - lgamma(n - r - k + {x} + 1)"


@query(
    f"""WITH {_COUNTS_SQL.format(x="toxic")},
    m AS (SELECT *, (s_a + f_a)::DOUBLE AS r, (s_a + s_b)::DOUBLE AS k FROM n),
    p AS (SELECT m.*, {_LOG_P.format(x="i.x")} AS lp, {_LOG_P.format(x="s_a")} AS seen
          FROM m, range(0, (SELECT greatest(s_a + f_a, s_a + s_b) + 1 FROM c)) i(x)
          WHERE i.x <= r AND i.x <= k AND i.x >= r + k - n),
    q AS (SELECT s_a, f_a, s_b, f_b, sum(exp(lp)) FILTER (lp <= seen + 1e-7) AS p FROM p GROUP BY ALL)
    SELECT s_a, f_a, s_b, f_b, round(p, 6) AS p_value, p < 0.05 AS significant,
           p < 0.05 AND s_a / (s_a + f_a) > s_b / (s_b + f_b) AS first_better FROM q"""
)
def fisher_exact_2x2(spark, sf_dir):
    counts = contingency_counts(_outcomes(spark, sf_dir), "toxic", "group", "en", "other")
    return rounded(fisher_2x2(counts))
