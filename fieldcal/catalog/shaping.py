"""Queries on shaping, splits, text, lines, files and run records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.catalog.registry import (
    EVENT_READINGS_SQL,
    LINE_KEY,
    PAIRS_SQL,
    event_readings,
    lines,
    pairs,
    query,
    rounded,
    sql_rounded,
    station_rows,
    table,
)
from fieldcal.functions.calendar import parse_time
from fieldcal.functions.measure import replace_zero
from fieldcal.functions.text import (
    acronym,
    adler32,
    argument_line,
    capitalize,
    choose,
    concat_all,
    concat_pair,
    digits_only,
    first_upper,
    is_consonant,
    is_valid_filename,
    is_vowel,
    model_label,
    parse_augmentation,
)
from fieldcal.operators.lines import (
    count_lines,
    expand_grid,
    filter_lines,
    lines_only_in_first,
    runs_left,
    same_lines,
)
from fieldcal.operators.ordering import (
    chunk_rows,
    contiguous_folds,
    every_nth,
    exact_split,
    hash_key,
    head_rows,
    zip_by_position,
)
from fieldcal.operators.prep import apply_scaling, augment, augment_rare, fit_scaling
from fieldcal.operators.reshape import (
    cap_rows,
    drop_columns,
    drop_duplicate_rows,
    move_after,
    move_before_target,
    move_last_first,
    rename,
    rename_by_position,
    select_features,
    union_tables,
    union_zones,
)
from fieldcal.plans.analysis import experiment_plan
from fieldcal.schema import STATION_SCHEMA, numeric_columns, text_columns
from fieldcal.session import scratch_path
from fieldcal.sources.files import (
    append_ledger,
    filter_csv_rows,
    merged_readings,
    merged_station_feed,
    numbered_seeds,
    parse_ledger,
    read_csv,
    read_lines,
    write_csv,
    write_parquet,
)
from fieldcal.sources.results import failure_log, flatten_results, layout_path, nest_results, read_results, write_results

# ---------------------------------------------------------------- columns


@query(
    """SELECT l_tax AS tax, l_shipdate AS shipped, l_orderkey AS "order", l_discount AS discount,
       l_extendedprice AS price, l_quantity AS target FROM lineitem"""
)
def column_shape(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_extendedprice", "l_linestatus"
    )
    named = rename_by_position(li, ["order", "target", "discount", "tax", "shipped", "extended", "status"])
    kept = drop_columns(rename(named, {"extended": "price"}), ["status", "absent"], required=False)
    moved = move_after(move_last_first(kept, 2), "shipped", "order")
    return select_features(move_before_target(moved, ["price"], "target"), [], "target")


@query("SELECT l_tax, l_shipdate, l_discount, l_quantity FROM lineitem")
def feature_selection(spark, sf_dir):
    """The listed features in the order of the list, then the target; all other columns go."""
    return select_features(table(spark, sf_dir, "lineitem"), ["l_tax", "l_shipdate", "l_discount"], "l_quantity")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def select_by_type(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    doubles = [c for c in numeric_columns(li) if dict(li.dtypes)[c] == "double"]
    return li.select(*doubles, *text_columns(li))


@query(
    """SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_shipdate FROM lineitem"""
)
def full_row_dedup(spark, sf_dir):
    return drop_duplicate_rows(
        table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate")
    )


@query(
    f"""WITH {PAIRS_SQL} SELECT zone, count(*) AS n, round(sum(CASE WHEN d = 0 THEN 1e-8::DOUBLE ELSE d END), 4) AS total
    FROM (SELECT zone, l_discount AS d FROM pairs WHERE truth <= 40 AND raw <= 35) GROUP BY zone"""
)
def capped_rows(spark, sf_dir):
    capped = cap_rows(pairs(spark, sf_dir), "truth", 40.0, "raw", 35.0)
    return capped.groupBy("zone").agg(
        F.count("*").alias("n"), F.round(F.sum(replace_zero(F.col("l_discount"))), 4).alias("total")
    )


@query(
    """SELECT 'A' AS zone, o_orderkey AS key, o_totalprice AS amount, NULL::VARCHAR AS note FROM orders
       UNION ALL SELECT 'B', c_custkey, c_acctbal, c_mktsegment FROM customer"""
)
def union_of_zones(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("note")
    )
    return union_zones({"A": o, "B": c}).select("zone", "key", "amount", "note")


# ---------------------------------------------------------------- order and splits


@query(
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
    b AS (SELECT o_orderkey AS key_by_price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS p FROM orders)
    SELECT o_orderkey, key_by_price FROM a JOIN b USING (p)"""
)
def zip_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = o.select("o_orderkey", "o_orderdate")
    right = o.select(F.col("o_orderkey").alias("key_by_price"), "o_totalprice")
    both = zip_by_position(left, right, ["o_orderdate", "o_orderkey"], ["o_totalprice", "key_by_price"])
    return both.select("o_orderkey", "key_by_price")


_SPLIT_SEED = 83811


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY md5('{_SPLIT_SEED}|' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_orderdate, CASE WHEN r <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k"""
)
def exact_train_test_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return exact_split(o, ["o_orderkey"], 0.3, _SPLIT_SEED).orderBy("split", "o_orderdate", "o_orderkey")


@query(f"SELECT o_orderkey, (ntile(4) OVER (ORDER BY md5('{_SPLIT_SEED}|' || o_orderkey)) - 1)::INTEGER AS fold FROM orders")
def contiguous_fold_numbers(spark, sf_dir):
    return contiguous_folds(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 4, _SPLIT_SEED)


@query(
    f"""SELECT o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (ORDER BY md5('{_SPLIT_SEED}|' || o_orderkey)) <= 400"""
)
def head_train(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return head_rows(o, ["o_orderkey"], 400, _SPLIT_SEED)


@query(
    """WITH p AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
                  count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_orderdate, position FROM p WHERE position % greatest(1, n // 10) = 0"""
)
def tick_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return every_nth(o, ["o_orderdate", "o_orderkey"], 10)


# ---------------------------------------------------------------- preparation

_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scaled(spark, sf_dir, strategy):
    li = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *_SCALED)
    li = li.withColumn("constant", F.lit(7.0))
    return rounded(apply_scaling(li, fit_scaling(li, [*_SCALED, "constant"], strategy)))


def _scaled_sql(center: str, scale: str) -> str:
    return (
        "WITH s AS (SELECT "
        + ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in _SCALED)
        + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"round(({c} - c_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
        + ", 0.0::DOUBLE AS constant FROM lineitem, s"
    )


@query(_scaled_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query(_scaled_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query(_scaled_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


_UNIFORM = "((('0x' || left(md5('{seed}|{salt}|' || {key}), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)"


def _noise_sql(seed: int, salt: str, key: str, sd: float) -> str:
    r = _UNIFORM.format(seed=seed, salt=salt + "/r", key=key)
    a = _UNIFORM.format(seed=seed, salt=salt + "/a", key=key)
    return f"{sd} * sqrt(-2 * ln({r})) * cos(2 * pi() * {a})"


@query(
    f"""WITH t AS (SELECT quantile_cont(o_totalprice, 0.9) AS lim FROM orders),
    r AS (SELECT o.*, c.copy, o_orderkey || '|' || c.copy AS k FROM orders o, t, range(1, 4) c(copy) WHERE o_totalprice > lim)
    SELECT o_orderkey, 0 AS copy, round(o_totalprice, 4) AS o_totalprice FROM orders
    UNION ALL SELECT o_orderkey, copy::INTEGER, round(greatest(0, o_totalprice + {_noise_sql(7, "o_totalprice", "k", 5.0)}), 4) FROM r"""
)
def rare_target_augment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    made = augment_rare(o, "o_totalprice", [], F.col("o_orderkey").cast("string"), 0.9, 3, 0.0, 5.0, seed=7)
    return made.select("o_orderkey", "copy", F.round("o_totalprice", 4).alias("o_totalprice"))


@query(
    f"""WITH t AS (SELECT quantile_cont(o_totalprice, 0.95) AS lim FROM orders),
    b AS (SELECT o_orderkey, o_totalprice, (o_custkey % 50)::DOUBLE AS x FROM orders),
    r AS (SELECT b.*, md5('3|' || o_orderkey) || '|' || c.copy AS k FROM b, t, range(1, 3) c(copy) WHERE o_totalprice > lim),
    u AS (SELECT o_orderkey, o_totalprice, x FROM b
          UNION ALL SELECT o_orderkey, o_totalprice, x + {_noise_sql(3, "x", "k", 0.5)} FROM r)
    SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(x, 6) AS x FROM u"""
)
def augmented_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 50).cast("double").alias("x"))
    made = augment(o, "simple_0.95_2_0.5_0.0", "o_totalprice", ["x"], hash_key(3, F.col("o_orderkey")), seed=3)
    same = augment(made, "none", "o_totalprice", ["x"], F.lit(""), seed=3)
    return same.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.round("x", 6).alias("x"))


# ---------------------------------------------------------------- text


@query(
    r"""WITH u AS (SELECT p_partkey, p_name || ' ' || (p_partkey % 100) AS s FROM part),
    v AS (SELECT p_partkey, upper(s) AS s, regexp_replace(s, '[^0-9]', '', 'g') AS d FROM u),
    a AS (SELECT p_partkey, d, left(s, 1) || left(regexp_replace(substr(s, 2), '[^A-Z]|[AEIOU]', '', 'g'), 3 - length(d)) || d AS x FROM v)
    SELECT p_partkey, CASE WHEN length(d) < 4 THEN x END AS acronym, d AS digits FROM a"""
)
def text_acronym(spark, sf_dir):
    s = F.concat_ws(" ", F.col("p_name"), (F.col("p_partkey") % 100).cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", acronym(s, 4).alias("acronym"), digits_only(s).alias("digits")
    )


@query(
    """SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS first_upper,
       upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS capitalized, p_name || '-' || p_brand AS pair,
       p_name || '/' || p_brand || '/' || p_type AS joined,
       upper(left(p_name, 1)) IN ('A', 'E', 'I', 'O', 'U') AS vowel,
       upper(left(p_name, 1)) NOT IN ('A', 'E', 'I', 'O', 'U') AS consonant,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS label
       FROM part"""
)
def text_labels(spark, sf_dir):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", first_upper(name).alias("first_upper"), capitalize(kind).alias("capitalized"),
        concat_pair(name, brand, "-").alias("pair"), concat_all(F.array(name, brand, kind), "/").alias("joined"),
        is_vowel(F.left(name, F.lit(1))).alias("vowel"), is_consonant(F.left(name, F.lit(1))).alias("consonant"),
        model_label(F.replace(name, F.lit(" "), F.lit("_"))).alias("label"),
    )


@query(
    r"""WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name || ':x' WHEN 2 THEN ''
         WHEN 3 THEN 'com' || (c_custkey % 12) || '.txt' ELSE repeat('a', (c_custkey % 300)::INTEGER) END AS name FROM customer)
    SELECT c_custkey, length(name) BETWEEN 1 AND 255 AND NOT regexp_matches(name, '[<>:"/\\|?*]')
      AND upper(split_part(name, '.', 1)) NOT IN ('CON', 'PRN', 'AUX', 'NUL', 'COM1', 'COM2', 'COM3', 'COM4', 'COM5', 'COM6',
      'COM7', 'COM8', 'COM9', 'LPT1', 'LPT2', 'LPT3', 'LPT4', 'LPT5', 'LPT6', 'LPT7', 'LPT8', 'LPT9') AS valid FROM n"""
)
def valid_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = (
        F.when(k % 5 == 0, F.col("c_name"))
        .when(k % 5 == 1, F.concat(F.col("c_name"), F.lit(":x")))
        .when(k % 5 == 2, "")
        .when(k % 5 == 3, F.concat(F.lit("com"), (k % 12).cast("string"), F.lit(".txt")))
        .otherwise(F.expr("repeat('a', cast(c_custkey % 300 as int))"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", is_valid_filename(name).alias("valid"))


@query(
    """WITH RECURSIVE names AS (SELECT DISTINCT p_type AS s FROM part),
    f AS (SELECT s, 0 AS i, 1::BIGINT AS a, 0::BIGINT AS b FROM names
          UNION ALL SELECT s, i + 1, (a + ascii(substr(s, i + 1, 1))) % 65521, (b + a + ascii(substr(s, i + 1, 1))) % 65521
          FROM f WHERE i < length(s))
    SELECT s AS text, b * 65536 + a AS checksum FROM f WHERE i = length(s)"""
)
def feature_checksum(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("text")).distinct()
    return names.select("text", adler32(F.col("text")).alias("checksum"))


@query(
    """SELECT o_orderkey, ['near', 'far', 'none'][('0x' || left(md5('11|' || o_orderkey), 12))::BIGINT % 3 + 1] AS choice FROM orders"""
)
def random_choice(spark, sf_dir):
    values = F.array(F.lit("near"), F.lit("far"), F.lit("none"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", choose(values, F.col("o_orderkey"), seed=11).alias("choice")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size / 100 END AS share,
       CASE WHEN p_size % 4 > 0 THEN p_size % 4 END::INTEGER AS copies,
       CASE WHEN p_size % 4 > 0 THEN 0.04::DOUBLE END AS x_noise, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS y_noise FROM part"""
)
def augmentation_mode(spark, sf_dir):
    size = F.col("p_size")
    mode = F.when(size % 4 == 0, "none").otherwise(
        F.concat_ws(
            "_", F.lit("simple"), (size / 100).cast("string"), (size % 4).cast("string"), F.lit("0.04"),
            F.col("p_retailprice").cast("string"),
        )
    )
    return table(spark, sf_dir, "part").select("p_partkey", parse_augmentation(mode).alias("m")).select("p_partkey", "m.*")


# ---------------------------------------------------------------- lines, grids, ledgers


def _text_lines(spark, sf_dir):
    """The documents line by line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.explode(F.split("text", "\n", -1)).alias("line"))


@query(
    r"""WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
    a AS (SELECT line FROM l WHERE regexp_matches(line, '\S') AND source IN (SELECT min(source) FROM documents)),
    b AS (SELECT DISTINCT line FROM l WHERE source NOT IN (SELECT min(source) FROM documents))
    SELECT md5(line) AS line_key FROM a ANTI JOIN b USING (line)"""
)
def lines_anti_join(spark, sf_dir):
    docs = _text_lines(spark, sf_dir)
    first = docs.agg(F.min("source").alias("source"))
    a, b = docs.join(first, "source", "left_semi"), docs.join(first, "source", "left_anti")
    return lines_only_in_first(a, b, "line").select(F.md5("line").alias("line_key"))


@query(
    r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT line, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang <> 'en') AS b FROM l
          WHERE regexp_matches(line, '\S') GROUP BY line)
    SELECT count(*) FILTER (a <> b) AS differing, count(*) FILTER (a <> b) = 0 AS same FROM c"""
)
def lines_multiset_equal(spark, sf_dir):
    docs = _text_lines(spark, sf_dir)
    return same_lines(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "line")


@query(
    r"""SELECT count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '\S')"""
)
def line_count(spark, sf_dir):
    return count_lines(_text_lines(spark, sf_dir), "line")


@query(
    """SELECT doc_id, md5(line) AS line_key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE contains(line, 'the')"""
)
def line_filter(spark, sf_dir):
    return filter_lines(_text_lines(spark, sf_dir), "line", "the").select("doc_id", F.md5("line").alias("line_key"))


def _grid(spark, sf_dir):
    """All combinations of nation, test size and fold count."""
    arrays = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("data"),
        F.array(F.lit(0.2), F.lit(0.3)).alias("test_size"),
        F.array(F.lit(3), F.lit(4), F.lit(5)).alias("cv"),
        F.array(F.lit("linear")).alias("model"),
    )
    return expand_grid(arrays, ["test_size", "cv", "model"])


_GRID_SQL = """
grid AS (SELECT n_name AS data, t.test_size, c.cv, 'linear' AS model,
  'cv;' || c.cv || ';data;' || n_name || ';model;linear;test_size;' || t.test_size AS line
  FROM nation, (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) t(test_size), (VALUES (3), (4), (5)) c(cv))"""
_GRID_NAMES = ["data", "test_size", "cv", "model"]


@query(f"WITH {_GRID_SQL} SELECT data, test_size, cv, model, line FROM grid")
def grid_expand(spark, sf_dir):
    return experiment_plan(_grid(spark, sf_dir), _GRID_NAMES)


@query(
    f"""WITH {_GRID_SQL}, p AS (SELECT line, row_number() OVER (ORDER BY line) - 1 AS r, count(*) OVER () AS n FROM grid)
    SELECT line, (r // ceil(n / 7)::BIGINT + 1)::INTEGER AS chunk, 'plan_' || (r // ceil(n / 7)::BIGINT + 1) AS run_id FROM p"""
)
def grid_chunks(spark, sf_dir):
    return chunk_rows(grid_expand(spark, sf_dir).select("line"), ["line"], 7, "plan").select("line", "chunk", "run_id")


@query(f"WITH {_GRID_SQL} SELECT line FROM grid WHERE cv <> 4")
def runs_left_to_do(spark, sf_dir):
    plan = grid_expand(spark, sf_dir)
    done = plan.where("cv = 4").select("line")
    return runs_left(plan.select("line"), union_tables([done, done]), "line")


@query(
    """SELECT n_name, 'data;' || n_name || ';region;' || n_regionkey || ';seed_index;' || (n_nationkey + 1) AS line,
       n_name AS data, (n_nationkey + 1)::INTEGER AS seed_index FROM nation"""
)
def ledger_parse(spark, sf_dir):
    arguments = F.create_map(
        F.lit("seed_index"), (F.col("n_nationkey") + 1).cast("string"),
        F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("data"), F.col("n_name"),
    )
    path = scratch_path(spark, "ledger")
    append_ledger(table(spark, sf_dir, "nation").select(argument_line(arguments).alias("value")), path)
    parsed = parse_ledger(read_lines(spark, path))
    return parsed.select(
        F.col("arguments")["data"].alias("n_name"), "line", F.col("arguments")["data"].alias("data"),
        F.col("arguments")["seed_index"].try_cast("int").alias("seed_index"),
    )


@query(
    """SELECT (row_number() OVER (ORDER BY o_orderdate, o_orderkey))::INTEGER AS seed_index, o_custkey AS seed FROM orders"""
)
def seed_lookup(spark, sf_dir):
    return numbered_seeds(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "o_custkey")


@query("SELECT o_orderkey, 'order;' || o_orderkey AS arguments, 'price ' || o_orderstatus AS error FROM orders WHERE o_orderstatus = 'F'")
def failed_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("order;"), F.col("o_orderkey").cast("string")).alias("arguments"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("price "), F.col("o_orderstatus"))).alias("error"),
    )
    log = failure_log(runs, "arguments", "error")
    return log.select(F.split_part("arguments", F.lit(";"), F.lit(2)).cast("long").alias("o_orderkey"), "arguments", "error")


# ---------------------------------------------------------------- files and run records

_ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.TimestampNTZType()),
    ]
)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders")
    write_csv(table(spark, sf_dir, "orders").select(*_ORDER_SCHEMA.names), path)
    return read_csv(spark, path, _ORDER_SCHEMA)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def parquet_partition_prune(spark, sf_dir):
    path = scratch_path(spark, "orders")
    write_parquet(table(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    """SELECT o_orderdate + to_hours(o_orderkey % 24) AS timestamp, 'Supplier#' || lpad((o_custkey % 4)::VARCHAR, 9, '0') AS station,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice / 5000 END AS value FROM orders"""
)
def folder_merge_stations(spark, sf_dir):
    folder = scratch_path(spark, "monthly")
    rows = station_rows(spark, sf_dir)
    day_first = F.regexp_replace("timestamp", r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}:\d{2}:\d{2}).*$", "$3/$2/$1 $4")
    rows.withColumn("timestamp", day_first).write.csv(folder, header=True)
    return merged_station_feed(spark, folder).select("timestamp", "station", F.col("value").try_cast("double").alias("value"))


@query(f"WITH {EVENT_READINGS_SQL} SELECT sec AS time, device, sensor, val FROM event_readings")
def folder_merge_readings(spark, sf_dir):
    folder = scratch_path(spark, "readings")
    event_readings(spark, sf_dir).drop("event_id").write.csv(folder, header=True)
    return merged_readings(spark, folder).select(parse_time(F.col("time")).alias("time"), "device", "sensor", "val")


@query(
    """SELECT o_orderdate + to_hours(o_orderkey % 24) AS timestamp, 'Supplier#' || lpad((o_custkey % 4)::VARCHAR, 9, '0') AS station
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def station_line_filter(spark, sf_dir):
    source, target = scratch_path(spark, "feed"), scratch_path(spark, "filtered")
    station_rows(spark, sf_dir).write.csv(source, header=True)
    filter_csv_rows(spark, source, target, "Particelle sospese PM10")
    return read_csv(spark, target, STATION_SCHEMA).select(parse_time(F.col("timestamp")).alias("timestamp"), "station")


_ZONES = ["A", "N", "R"]
_KINDS_SQL = {
    "train_score": "avg(l_tax)", "test_score": "avg(l_discount)", "train_score_sum_cocal": "avg(l_quantity)",
    "test_score_sum_cocal": "max(l_quantity)",
}


@query(
    "WITH w AS (SELECT (l_orderkey % 30 + 1)::INTEGER AS seed_index, l_returnflag AS zone, "
    "CASE l_linenumber % 2 WHEN 0 THEN 'mae' ELSE 'r2' END AS metric, "
    + ", ".join(f"round({e}, 6) AS {k}" for k, e in _KINDS_SQL.items())
    + " FROM lineitem GROUP BY 1, 2, 3) "
    + " UNION ALL ".join(f"SELECT 'run' AS run_id, seed_index, zone, metric, '{k}' AS kind, {k} AS score FROM w" for k in _KINDS_SQL)
)
def results_json_flatten(spark, sf_dir):
    flat = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.lit("run").alias("run_id"), (F.col("l_orderkey") % 30 + 1).cast("int").alias("seed_index"),
            F.col("l_returnflag").alias("zone"),
            F.when(F.col("l_linenumber") % 2 == 0, "mae").otherwise("r2").alias("metric"), "l_tax", "l_discount", "l_quantity",
        )
        .groupBy("run_id", "seed_index", "zone", "metric")
        .agg(
            F.round(F.avg("l_tax"), 6).alias("train_score"), F.round(F.avg("l_discount"), 6).alias("test_score"),
            F.round(F.avg("l_quantity"), 6).alias("train_score_sum_cocal"), F.max("l_quantity").alias("test_score_sum_cocal"),
        )
    )
    path = scratch_path(spark, "results")
    write_results(nest_results(flat, _ZONES, ["run_id", "seed_index"]), path)
    return flatten_results(read_results(spark, path, _ZONES, multi_line=False), _ZONES)


@query(
    """SELECT p_partkey, 'results/' || lower(p_type) || '/' || p_brand || '/onehot_robust_simple_0d9_5_' || p_size || 'd5_linear/test0d'
       || (p_partkey % 9 + 1) || 'cviter40cvfold4linscale' || (p_size % 2) || 'logscaletarget0ntrain' || (p_partkey % 3 * 400) || '/' AS path
       FROM part"""
)
def results_by_layout(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    path = layout_path(
        "results/", F.lower("p_type"), F.col("p_brand"), F.lit("onehot"), F.lit("robust"),
        F.concat(F.lit("simple_0.9_5_"), size.cast("string"), F.lit(".5")), F.lit("linear"),
        F.concat(F.lit("0."), (k % 9 + 1).cast("string")), F.lit(40), F.lit(4), size % 2, F.lit(0), k % 3 * 400,
    )
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
