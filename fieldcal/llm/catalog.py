"""Named queries over the given tables, one for each operator, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.llm.bpe import bpe
from fieldcal.llm.collocations import collocations
from fieldcal.llm.exact_dedup import exact_dedup
from fieldcal.llm.fill_in_middle import fill_in_middle, restored
from fieldcal.llm.jaccard_join import jaccard_components
from fieldcal.llm.line_dedup import MIN_SITES, line_dedup
from fieldcal.llm.mixing import copies
from fieldcal.llm.quality import score_quality
from fieldcal.llm.simhash import hex_digits, simhash_components
from fieldcal.llm.substring_dedup import substring_dedup
from fieldcal.llm.topk_search import top_k
from fieldcal.llm.toxicity import score_toxicity, train
from fieldcal.llm.warc import warc_round_trip

#: The vocabulary of the BPE query.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
common AS (
  SELECT trim(line, ' ') AS line, min((doc_id, pos)) AS first FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.*, c.line IS NOT NULL AND (l.doc_id, l.pos) <> c.first AS gone
  FROM lines l LEFT JOIN common c ON c.line = trim(l.line, ' ')),
left_over AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL WHEN n_removed = n_lines THEN '' ELSE coalesce(l.text, '') END AS text
FROM documents d LEFT JOIN left_over l USING (doc_id)"""


@query(_LINES)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


_MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source),
-- sources in the order in which a growing share reaches their bound
filled AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS cut_before, sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, source NULLS FIRST) AS rest
  FROM totals WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(share, 3 * source_size / weight) AS share FROM (
    SELECT ((SELECT sum(source_size) FROM totals) - cut_before)::DOUBLE / rest::DOUBLE AS share, source_size, weight FROM filled)
  WHERE 3 * source_size > share * weight),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(share * weight, (3 * source_size)::DOUBLE)) AS target
  FROM totals, level),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
         (('0x' || substr(md5('7|' || coalesce(s.source, chr(0))), 1, 5))::BIGINT)::DOUBLE / 1048576 AS start,
         (row_number() OVER (PARTITION BY s.source ORDER BY size, md5(doc_id::VARCHAR), doc_id) - 1)::DOUBLE AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(3, floor((before + 1) * ratio + start)::BIGINT - floor(before * ratio + start)::BIGINT) * size AS taken
FROM placed"""


@query(_MIXING)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""
)
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def _crc_is(remainder: int, parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scores = score_quality(documents, labels, label_col="quality", learn_from=~_crc_is(0, 5))
    return scores.select("doc_id", _crc_is(0, 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe(_table(spark, sf_dir, "documents"), VOCABULARY)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(digits, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(documents, labels, label_col="toxic", learn_from=~_crc_is(2, 4))
    scores = score_toxicity(documents, model)
    return scores.select(
        "doc_id", _crc_is(2, 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").alias("n_offending"),
    )


@query(
    """
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
parts AS (
  SELECT page_id, html, hex, min(page_id) OVER (PARTITION BY html) AS first,
         list_transform(range(4), lambda i: lpad(to_base(('0x' || substr(hex, (1 + 10 * i)::INTEGER, 10))::BIGINT, 32), 8, '0')) AS digits
  FROM digests)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       translate(upper(array_to_string(digits, '')), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM parts"""
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)"""
)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query(
    r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:(i + k - 1)::BIGINT], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3]) AS k)),
frequent AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM frequent WHERE k > 1),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, c, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * x.a::HUGEINT * x.a::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
  FROM cuts x JOIN frequent l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:c], ' ')
  JOIN frequent r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[(c + 1):x.k], ' ')),
weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored),
longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cuts WHERE k = 3 AND c = 1),
around AS (SELECT lang, phrase, max(a) AS a FROM longer GROUP BY ALL),
ranked AS (
  SELECT x.lang, x.phrase, x.a, x.l, x.r, x.score,
         row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, x.phrase) AS rank
  FROM weakest x LEFT JOIN around o ON x.k = 2 AND o.lang = x.lang AND o.phrase = x.phrase
  WHERE place = 1 AND (o.a IS NULL OR 100 * o.a < 50 * x.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


@query(
    r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
drawn AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(w[1:least(c1, c2)], '') AS p, array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(w[greatest(c1, c2) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN len(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"),
    )


@query()
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_table(spark, sf_dir, "documents"), n=3, bits=2)
    return found.select(F.col("id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
