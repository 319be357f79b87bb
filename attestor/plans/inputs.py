"""The driver's tables as stand-ins for literature: what each operator's query reads, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A_TERMS = ["that", "los"]
B_TERMS = ["with", "whou", "und", "que", "one"]
C_TERMS = ["der", "thin"]
YEARS = [1984, 1994, 2004, 2014, 2024]

#: Expressions that Spark SQL and DuckDB read alike.
RAW_TERM = "CASE doc_id % 6 WHEN 0 THEN concat('|', source, '|', lang) WHEN 1 THEN concat('  ', source, '   &  ', lang, ' || x') WHEN 2 THEN NULL WHEN 3 THEN '   ' WHEN 4 THEN concat(lang, '/', source, ' a  b|', source) ELSE concat(source, '&', lang, '|') END"
PUB_YEAR = "CAST(1975 + doc_id % 50 AS INT)"

ART = f"art AS (SELECT doc_id AS pmid, text AS abstract, source, lang, {PUB_YEAR} AS pub_year FROM documents)"
MENTION = "mention AS (SELECT token, doc_id AS pmid FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents) WHERE token <> '')"
PAIRS = f"""{MENTION},
n AS (SELECT token, count(*) AS n FROM mention GROUP BY token),
grid AS (SELECT a_term, b_term FROM (SELECT unnest({A_TERMS}) AS a_term), (SELECT unnest({B_TERMS}) AS b_term)),
ab AS (SELECT a.token AS a_term, b.token AS b_term, count(*) AS ab_count FROM mention a JOIN mention b USING (pmid) WHERE a.token IN {tuple(A_TERMS)} AND b.token IN {tuple(B_TERMS)} GROUP BY ALL),
pairs AS (
  SELECT a_term, b_term, coalesce(x.n, 0) AS a_count, coalesce(y.n, 0) AS b_count, coalesce(ab_count, 0) AS ab_count
  FROM grid LEFT JOIN ab USING (a_term, b_term) LEFT JOIN n x ON x.token = a_term LEFT JOIN n y ON y.token = b_term)"""
#: The upper tail of the hypergeometric distribution, by lgamma.
FISHER = """fet AS (
  SELECT a_term, b_term, a_count, b_count, ab_count, least(1.0, sum(exp(
    lgamma(a_count + 1.0) - lgamma(k + 1.0) - lgamma(a_count - k + 1.0) + lgamma(t - a_count + 1.0) - lgamma(b_count - k + 1.0) - lgamma(t - a_count - b_count + k + 1.0)
    - lgamma(t + 1.0) + lgamma(b_count + 1.0) + lgamma(t - b_count + 1.0)))) AS p
  FROM (SELECT *, unnest(range(greatest(ab_count, a_count + b_count - t), least(a_count, b_count) + 1)) AS k FROM pairs, (SELECT count(*) AS t FROM documents))
  GROUP BY ALL)"""
SERIES = f"""has AS (
  SELECT {PUB_YEAR} AS pub_year, list_contains(w, 'that') AS a, list_contains(w, 'with') AS b1, list_contains(w, 'und') AS b2
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents)),
series AS (
  SELECT date, count(*) FILTER (WHERE a) AS a_count, count(*) FILTER (WHERE b1) AS b1, count(*) FILTER (WHERE b2) AS b2, count(*) FILTER (WHERE a AND b1) AS ab1, count(*) FILTER (WHERE a AND b2) AS ab2, count(*) AS total
  FROM has JOIN (SELECT unnest({YEARS})::INT AS date) ON pub_year <= date GROUP BY date)"""
#: Judged comparisons, scores by iteration and entries, made from events.
RUNS = """runs AS (
  SELECT concat('t', user_id % 7) AS term, CAST(dayofmonth(ts) % 5 + 2018 AS INT) AS censor_year, CAST(event_id % 10 + 1 AS INT) AS iteration, event_id, user_id,
    CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE CAST(CAST(floor(least(value, 100.0)) AS INT) AS VARCHAR) END AS score, event_type,
    CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INT) AS support_h1, CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS INT) AS support_h2
  FROM events)"""
COMPARED = """compared AS (
  SELECT event_id, concat('t', user_id % 8) AS term_i, concat('t', (user_id % 8 + 1 + event_id % 7) % 8) AS term_j,
    CASE event_type WHEN 'view' THEN 'term_i' WHEN 'click' THEN 'term_j' WHEN 'signup' THEN 'tie' WHEN 'purchase' THEN 'no_evidence' ELSE 'error' END AS outcome,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_id % 5 = 0 AS from_cache,
    CASE WHEN event_type = 'error' THEN NULL ELSE floor(least(value, 100.0)) END AS mean_score
  FROM events)"""
ORDERED = "ordered AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS pos, s_suppkey AS k, concat('s', s_suppkey) AS term FROM supplier)"
CACHE = "cache AS (SELECT concat('s', s_suppkey) AS term_i, concat('s', s_suppkey + 1) AS term_j, CASE WHEN s_nationkey % 3 = 0 THEN 'term_i' ELSE 'tie' END AS outcome FROM supplier)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), F.col("text").alias("abstract"), "source", "lang", F.expr(PUB_YEAR).alias("pub_year"))


def _of(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """The inner query of one of the expressions above, over a table."""
    inner = sql.split(" AS (", 1)[1].rstrip()[:-1].replace("AS VARCHAR", "AS STRING")
    return spark.sql(inner.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "events", RUNS)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "events", COMPARED)


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "supplier", ORDERED)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "supplier", CACHE)
