"""Queries of the operators that make questions out of evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.config import Job
from attestor.operators import dispatch, reports, selection
from attestor.plans import inputs
from attestor.plans.registry import query

CHAINS = Job(a_terms=("a",), b_terms=("b",), c_terms=("c",), kind="chains", hypotheses={"abc": "{a_term} acts on {c_term} by {b_term}.", "ac": "{a_term} acts on {c_term}."})
PAIRS = Job(a_terms=("a",), b_terms=("b", "c"), post_n=20)

EVIDENCE = """SELECT user_id % 50 AS row_id, CASE WHEN event_id % 2 = 0 THEN 'ab' ELSE 'bc' END AS intersection, event_id AS pos, event_id % 997 AS pmid, concat(event_type, ' entry ', event_id) AS text,
  CAST(1990 + event_id % 30 AS INT) AS pub_year, CAST(CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS INT) AS mask FROM events"""


def _sql(spark, sf_dir, sql, name="events"):
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=inputs.table(spark, sf_dir, name))


@query(f"""WITH e AS ({EVIDENCE}), kept AS (SELECT * FROM (SELECT *, sum(length(text) // 4) OVER (PARTITION BY row_id, intersection ORDER BY pos) AS running FROM e WHERE mask = 1) WHERE running <= 300),
turns AS (SELECT row_id, intersection, pmid, row_number() OVER (PARTITION BY row_id, intersection ORDER BY pos) * 2 AS slot FROM kept
  UNION ALL SELECT row_id, intersection, pmid, row_number() OVER (PARTITION BY row_id, intersection ORDER BY pub_year DESC, pos) * 2 + 1 FROM kept),
f AS (SELECT row_id, intersection, pmid, min(slot) AS slot FROM turns GROUP BY ALL)
SELECT row_id, intersection, pmid, CAST(place - 1 AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY row_id, intersection ORDER BY slot) AS place FROM f) WHERE place <= 20""")
def prepared_evidence(spark, sf_dir):
    return dispatch.prepared(_sql(spark, sf_dir, EVIDENCE), ["row_id"], PAIRS, lists=2, budget=600).select("row_id", "intersection", "pmid", "pos")


TERMS = "SELECT n_nationkey AS row_id, n_name AS a_term, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE concat('B', n_regionkey) END AS b_term, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE concat('C|', n_regionkey) END AS c_term FROM nation"


@query(f"""WITH t AS (SELECT row_id, trim(a_term) AS a, b_term AS b, 'C' AS c FROM ({TERMS}) WHERE trim(c_term) <> '')
SELECT row_id, 'A_B_C' AS relation, concat(a, ' - ', b, ' - ', c) AS label, concat(a, ' acts on ', c, ' by ', b, '.') AS hypothesis FROM t WHERE b IS NOT NULL
UNION ALL SELECT row_id, 'A_C', concat(a, ' - ', c), concat(a, ' acts on ', c, '.') FROM t""")
def job_questions(spark, sf_dir):
    return dispatch.questions(_sql(spark, sf_dir, TERMS, "nation"), CHAINS).select("row_id", "relation", "label", F.col("hypothesis1").alias("hypothesis"))


POOLED = "SELECT user_id % 40 AS row_id, CASE event_id % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'bc' ELSE 'ac' END AS intersection, event_id AS pos, event_id AS pmid, event_type AS text FROM events WHERE NOT (user_id % 40 % 5 = 0 AND event_id % 3 = 2) AND NOT (user_id % 40 % 7 = 0 AND event_id % 3 = 1)"


@query(f"""WITH e AS ({POOLED}), l AS (SELECT row_id, intersection, count(*) AS n, string_agg(concat(text, '===END OF ABSTRACT===', chr(10), chr(10)), '' ORDER BY pos) AS body FROM e GROUP BY ALL),
w AS (SELECT n_nationkey AS row_id, max(CASE WHEN intersection = 'ab' THEN body END) AS ab, max(CASE WHEN intersection = 'bc' THEN body END) AS bc, max(CASE WHEN intersection = 'ac' THEN body END) AS ac,
  max(CASE WHEN intersection = 'ab' THEN n END) AS nab, max(CASE WHEN intersection = 'bc' THEN n END) AS nbc, max(CASE WHEN intersection = 'ac' THEN n END) AS nac FROM nation LEFT JOIN l ON l.row_id = n_nationkey GROUP BY n_nationkey),
p AS (SELECT row_id, 'A_B_C' AS relation, 'Evidence for A and B:' || chr(10) || ab || chr(10) || 'Evidence for B and C:' || chr(10) || bc AS pool, nab + nbc AS n FROM w UNION ALL SELECT row_id, 'A_C', ac, nac FROM w)
SELECT row_id, relation, CASE WHEN pool IS NULL THEN 'N/A' ELSE 'ask' END AS status, CAST(CASE WHEN pool IS NULL THEN 0 ELSE n END AS INT) AS expected, md5(pool) AS digest FROM p""")
def question_pools(spark, sf_dir):
    nation = inputs.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_id"), F.explode(F.array(F.lit("A_B_C"), F.lit("A_C"))).alias("relation"))
    return dispatch.pools(nation, _sql(spark, sf_dir, POOLED)).select("row_id", "relation", "status", "expected", F.md5("pool").alias("digest"))


SAMPLED = "SELECT user_id % 10 AS k, CAST(user_id % 3 % 2 + 1 AS INT) AS pool, event_id AS pos, CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(user_id * 3 + event_id % 17 AS {s}) END AS pmid, concat(event_type, event_id) AS text FROM events"


def _sample(fixed: bool) -> str:
    key = "'1'" if fixed else "CAST(iteration AS VARCHAR)"
    return f"""WITH e AS ({SAMPLED.format(s='VARCHAR')}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, CASE WHEN pmid = '' THEN concat('row:', pool, ':', pos) ELSE pmid END ORDER BY pool, pos) AS r FROM e) WHERE r = 1),
t AS (SELECT k, count(*) FILTER (WHERE pool = 1) AS t1, count(*) FILTER (WHERE pool = 2) AS t2, count(*) AS total FROM d GROUP BY k), s AS (SELECT *, least(50, total) AS av FROM t),
p AS (SELECT *, least(t1, CAST(round_even(t1 / total * av, 0) AS BIGINT)) AS n0, least(t1, 3) AS f1, least(t2, 3) AS f2 FROM s),
q AS (SELECT *, CASE WHEN av - n0 > t2 THEN av - t2 ELSE n0 END AS n1 FROM p),
n AS (SELECT k, total, av, CASE WHEN f1 + f2 > av THEN CASE WHEN av - least(t1, av // 2) > t2 THEN av - t2 ELSE least(t1, av // 2) END WHEN n1 < f1 THEN f1 WHEN av - n1 < f2 THEN av - f2 ELSE n1 END AS n1 FROM q),
w AS (SELECT k, iteration, pool, text, row_number() OVER (PARTITION BY k, iteration, pool ORDER BY md5(concat_ws(':', '7', {key}, pmid)), pmid, pos) AS draw FROM d, (SELECT CAST(unnest(range(1, 4)) AS INT) AS iteration))
SELECT k, iteration, count(*) AS sampled, any_value(total) AS total, md5(string_agg(concat(text, '===END OF ABSTRACT===', chr(10), chr(10)), '' ORDER BY pool, draw)) AS digest
FROM w JOIN n USING (k) WHERE draw <= CASE pool WHEN 1 THEN n1 ELSE av - n1 END GROUP BY k, iteration"""


def _sampled(spark, sf_dir, fixed):
    out = dispatch.sampled_pools(_sql(spark, sf_dir, SAMPLED.format(s="STRING")), ["k"], 7, 3, fixed)
    return out.select("k", "iteration", "sampled", "total", F.md5("text").alias("digest"))


@query(_sample(True))
def fixed_sample(spark, sf_dir):
    return _sampled(spark, sf_dir, True)


@query(_sample(False))
def iteration_samples(spark, sf_dir):
    return _sampled(spark, sf_dir, False)


LISTS = "SELECT user_id, array_agg(event_id ORDER BY event_id) FILTER (WHERE event_type = 'view') AS ab, array_agg(event_id % 50 ORDER BY event_id) FILTER (WHERE event_type = 'click') AS bc FROM events GROUP BY user_id"


def _lists(spark, sf_dir):
    own = lambda kind, value: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, value)))
    return inputs.table(spark, sf_dir, "events").groupBy("user_id").agg(own("view", F.col("event_id")).alias("ab_pmids"), own("click", F.col("event_id") % 50).alias("bc_pmids"))


@query(f"SELECT user_id FROM ({LISTS}) WHERE len(ab) > 0 OR len(bc) > 0")
def nonempty_chains(spark, sf_dir):
    return dispatch.nonempty(_lists(spark, sf_dir), CHAINS).select("user_id")


@query("SELECT count(*) AS listed, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id ELSE event_id % 50 END) AS distinct_listed FROM events WHERE event_type IN ('view', 'click')")
def listed_total(spark, sf_dir):
    return dispatch.listed_total(_lists(spark, sf_dir), "ab_pmids", "bc_pmids")


@query("""WITH n AS (SELECT o_orderpriority AS term, CAST(year(o_orderdate) AS INT) AS y, count(*) AS c FROM orders WHERE o_custkey % 3 = 0 OR year(o_orderdate) % 2 = 0 GROUP BY ALL),
d AS (SELECT y, lag(y) OVER (ORDER BY y) AS before FROM (SELECT DISTINCT y FROM n))
SELECT n.term, n.y, n.c, coalesce(p.c, 0) AS prior_c FROM n JOIN d USING (y) LEFT JOIN n p ON p.term = n.term AND p.y = d.before""")
def previous_year(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")).where("o_custkey % 3 = 0 OR y % 2 = 0")
    return dispatch.previous_year(orders.groupBy(F.col("o_orderpriority").alias("term"), "y").agg(F.count("*").alias("c")), ["term"], "y", ["c"])


@query("""WITH u AS (SELECT user_id, event_id * 2 + i AS spot, r FROM (SELECT user_id, event_id, unnest([event_type, concat('r', event_id % 3)]) AS r, unnest([0, 1]) AS i FROM events))
SELECT user_id, string_agg(r, ',' ORDER BY spot) AS rationales FROM (SELECT user_id, r, min(spot) AS spot FROM u GROUP BY ALL) GROUP BY user_id""")
def distinct_rationales(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.array("event_type", F.concat(F.lit("r"), F.col("event_id") % 3)).alias("score_rationale"))
    return dispatch.distinct_rationales(rows, ["user_id"]).select("user_id", F.array_join("rationales", ",").alias("rationales"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return dispatch.status_counts(inputs.table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query(f"WITH n AS (SELECT intersection, count(pmid) AS n FROM ({POOLED}) GROUP BY intersection) SELECT intersection, n, CAST(coalesce(sum(n) OVER (ORDER BY CASE intersection WHEN 'ab' THEN 1 WHEN 'bc' THEN 2 ELSE 3 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def list_breaks(spark, sf_dir):
    return dispatch.break_points(_sql(spark, sf_dir, POOLED), ["ab", "bc", "ac"])


@query("SELECT s_suppkey, format('pair{:02d}_{}_vs_{}', s_suppkey, s_name, concat('n', s_nationkey)) AS pair_id FROM supplier")
def pair_ids(spark, sf_dir):
    return inputs.table(spark, sf_dir, "supplier").select("s_suppkey", dispatch.pair_id(F.col("s_suppkey"), F.col("s_name"), F.concat(F.lit("n"), F.col("s_nationkey"))).alias("pair_id"))


@query("SELECT user_id, event_id, draw FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', '9', CAST(event_id AS VARCHAR))), event_id) AS draw FROM events) WHERE draw <= 3")
def sample_n(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select("user_id", "event_id")
    return selection.sample_n(rows, ["user_id"], 3, 9, F.col("event_id")).withColumn("draw", F.col("draw").cast("long"))


@query(f"WITH {inputs.RUNS} SELECT censor_year, round(avg(support_h1), 6) AS support_h1_mean, min_by(term, event_id) AS term_first, min_by(event_type, event_id) AS event_type_first FROM runs GROUP BY censor_year")
def year_firsts(spark, sf_dir):
    out = reports.year_means(inputs.runs(spark, sf_dir), ["censor_year"], ["support_h1"], firsts=["term", "event_type"], order="event_id")
    return out.withColumn("support_h1_mean", F.round("support_h1_mean", 6))
