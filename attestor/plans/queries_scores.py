"""Queries of judging, statistics, competition, cost and report operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import special, text
from attestor.operators import competition, cooccurrence, cost, judging, reports, selection, statistics
from attestor.plans import inputs
from attestor.plans.registry import query

# ---- verdicts ----

ENTRIES = """SELECT conv_id, turn AS pos, CAST(doc_id AS VARCHAR) AS pmid,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'supports_H1' WHEN quality = 0 THEN 'supports_H2' WHEN doc_id % 3 = 0 THEN 'both' WHEN doc_id % 3 = 1 THEN 'neither' ELSE 'inconclusive' END AS label
FROM (SELECT DISTINCT conv_id, turn FROM conversations) JOIN labels ON doc_id = conv_id * 5 + turn"""
LABELLED = f"""entries AS ({ENTRIES}),
tallied AS (SELECT conv_id, count(*) FILTER (WHERE label = 'supports_H1') AS h1, count(*) FILTER (WHERE label = 'supports_H2') AS h2, count(*) FILTER (WHERE label = 'both') AS b, count(*) FILTER (WHERE label IN ('neither', 'inconclusive')) AS n FROM entries GROUP BY conv_id)"""


def _entries(spark, sf_dir):
    sql = ENTRIES.replace("VARCHAR", "STRING").replace("FROM conversations", "FROM {c}").replace("JOIN labels", "JOIN {l}")
    return spark.sql(sql, c=inputs.table(spark, sf_dir, "conversations"), l=inputs.table(spark, sf_dir, "labels"))


def _payloads(spark, sf_dir):
    """A verdict for each conversation, as JSON text; every third claims one supporter of H1 too many, every fourth has no score."""
    per_abstract = F.transform(F.array_sort(F.collect_list(F.struct("pos", "pmid", "label"))), lambda x: F.struct(x["pmid"].alias("pmid"), F.array(F.lit("e")).alias("evidence"), x["label"].alias("label")))
    rows = _entries(spark, sf_dir).groupBy("conv_id").agg(per_abstract.alias("per_abstract"))
    counts = [(judging.tally(F.col("per_abstract"), labels) + (F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0) if name == "support_H1" else F.lit(0))).alias(name) for name, labels in judging.LABELS_COMPARISON.items()]
    body = F.struct("per_abstract", F.array(F.lit("r")).alias("score_rationale"), F.struct(*counts).alias("tallies"), F.when(F.col("conv_id") % 4 != 0, (F.col("conv_id") % 101).cast("double")).alias("score"), F.lit("H1").alias("decision"))
    return rows.select("conv_id", F.to_json(body).alias("text"))


@query(f"WITH {LABELLED} SELECT conv_id, h1 AS support_h1, h2 AS support_h2, b AS both_n, n AS neither_or_inconclusive FROM tallied")
def label_tally(spark, sf_dir):
    p = judging.payload(F.col("text"), "comparison")
    names = dict(zip(judging.LABELS_COMPARISON, ("support_h1", "support_h2", "both_n", "neither_or_inconclusive"), strict=True))
    return _payloads(spark, sf_dir).select("conv_id", *[judging.tally(p["per_abstract"], labels).cast("long").alias(names[k]) for k, labels in judging.LABELS_COMPARISON.items()])


@query(f"WITH {LABELLED} SELECT conv_id, conv_id % 3 <> 0 AS agrees FROM tallied")
def tally_check(spark, sf_dir):
    p = judging.payload(F.col("text"), "comparison")
    agrees = F.lit(True)
    for name, labels in judging.LABELS_COMPARISON.items():
        agrees = agrees & (p["tallies"][name] == judging.tally(p["per_abstract"], labels))
    return _payloads(spark, sf_dir).select("conv_id", agrees.alias("agrees"))


@query(f"""WITH {LABELLED} SELECT conv_id, array_to_string(list_filter([CASE WHEN conv_id % 4 = 0 THEN 'score' END, CASE WHEN h1 + h2 + b + n <> 3 THEN 'per_abstract length' END, CASE WHEN conv_id % 3 = 0 THEN 'support_H1' END], lambda x: x IS NOT NULL), ',') AS problems FROM tallied""")
def payload_validate(spark, sf_dir):
    p = judging.payload(F.col("text"), "comparison")
    return _payloads(spark, sf_dir).select("conv_id", F.array_join(judging.problems(p, "comparison", F.lit(3)), ",").alias("problems"))


@query(f"""WITH {LABELLED} SELECT conv_id, CASE WHEN conv_id % 4 <> 0 THEN CAST(conv_id % 101 AS DOUBLE) END AS score, 'H1' AS decision,
  CAST(h1 + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS support_h1, CAST(h2 AS INT) AS support_h2, CAST(b AS INT) AS both_n, CAST(n AS INT) AS neither_or_inconclusive FROM tallied""")
def score_extract(spark, sf_dir):
    rows = _payloads(spark, sf_dir).withColumn("payload", judging.payload(F.col("text"), "comparison")).drop("text")
    return judging.scores_comparison(rows).withColumnsRenamed({"support_H1": "support_h1", "support_H2": "support_h2", "both": "both_n"})


@query(f"WITH {LABELLED} SELECT conv_id, CASE WHEN h1 + h2 > 0 THEN round(50 + 50 * (h1 - h2) / (h1 + h2), 6) END AS score FROM tallied")
def tally_judge(spark, sf_dir):
    p = judging.payload(F.col("text"), "comparison")
    h1, h2 = (judging.tally(p["per_abstract"], judging.LABELS_COMPARISON[k]) for k in ("support_H1", "support_H2"))
    return _payloads(spark, sf_dir).select("conv_id", F.round(judging.tally_judge(h1, h2), 6).alias("score"))


@query("SELECT conv_id, length(p) AS n, md5(p) AS digest, 2 AS expected FROM (SELECT conv_id, concat('Hypothesis 1: A', chr(10), 'Hypothesis 2: ', role, chr(10), 'Available PMIDs: ', conv_id, ', ', conv_id + 1, chr(10), 'Scale: 0 to 100, above 50 for hypothesis 1', chr(10), chr(10), text) AS p FROM (SELECT conv_id, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id))")
def judge_prompt(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    ids = F.array(F.col("conv_id").cast("string"), (F.col("conv_id") + 1).cast("string"))
    prompt = judging.judge_prompt([F.lit("A"), F.col("role")], F.col("text"), ids, judging.SCALES["comparison"])
    return rows.select("conv_id", F.length(prompt).cast("long").alias("n"), F.md5(prompt).alias("digest"), judging.expected_count(prompt).alias("expected"))


# ---- reports over runs ----


@query(f"""WITH {inputs.RUNS}, g AS (SELECT censor_year AS cluster, event_type AS cell_type, concat('G', event_id % 6) AS gene, TRY_CAST(score AS DOUBLE) - 50 AS s FROM runs)
SELECT cluster, cell_type, round(avg(CASE WHEN s <> 0 THEN s END), 6) AS mean_score, coalesce(string_agg(DISTINCT CASE WHEN s > 0 THEN gene END, ', ' ORDER BY CASE WHEN s > 0 THEN gene END), 'none') AS supporting,
  coalesce(string_agg(DISTINCT CASE WHEN s < 0 THEN gene END, ', ' ORDER BY CASE WHEN s < 0 THEN gene END), 'none') AS refuting, count(s) AS n_scores FROM g GROUP BY ALL""")
def cell_type_summary(spark, sf_dir):
    rows = inputs.runs(spark, sf_dir).select(F.col("censor_year").alias("cluster"), F.col("event_type").alias("cell_type"), F.concat(F.lit("G"), F.col("event_id") % 6).alias("gene"), (text.number(F.col("score")) - 50).cast("string").alias("score"))
    return reports.cell_type_summary(rows).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {inputs.RUNS} SELECT user_id, event_type, count(*) AS n, md5(string_agg(score, ',' ORDER BY event_id)) AS digest FROM runs GROUP BY ALL")
def merged_runs(spark, sf_dir):
    rows = inputs.runs(spark, sf_dir).withColumn("gene", F.lit("g"))
    return reports.merged_runs(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.size("scores").cast("long").alias("n"), F.md5(F.array_join("scores", ",")).alias("digest"))


@query(f"""WITH {inputs.RUNS} SELECT censor_year, term, round(avg(support_h1), 6) AS support_h1_mean, round(avg(support_h2), 6) AS support_h2_mean, round(avg(TRY_CAST(score AS DOUBLE)), 6) AS s_mean, round(var_samp(TRY_CAST(score AS DOUBLE)), 4) AS s_variance FROM runs GROUP BY ALL""")
def per_year_means(spark, sf_dir):
    rows = inputs.runs(spark, sf_dir).withColumn("s", text.number(F.col("score")))
    out = reports.year_means(rows, ["censor_year", "term"], ["support_h1", "support_h2", "s"], "s")
    return out.select("censor_year", "term", *[F.round(c, 6).alias(c) for c in ("support_h1_mean", "support_h2_mean", "s_mean")], F.round("s_variance", 4).alias("s_variance"))


@query(f"WITH {inputs.RUNS} SELECT censor_year, term, count(*) AS n FROM runs GROUP BY ALL")
def year_merge(spark, sf_dir):
    rows = inputs.runs(spark, sf_dir)
    merged = reports.years_merged({y: rows.where(F.col("censor_year") == y).select("term", "score") for y in range(2018, 2023)})
    return merged.groupBy("censor_year", "term").agg(F.count("*").alias("n"))


EVIDENCE = "SELECT user_id AS winner, event_id AS pos, CAST(event_id % 40 AS VARCHAR) AS pmid, concat('e', event_id % 3) AS e1, event_type AS e2 FROM events"


@query(f"""WITH e AS ({EVIDENCE}), u AS (SELECT winner, pmid, pos, unnest([e1, e2]) AS e, unnest([0, 1]) AS i FROM e), f AS (SELECT winner, pmid, e, min(pos * 2 + i) AS spot FROM u GROUP BY ALL)
SELECT winner, pmid, string_agg(e, ',' ORDER BY spot) AS evidence, any_value(times) AS times, any_value(first_pos) AS first_pos
FROM f JOIN (SELECT winner, pmid, count(*) AS times, min(pos) AS first_pos FROM e GROUP BY ALL) USING (winner, pmid) GROUP BY winner, pmid""")
def evidence_merge(spark, sf_dir):
    rows = spark.sql(EVIDENCE.replace("VARCHAR", "STRING").replace("FROM events", "FROM {e}"), e=inputs.table(spark, sf_dir, "events")).withColumn("evidence", F.array("e1", "e2"))
    return reports.evidence_by_pmid(rows, ["winner"]).withColumn("evidence", F.array_join("evidence", ","))


# ---- statistics ----

T1 = ("a_count", "b1", "ab1", "total")
T2 = ("a_count", "b2", "ab2", "total")


def _series(spark, sf_dir):
    long = cooccurrence.year_series(inputs.articles(spark, sf_dir), ["that"], ["with", "und"], inputs.YEARS)
    first, second = (F.col("b_term") == b for b in ("with", "und"))
    of = lambda which, c: F.max(F.when(which, F.col(c)))
    return long.groupBy("date").agg(F.max("a_count").alias("a_count"), of(first, "b_count").alias("b1"), of(second, "b_count").alias("b2"), of(first, "ab_count").alias("ab1"), of(second, "ab_count").alias("ab2"), F.max("total_count").alias("total"))


@query(f"WITH {inputs.SERIES} SELECT * FROM series")
def year_series(spark, sf_dir):
    return _series(spark, sf_dir).select("date", "a_count", "b1", "b2", "ab1", "ab2", "total")


@query(f"""WITH {inputs.SERIES} SELECT date, round((ab1 / b1 - ab2 / b2) / sqrt((ab1 + ab2) / (b1 + b2) * (1 - (ab1 + ab2) / (b1 + b2)) * (1 / b1 + 1 / b2)), 6) AS z FROM series""")
def ztest(spark, sf_dir):
    return _series(spark, sf_dir).select("date", F.round(statistics.z_statistic(F.col("ab1"), F.col("b1"), F.col("ab2"), F.col("b2")), 6).alias("z"))


#: erfc(x) for x up to 6, beyond which it is 0 here: 1 less a series of positive terms.
ERFC = "CASE WHEN {x} >= 6 THEN 0.0::DOUBLE WHEN {x} = 0 THEN 1.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum([exp(2 * n * ln(2.0::DOUBLE) + (2 * n + 1) * ln({x}) + lgamma(n + 1.0) - lgamma(2 * n + 2.0)) FOR n IN range(0, 160)]) END"
Z = "abs(ab1 / b1 - ab2 / b2) / sqrt((ab1 + ab2) / (b1 + b2) * (1 - (ab1 + ab2) / (b1 + b2)) * (1 / b1 + 1 / b2))"


@query(f"""WITH {inputs.SERIES}, z AS (SELECT date, {Z} / sqrt(2.0::DOUBLE) AS x FROM series) SELECT date, round({ERFC.format(x='x')}, 8) + 0.0::DOUBLE AS p_value FROM z""")
def ztest_p(spark, sf_dir):
    z = statistics.z_statistic(F.col("ab1"), F.col("b1"), F.col("ab2"), F.col("b2"))
    return _series(spark, sf_dir).select("date", F.round(statistics.z_p_value(z), 8).alias("p_value"))


@query(f"""WITH {inputs.SERIES} SELECT date, round(n * power(greatest(0, abs(ab1 * b2 - b1 * ab2) - n / 2), 2) / ((ab1 + b1)::DOUBLE * (ab2 + b2) * (ab1 + ab2) * (b1 + b2)), 6) AS chi_square FROM (SELECT *, ab1 + b1 + ab2 + b2 AS n FROM series)""")
def chisq_yates(spark, sf_dir):
    x = statistics.chi_square_yates(F.col("ab1"), F.col("b1"), F.col("ab2"), F.col("b2"))
    return _series(spark, sf_dir).select("date", F.round(x, 6).alias("chi_square"))


ODDS = "ab{k} * (total - a_count - b{k} + ab{k}) / nullif((a_count - ab{k}) * (b{k} - ab{k}), 0)"


@query(f"WITH {inputs.SERIES} SELECT date, round({ODDS.format(k=1)}, 6) AS or1, round({ODDS.format(k=2)}, 6) AS or2 FROM series")
def odds_ratio(spark, sf_dir):
    return _series(spark, sf_dir).select("date", *[F.round(statistics.odds_ratio(*map(F.col, t)), 6).alias(f"or{k}") for k, t in ((1, T1), (2, T2))])


@query(f"""WITH {inputs.SERIES}, o AS (SELECT date, {', '.join(f"{ODDS.format(k=k)} AS or{k}, 2.576 * sqrt(1 / nullif(ab{k}, 0) + 1 / nullif(a_count - ab{k}, 0) + 1 / nullif(b{k} - ab{k}, 0) + 1 / nullif(total - a_count - b{k} + ab{k}, 0)) AS w{k}" for k in (1, 2))} FROM series)
SELECT date, round(or1 * exp(-w1), 6) AS low1, round(or1 * exp(w1), 6) AS high1, round(or2 * exp(-w2), 6) AS low2, round(or2 * exp(w2), 6) AS high2,
  CAST(CASE WHEN or1 * exp(-w1) > or2 * exp(w2) OR or1 * exp(w1) < or2 * exp(-w2) THEN 0.01 ELSE 1.0 END AS DOUBLE) AS p_value FROM o""")
def ci_or_km(spark, sf_dir):
    l1, h1 = statistics.odds_interval(*map(F.col, T1))
    l2, h2 = statistics.odds_interval(*map(F.col, T2))
    return _series(spark, sf_dir).select("date", *[F.round(c, 6).alias(n) for c, n in ((l1, "low1"), (h1, "high1"), (l2, "low2"), (h2, "high2"))], statistics.disjoint_p(l1, h1, l2, h2).alias("p_value"))


@query(f"""WITH {inputs.SERIES}, k AS (
  SELECT date, ab1, unnest(range(greatest(0, a_count + b1 - total), least(a_count, b1) + 1)) AS k, a_count AS a, b1 AS b, total AS t FROM series),
p AS (SELECT date, k = ab1 AS own, lgamma(a + 1.0) - lgamma(k + 1.0) - lgamma(a - k + 1.0) + lgamma(t - a + 1.0) - lgamma(b - k + 1.0) - lgamma(t - a - b + k + 1.0) - lgamma(t + 1.0) + lgamma(b + 1.0) + lgamma(t - b + 1.0) AS l FROM k)
SELECT date, round(log10(greatest(least(1.0, sum(exp(l))), 1e-300)), 4) + 0.0::DOUBLE AS log_p FROM p JOIN (SELECT date, l AS mine FROM p WHERE own) USING (date) WHERE l <= mine + 1e-7 GROUP BY date""")
def fisher_two_sided(spark, sf_dir):
    d = [F.col(c).cast("double") for c in ("ab1", "a_count", "b1", "total")]
    return _series(spark, sf_dir).select("date", F.round(F.log10(F.greatest(special.fisher_two_sided_p(*d), F.lit(1e-300))), 4).alias("log_p"))


BINOMIAL = """SELECT date, round(log10(greatest(least(1.0, sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + n * ln(0.5)))), 1e-300)), 4) + 0.0::DOUBLE AS log_p
FROM (SELECT date, ab1 + ab2 AS n, unnest(range({k}, ab1 + ab2 + 1)) AS k FROM series) GROUP BY date"""


@query(f"WITH {inputs.SERIES} {BINOMIAL.format(k='ab1')}")
def binomial(spark, sf_dir):
    p = special.binomial_greater_p(F.col("ab1").cast("double"), (F.col("ab1") + F.col("ab2")).cast("double"), F.lit(0.5))
    return _series(spark, sf_dir).select("date", F.round(F.log10(F.greatest(p, F.lit(1e-300))), 4).alias("log_p"))


@query(f"WITH {inputs.SERIES} {BINOMIAL.format(k='greatest(1, CAST(round_even(ab2 * (ab1 / b1) / nullif(ab2 / b2, 0), 0) AS BIGINT))')}")
def weighted_binomial(spark, sf_dir):
    k = F.greatest(F.lit(1).cast("double"), F.bround(F.col("ab2") * (F.col("ab1") / F.col("b1")) / F.nullif(F.col("ab2") / F.col("b2"), F.lit(0.0))))
    p = special.binomial_greater_p(k, (F.col("ab1") + F.col("ab2")).cast("double"), F.lit(0.5))
    return _series(spark, sf_dir).select("date", F.round(F.log10(F.greatest(p, F.lit(1e-300))), 4).alias("log_p"))


@query()
def perm_test(spark, sf_dir):
    s = text.number(F.col("score"))
    lists = inputs.runs(spark, sf_dir).groupBy("censor_year").agg(*[F.array_sort(F.collect_list(F.when(F.col("event_type") == e, s))).alias(f"list{i}") for i, e in ((1, "view"), (2, "click"))])
    return statistics.permutation_test(lists, ["censor_year"], seed=3)


@query("""SELECT s_nationkey AS year, CASE WHEN count(*) FILTER (s_acctbal > 5000) = 0 THEN 'NOLINES' WHEN count(*) FILTER (s_acctbal > 5000) = 1 OR count(DISTINCT CASE WHEN s_acctbal > 5000 THEN s_suppkey % 2 END) = 1 THEN 'ONLY1' END AS sentinel FROM supplier GROUP BY s_nationkey""")
def sentinels(spark, sf_dir):
    line = F.col("s_acctbal") > 5000
    rows = inputs.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("year")).agg(F.count_if(line).alias("n"), F.count_distinct(F.when(line, F.col("s_suppkey") % 2)).alias("t"))
    return rows.select("year", statistics.year_sentinel(F.col("t"), F.col("n"), F.col("t")).alias("sentinel"))


def _units(spark, sf_dir):
    rows = inputs.runs(spark, sf_dir).select("term", "event_id", text.number(F.col("score")).alias("score"))
    return statistics.unit_scores(rows, ["term"], order="event_id")


UNITS = f"{inputs.RUNS}, units AS (SELECT term, coalesce(TRY_CAST(score AS DOUBLE) / 100, 0.5) AS x FROM runs), m AS (SELECT term, avg(x) AS mean, greatest(coalesce(var_samp(x), 1e-6), 1e-6) AS v FROM units GROUP BY term)"


@query(f"WITH {UNITS} SELECT term, round(mean * (mean * (1 - mean) / v - 1), 6) AS a, round((1 - mean) * (mean * (1 - mean) / v - 1), 6) AS b FROM m")
def beta_mom(spark, sf_dir):
    return statistics.beta_summary(_units(spark, sf_dir), ["term"]).select("term", F.round("a_mom", 6).alias("a"), F.round("b_mom", 6).alias("b"))


def _digamma(x: str) -> str:
    return f"(ln({x} + 10) - 1 / (2 * ({x} + 10)) - 1 / (12 * power({x} + 10, 2)) + 1 / (120 * power({x} + 10, 4)) - 1 / (252 * power({x} + 10, 6)) - list_sum([1 / ({x} + i) FOR i IN range(10)]))"


def _trigamma(x: str) -> str:
    return f"(1 / ({x} + 10) + 1 / (2 * power({x} + 10, 2)) + 1 / (6 * power({x} + 10, 3)) - 1 / (30 * power({x} + 10, 5)) + 1 / (42 * power({x} + 10, 7)) + list_sum([1 / power({x} + i, 2) FOR i IN range(10)]))"


#: Newton's method for the two conditions of the largest likelihood, from small parameters, where it does not overshoot.
@query(f"""WITH RECURSIVE {inputs.RUNS}, c AS (SELECT term, least(1 - 1e-10, greatest(1e-10, coalesce(TRY_CAST(score AS DOUBLE) / 100, 0.5::DOUBLE))) AS x FROM runs),
l AS (SELECT term, avg(ln(x)) AS lx, avg(ln(1 - x)) AS ly FROM c GROUP BY term),
fit AS (SELECT term, lx, ly, 0.02::DOUBLE AS a, 0.02::DOUBLE AS b, 0 AS step FROM l
  UNION ALL SELECT term, lx, ly, a - (ga * jb - gb * t) / (ja * jb - t * t), b - (gb * ja - ga * t) / (ja * jb - t * t), step + 1 FROM (
    SELECT *, {_digamma('(a + b)')} - {_digamma('a')} + lx AS ga, {_digamma('(a + b)')} - {_digamma('b')} + ly AS gb, {_trigamma('(a + b)')} AS t, {_trigamma('(a + b)')} - {_trigamma('a')} AS ja, {_trigamma('(a + b)')} - {_trigamma('b')} AS jb FROM fit WHERE step < 60))
SELECT term, round(a, 6) AS a_mle, round(b, 6) AS b_mle FROM fit WHERE step = 60""")
def beta_mle(spark, sf_dir):
    return statistics.beta_summary(_units(spark, sf_dir), ["term"]).select("term", F.round("a_mle", 6).alias("a_mle"), F.round("b_mle", 6).alias("b_mle"))


@query()
def hdi(spark, sf_dir):
    return statistics.beta_summary(_units(spark, sf_dir), ["term"]).withColumn("hdi", statistics.hdi(F.col("a_mom"), F.col("b_mom"))).select("term", F.col("hdi.low").alias("low"), F.col("hdi.high").alias("high"))


#: Quantiles by adding up the density over angles t, with x = sin(t) ** 2, where it stays finite.
@query(f"""WITH {UNITS}, k AS (SELECT term, mean * (mean * (1 - mean) / v - 1) AS a, (1 - mean) * (mean * (1 - mean) / v - 1) AS b FROM m),
g AS (SELECT term, i, 2 * exp(lgamma(a + b) - lgamma(a) - lgamma(b)) * power(sin(pi() / 2 * (i - 0.5) / 20000), 2 * a - 1) * power(cos(pi() / 2 * (i - 0.5) / 20000), 2 * b - 1) * pi() / 2 / 20000 AS p FROM k, (SELECT unnest(range(1, 20001)) AS i)),
f AS (SELECT term, i, p, sum(p) OVER (PARTITION BY term ORDER BY i) AS f FROM g),
q AS (SELECT term, q, min_by(power(sin(pi() / 2 * (i - (f - q) / p) / 20000), 2), i) AS x FROM f, (SELECT unnest([0.025::DOUBLE, 0.975::DOUBLE]) AS q) WHERE f >= q GROUP BY ALL)
SELECT term, round(max(CASE WHEN q < 0.5 THEN x END), 3) AS low, round(max(CASE WHEN q > 0.5 THEN x END), 3) AS high FROM q GROUP BY term""")
def eti(spark, sf_dir):
    return statistics.beta_summary(_units(spark, sf_dir), ["term"]).withColumn("eti", statistics.eti(F.col("a_mom"), F.col("b_mom"))).select("term", F.round(F.col("eti.low"), 3).alias("low"), F.round(F.col("eti.high"), 3).alias("high"))


PRIOR = f"{inputs.RUNS}, c AS (SELECT term, sum(support_h1) AS h1, sum(support_h2) AS h2, count(*) FILTER (WHERE event_type = 'purchase') AS b, count(*) // 40 AS n FROM runs GROUP BY term), pr AS (SELECT term, greatest(coalesce((h1 + b / 2) * s, 0.01), 0.01) AS a, greatest(coalesce((h2 + b / 2) * s, 0.01), 0.01) AS b FROM (SELECT *, CASE WHEN n <= 50 THEN 1.0::DOUBLE ELSE n / nullif(h1 + h2 + b, 0) END AS s FROM c))"


def _priors(spark, sf_dir):
    rows = inputs.runs(spark, sf_dir).groupBy("term").agg(F.sum("support_h1").alias("h1"), F.sum("support_h2").alias("h2"), F.count_if(F.col("event_type") == "purchase").alias("b"), F.floor(F.count("*") / 40).alias("n"))
    a, b = statistics.prior(F.col("h1"), F.col("h2"), F.col("b"), F.col("n"))
    return rows.select("term", a.alias("prior_a"), b.alias("prior_b"))


@query(f"WITH {PRIOR} SELECT term, round(a, 6) AS prior_a, round(b, 6) AS prior_b FROM pr")
def beta_prior(spark, sf_dir):
    return _priors(spark, sf_dir).select("term", F.round("prior_a", 6).alias("prior_a"), F.round("prior_b", 6).alias("prior_b"))


def _posteriors(spark, sf_dir):
    both = statistics.beta_summary(_units(spark, sf_dir), ["term"]).join(_priors(spark, sf_dir), "term")
    a, b, mean = statistics.posterior(F.col("a_mom"), F.col("b_mom"), F.col("prior_a"), F.col("prior_b"))
    return both.select("term", a.alias("a"), b.alias("b"), mean.alias("mean"))


@query(f"""WITH {UNITS}, {PRIOR[len(inputs.RUNS) + 2 :]},
k AS (SELECT term, mean * (mean * (1 - mean) / v - 1) AS a0, (1 - mean) * (mean * (1 - mean) / v - 1) AS b0 FROM m)
SELECT term, round(a0 + a, 6) AS a, round(b0 + b, 6) AS b, round((a0 + a) / (a0 + a + b0 + b), 6) AS mean FROM k JOIN pr USING (term)""")
def posterior(spark, sf_dir):
    return _posteriors(spark, sf_dir).select("term", *[F.round(c, 6).alias(c) for c in ("a", "b", "mean")])


@query()
def posterior_summary(spark, sf_dir):
    return statistics.draw_summary(statistics.beta_draws(_posteriors(spark, sf_dir), ["term"], "a", "b", 1000, 7), ["term"])


POSTERIOR = f"""{UNITS}, {PRIOR[len(inputs.RUNS) + 2 :]},
k AS (SELECT term, mean * (mean * (1 - mean) / v - 1) AS a0, (1 - mean) * (mean * (1 - mean) / v - 1) AS b0 FROM m),
post AS (SELECT term, a0 + a AS a, b0 + b AS b FROM k JOIN pr USING (term))"""


@query(f"""WITH {POSTERIOR}, g AS (SELECT term, a, b, unnest(range(1, 500)) / 500 AS x FROM post)
SELECT term, round(x, 9) AS x, round(exp((a - 1) * ln(x) + (b - 1) * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)), 6) AS density FROM g""")
def beta_density(spark, sf_dir):
    return statistics.density_curve(_posteriors(spark, sf_dir), ["term"], 500).select("term", F.round("x", 9).alias("x"), F.round("density", 6).alias("density"))


@query(f"WITH {inputs.RUNS} SELECT event_id, CASE WHEN p = 0 THEN 300.0::DOUBLE ELSE round(-log10(p), 6) + 0.0::DOUBLE END AS neg_log10 FROM (SELECT event_id, TRY_CAST(score AS DOUBLE) / 100 AS p FROM runs)")
def stat_plot_series(spark, sf_dir):
    p = text.number(F.col("score")) / 100
    return inputs.runs(spark, sf_dir).select("event_id", F.round(text.neg_log10(p), 6).alias("neg_log10"))


CHAIN = f"""{inputs.PAIRS}, bc AS (SELECT b.token AS b_term, c.token AS c_term, count(*) AS bc_count FROM mention b JOIN mention c USING (pmid) WHERE b.token IN {tuple(inputs.B_TERMS)} AND c.token IN {tuple(inputs.C_TERMS)} GROUP BY ALL),
chains AS (SELECT p.a_term, p.b_term, c_term, a_count, b_count, ab_count, bc_count, n.n AS c_count FROM pairs p JOIN bc USING (b_term) JOIN n ON n.token = c_term WHERE ab_count > 0)"""


def _chains(spark, sf_dir):
    rows = inputs.articles(spark, sf_dir)
    ab = cooccurrence.pair_counts(rows, inputs.A_TERMS, inputs.B_TERMS).where("ab_count > 0")
    bc = cooccurrence.pair_counts(rows, inputs.B_TERMS, inputs.C_TERMS).where("ab_count > 0")
    bc = bc.select(F.col("a_term").alias("b_term"), F.col("b_term").alias("c_term"), F.col("b_count").alias("c_count"), F.col("ab_count").alias("bc_count"))
    return cooccurrence.chains(ab, bc).withColumn("bc_sort_ratio", cooccurrence.sort_ratio(F.col("bc_count"), F.col("c_count")))


@query(f"WITH {CHAIN} SELECT a_term, c_term, round(sum(bc_count / c_count), 9) AS ratio_sum, CAST(sum(bc_count) AS BIGINT) AS bc_sum, CAST(sum(b_count) AS BIGINT) AS b_sum, max(c_count) AS c_count FROM chains GROUP BY ALL")
def sums_by_c(spark, sf_dir):
    out = statistics.sums_by_c(_chains(spark, sf_dir), ["a_term", "c_term"])
    return out.select("a_term", "c_term", F.round("ratio_sum", 9).alias("ratio_sum"), "bc_sum", "b_sum", "c_count")


STEP = "ln({k} * (t - {x} - b_count + {k}) / nullif(({x} - {k}) * (b_count - {k}), 0))"
WIDTH = "1 / nullif({k}, 0) + 1 / nullif({x} - {k}, 0) + 1 / nullif(b_count - {k}, 0) + 1 / nullif(t - {x} - b_count + {k}, 0)"


@query(f"""WITH {CHAIN}, o AS (
  SELECT a_term, c_term, b_term, {STEP.format(k='ab_count', x='a_count')} + {STEP.format(k='bc_count', x='c_count')} AS log_odds, 2.576 * sqrt({WIDTH.format(k='ab_count', x='a_count')} + {WIDTH.format(k='bc_count', x='c_count')}) AS width
  FROM chains, (SELECT count(*) AS t FROM documents) WHERE ab_count > 2 AND bc_count > 2 AND ab_count * (t - a_count - b_count + ab_count) > 0 AND bc_count * (t - c_count - b_count + bc_count) > 0)
SELECT a_term, c_term, b_term, round(log_odds, 6) AS log_odds, round(log_odds - width, 6) AS low, round(log_odds + width, 6) AS high FROM o WHERE log_odds > 0 QUALIFY row_number() OVER (PARTITION BY a_term, c_term ORDER BY log_odds DESC, b_term DESC) = 1""")
def ci_or_chain(spark, sf_dir):
    total = inputs.table(spark, sf_dir, "documents").count()
    out = statistics.best_chain_intervals(_chains(spark, sf_dir), ["a_term", "c_term"], F.lit(total))
    return out.select("a_term", "c_term", "b_term", *[F.round(c, 6).alias(c) for c in ("log_odds", "low", "high")])


@query(f"""WITH {CHAIN}, s AS (SELECT a_term, c_term, sum(bc_count)::DOUBLE AS k, max(c_count)::DOUBLE AS c FROM chains GROUP BY ALL), w AS (
  SELECT a_term, max(CASE WHEN c_term = 'der' THEN k END) AS k1, max(CASE WHEN c_term = 'thin' THEN k END) AS k2, max(CASE WHEN c_term = 'der' THEN c END) AS c1, max(CASE WHEN c_term = 'thin' THEN c END) AS c2 FROM s GROUP BY a_term)
SELECT a_term, round((k1 - k2) * (c2 / c1), 6) AS difference, round_even(k2 * c1 / c2, 0) AS k2_normalised FROM w WHERE k1 IS NOT NULL AND k2 IS NOT NULL""")
def difference_of_sums(spark, sf_dir):
    sums = statistics.sums_by_c(_chains(spark, sf_dir), ["a_term", "c_term"])
    of = lambda t, c: F.max(F.when(F.col("c_term") == t, F.col(c)))
    w = sums.groupBy("a_term").agg(of("der", "bc_sum").alias("k1"), of("thin", "bc_sum").alias("k2"), of("der", "c_count").alias("c1"), of("thin", "c_count").alias("c2")).where("k1 IS NOT NULL AND k2 IS NOT NULL")
    c = [F.col(x) for x in ("k1", "k2", "c1", "c2")]
    return w.select("a_term", F.round(statistics.difference_of_sums(*c), 6).alias("difference"), statistics.normalised_count(c[1], c[2], c[3]).alias("k2_normalised"))


# ---- competition ----


@query(f"""WITH {inputs.RUNS}, s AS (SELECT user_id, censor_year, avg(TRY_CAST(score AS DOUBLE)) AS m, count(TRY_CAST(score AS DOUBLE)) AS n, sum(support_h1) > 0 AS s1, sum(support_h2) > 0 AS s2 FROM runs GROUP BY ALL)
SELECT user_id, censor_year, CASE WHEN n = 0 THEN 'error' WHEN abs(m - 50) <= 15 AND s1 AND s2 THEN 'tie' WHEN abs(m - 50) <= 15 AND s1 THEN 'term1' WHEN abs(m - 50) <= 15 AND s2 THEN 'term2' WHEN abs(m - 50) <= 15 THEN 'eliminated' WHEN m > 50 THEN 'term1' ELSE 'term2' END AS outcome FROM s""")
def pair_winner(spark, sf_dir):
    scored = competition.pair_scores(inputs.runs(spark, sf_dir), ["user_id", "censor_year"])
    return scored.select("user_id", "censor_year", competition.outcome(F.col("mean_score"), F.col("n_scores"), F.col("support1"), F.col("support2"), 15.0).alias("outcome"))


@query(f"WITH {inputs.RUNS} SELECT term, round(avg(TRY_CAST(score AS DOUBLE)), 6) AS mean_score, count(TRY_CAST(score AS DOUBLE)) AS n_scores, sum(support_h1) > 0 AS support1, sum(support_h2) > 0 AS support2 FROM runs GROUP BY term")
def pair_scores(spark, sf_dir):
    return competition.pair_scores(inputs.runs(spark, sf_dir), ["term"]).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {inputs.ORDERED} SELECT pos AS position_i, lead_pos AS position_j, term AS term_i, lead_term AS term_j FROM (SELECT *, lead(pos) OVER (ORDER BY pos) AS lead_pos, lead(term) OVER (ORDER BY pos) AS lead_term FROM ordered) WHERE pos % 2 = 1 AND lead_term IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    return competition.adjacent_pairs(inputs.ordered(spark, sf_dir), 1)


CHAINS = f"""{inputs.ORDERED}, {inputs.CACHE},
marked AS (SELECT o.pos, sum(CASE WHEN c.outcome = 'tie' THEN 0 ELSE 1 END) OVER (ORDER BY o.pos) AS island FROM (SELECT *, lag(term) OVER (ORDER BY pos) AS before FROM ordered) o LEFT JOIN cache c ON c.term_i = o.before AND c.term_j = o.term),
chains AS (SELECT min(pos) AS chain_start, max(pos) AS chain_end FROM marked GROUP BY island HAVING count(*) > 1)"""


@query(f"WITH {CHAINS} SELECT * FROM chains")
def frozen_chains(spark, sf_dir):
    return competition.frozen_chains(inputs.ordered(spark, sf_dir), inputs.cache(spark, sf_dir))


def _candidates(spark, sf_dir, kind):
    order, cache = inputs.ordered(spark, sf_dir), inputs.cache(spark, sf_dir)
    return competition.boundary_candidates(order, competition.frozen_chains(order, cache), cache, kind)


KNOWN = "known AS (SELECT term_i AS x, term_j AS y FROM cache UNION SELECT term_j, term_i FROM cache)"


@query(f"""WITH {CHAINS}, {KNOWN} SELECT chain_start, chain_end, max(o.pos) AS pos FROM chains JOIN ordered n ON n.pos = chain_start - 1 JOIN ordered o ON o.pos BETWEEN chain_start AND chain_end
WHERE NOT EXISTS (SELECT 1 FROM known WHERE x = o.term AND y = n.term) GROUP BY ALL""")
def escape_candidate(spark, sf_dir):
    return _candidates(spark, sf_dir, "escape")


@query(f"""WITH {CHAINS}, {KNOWN} SELECT chain_start, chain_end, min(o.pos) AS pos FROM chains JOIN ordered n ON n.pos = chain_end + 1 JOIN ordered o ON o.pos BETWEEN chain_start AND chain_end
WHERE NOT EXISTS (SELECT 1 FROM known WHERE x = o.term AND y = n.term) GROUP BY ALL""")
def downward_candidate(spark, sf_dir):
    return _candidates(spark, sf_dir, "validate")


RECORD = f"""{inputs.COMPARED}, sides AS (SELECT term_i AS term, outcome, 'term_i' AS own, status, mean_score FROM compared WHERE NOT from_cache UNION ALL SELECT term_j, outcome, 'term_j', status, 100 - mean_score FROM compared WHERE NOT from_cache),
record AS (SELECT term, count(*) FILTER (WHERE outcome = own) AS wins, count(*) FILTER (WHERE outcome = 'tie') AS ties, count(*) FILTER (WHERE outcome IN ('term_i', 'term_j') AND outcome <> own) AS losses, count(*) FILTER (WHERE outcome = 'no_evidence') AS no_evidence, count(*) FILTER (WHERE outcome = 'error') AS errors FROM sides GROUP BY term),
scores AS (SELECT term, count(mean_score) AS n_scores, avg(mean_score) AS mean_score FROM sides WHERE status = 'ok' AND mean_score IS NOT NULL GROUP BY term)"""


@query(f"WITH {RECORD} SELECT * FROM record")
def term_record(spark, sf_dir):
    return competition.records(inputs.compared(spark, sf_dir))


@query(f"WITH {RECORD} SELECT term, n_scores, round(mean_score, 6) AS mean_score FROM scores")
def term_scores(spark, sf_dir):
    return competition.term_scores(inputs.compared(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {RECORD} SELECT row_number() OVER (ORDER BY wins - losses DESC, term) - 1 AS pos, term FROM record")
def reseeded(spark, sf_dir):
    record = competition.records(inputs.compared(spark, sf_dir))
    order = record.select("term", F.row_number().over(_by("term")).alias("pos"))
    return competition.reseeded(order, record).select(F.col("pos").cast("long").alias("pos"), "term")


def _by(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


@query(f"""WITH {RECORD}, o AS (SELECT term, row_number() OVER (ORDER BY term) AS pos, CASE WHEN term = 't3' THEN 'errors' END AS reason FROM record)
SELECT row_number() OVER (ORDER BY reason IS NOT NULL, pos) AS rank, term, wins, ties, losses, round(mean_score, 6) AS mean_score, reason FROM o JOIN record USING (term) LEFT JOIN scores USING (term)""")
def final_ranking(spark, sf_dir):
    rows = inputs.compared(spark, sf_dir)
    record = competition.records(rows)
    order = record.select("term", F.row_number().over(_by("term")).alias("pos"))
    out = competition.final_ranking(order, record, competition.term_scores(rows), spark.createDataFrame([("t3", "errors")], "term string, reason string"))
    return out.withColumns({"rank": F.col("rank").cast("long"), "mean_score": F.round("mean_score", 6)})


def _judge(spark, sf_dir):
    """Scores pairs by the suppliers' balances: a stand-in for a model, whose verdict does not depend on the order of the pair."""
    balance = inputs.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("term"), F.col("s_acctbal").alias("v"))

    def judge(pairs):
        one, two = (balance.select(F.col("term").alias(f"term{k}"), F.col("v").alias(f"v{k}")) for k in (1, 2))
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + (F.col("v1") - F.col("v2")) / 100))
        return pairs.join(one, "term1").join(two, "term2").select("term1", "term2", score.alias("mean_score"), F.lit(1).alias("n_scores"), (F.col("v1") > -5000).alias("support1"), (F.col("v2") > -5000).alias("support2"))

    return judge


def _contenders(spark, sf_dir):
    return [r[0] for r in inputs.ordered(spark, sf_dir).orderBy("pos").select("term").collect()]


@query()
def tournament(spark, sf_dir):
    alive, history = competition.tournament(spark, _contenders(spark, sf_dir), _judge(spark, sf_dir), seed=1, threshold=1.0)
    rounds = max((h["round"] for h in history), default=0)
    return spark.createDataFrame([(t, rounds) for t in alive] or [("", rounds)], "term string, rounds int")


@query()
def ranking(spark, sf_dir):
    order, _, out, converged = competition.ranking(spark, _contenders(spark, sf_dir), _judge(spark, sf_dir), seed=1, threshold=0.5, presort=True, history=False)
    return spark.createDataFrame([(i + 1, t, out.get(t), converged) for i, t in enumerate(order)], "rank int, term string, reason string, converged boolean")


@query(f"WITH {inputs.COMPARED} SELECT round(avg(CASE WHEN term_i = 't1' THEN mean_score ELSE 100 - mean_score END), 6) AS mean_score, count(*) AS comparisons FROM compared WHERE (term_i = 't1' OR term_j = 't1') AND status = 'ok'")
def winner_summary(spark, sf_dir):
    rows = inputs.compared(spark, sf_dir)
    history = rows.select(F.col("event_id").alias("pair_id"), F.col("term_i").alias("term1"), F.col("term_j").alias("term2"), "status", "mean_score")
    cited = rows.select(F.col("event_id").alias("pair_id"), F.lit(0).alias("pos"), F.col("event_id").cast("string").alias("pmid"), F.array("outcome").alias("evidence"))
    overall, _ = reports.winner_summary(history, cited, "t1")
    return overall.withColumn("mean_score", F.round("mean_score", 6))


# ---- cost and service figures ----


@query("SELECT o_orderkey, CAST(least(o_custkey, 20) * 300 + floor(w * 4 / 3) + least(o_custkey // 3, 20) * 300 + CASE WHEN o_custkey % 4 > 0 THEN least(o_custkey % 4, 20) * 300 + floor(w * 4 / 3) ELSE 0 END AS BIGINT) AS tokens FROM (SELECT *, length(o_orderpriority) * 10 AS w FROM orders)")
def cost_input(spark, sf_dir):
    k = F.col("o_custkey")
    tokens = cost.input_tokens(k, F.length("o_orderpriority") * 10, 20, F.floor(k / 3), k % 4)
    return inputs.table(spark, sf_dir, "orders").select("o_orderkey", tokens.cast("long").alias("tokens"))


INTERVALS = [(1, 25, 300), (25, 50, 420), (51, 100, 700)]


@query(f"SELECT c_custkey, CASE WHEN n BETWEEN 1 AND 25 THEN 300 WHEN n BETWEEN 25 AND 50 THEN 420 ELSE 700 END AS output_tokens FROM (SELECT c_custkey, c_custkey % 130 AS n FROM customer)")
def cost_output(spark, sf_dir):
    intervals = spark.createDataFrame(INTERVALS, "start int, end int, tokens int")
    rows = inputs.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 130).alias("n"))
    return cost.output_tokens(rows, intervals, "n").select("c_custkey", "output_tokens")


@query(f"""WITH t AS ({' UNION ALL '.join(f"SELECT '{job}' AS job, '{family}' AS family, {list(tokens)} AS tokens" for (job, family), tokens in cost.OUTPUT_TOKENS.items())}),
m AS (SELECT * FROM (VALUES ('o1', 'o1'), ('r1', 'r1'), ('o3-mini', 'o3'), ('gpt-5', 'gpt-5'), ('odd', 'o1')) v(model, family))
SELECT job, model, CAST(sum(tokens[CAST(CASE WHEN n > 200 THEN 8 ELSE greatest(1, ceil(n / 25)) END AS INT)]) AS BIGINT) AS tokens FROM (SELECT c_custkey % 230 AS n FROM customer), t JOIN m USING (family) GROUP BY ALL""")
def cost_families(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 230).alias("n"))
    parts = [cost.output_tokens(rows, cost.output_intervals(spark, job, model), "n").agg(F.sum("output_tokens").alias("tokens")).select(F.lit(job).alias("job"), F.lit(model).alias("model"), "tokens") for job in ("pairs", "chains") for model in ("o1", "r1", "o3-mini", "gpt-5", "odd")]
    return selection.union_all(*parts)


@query("""SELECT model, round(sum(o_custkey * 300) / 1e6 * price * 3 * 35, 4) AS dollars FROM orders,
  (SELECT * FROM (VALUES ('o1', 15.0::DOUBLE), ('o3', 2.0), ('unknown', 1.1)) t(model, price)) GROUP BY model, price""")
def cost_total(spark, sf_dir):
    tokens = inputs.table(spark, sf_dir, "orders").agg(F.sum(F.col("o_custkey") * cost.TOKENS_PER_ABSTRACT).alias("tokens"))
    years = cost.censor_years(spark, 1990, 2025).count()
    models = spark.createDataFrame([("o1",), ("o3",), ("unknown",)], "model string")
    return tokens.crossJoin(models).select("model", F.round(cost.total(cost.dollars(F.col("tokens"), cost.price_of(F.col("model"), 0)), 3, years), 4).alias("dollars"))


@query("SELECT CAST(y - 4 AS INT) AS lower, CAST(y AS INT) AS upper FROM (SELECT unnest(range(1990, 2020, 3)) AS y)")
def censor_years(spark, sf_dir):
    return cost.censor_years(spark, 1990, 2020, 3, 5)


@query("""WITH c AS (SELECT user_id % 4 AS workers, epoch_us(ts) / 1e6 AS started, epoch_us(ts) / 1e6 + value AS finished, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'http_5xx' WHEN 'click' THEN 'other' ELSE 'ok' END AS class FROM events)
SELECT workers, round(max(finished) - min(started), 3) AS elapsed_s, round(count(*) / (max(finished) - min(started)), 9) AS throughput_rps, round(avg(finished - started), 4) AS avg_latency_s,
  count(*) FILTER (WHERE class = 'ok') AS n_ok, count(*) FILTER (WHERE class = 'timeout') AS n_timeout, 0::BIGINT AS n_kv_exhausted, count(*) FILTER (WHERE class = 'http_5xx') AS n_http_5xx, count(*) FILTER (WHERE class = 'other') AS n_other FROM c GROUP BY workers""")
def bench_summary(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", "Read timed out").when(F.col("event_type") == "signup", "bad gateway").when(F.col("event_type") == "click", "odd")
    started = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = inputs.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("workers"), started.alias("started"), (started + F.col("value")).alias("finished"), text.error_class(error, F.when(F.col("event_type") == "signup", 502)).alias("class"))
    out = reports.bench_summary(rows, ["workers"])
    return out.withColumns({"elapsed_s": F.round("elapsed_s", 3), "throughput_rps": F.round("throughput_rps", 9), "avg_latency_s": F.round("avg_latency_s", 4)})


def _merged(ratio: float, cited: str, recent: str) -> str:
    """SQL of interleaved(): cited and recent are the turns of the i-th article of either list, as (turn, side) in order."""
    return f"""WITH c AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS i FROM (SELECT DISTINCT user_id, event_id % 50 AS k FROM events)),
r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) - 1 AS i FROM (SELECT DISTINCT user_id, event_id % 31 AS k FROM events)),
f AS (SELECT user_id, k, min((turn, side, i)) AS slot FROM (SELECT user_id, k, {cited}, i FROM c UNION ALL SELECT user_id, k, {recent}, i FROM r) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS place FROM f)
SELECT user_id, {ratio} AS ratio, string_agg(CAST(k AS VARCHAR), ',' ORDER BY place) AS merged FROM n WHERE place <= 20 GROUP BY user_id"""


#: (turn, side) of the i-th cited and recent article: two cited ones before each but the first recent one, and so on.
INTERLEAVED = {2.0: ("i // 2 + 1 AS turn, 0 AS side", "i AS turn, 1 AS side"), 0.5: ("i AS turn, 1 AS side", "i // 2 + 1 AS turn, 0 AS side"), 1.0: ("i AS turn, 0 AS side", "i AS turn, 1 AS side")}


@query(" UNION ALL ".join(f"SELECT user_id, CAST(ratio AS DOUBLE) AS ratio, merged FROM ({_merged(ratio, *turns)})" for ratio, turns in INTERLEAVED.items()))
def interleave_exact(spark, sf_dir):
    lists = inputs.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 50)).alias("cited"), F.sort_array(F.collect_set(F.col("event_id") % 31), asc=False).alias("recent"))
    parts = [lists.select("user_id", F.lit(ratio).alias("ratio"), F.array_join(selection.interleave(F.col("cited"), F.col("recent"), ratio, 20).cast("array<string>"), ",").alias("merged")) for ratio in INTERLEAVED]
    return selection.union_all(*parts)


@query("SELECT user_id, fingerprint FROM (SELECT user_id, substring(sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY md5(concat_ws(':', '5', CAST(event_id AS VARCHAR))))), 1, 8) AS fingerprint FROM events GROUP BY user_id)")
def seeded_shuffle(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct(selection.shuffle_key(5, F.col("event_id")).alias("k"), F.col("event_id").cast("string").alias("id"))))
    lists = inputs.table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))
    return lists.select("user_id", text.fingerprint(F.col("ids")).alias("fingerprint"))
