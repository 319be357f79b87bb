"""The whole pair analysis as one plan: counts, test, filter, order, articles, relevance, ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import cooccurrence, relevance
from attestor.plans import inputs
from attestor.plans.registry import query


def pair_evidence(articles: DataFrame, relevant: DataFrame, a_terms: list[str], b_terms: list[str], *, threshold: float, lower: int, upper: int) -> DataFrame:
    """A row for each pair whose one-sided Fisher p-value is below the threshold: counts, sort ratio, articles in the
    window of years, and the share of them that relevant(pmid) has."""
    total = articles.count()
    kept = cooccurrence.significant(cooccurrence.with_fisher(cooccurrence.pair_counts(articles, a_terms, b_terms), total), threshold).where("ab_count > 0")
    places = cooccurrence.pair_articles(cooccurrence.censored(articles, lower, upper), a_terms, b_terms)
    masked = places.join(relevant.select("pmid", F.lit(1).alias("mask")).distinct(), "pmid", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    ratios = relevance.relevance_ratio(masked, ["a_term", "b_term"])
    return kept.join(ratios, ["a_term", "b_term"], "left").select("a_term", "b_term", "a_count", "b_count", "ab_count", F.round("sort_ratio", 9).alias("sort_ratio"), F.coalesce("total", F.lit(0)).alias("in_window"), F.coalesce("relevant", F.lit(0)).alias("relevant"), F.round(F.coalesce("ratio", F.lit(0.0)), 9).alias("ratio"))


@query(f"""WITH {inputs.PAIRS}, {inputs.FISHER}, w AS (
  SELECT a.token AS a_term, b.token AS b_term, count(*) AS in_window, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS relevant
  FROM mention a JOIN mention b USING (pmid) LEFT JOIN labels l ON l.doc_id = pmid WHERE a.token = 'that' AND b.token IN {tuple(inputs.B_TERMS)} AND 1975 + pmid % 50 BETWEEN 1980 AND 2015 GROUP BY ALL)
SELECT a_term, b_term, a_count, b_count, ab_count, round(ab_count / nullif(b_count, 0), 9) AS sort_ratio, coalesce(in_window, 0) AS in_window, coalesce(relevant, 0) AS relevant, round(coalesce(relevant / in_window, 0), 9) AS ratio
FROM fet LEFT JOIN w USING (a_term, b_term) WHERE a_term = 'that' AND p < 0.999 AND ab_count > 0""")
def km_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inputs.table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("pmid"))
    return pair_evidence(inputs.articles(spark, sf_dir), labels, ["that"], inputs.B_TERMS, threshold=0.999, lower=1980, upper=2015)
