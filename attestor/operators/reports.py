"""Summaries of scores over runs, years, clusters and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import number


def evidence_by_pmid(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (keys, pos, pmid, evidence) merged by article: its distinct evidence in order, and how often it was judged."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "evidence")))
    merged = F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["evidence"])))
    return entries.groupBy(*keys, "pmid").agg(merged.alias("evidence"), F.count("*").alias("times"), F.min("pos").alias("first_pos"))


def cell_type_summary(rows: DataFrame, cluster: str = "cluster", cell_type: str = "cell_type") -> DataFrame:
    """Mean of the scores other than 0, the genes that support and refute, sorted; "none" where there are none."""

    def genes(which: Column) -> Column:
        found = F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("gene")))), ", ")
        return F.coalesce(F.nullif(found, F.lit("")), F.lit("none"))

    score = number(F.col("score"))
    return rows.groupBy(cluster, cell_type).agg(F.avg(F.when(score != 0, score)).alias("mean_score"), genes(score > 0).alias("supporting"), genes(score < 0).alias("refuting"), F.count(score).alias("n_scores"))


def merged_runs(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Of each key the scores of all its runs in order of time, and its genes."""
    in_time = F.array_sort(F.collect_list(F.struct(time, "score")))
    return rows.groupBy(*keys).agg(F.transform(in_time, lambda x: x["score"]).alias("scores"), F.array_sort(F.collect_set("gene")).alias("genes"))


def year_means(rows: DataFrame, keys: list[str], values: list[str], spread: str | None = None, firsts: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Means of the values, the variance of one of them, and the first value by `order` of further columns."""
    extra = [F.var_samp(spread).alias(f"{spread}_variance")] if spread else []
    extra += [F.min_by(f, order).alias(f"{f}_first") for f in firsts or []]
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_mean") for v in values], *extra)


def years_merged(by_year: dict[int, DataFrame]) -> DataFrame:
    """Results of several censor years as one table."""
    out = None
    for year, rows in sorted(by_year.items()):
        part = rows.withColumn("censor_year", F.lit(year))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pivot_years(rows: DataFrame, year: str, term: str, value: str, terms: list[str]) -> DataFrame:
    """A column for each of the given terms, 0 where a year has none."""
    return rows.groupBy(year).pivot(term, terms).agg(F.sum(value)).na.fill(0)


def winner_summary(history: DataFrame, payloads: DataFrame, winner: str) -> tuple[DataFrame, DataFrame]:
    """Of a winner: its score over all comparisons, and the evidence that was cited, merged by article.

    history(pair_id, term1, term2, status, mean_score), payloads(pair_id, pos, pmid, evidence).
    """
    own = history.where(((F.col("term1") == winner) | (F.col("term2") == winner)) & (F.col("status") == "ok"))
    score = F.when(F.col("term1") == winner, F.col("mean_score")).otherwise(100 - F.col("mean_score"))
    overall = own.agg(F.avg(score).alias("mean_score"), F.count("*").alias("comparisons"))
    evidence = evidence_by_pmid(payloads.join(own.select("pair_id"), "pair_id", "left_semi").withColumn("winner", F.lit(winner)), ["winner"])
    return overall, evidence


def bench_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """elapsed, throughput, mean latency and errors by class of request rows (started, finished, class)."""
    elapsed = F.max("finished") - F.min("started")
    return rows.groupBy(*keys).agg(
        elapsed.alias("elapsed_s"),
        (F.count("*") / F.nullif(elapsed, F.lit(0.0))).alias("throughput_rps"),
        F.avg(F.col("finished") - F.col("started")).alias("avg_latency_s"),
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("ok", "timeout", "kv_exhausted", "http_5xx", "other")],
    )
