"""What judging a table of pairs would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: US dollars for a million input and output tokens.
PRICES = (
    ("o1", 15.00, 60.00),
    ("o1-mini", 1.10, 4.40),
    ("o3", 2.00, 8.00),
    ("o3-mini", 1.10, 4.40),
    ("gpt-5", 1.25, 10.00),
    ("r1", 0.55, 2.19),
)
DEFAULT_PRICE = (1.10, 4.40)
TOKENS_PER_ABSTRACT = 300


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


def price_of(model: Column, side: int) -> Column:
    out = F.lit(DEFAULT_PRICE[side])
    for row in PRICES:
        out = F.when(model == row[0], row[1 + side]).otherwise(out)
    return out


def dollars(tokens: Column, price: Column) -> Column:
    return tokens / 1e6 * price


def pool_tokens(count: Column, post_n: int) -> Column:
    return F.least(count, F.lit(post_n)) * TOKENS_PER_ABSTRACT


def prompt_tokens(words: Column) -> Column:
    return F.floor(words * 4 / 3)


def input_tokens(ab: Column, words: Column, post_n: int, bc: Column | None = None, ac: Column | None = None) -> Column:
    """Of a pair, or with bc (and ac where it is not empty) of a chain."""
    out = pool_tokens(ab, post_n) + prompt_tokens(words)
    if bc is not None:
        out = out + pool_tokens(bc, post_n)
    if ac is not None:
        out = out + F.when(ac > 0, pool_tokens(ac, post_n) + prompt_tokens(words)).otherwise(0)
    return out


#: Output tokens for up to 25, 50, ..., 200 articles, by kind of job and family of models.
OUTPUT_TOKENS = {
    ("pairs", "o1"): (4400, 4600, 4800, 5000, 5200, 5400, 5600, 5800),
    ("pairs", "r1"): (780, 850, 920, 990, 1060, 1130, 1200, 1270),
    ("pairs", "o3"): (152500, 305000, 457500, 610000, 762500, 915000, 1067500, 1220000),
    ("pairs", "gpt-5"): (800, 900, 1000, 1100, 1200, 1300, 1400, 1500),
    ("chains", "o1"): (8500, 9800, 11000, 12300, 13600, 14800, 16000, 17400),
    ("chains", "r1"): (2690, 5710, 8730, 11750, 14770, 17790, 20810, 23830),
    ("chains", "o3"): (152500, 305000, 457500, 610000, 762500, 915000, 1067500, 1220000),
    ("chains", "gpt-5"): (1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600),
}
FAMILIES = {"r1": "r1", "gpt-5": "gpt-5", "o3": "o3", "o3-mini": "o3"}


def output_intervals(spark: SparkSession, job: str, model: str) -> DataFrame:
    """The price list (start, end, tokens) of a kind of job and a model; models of no family count as o1."""
    tokens = OUTPUT_TOKENS[job, FAMILIES.get(model, "o1")]
    return spark.createDataFrame([(25 * i, 25 * i + 25, t) for i, t in enumerate(tokens)], "start int, end int, tokens int")


#: Rows of a price list at most.
PRICE_LIST = 1000


def output_tokens(rows: DataFrame, intervals: DataFrame, count: str) -> DataFrame:
    """rows with the tokens of the first interval (start, end, tokens), ends included, that holds their count; of the last where none does.

    intervals is a price list: it becomes part of an expression, and one that is too long for that is an error.
    """
    listed = sorted(tuple(r) for r in intervals.select("start", "end", "tokens").limit(PRICE_LIST + 1).collect())
    if not 0 < len(listed) <= PRICE_LIST:
        raise ValueError(f"a price list has 1 to {PRICE_LIST} rows")
    each = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("tokens")) for a, b, t in listed])
    first = F.get(F.filter(each, lambda x: F.col(count).between(x["start"], x["end"])), F.lit(0))
    return rows.withColumn("output_tokens", F.coalesce(first["tokens"], F.lit(listed[-1][2])))


def total(per_iteration: Column, n_iterations: int, n_years: int = 1) -> Column:
    return per_iteration * n_iterations * n_years


def censor_years(spark: SparkSession, lower: int, upper: int, step: int = 1, depth: int = 0) -> DataFrame:
    """(lower, upper) of each step of a year sweep, upper excluded; with a depth, windows of so many years, else open downwards."""
    years = spark.range(1).select(F.explode(F.sequence(F.lit(lower), F.lit(upper - 1), F.lit(step))).alias("upper"))
    return years.select((F.col("upper") - (depth - 1) if depth else F.lit(0)).alias("lower"), "upper")
