"""Term mentions, co-occurrence counts, contingency tests and two-hop chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.special import fisher_greater_p
from attestor.functions.terms import alternatives


def mentions(articles: DataFrame, text: str = "abstract") -> DataFrame:
    """Distinct (token, pmid): lower-cased runs of the letters a to z. Repeats within an article are removed before any shuffle."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z]+"))
    return articles.select("pmid", F.explode(words).alias("token")).where("token <> ''").select("token", "pmid")


def term_mentions(mention: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (term, pmid) for terms(term) with synonyms and conjunctions: an article has a term if it has all words of one
    of its alternatives. Words of more than one letter run must be given as conjunctions."""
    wanted = terms.select("term", F.posexplode(alternatives(F.col("term"))).alias("alternative", "words"))
    needed = wanted.select("term", "alternative", F.size(F.array_distinct("words")).alias("needed"), F.explode(F.array_distinct("words")).alias("token"))
    hits = mention.join(needed, "token").groupBy("term", "alternative", "pmid").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    return hits.where("n = needed").select("term", "pmid").distinct()


def censored(articles: DataFrame, lower: int, upper: int) -> DataFrame:
    """Articles of the years lower to upper; an unknown year is 0."""
    return articles.where(F.coalesce("pub_year", F.lit(0)).between(lower, upper))


def term_counts(mention: DataFrame, terms: list[str]) -> DataFrame:
    return mention.where(F.col("token").isin(terms)).groupBy("token").agg(F.count("*").alias("n"))


def _asked(articles: DataFrame, terms: list[str], text: str) -> Column:
    """The asked terms that an article has, each once."""
    return F.array_intersect(F.split(F.lower(F.col(text)), "[^a-z]+"), F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))


def pair_counts(articles: DataFrame, a_terms: list[str], b_terms: list[str], text: str = "abstract") -> DataFrame:
    """Every pair of an A and a B term: a_count, b_count, ab_count; 0 where they never meet.

    One scan and one aggregation: each article gives the asked terms and pairs of terms that it has, which are counted
    before they are shuffled. articles has one row for each article.
    """
    spark = articles.sparkSession
    none = F.lit("")
    has = articles.select(_asked(articles, [*a_terms, *b_terms], text).alias("tokens")).where(F.size("tokens") > 0)

    def of(terms: list[str]) -> Column:
        return F.array_intersect("tokens", F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))

    single = F.transform("tokens", lambda t: F.struct(t.alias("x"), none.alias("y")))
    both = F.flatten(F.transform(of(a_terms), lambda a: F.transform(of(b_terms), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    counts = has.select(F.inline(F.concat(single, both))).groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = spark.createDataFrame([(a, b) for a in dict.fromkeys(a_terms) for b in dict.fromkeys(b_terms)], "a_term string, b_term string")
    sides = F.array(F.struct(F.col("a_term").alias("x"), none.alias("y"), F.lit("a").alias("side")), F.struct(F.col("b_term").alias("x"), none.alias("y"), F.lit("b").alias("side")), F.struct(F.col("a_term").alias("x"), F.col("b_term").alias("y"), F.lit("ab").alias("side")))
    asked = pairs.select("a_term", "b_term", F.inline(sides))
    of_side = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).alias(f"{side}_count")
    return asked.join(counts, ["x", "y"], "left").groupBy("a_term", "b_term").agg(*map(of_side, ("a", "b", "ab")))


def pair_articles(articles: DataFrame, a_terms: list[str], b_terms: list[str], text: str = "abstract") -> DataFrame:
    """Rows (a_term, b_term, pmid) of the articles that have both; a map over the articles."""
    of = lambda terms: F.array_intersect("tokens", F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))
    has = articles.select("pmid", _asked(articles, [*a_terms, *b_terms], text).alias("tokens"))
    return has.select("pmid", F.explode(of(a_terms)).alias("a_term"), of(b_terms).alias("bs")).select("a_term", F.explode("bs").alias("b_term"), "pmid")


def sort_ratio(both: Column, single: Column) -> Column:
    return both / F.nullif(single, F.lit(0))


def with_fisher(pairs: DataFrame, total: int) -> DataFrame:
    """pairs with sort_ratio and the one-sided Fisher p-value of each."""
    n = F.lit(total).cast("double")
    return pairs.withColumns({"sort_ratio": sort_ratio(F.col("ab_count"), F.col("b_count")), "p_value": fisher_greater_p(F.col("ab_count").cast("double"), F.col("a_count").cast("double"), F.col("b_count").cast("double"), n)})


def significant(pairs: DataFrame, threshold: float, terms: list[str] | None = None, p: str = "p_value", term: str = "b_term") -> DataFrame:
    kept = pairs.where(F.col(p) < threshold)
    return kept.where(F.col(term).isin(terms)) if terms is not None else kept


def chains(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """A-B-C paths: ab(a_term, b_term, ab_count, ...) and bc(b_term, c_term, bc_count, ...) joined on B."""
    return ab.join(bc, "b_term")


def best_chain(paths: DataFrame, by: Column, keys: list[str]) -> DataFrame:
    """Of each key the path with the largest value; ties go to the first B term."""
    return paths.withColumn("chain_value", by).groupBy(*keys).agg(F.max(F.struct("chain_value", F.struct(*[F.col(c) for c in paths.columns if c not in keys]))).alias("best")).select(*keys, "best.chain_value", "best.col2.*")


def top(hits: DataFrame, n: int, by: str, keys: list[str], rank: str) -> DataFrame:
    """The n rows of each key with the greatest `by`, ranked, ties by pmid. As the rank is limited, each task keeps n rows of a key before any shuffle."""
    ranked = hits.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), "pmid")))
    return ranked.where(F.col(rank) <= n)


def top_cited_and_recent(hits: DataFrame, n_cited: int, n_recent: int, keys: list[str]) -> DataFrame:
    """The n most cited and the n most recent articles of each key, without repeats; hits has citations, pub_year and pmid."""
    cited, recent = top(hits, n_cited, "citations", keys, "_rank").drop("_rank"), top(hits, n_recent, "pub_year", keys, "_rank").drop("_rank")
    return cited.unionByName(recent).dropDuplicates([*keys, "pmid"])


def year_series(articles: DataFrame, a_terms: list[str], b_terms: list[str], years: list[int], text: str = "abstract") -> DataFrame:
    """(date, a_term, b_term, a_count, b_count, ab_count, total_count) of every pair, for articles up to each year.

    One scan and one aggregation with a row for each year: an article counts for the years from its own on.
    """
    terms = list(dict.fromkeys([*a_terms, *b_terms]))
    words = F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z]+"))
    has = articles.select(F.coalesce("pub_year", F.lit(0)).alias("pub_year"), *[F.coalesce(F.array_contains(words, t), F.lit(False)).alias(f"has_{i}") for i, t in enumerate(terms)])
    own = F.filter(F.array(*[F.lit(y) for y in sorted(years)]), lambda y: y >= F.col("pub_year"))
    dated = has.withColumn("date", F.explode(own))
    pairs = [(terms.index(a), terms.index(b)) for a in dict.fromkeys(a_terms) for b in dict.fromkeys(b_terms)]
    summed = dated.groupBy("date").agg(F.count("*").alias("total"), *[F.count_if(f"has_{i}").alias(f"n_{i}") for i in range(len(terms))], *[F.count_if(F.col(f"has_{a}") & F.col(f"has_{b}")).alias(f"n_{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(terms[a]).alias("a_term"), F.lit(terms[b]).alias("b_term"), F.col(f"n_{a}").alias("a_count"), F.col(f"n_{b}").alias("b_count"), F.col(f"n_{a}_{b}").alias("ab_count"), F.col("total").alias("total_count")) for a, b in pairs])
    return summed.select("date", F.inline(rows))
