"""Tests on contingency tables of two terms, and Beta summaries of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.special import beta_density, beta_interval_eti, beta_interval_hdi, beta_mle_fit, erfc

#: Fixed value: the 99 % quantile used for intervals of odds ratios.
Z99 = 2.576


def _d(c: Column) -> Column:
    return c.cast("double")


def z_statistic(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-sample z of proportions k1 / n1 and k2 / n2."""
    p = (_d(k1) + k2) / (_d(n1) + n2)
    return (_d(k1) / n1 - _d(k2) / n2) / F.sqrt(p * (1 - p) * (1 / _d(n1) + 1 / _d(n2)))


def z_p_value(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def chi_square_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table [[a, b], [c, d]] with the correction for continuity."""
    n = _d(a) + b + c + d
    off = F.greatest(F.lit(0.0), F.abs(_d(a) * d - _d(b) * c) - n / 2)
    return n * off * off / ((_d(a) + b) * (_d(c) + d) * (_d(a) + c) * (_d(b) + d))


def chi_square_p_value(x: Column) -> Column:
    return erfc(F.sqrt(x / 2))


def cells(a: Column, b: Column, ab: Column, total: Column) -> tuple[Column, Column, Column, Column]:
    """The 2 x 2 table of articles with both terms, only A, only B, neither."""
    return _d(ab), _d(a) - ab, _d(b) - ab, _d(total) - a - b + ab


def odds_ratio(a: Column, b: Column, ab: Column, total: Column) -> Column:
    both, only_a, only_b, rest = cells(a, b, ab, total)
    return both * rest / F.nullif(only_a * only_b, F.lit(0.0))


def odds_interval(a: Column, b: Column, ab: Column, total: Column, scale: str = "log") -> tuple[Column, Column]:
    """The 99 % interval of the odds ratio on the log scale, or with scale "plain" around the ratio itself."""
    both, only_a, only_b, rest = cells(a, b, ab, total)
    width = F.lit(Z99) * F.sqrt(1 / F.nullif(both, F.lit(0.0)) + 1 / F.nullif(only_a, F.lit(0.0)) + 1 / F.nullif(only_b, F.lit(0.0)) + 1 / F.nullif(rest, F.lit(0.0)))
    value = odds_ratio(a, b, ab, total)
    return (value - width, value + width) if scale == "plain" else (value * F.exp(-width), value * F.exp(width))


def disjoint_p(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """0.01 where two 99 % intervals do not meet, else 1."""
    return F.when((low1 > high2) | (high1 < low2), 0.01).otherwise(1.0)


def year_sentinel(terms: Column, n_lines: Column, n_terms: Column) -> Column:
    """NOLINES for a year without lines, ONLY1 for one with a single line or term, else null."""
    return F.when(n_lines == 0, "NOLINES").when((n_lines == 1) | (n_terms == 1), "ONLY1")


#: Shuffled values that a permutation test holds at once.
SHUFFLED = 1 << 20


def _beyond(x: np.ndarray, y: np.ndarray, n: int, seed: int, statistic: str, split: str) -> tuple[float | None, float | None]:
    """The observed difference or ratio of the sums of two lists, and the share of n shuffles that are as far out."""
    if not len(x) + len(y):
        return None, None
    a, b = x.sum(), y.sum()
    if statistic == "ratio":
        observed = a / b if b else None
    else:
        observed = a - b
    if observed is None:
        return None, None
    every, rng, count = np.concatenate([x, y]), np.random.default_rng(seed), 0
    size = max(1, SHUFFLED // len(every))
    for first in range(0, n, size):
        m = min(size, n - first)
        sums = np.zeros((m, len(every) + 1))
        np.cumsum(rng.permuted(np.tile(every, (m, 1)), axis=1), axis=1, out=sums[:, 1:])
        cut = rng.integers(0, len(every) + 1, m) if split == "random" else np.full(m, len(x))
        head = sums[np.arange(m), cut]
        rest = sums[:, -1] - head
        if statistic == "ratio":
            value = np.divide(head, rest, out=np.full(m, observed), where=rest != 0)  # a sum of 0 counts as the observed ratio
            count += int((value >= observed).sum())
        else:
            count += int((head - rest >= observed).sum() if observed >= 0 else (head - rest <= observed).sum())
    return float(observed), count / n


def permutation_test(groups: DataFrame, keys: list[str], n: int = 10_000, seed: int = 0, statistic: str = "difference", split: str = "random") -> DataFrame:
    """(keys, observed, p_value) for rows (keys, list1, list2): how often a shuffle of both lists parts into sums whose
    difference, or ratio, is at least as far out, on the side of the observed one.

    Each shuffle is cut at a random place, also at its ends; with split "fixed" where the first list ends. A null list, or
    null in a list, is nothing; two empty lists, or a ratio to a sum of 0, give nulls.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields if f.name in keys)

    def values(x) -> np.ndarray:
        given = np.asarray([] if x is None else list(x), dtype=float)
        return given[~np.isnan(given)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_beyond(values(x), values(y), n, seed, statistic, split) for x, y in zip(batch["list1"], batch["list2"], strict=True)]
            yield batch[keys].assign(observed=pd.Series([o for o, _ in found], dtype=float, index=batch.index), p_value=pd.Series([p for _, p in found], dtype=float, index=batch.index))

    return groups.mapInPandas(run, f"{fields}, observed double, p_value double")


def unit_scores(rows: DataFrame, keys: list[str], score: str = "score", order: str = "iteration") -> DataFrame:
    """Scores from 0..100 to 0..1, missing ones as 0.5; where all of a key's scores are equal, the first goes up by 0.01 and the second down."""
    w, o = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    scaled = rows.withColumn("x", F.coalesce(F.col(score) / 100, F.lit(0.5)))
    marked = scaled.withColumns({"_low": F.min("x").over(w), "_high": F.max("x").over(w), "_n": F.row_number().over(o)})
    shift = F.when(F.col("_low") != F.col("_high"), 0.0).when(F.col("_n") == 1, 0.01).when(F.col("_n") == 2, -0.01).otherwise(0.0)
    return marked.withColumn("x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x") + shift))).drop("_low", "_high", "_n")


def beta_moments(mean: Column, variance: Column) -> tuple[Column, Column]:
    """Beta parameters with this mean and variance; both stay above 0, also for means of 0 and 1 and no variance."""
    tiny = F.lit(1e-22)
    m, v = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), mean)), F.greatest(F.coalesce(variance, F.lit(1e-6)), F.lit(1e-6))
    common = m * (1 - m) / v - 1
    return F.greatest(m * common, tiny), F.greatest((1 - m) * common, tiny)


#: How far from 0 and 1 scores are kept for a maximum-likelihood fit: the figures of the interval, and of the violin plot.
CLIP, VIOLIN_CLIP = 1e-10, 1e-9


def beta_summary(units: DataFrame, keys: list[str], x: str = "x", clip: float = CLIP) -> DataFrame:
    """mean, variance, and Beta parameters by moments (a_mom, b_mom) and by maximum likelihood (a_mle, b_mle) of each key."""
    inside = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), F.col(x)))
    stats = units.groupBy(*keys).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.avg(F.log(inside)).alias("_l"), F.avg(F.log1p(-inside)).alias("_m"))
    a, b = beta_moments(F.col("mean"), F.col("variance"))
    withs = stats.withColumns({"a_mom": a, "b_mom": b})
    fit = beta_mle_fit("_l", "_m", F.least(F.greatest("a_mom", F.lit(0.05)), F.lit(1e4)), F.least(F.greatest("b_mom", F.lit(0.05)), F.lit(1e4)))
    return withs.withColumn("_fit", fit).select(*keys, "mean", "variance", "a_mom", "b_mom", F.col("_fit.a").alias("a_mle"), F.col("_fit.b").alias("b_mle"))


def prior(h1: Column, h2: Column, both: Column, n: Column, few: int = 50) -> tuple[Column, Column]:
    """Prior counts of H1 and H2: as they are up to `few` abstracts, else as shares of n; "both" counts half for each."""
    total = F.nullif(_d(h1) + h2 + both, F.lit(0.0))
    scale = F.when(n <= few, 1.0).otherwise(n / total)
    floor = F.lit(0.01)
    return (F.greatest(F.coalesce((h1 + both / 2) * scale, floor), floor), F.greatest(F.coalesce((h2 + both / 2) * scale, floor), floor))


def posterior(a: Column, b: Column, prior_a: Column, prior_b: Column) -> tuple[Column, Column, Column]:
    """Parameters and mean of the posterior."""
    return a + prior_a, b + prior_b, (a + prior_a) / (a + prior_a + b + prior_b)


def hdi(a: Column, b: Column, mass: float = 0.95) -> Column:
    return beta_interval_hdi(a, b, F.lit(mass))


def eti(a: Column, b: Column, mass: float = 0.95) -> Column:
    return beta_interval_eti(a, b, F.lit(mass))


def beta_draws(rows: DataFrame, keys: list[str], a: str, b: str, n: int = 1000, seed: int | None = None) -> DataFrame:
    """n draws (keys, draw, value) from each row's Beta distribution; with a seed each row's draws depend on it and the keys alone."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                own = None if seed is None else [seed, *f"{[r[k] for k in keys]}".encode()]
                values = np.random.default_rng(own).beta(r[a], r[b], n)
                yield pd.DataFrame({**{k: [r[k]] * n for k in keys}, "draw": np.arange(1, n + 1), "value": values})

    return rows.mapInPandas(run, f"{fields}, draw int, value double")


def draw_summary(draws: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(F.avg("value").alias("mean"), q.alias("q")).select(*keys, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def density_curve(rows: DataFrame, keys: list[str], points: int = 500, a: str = "a", b: str = "b") -> DataFrame:
    """(keys, x, density) of each row's Beta distribution at x = 1 / points, ..., 1 - 1 / points."""
    at = rows.select(*keys, a, b, F.explode(F.transform(F.sequence(F.lit(1), F.lit(points - 1)), lambda i: i / points)).alias("x"))
    return at.select(*keys, "x", beta_density(F.col("x"), F.col(a), F.col(b)).alias("density"))


def kernel_density(draws: DataFrame, keys: list[str], points: int = 500, value: str = "value") -> DataFrame:
    """(keys, x, density): Gaussian kernels on the draws of each key, of Scott's width, at x = 0, ..., 1. The sums are
    taken over all draws, with partial aggregation, one column of the grid for each draw's neighbourhood of 8 widths."""
    stats = draws.groupBy(*keys).agg((F.stddev_samp(value) * F.pow(F.count(value), F.lit(-0.2))).alias("_h"), F.count(value).alias("_n"))
    near = draws.join(stats, keys).where("_h > 0").withColumns({"_low": F.greatest(F.lit(0), F.ceil((F.col(value) - 8 * F.col("_h")) * (points - 1))), "_high": F.least(F.lit(points - 1), F.floor((F.col(value) + 8 * F.col("_h")) * (points - 1)))})
    spread = near.where("_low <= _high").withColumn("_i", F.explode(F.sequence("_low", "_high")))
    z = (F.col("_i") / (points - 1) - F.col(value)) / F.col("_h")
    return spread.groupBy(*keys, (F.col("_i") / (points - 1)).alias("x")).agg(F.sum(F.exp(-z * z / 2) / (F.col("_n") * F.col("_h") * (2 * np.pi) ** 0.5)).alias("density"))


def sums_by_c(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Of each C term (and further keys): sums of its chains' ratios and counts, and its own count."""
    return chains.groupBy(*keys).agg(
        F.sum("bc_sort_ratio").alias("ratio_sum"),
        F.avg("bc_sort_ratio").alias("ratio_mean"),
        F.sum("bc_count").alias("bc_sum"),
        F.sum("b_count").alias("b_sum"),
        F.sum("c_count").alias("c_sum"),
        F.max("c_count").alias("c_count"),
    )


def difference_of_sums(s1: Column, s2: Column, c1: Column, c2: Column) -> Column:
    """The difference of two sums, scaled by how common the two C terms are."""
    return (s1 - s2) * (_d(c2) / F.nullif(_d(c1), F.lit(0.0)))


def normalised_count(k2: Column, c1: Column, c2: Column) -> Column:
    """k2 as if its C term were as common as the first one, rounded."""
    return F.bround(_d(k2) * c1 / F.nullif(_d(c2), F.lit(0.0)))


def best_chain_intervals(chains: DataFrame, keys: list[str], total: Column, least: int = 2) -> DataFrame:
    """Of each key the chain with the largest ln OR(A, B) + ln OR(B, C), and the 99 % interval of that sum.

    Only chains with more than `least` articles at both steps and a positive sum count; a key without one has
    no row. chains: a_count, b_count, c_count, ab_count, bc_count.
    """
    ab, bc = ([F.col(x), F.col(y), F.col(z), total] for x, y, z in (("a_count", "b_count", "ab_count"), ("c_count", "b_count", "bc_count")))
    fit = chains.where((F.col("ab_count") > least) & (F.col("bc_count") > least)).withColumn("log_odds", F.log(odds_ratio(*ab)) + F.log(odds_ratio(*bc)))
    variance = sum((1 / F.nullif(c, F.lit(0.0)) for t in (ab, bc) for c in cells(*t)), F.lit(0.0))
    best = fit.where("log_odds > 0").withColumn("width", F.lit(Z99) * F.sqrt(variance)).groupBy(*keys).agg(F.max(F.struct("log_odds", "b_term", "width")).alias("best"))
    return best.select(*keys, "best.b_term", "best.log_odds", (F.col("best.log_odds") - F.col("best.width")).alias("low"), (F.col("best.log_odds") + F.col("best.width")).alias("high"))
