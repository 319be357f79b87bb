import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import special
from attestor.operators import statistics

#: Fixed values: (A, B, AB, total) of two terms, and z, chi-square and the quotient of odds ratios.
YEARS = [
    ((10454, 8642, 98, 10156146), (10454, 49, 1, 10156146), -0.596480426, 0.0, 0.555253302),
    ((11774, 9562, 126, 10581310), (11774, 64, 2, 10581310), -1.258034733, 0.473311821, 0.417982264),
    ((13145, 10514, 156, 11017996), (13145, 99, 4, 11017996), -2.077851694, 2.600714792, 0.361542864),
    ((26350, 18823, 574, 13983238), (26350, 1108, 166, 13983238), -20.414804006, 348.338204159, 0.181091137),
    ((49032, 28789, 1226, 17025946), (49032, 6671, 1253, 17025946), -41.918021623, 1409.995107742, 0.191972717),
    ((16268, 7412, 13, 22627076), (16268, 7557, 37, 22627076), -3.331341761, 10.103631009, 0.356571863),
    ((21750, 13359, 49, 24655223), (21750, 8629, 45, 24655223), -1.716853831, 2.57096961, 0.702250255),
    ((61698, 121678, 957, 36691282), (61698, 14976, 112, 36691282), 0.506459158, 0.205602534, 1.063627208),
]


@pytest.mark.parametrize("one, two, z, chi, quotient", YEARS)
def test_statistics_of_two_terms(spark, one, two, z, chi, quotient):
    row = spark.createDataFrame([(*one, *two)], "a1 long, b1 long, k1 long, n1 long, a2 long, b2 long, k2 long, n2 long")
    t1, t2 = ([F.col(f"{c}{i}") for c in "abkn"] for i in (1, 2))
    got = row.select(
        statistics.z_statistic(t1[2], t1[1], t2[2], t2[1]),
        statistics.chi_square_yates(t1[2], t1[1], t2[2], t2[1]),
        statistics.odds_ratio(*t1) / statistics.odds_ratio(*t2),
    ).first()
    assert tuple(got) == pytest.approx((z, chi, quotient), rel=1e-6, abs=1e-9)


def test_p_values(spark):
    row = spark.range(1)
    z, x = row.select(statistics.z_p_value(F.lit(-0.596480426)), statistics.chi_square_p_value(F.lit(0.0))).first()
    assert z == pytest.approx(0.550854326, rel=1e-6) and x == 1.0


def test_intervals(spark):
    row = spark.createDataFrame([YEARS[0][0]], "a long, b long, k long, n long")
    t = [F.col(c) for c in "abkn"]
    low, high = row.select(*statistics.odds_interval(*t)).first()
    assert (low, high) == pytest.approx((8.631798, 14.604137), rel=1e-6)
    plain = row.select(*statistics.odds_interval(*t, scale="plain")).first()
    assert plain[1] - plain[0] == pytest.approx(2 * 2.576 * 0.10207, rel=1e-4) and sum(plain) / 2 == pytest.approx(math.sqrt(low * high))
    p = spark.range(1).select(statistics.disjoint_p(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)), statistics.disjoint_p(F.lit(1.0), F.lit(3.5), F.lit(3.0), F.lit(4.0))).first()
    assert tuple(p) == (0.01, 1.0)


@pytest.mark.parametrize("a, b, ab, total, p", [(10454, 8642, 98, 10156146, 7.232708e-66), (10454, 49, 1, 10156146, 0.049211028), (268, 41, 1, 4510049, 0.00243345)])
def test_fisher_upper_tail(a, b, ab, total, p):
    assert special.fisher_greater(ab, a, b, total) == pytest.approx(p, rel=1e-5)


def test_fisher_by_enumeration():
    a, b, total = 7, 9, 20
    probability = {k: math.comb(a, k) * math.comb(total - a, b - k) / math.comb(total, b) for k in range(0, 8) if b - k <= total - a}
    for ab in probability:
        assert special.fisher_greater(ab, a, b, total) == pytest.approx(sum(v for k, v in probability.items() if k >= ab))
        assert special.fisher_two_sided(ab, a, b, total) == pytest.approx(sum(v for v in probability.values() if v <= probability[ab] * (1 + 1e-7)))
    assert math.isnan(special.fisher_greater(9, 7, 9, 20)) and special.fisher_greater(0, 7, 9, 20) == pytest.approx(1.0)


def test_binomial_tail():
    for k in range(12):
        assert special.binomial_greater(k, 11, 0.3) == pytest.approx(sum(math.comb(11, i) * 0.3**i * 0.7 ** (11 - i) for i in range(k, 12)))
    assert special.binomial_greater(0, 5, 0.5) == 1.0 and special.binomial_greater(6, 5, 0.5) == 0.0


def test_beta_functions():
    assert special.beta_cdf(0.3, 1, 1) == pytest.approx(0.3) and special.beta_cdf(0.25, 2, 2) == pytest.approx(3 * 0.0625 - 2 * 0.015625)
    assert special.beta_ppf(0.5, 3, 3) == pytest.approx(0.5) and special.beta_cdf(special.beta_ppf(0.2, 2.5, 7), 2.5, 7) == pytest.approx(0.2)
    low, high = special.beta_hdi(4, 4)
    assert low + high == pytest.approx(1, abs=1e-4) and special.beta_cdf(high, 4, 4) - special.beta_cdf(low, 4, 4) == pytest.approx(0.95)
    assert special.beta_hdi(1, 5)[0] == pytest.approx(0, abs=1e-3)
    assert special.digamma(1) == pytest.approx(-0.5772156649) and special.trigamma(1) == pytest.approx(math.pi**2 / 6)
    a, b = 3.0, 5.0
    assert special.beta_mle(special.digamma(a) - special.digamma(a + b), special.digamma(b) - special.digamma(a + b), 1.0, 1.0) == pytest.approx((a, b))
    assert special.beta_pdf(0.5, 1, 1) == pytest.approx(1) and special.beta_pdf(1.5, 2, 2) == 0


def test_beta_summaries(spark):
    rows = spark.createDataFrame([("a", 1, 60.0), ("a", 2, 80.0), ("a", 3, None), ("b", 1, 50.0), ("b", 2, 50.0), ("c", 1, 100.0), ("d", 1, 0.0), ("d", 2, 0.0)], "term string, iteration int, score double")
    units = statistics.unit_scores(rows, ["term"])
    x = {(r["term"], r["iteration"]): r["x"] for r in units.collect()}
    assert x["a", 3] == 0.5 and x["b", 1] == 0.51 and x["b", 2] == 0.49 and 0 <= x["d", 2] <= x["d", 1] <= 0.01
    for r in statistics.beta_summary(units, ["term"]).collect():
        assert r["a_mom"] > 0 and r["b_mom"] > 0 and r["a_mle"] > 0
        if r["term"] == "a":
            assert r["a_mom"] / (r["a_mom"] + r["b_mom"]) == pytest.approx(r["mean"])


def test_priors_and_posteriors(spark):
    row = spark.createDataFrame([(10, 20, 10, 40), (100, 0, 0, 200), (0, 0, 0, 5)], "h1 int, h2 int, b int, n int")
    a, b = statistics.prior(F.col("h1"), F.col("h2"), F.col("b"), F.col("n"))
    assert [tuple(r) for r in row.select(a, b).collect()] == [(15.0, 25.0), (200.0, 0.01), (0.01, 0.01)]
    got = row.limit(1).select(*statistics.posterior(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))).first()
    assert tuple(got) == (4.0, 6.0, 0.4)


def test_draws_depend_on_seed_and_key_alone(spark):
    rows = spark.createDataFrame([("x", 2.0, 3.0), ("y", 2.0, 3.0)], "term string, a double, b double")
    once, again = (statistics.beta_draws(rows.repartition(n), ["term"], "a", "b", 50, 4).orderBy("term", "draw").collect() for n in (1, 3))
    assert once == again and len(once) == 100 and once[0]["value"] != once[50]["value"]
    summary = statistics.draw_summary(statistics.beta_draws(rows, ["term"], "a", "b", 1000, 4), ["term"]).collect()
    assert all(abs(r["mean"] - 0.4) < 0.05 and r["low"] < r["mean"] < r["high"] for r in summary)


def test_permutations(spark):
    rows = spark.createDataFrame([("far", [5.0, 6.0, 7.0, 8.0, 9.0], [0.0, 1.0, 2.0, 1.0, 0.0]), ("same", [1.0, 2.0], [1.0, 2.0])], "k string, list1 array<double>, list2 array<double>")
    got = {r["k"]: r["p_value"] for r in statistics.permutation_test(rows, ["k"], 500, 1, split="fixed").collect()}
    assert got["far"] < 0.05 < got["same"]
    # a random cut puts everything on one side once in len + 1 times
    got = {r["k"]: (r["observed"], r["p_value"]) for r in statistics.permutation_test(rows, ["k"], 20_000, 1).collect()}
    assert got["far"][0] == 31 and 1 / 11 < got["far"][1] < 0.25 and got["same"][0] == 0 and got["same"][1] > 0.5
    turned = rows.select("k", F.col("list2").alias("list1"), F.col("list1").alias("list2"))
    back = {r["k"]: (r["observed"], r["p_value"]) for r in statistics.permutation_test(turned, ["k"], 20_000, 1).collect()}
    assert back["far"][0] == -31 and abs(back["far"][1] - got["far"][1]) < 0.03
    ratio = {r["k"]: r["observed"] for r in statistics.permutation_test(rows, ["k"], 100, 1, "ratio").collect()}
    assert ratio == {"far": 35 / 4, "same": 1.0}
    odd = spark.createDataFrame([("a", None, [1.0, None]), ("b", [], []), ("c", None, None), ("d", [1.0], [0.0])], "k string, list1 array<double>, list2 array<double>")
    assert {r["k"]: r["observed"] for r in statistics.permutation_test(odd, ["k"], 50, 1).collect()} == {"a": -1.0, "b": None, "c": None, "d": 1.0}
    assert {r["k"]: r["observed"] for r in statistics.permutation_test(odd, ["k"], 50, 1, "ratio").collect()} == {"a": 0.0, "b": None, "c": None, "d": None}


def test_tails_of_large_and_degenerate_parameters():
    for a in (1e4, 1e6, 1e8):
        assert special.beta_cdf(0.5, a, a) == pytest.approx(0.5, abs=1e-6)
        low, high = special.beta_ppf(0.025, a, a), special.beta_ppf(0.975, a, a)
        assert high - low == pytest.approx(2 * 1.959964 / (2 * (2 * a + 1) ** 0.5), rel=1e-3)
    assert special.binomial_greater(3, 10, 0.0) == 0 and special.binomial_greater(3, 10, 1.0) == 1 and special.binomial_greater(0, 10, 0.0) == 1
    assert np.isnan(special.beta_pdf(0.5, 0, 1))


def test_the_clip_of_scores_of_0_and_1(spark):
    units = spark.createDataFrame([("t", float(x)) for x in (0, 0, 1, 1, 0.5, 0.25)], "term string, x double")
    fits = [statistics.beta_summary(units, ["term"], clip=c).first() for c in (1e-6, statistics.CLIP)]
    assert fits[1]["a_mle"] < 0.75 * fits[0]["a_mle"]


def test_density_curves(spark):
    rows = spark.createDataFrame([("t", 2.0, 3.0)], "term string, a double, b double")
    curve = statistics.density_curve(rows, ["term"])
    assert curve.count() == 499 and curve.agg(F.sum("density") / 500).first()[0] == pytest.approx(1, abs=1e-3)
    kde = statistics.kernel_density(statistics.beta_draws(rows, ["term"], "a", "b", 4000, 4), ["term"])
    assert kde.where("x BETWEEN 0.1 AND 0.9").join(curve.select(F.round(F.col("x") * 499).alias("i"), "density").withColumnRenamed("density", "want"), F.round(F.col("x") * 499) == F.col("i")).where(F.abs(F.col("density") - F.col("want")) > 0.35).count() == 0


def test_sentinels(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (3, 1), (3, 2)], "n int, t int")
    assert [r[0] for r in rows.select(statistics.year_sentinel(F.col("t"), F.col("n"), F.col("t"))).collect()] == ["NOLINES", "ONLY1", "ONLY1", None]
