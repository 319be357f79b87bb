"""The tournament and ranking queries against plain Python over all suppliers."""

import os

import pytest

import attestor.plans.queries_scores  # noqa: F401
from attestor.operators import competition
from attestor.plans.registry import QUERIES

PATH = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="the tables are not there")


@pytest.fixture(scope="module")
def balances(spark):
    rows = spark.read.parquet(f"{PATH}/supplier.parquet").orderBy("s_suppkey").collect()
    return {f"s{r['s_suppkey']}": r["s_acctbal"] for r in rows}


def score(balances, one, two):
    return max(0.0, min(100.0, 50 + (balances[one] - balances[two]) / 100))


def test_tournament_of_all_suppliers(spark, balances):
    alive, bye, rounds, stalls = list(balances), None, 0, 0
    while len(alive) > 1 and stalls < 2:
        rounds += 1
        pairs, bye = competition.round_pairs(alive, 1, rounds, bye)
        left = [bye] if bye is not None else []
        for one, two in pairs:
            mean = score(balances, one, two)
            left += [one, two] if abs(mean - 50) <= 1.0 else [one if mean > 50 else two]
        stalls = stalls + 1 if len(left) == len(alive) else 0
        alive = left
    got = QUERIES["tournament"](spark, PATH).collect()
    assert sorted(r["term"] for r in got) == sorted(alive) and {r["rounds"] for r in got} == {rounds}


def test_tournament_reads_suppliers_past_the_ninth(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(competition, "tournament", lambda spark, terms, *_, **__: (asked.extend(terms), (terms[:1], []))[1])
    QUERIES["tournament"](spark, PATH)
    assert len(asked) == spark.read.parquet(f"{PATH}/supplier.parquet").count()


def test_ranking_of_all_suppliers(spark, balances):
    rows = QUERIES["ranking"](spark, PATH).orderBy("rank").collect()
    order = [r["term"] for r in rows]
    assert sorted(order) == sorted(balances) and rows[0]["converged"]
    assert all(score(balances, one, two) >= 49.5 for one, two in zip(order, order[1:]))
