import json

import pytest
from pyspark.sql import functions as F

from attestor.operators import cost, judging, reports


def comparison(labels, tallies, drop=(), kind="comparison"):
    body = {"per_abstract": [{"pmid": str(i), "evidence": ["e"], "label": x} for i, x in enumerate(labels)], "score_rationale": ["r"], "tallies": tallies, "score": 50, "decision": "tie"}
    return json.dumps({k: v for k, v in body.items() if k not in drop})


def tallied(h1, h2, both, neither):
    return {"support_H1": h1, "support_H2": h2, "both": both, "neither_or_inconclusive": neither}


FIVE = ["supports_H1", "supports_H2", "both", "neither", "inconclusive"]


@pytest.mark.parametrize(
    "text, kind, expected, problems",
    [
        (comparison(FIVE, tallied(1, 1, 1, 2)), "comparison", 5, []),
        (comparison(["supports_H1"], tallied(2, 0, 0, 0)), "comparison", 1, ["support_H1"]),
        (comparison(["supports_H1", "supports_H2"], tallied(1, 1, 0, 1)), "comparison", 2, ["neither_or_inconclusive"]),
        (comparison([], {"support_H1": 0, "refute_H1": 0, "inconclusive_H1": 0, "support_H2": 0, "refute_H2": 0, "inconclusive_H2": 0}), "comparison", 0, ["tallies.both", "tallies.neither_or_inconclusive"]),
        (comparison(["neither", "neither", "inconclusive"], tallied(0, 0, 0, 3)), "comparison", 3, []),
        (comparison(["supports_H1"], tallied(1, 0, 0, 0), ["score"]), "comparison", 1, ["score"]),
        (comparison(["supports_H1"], tallied(1, 0, 0, 0)), "comparison", 5, ["per_abstract length"]),
        ('{"score_rationale": ["r"], "score": 1, "decision": "supports", "tallies": {"x": 1}}', "chain", 9, []),
        ('{"score_rationale": ["r"], "score": 1}', "chain", 0, ["decision"]),
        ('{"score": 1, "decision": "supports"}', "chain", 0, ["score_rationale"]),
        (comparison(["supports"], {"support": 5, "refute": 0, "inconclusive": 0}), "single", 1, []),
    ],
)
def test_payload_checks(spark, text, kind, expected, problems):
    row = spark.createDataFrame([(text,)], "t string").withColumn("p", judging.payload(F.col("t"), kind))
    assert row.select(judging.problems(F.col("p"), kind, F.lit(expected)).alias("x")).first()["x"] == problems


def test_single_tallies_only_warn(spark):
    row = spark.createDataFrame([(comparison(["supports"], {"support": 5, "refute": 0, "inconclusive": 0}),)], "t string").withColumn("p", judging.payload(F.col("t"), "single"))
    assert row.select(judging.tally_warnings(F.col("p")).alias("x")).first()["x"] == ["support"]


def test_broken_payloads_are_refused(spark):
    row = spark.createDataFrame([("no json",)], "t string").withColumn("p", judging.payload(F.col("t"), "comparison"))
    assert row.select(judging.problems(F.col("p"), "comparison", F.lit(1)).alias("x")).first()["x"]


def test_prompts(spark):
    row = spark.range(1)
    p = row.select(judging.judge_prompt([F.lit("h")], F.lit("pool"), F.array(F.lit("1"), F.lit("2")), "s").alias("p"))
    assert p.select(judging.expected_count(F.col("p")).alias("n")).first()["n"] == 2
    none = row.select(judging.judge_prompt([F.lit("h")], F.lit("pool 3"), F.array().cast("array<string>"), "s").alias("p")).first()["p"]
    assert "None found" in none


def test_judges_are_tried_again(spark):
    def model():
        calls = {}

        def ask(text):
            calls[text] = calls.get(text, 0) + 1
            if text == "stop":
                raise StopIteration
            if text == "never" or calls[text] < 3:
                raise OSError("busy")
            return f"{text} after {calls[text]}"

        return ask

    rows = spark.createDataFrame([(1, "a"), (2, "never"), (3, "stop")], "k int, prompt string")
    assert [r["payload"] for r in judging.judged(rows, model).orderBy("k").collect()] == ["a after 3", None, None]


def test_scores(spark):
    rows = spark.createDataFrame([(1, comparison(FIVE, tallied(1, 1, 1, 2))), (2, "broken")], "k int, t string").withColumn("payload", judging.payload(F.col("t"), "comparison")).drop("t")
    got = judging.scores_comparison(rows).orderBy("k").collect()
    assert tuple(got[0]) == (1, 50.0, "tie", 1, 1, 1, 2) and tuple(got[1]) == (2, None, None, 0, 0, 0, 0)


def test_evidence_keeps_its_order(spark):
    rows = spark.createDataFrame([("w", 0, "1", ["b", "a"]), ("w", 1, "2", ["x"]), ("w", 2, "1", ["c", "b"])], "winner string, pos int, pmid string, evidence array<string>")
    got = {r["pmid"]: (r["evidence"], r["times"]) for r in reports.evidence_by_pmid(rows, ["winner"]).collect()}
    assert got == {"1": (["b", "a", "c"], 2), "2": (["x"], 1)}


def test_cell_types(spark):
    rows = spark.createDataFrame([(1, "t", "B", "2"), (1, "t", "A", "1"), (1, "t", "C", "0"), (1, "t", "D", "N/A"), (1, "u", "A", "0")], "cluster int, cell_type string, gene string, score string")
    got = {r["cell_type"]: (r["mean_score"], r["supporting"], r["refuting"]) for r in reports.cell_type_summary(rows).collect()}
    assert got == {"t": (1.5, "A, B", "none"), "u": (None, "none", "none")}


def test_winners(spark):
    history = spark.createDataFrame([(1, "a", "b", "ok", 70.0), (2, "c", "a", "ok", 20.0), (3, "b", "c", "ok", 1.0), (4, "a", "c", "error", None)], "pair_id int, term1 string, term2 string, status string, mean_score double")
    cited = spark.createDataFrame([(1, 0, "9", ["x"]), (3, 0, "8", ["y"])], "pair_id int, pos int, pmid string, evidence array<string>")
    overall, evidence = reports.winner_summary(history, cited, "a")
    assert tuple(overall.first()) == (75.0, 2) and [r["pmid"] for r in evidence.collect()] == ["9"]


def test_pivot_fills_gaps(spark):
    rows = spark.createDataFrame([(2000, "a", 2), (2001, "b", 3)], "year int, term string, n int")
    assert [tuple(r) for r in reports.pivot_years(rows, "year", "term", "n", ["a", "b"]).orderBy("year").collect()] == [(2000, 2, 0), (2001, 0, 3)]


def test_costs(spark):
    row = spark.createDataFrame([(50, 90, 10, 0)], "ab int, words int, bc int, ac int")
    tokens = row.select(cost.input_tokens(F.col("ab"), F.col("words"), 20).alias("pair"), cost.input_tokens(F.col("ab"), F.col("words"), 20, F.col("bc"), F.col("ac")).alias("chain")).first()
    assert tuple(tokens) == (20 * 300 + 120, 20 * 300 + 120 + 3000)
    intervals = spark.createDataFrame([(1, 25, 300), (25, 50, 420)], "start int, end int, tokens int")
    rows = spark.createDataFrame([(1, 25), (2, 26), (3, 99)], "k int, n int")
    assert [r["output_tokens"] for r in cost.output_tokens(rows, intervals, "n").orderBy("k").collect()] == [300, 420, 420]
    prices = spark.createDataFrame([("o1",), ("other",)], "m string").select(cost.price_of(F.col("m"), 1).alias("p")).collect()
    assert [r["p"] for r in prices] == [60.0, 4.4]
    assert [tuple(r) for r in cost.censor_years(spark, 2000, 2005, 2, 3).collect()] == [(1998, 2000), (2000, 2002), (2002, 2004)]
