"""Questions, inference in batches, services, samples and histories of jobs."""

import json
import time
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from attestor.config import Job
from attestor.operators import competition, dispatch, judging, relevance
from attestor.sources import providers, readers, writers

TABLE = "row_id long, intersection string, pos long, pmid long, text string"


def payload(prompt):
    """A judge that labels every article that it is shown."""
    ids = prompt.split("Available PMIDs: ")[1].split("\n")[0].split(", ")
    if prompt.startswith(judging.INSTRUCTIONS["chain"]):
        return json.dumps({"score_rationale": ["r"], "score": 2, "decision": "supports"})
    if prompt.startswith(judging.INSTRUCTIONS["comparison"]):
        return json.dumps({"per_abstract": [{"pmid": i, "evidence": [], "label": "supports_H1"} for i in ids], "score_rationale": [], "tallies": {"support_H1": len(ids), "support_H2": 0, "both": 0, "neither_or_inconclusive": 0}, "score": 90, "decision": "H1"})
    return json.dumps({"per_abstract": [{"pmid": i, "evidence": [], "label": "supports"} for i in ids], "score_rationale": [], "tallies": {"support": len(ids), "refute": 0, "inconclusive": 0}, "score": 1, "decision": "supports"})


def test_a_job_of_chains_asks_two_questions_and_skips_empty_pools(spark):
    job = Job(a_terms=("a",), b_terms=("b",), c_terms=("c",), kind="chains", iterations=2)
    rows = spark.createDataFrame([(1, "a|x", "b", "c"), (2, "a", "b2", "c"), (3, "a", None, "c")], "row_id long, a_term string, b_term string, c_term string")
    evidence = spark.createDataFrame([(1, "ab", 0, 11, "t"), (1, "bc", 0, 12, "u"), (1, "bc", 1, 13, None), (2, "ab", 0, 14, "v"), (3, "ac", 0, 15, "w")], TABLE)
    got = {(r["row_id"], r["relation"], r["iteration"]): r for r in dispatch.run_job(rows, evidence, job, lambda: payload).collect()}
    assert {k: (r["status"], r["score"], r["problems"]) for k, r in got.items()} == {
        (1, "A_B_C", 1): ("ask", 2.0, []), (1, "A_B_C", 2): ("ask", 2.0, []), (1, "A_C", None): ("N/A", None, []),
        (2, "A_B_C", None): ("N/A", None, []), (2, "A_C", None): ("N/A", None, []), (3, "A_C", 1): ("ask", 1.0, []), (3, "A_C", 2): ("ask", 1.0, []),
    }
    assert got[1, "A_B_C", 1]["ids"] == ["11", "12", "13"] and got[1, "A_B_C", 1]["label"] == "a - b - c"
    assert dispatch.run_job(rows.limit(0), evidence, job, lambda: payload).collect() == []


def test_a_comparison_is_one_question(spark):
    job = Job(a_terms=("a",), b_terms=("b", "d"), comparison=True)
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "d")], "row_id long, a_term string, b_term string")
    evidence = spark.createDataFrame([(1, "ab", 0, 5, "t"), (1, "ab", 1, 6, "u")], TABLE)
    (r,) = dispatch.run_job(rows, evidence, job, lambda: payload).collect()
    assert (r["hypothesis1"], r["hypothesis2"], r["score"], r["problems"]) == ("a affects b.", "a affects d.", 90.0, [])
    assert dispatch.pair_job(Job(a_terms=("a",), b_terms=("x", "y", "z")), "y", "z").b_terms == ("y", "z")


def test_wrong_verdicts_have_no_score(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "row_id long, a_term string, b_term string")
    evidence = spark.createDataFrame([(1, "ab", 0, 5, "t")], TABLE)
    job = Job(a_terms=("a",), b_terms=("b",))
    (r,) = dispatch.run_job(rows, evidence, job, lambda: lambda p: "{}").collect()
    assert r["score"] is None and "score" in r["problems"]

    def broken():
        def ask(prompt):
            raise ConnectionError

        return ask

    (r,) = dispatch.run_job(rows, evidence, job, broken).collect()
    assert r["payload"] is None and r["problems"] == ["no answer"]


def test_evidence_without_a_limit_keeps_its_order(spark):
    rows = spark.createDataFrame([(1, "ab", 0, 5, "t" * 8, 2000, 1), (1, "ab", 1, 6, "u" * 8, 2001, 0), (1, "ab", 2, 7, "v" * 8, 2002, 1)], "row_id long, intersection string, pos int, pmid long, text string, pub_year int, mask int")
    plain = Job(a_terms=("a",), b_terms=("b",), post_n=0)
    assert [(r["pos"], r["pmid"]) for r in dispatch.prepared(rows, ["row_id"], plain).orderBy("pos").collect()] == [(0, 5), (2, 7)]
    assert [(r["pos"], r["pmid"]) for r in dispatch.prepared(rows, ["row_id"], Job(a_terms=("a",), b_terms=("b",), post_n=2, top_cited=1, top_recent=2)).orderBy("pos").collect()] == [(0, 5), (1, 7)]
    assert dispatch.prepared(rows, ["row_id"], plain, budget=3).count() == 1


def test_prompts_go_in_batches_and_failures_are_asked_alone(spark):
    rows = spark.range(100).selectExpr("id", "concat('p', id) AS prompt").coalesce(1)

    def model():
        sizes = []

        def ask(prompts):
            sizes.append(len(prompts))
            if "p7" in prompts or "p8" in prompts and len(prompts) > 1:
                raise ConnectionError
            return [f"{p}/{max(sizes)}" for p in prompts]

        return ask

    for workers in (1, 4):
        got = {r["id"]: r["answer"] for r in relevance.classify(rows, model, size=16, workers=workers).collect()}
        assert got[7] == "" and got[8] == "p8/16" and got[99] == "p99/16"

    def nobody():
        def ask(prompts):
            raise ConnectionError("gone")

        return ask

    with pytest.raises(Exception, match="gone"):
        relevance.classify(rows, nobody, size=16).collect()


def test_streamed_calls_overlap_and_late_ones_fail(spark):
    rows = spark.range(8).selectExpr("id", "concat('p', id) AS prompt").coalesce(1)

    def slow():
        def ask(prompts):
            time.sleep(3 if "p0" in prompts else 0.4)
            return ["1" for _ in prompts]

        return ask

    began = time.perf_counter()
    got = {r["id"]: r["answer"] for r in relevance.classify(rows, slow, size=1, workers=8, drain=1.5).collect()}
    assert got == {0: ""} | dict.fromkeys(range(1, 8), "1") and time.perf_counter() - began < 8 * 0.4 + 3


def test_status_codes():
    answers, slept = [(503, ""), (429, ""), (200, "ok")], []
    ask = providers.client(lambda p: answers.pop(0), delay=1.0, factor=2.0, sleep=slept.append)
    assert ask("x") == "ok" and slept == [1.0, 2.0]
    for status, error in ((402, providers.Refused), (400, providers.Failed), (503, ConnectionError)):
        calls = []
        with pytest.raises(error):
            providers.client(lambda p: (calls.append(p), (status, "no"))[1], sleep=lambda s: None)("x")  # noqa: B023
        assert len(calls) == (3 if status == 503 else 1)


def test_nothing_is_asked_after_a_refusal(spark):
    rows = spark.range(5).selectExpr("id", "CAST(id AS string) AS prompt").coalesce(1)

    def model():
        seen = []

        def ask(prompt):
            seen.append(prompt)
            if len(seen) == 2:
                raise providers.Refused
            return str(len(seen))

        return ask

    assert [r["payload"] for r in judging.judged(rows, model).orderBy("id").collect()] == ["1", None, None, None, None]


def test_iterations_are_judged_at_a_time(spark):
    rows = spark.range(8).selectExpr("id", "CAST(id AS string) AS prompt").coalesce(1)

    def model():
        running, most = [], []

        def ask(prompt):
            running.append(prompt)
            most.append(len(running))
            time.sleep(0.3)
            running.remove(prompt)
            return str(max(most))

        return ask

    got = [int(r["payload"]) for r in judging.judged(rows, model, workers=5).collect()]
    assert 2 <= max(got) <= 5 and len(got) == 8


def test_jobs_are_polled():
    states = [("queued", None), OSError(), ("started", None), ("finished", [1])]

    def ask(job):
        x = states.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.wait_for(lambda: "j", ask, sleep=lambda s: None) == [1]
    with pytest.raises(AssertionError):
        providers.wait_for(lambda: "j", lambda j: ("failed", None), sleep=lambda s: None)
    with pytest.raises(ValueError, match="odd"):
        providers.wait_for(lambda: "j", lambda j: ("odd", None), sleep=lambda s: None)


def test_articles_are_fetched_once_in_batches(spark):
    wanted = spark.createDataFrame([(i % 25,) for i in range(60)] + [(None,)], "pmid long")

    def fetch():
        def ask(ids):
            if 13 in ids:
                raise ConnectionError
            return "<Set>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T <i>{i}</i></ArticleTitle><Abstract><AbstractText>a{len(ids)}</AbstractText><AbstractText>b</AbstractText></Abstract><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>" for i in ids) + "<PubmedArticle/></Set>"

        return ask

    got = {r["pmid"]: r for r in providers.fetched(wanted, fetch, size=10, pace=0.0, retries=2, delay=0.0).collect()}
    assert set(got) == set(range(10)) | set(range(20, 25))
    assert (got[3]["title"], got[3]["sections"], got[3]["pubdate_year"], got[24]["sections"]) == ("T 3", ["a10", "b"], "2001", ["a5", "b"])


@pytest.mark.parametrize("fixed", [True, False])
def test_samples_over_iterations(spark, fixed):
    rows = spark.range(300).selectExpr("'x' AS k", "CAST(IF(id < 200, 1, 2) AS int) AS pool", "id AS pos", "CAST(id AS string) AS pmid", "concat('entry ', id) AS text")
    got = dispatch.sampled_pools(rows, ["k"], 3, 4, fixed, target=10).orderBy("iteration").collect()
    assert [(r["iteration"], r["sampled"], r["total"]) for r in got] == [(i, 10, 300) for i in range(1, 5)]
    assert len({r["text"] for r in got}) == (1 if fixed else 4)
    assert got[0]["text"] == dispatch.sampled_pools(rows, ["k"], 3, 1, target=10).first()["text"]


def test_histories_can_be_read_again(spark, tmp_path):
    judge = lambda pairs: pairs.select("*", F.when(F.col("term1") < F.col("term2"), 90.0).otherwise(10.0).alias("mean_score"), F.lit(1).alias("n_scores"), F.lit(True).alias("support1"), F.lit(True).alias("support2"))
    _, rounds = competition.tournament(spark, list("abcd"), judge)
    writers.history(spark, rounds, f"{tmp_path}/t", readers.HISTORY)
    assert sorted((r["round"], r["term1"], r["winner"]) for r in readers.history(spark, f"{tmp_path}/t").collect()) == sorted((r["round"], r["term1"], r["winner"]) for r in rounds)
    order, log, _, _ = competition.ranking(spark, list("dbac"), judge)
    writers.history(spark, log, f"{tmp_path}/r", readers.COMPARISONS)
    again = readers.history(spark, f"{tmp_path}/r", readers.COMPARISONS)
    assert competition.oriented(again.where("NOT from_cache")).count() == 2 * sum(not x["from_cache"] for x in log) and order == list("abcd")
    writers.ranking(spark.createDataFrame(list(enumerate(order, 1)), "rank int, term string"), f"{tmp_path}/ranking")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/ranking/ranking.txt").collect()] == ["1. a", "2. b", "3. c", "4. d"]
    writers.parameters(spark, asdict(Job(a_terms=("a",), b_terms=("b",))), f"{tmp_path}/p")
    assert {r["name"]: r["value"] for r in readers.tsv(spark, f"{tmp_path}/p", sep=",").collect()}["kind"] == "pairs"


def test_result_folders(spark, tmp_path):
    for folder, name, score in (("cy2000", "results.tsv", "1"), ("cy2001", "results.tsv", "2"), ("cy2001", "results.txt", "3"), ("run1", "results.tsv", "N/A"), ("output_visualization_x", "results.tsv", "9")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f"Hypothesis\tScore\nh\t{score}\n")
    assert sorted((r["censor_year"], r["Score"]) for r in readers.year_results(spark, str(tmp_path)).collect()) == [(2000, "1"), (2001, "3")]
    found = readers.scores(readers.results_of_runs(spark, str(tmp_path)), "Score").collect()
    assert sorted((r["Score"] is None, r["Score"] or 0) for r in found) == [(False, 1.0), (False, 2.0), (True, 0)]
