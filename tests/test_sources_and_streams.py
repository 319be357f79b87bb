import pytest
from pyspark.sql import functions as F

from attestor.config import Job
from attestor.operators import cooccurrence
from attestor.sources import readers, writers
from attestor.streaming import articles as streams


def test_term_lists(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("b|x\n\n  a & c \n b |y\n")
    got = [tuple(r) for r in readers.terms(spark, f"file://{path}").orderBy("pos").collect()]
    assert got == [(0, "b|x", "b", "b"), (1, "a & c", "a & c", "a c"), (2, "b |y", "b", "b")]
    assert [r["raw"] for r in readers.competing_terms(spark, f"file://{path}").orderBy("pos").collect()] == ["b|x", "a & c"]
    path.write_text("only\nonly|same\n")
    with pytest.raises(ValueError):
        readers.competing_terms(spark, f"file://{path}")


def test_tables_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2]), ("b", None)], "term string, pmids array<bigint>")
    writers.tsv(rows, f"{tmp_path}/t")
    back = readers.tsv(spark, f"{tmp_path}/t").withColumn("pmids", readers.pmid_list("pmids"))
    assert sorted(map(tuple, back.collect())) == [("a", [1, 2]), ("b", None)]
    assert readers.tsv_or_none(spark, f"{tmp_path}/none") is None
    writers.tsv(rows.limit(0), f"{tmp_path}/empty")
    assert readers.tsv_or_none(spark, f"{tmp_path}/empty") is None
    writers.removed(rows, rows.where("term = 'a'"), "term", ["term"], f"{tmp_path}/removed")
    assert [r["term"] for r in readers.tsv(spark, f"{tmp_path}/removed").collect()] == ["b"]


def test_result_folders(spark, tmp_path):
    for i in (1, 2):
        folder = tmp_path / "results" / f"iteration_{i}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(f'[{{"score": {i}, "decision": "H1"}}]')
    (tmp_path / "results" / "iteration_2" / "broken.json").write_text("{no")
    got = readers.results(spark, f"file://{tmp_path}/results/iteration_*", "score double, decision string").orderBy("iteration").collect()
    assert [(r["score"], r["iteration"]) for r in got] == [(1.0, 1), (2.0, 2)]


def test_run_folders(spark, tmp_path):
    for name in ("clust3_output_20240101000000", "clust4_output_20240202000000"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.tsv").write_text("Score\tx\n1\ta\n")
    rows = readers.run_folders(spark, f"file://{tmp_path}/*/results.tsv").orderBy("cluster").collect()
    assert [(r["cluster"], r["run_time"], r["Score"]) for r in rows] == [(3, "20240101000000", "1"), (4, "20240202000000", "1")]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`B.Term` int, x int")
    assert readers.column_like(df, "b_term") == "B.Term" and readers.column_like(df, "none") is None
    assert readers.require(df, "x", optional={"ac": "array<bigint>"}).columns == ["B.Term", "x", "ac"]
    with pytest.raises(ValueError):
        readers.require(df, "y")
    wanted = spark.createDataFrame([("1",), ("1",), ("x",), ("2",)], "pmid string")
    assert [r["pmid"] for r in readers.missing_articles(wanted, spark.createDataFrame([("2",)], "pmid string")).collect()] == ["1"]


def test_output_names(spark):
    row = spark.createDataFrame([("a b|c", "d/e", "f'g")], "a string, b string, c string")
    names = row.select(*[writers.output_name(k, F.col("a"), F.col("b"), F.col("c")).alias(k) for k in ("pair", "comparison", "chain")]).first()
    assert tuple(names) == ("a_b_d_e", "a_b_vs_d_e", "a_b_f_g_d_e")


def test_jobs():
    assert Job(("a",), ("b", "c")).combinations() == [("a", ("b", "c"), None)]
    assert Job(("a", "x"), ("b", "c"), position=True).combinations() == [("a", ("b",), None), ("x", ("c",), None)]
    assert len(Job(("a", "x"), ("b",), ("c", "d"), kind="chains").combinations()) == 4
    for bad in ({"a_terms": ()}, {"comparison": True}, {"position": True, "a_terms": ("a", "z")}, {"kind": "chains"}, {"sample_seed": True}, {"sample_floor": 2}):
        with pytest.raises(ValueError):
            Job(**({"a_terms": ("a",), "b_terms": ("b",)} | bad))


def test_term_mentions_take_synonyms_and_conjunctions(spark):
    articles = spark.createDataFrame([(1, "Alpha and beta."), (2, "alpha alone"), (3, "gamma"), (4, None)], "pmid long, abstract string")
    mention = cooccurrence.mentions(articles)
    terms = spark.createDataFrame([("alpha&beta|gamma",), ("delta",)], "term string")
    assert sorted(r["pmid"] for r in cooccurrence.term_mentions(mention, terms).collect()) == [1, 3]


def test_counts_of_pairs_that_never_meet(spark):
    articles = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "b")], "pmid long, abstract string")
    got = {(r["a_term"], r["b_term"]): (r["a_count"], r["b_count"], r["ab_count"]) for r in cooccurrence.pair_counts(articles, ["a"], ["b", "c", "zz"]).collect()}
    assert got == {("a", "b"): (2, 2, 1), ("a", "c"): (2, 1, 1), ("a", "zz"): (2, 0, 0)}


def test_censoring_counts_unknown_years_as_zero(spark):
    rows = spark.createDataFrame([(1, 2000), (2, 2010), (3, 2020), (4, None)], "pmid long, pub_year int")
    assert [r["pmid"] for r in cooccurrence.censored(rows, 2005, 2015).collect()] == [2]
    assert 4 in [r["pmid"] for r in cooccurrence.censored(rows, 0, 2015).collect()]


def test_streams_give_the_rows_of_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-02 00:00:00")], "pmid long, t string").select("pmid", F.to_timestamp("t").alias("arrived"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = streams.without_repeats(streams.arriving(spark, f"{tmp_path}/in", "pmid long, arrived timestamp"))
    streams.each_batch(stream, lambda batch: batch.select("pmid"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert sorted(r["pmid"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    counted = streams.windowed(streams.arriving(spark, f"{tmp_path}/in", "pmid long, arrived timestamp"), ["pmid"])
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["pmid"], r["n"]) for r in spark.table("counted").collect()) == [(1, 2), (2, 1)]
