import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.operators import relevance, sampling, selection

#: Pools, floor and target, and what is drawn of each.
SPLITS = [
    (0, 0, 0.06, 50, 0, 0),
    (0, 10, 0.06, 50, 0, 10),
    (10, 0, 0.06, 50, 10, 0),
    (0, 1, 0.06, 50, 0, 1),
    (1, 0, 0.06, 50, 1, 0),
    (1, 1, 0.06, 50, 1, 1),
    (2, 2, 0.06, 50, 2, 2),
    (3, 3, 0.06, 50, 3, 3),
    (25, 25, 0.06, 50, 25, 25),
    (100, 100, 0.06, 50, 25, 25),
    (5, 1500, 0.06, 50, 3, 47),
    (30, 1800, 0.06, 50, 3, 47),
    (1, 999, 0.06, 50, 1, 49),
    (1337, 504, 0.06, 50, 36, 14),
    (12, 1504, 0.06, 200, 12, 188),
    (1000, 1000, 0.6, 50, 25, 25),
    (1, 1, 0.06, 1, 0, 1),
    (10, 10, 0.06, 50, 10, 10),
    (100, 100, 0.06, 0, 0, 0),
    (1000, 1000, 0.0, 50, 25, 25),
]


def split(spark, t1, t2, floor, target):
    row = spark.createDataFrame([(t1, t2)], "t1 long, t2 long")
    n1, n2 = sampling.allocation(F.col("t1"), F.col("t2"), floor, target)
    return tuple(row.select(n1.alias("a"), n2.alias("b")).first())


@pytest.mark.parametrize("t1, t2, floor, target, n1, n2", SPLITS)
def test_allocation(spark, t1, t2, floor, target, n1, n2):
    assert split(spark, t1, t2, floor, target) == (n1, n2)


def test_allocation_keeps_its_bounds(spark):
    grid = [(a, b) for a in (0, 1, 2, 5, 49, 50, 51, 400) for b in (0, 1, 3, 25, 60, 900)]
    n1, n2 = sampling.allocation(F.col("t1"), F.col("t2"))
    for r in spark.createDataFrame(grid, "t1 long, t2 long").select("t1", "t2", n1.alias("a"), n2.alias("b")).collect():
        assert r["a"] + r["b"] == min(50, r["t1"] + r["t2"]) and 0 <= r["a"] <= r["t1"] and 0 <= r["b"] <= r["t2"]
        if r["t1"] >= 3 and r["t2"] >= 3 and r["t1"] + r["t2"] >= 50:
            assert r["a"] >= 3 and r["b"] >= 3


def drawn(spark, seed, iteration):
    rows = spark.createDataFrame([(1 if i < 200 else 2, i) for i in range(280)], "pool int, pmid long").withColumn("k", F.lit(0))
    return [(r["pool"], r["pmid"]) for r in sampling.sample_pools(rows, ["k"], seed, F.lit(iteration), target=10).orderBy("pool", "draw").collect()]


def test_samples_repeat_by_seed_and_iteration(spark):
    assert drawn(spark, 1, 2) == drawn(spark, 1, 2) and len(drawn(spark, 1, 2)) == 10
    assert drawn(spark, 1, 2) != drawn(spark, 2, 1) != drawn(spark, 0, 1)
    for bad in (True, 1.5, "1"):
        with pytest.raises(ValueError):
            sampling.check_seed(bad)
    assert sampling.check_seed(0) == 0 and sampling.check_seed(None) is None


@pytest.mark.parametrize("n, count", [(None, [None]), (0, [None]), (True, [1]), ("x", [1]), (3, [1, 2, 3])])
def test_iterations(spark, n, count):
    assert sorted((r["iteration"] for r in sampling.iterations(spark.range(1), n).collect()), key=str) == count


def test_interleaving():
    assert selection.interleaved(list("abcd"), list("bacd"), compatible=True) == list("ab")
    assert selection.interleaved(list("abcd"), list("bacd")) == list("abcd")
    assert selection.interleaved([1, 2, 3], [7, 8, 9]) == [1, 7, 2, 8, 3, 9]
    assert "".join(selection.interleaved(list("abcd"), list("xy"), 2.0, compatible=True)) == "xabycd"
    assert "".join(selection.interleaved(list("xy"), list("abcd"), 0.5)) == "xabycd"
    assert "".join(selection.interleaved(list("abcd"), list("xy"), 1.0)) == "axbycd"
    assert "".join(selection.interleaved(list("ab"), list("xyz"), 2.0)) == "xabyz" and "".join(selection.interleaved(list("ab"), list("xyz"), 2.0, compatible=True)) == "xaby"
    assert "".join(selection.interleaved(list("abcdefg"), list("xyz"), 1.5)) == "xabyczdefg"
    assert "".join(selection.interleaved([], list("xy"), 0.0)) == "xy"
    assert selection.interleaved([1, 2, 3, 4], [7, 8], 2.0, 5) == [7, 1, 2, 8, 3]
    assert selection.interleaved([1, "", None, 2], [], selection.interleave_ratio(5, 0)) == [1, 2]
    assert selection.interleave_ratio(0, 0) == 1.0 and selection.interleave_ratio(2, 4) == 0.5


def test_pools_without_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "5"), (1, 1, "5"), (2, 0, "5"), (1, 2, ""), (1, 3, ""), (2, 1, None), (2, 2, "6")], "pool int, pos int, pmid string")
    assert sorted((r["pool"], r["pos"]) for r in selection.dedup_pools(rows).collect()) == [(1, 0), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(1, p, t) for p, t in enumerate([5, 4, 3, 1])], "k int, pos int, t int")
    assert sorted(r["pos"] for r in selection.within_budget(rows, ["k"], F.col("t"), 22, 2).collect()) == [0, 1]


def test_positions_keep_their_order_and_duplicates(spark):
    pairs = spark.createDataFrame([(1, [42, 99, 42], None)], "row_id int, ab array<long>, bc array<long>")
    where = relevance.positions(pairs, {"ab": "ab", "bc": "bc"}, {"ab": F.lit("h"), "bc": F.lit("g")}, ["row_id"])
    articles = spark.createDataFrame([(42, "a"), (42, "a"), (100, "c")], "pmid long, abstract string")
    rows = relevance.with_articles(where, articles).orderBy("intersection", "pos").collect()
    assert [(r["intersection"], r["pos"], r["text"]) for r in rows] == [("ab", 0, "a"), ("ab", 1, ""), ("ab", 2, "a"), ("bc", None, "")]


def test_classifier_failures_are_empty_answers(spark):
    rows = spark.createDataFrame([(0, "ok"), (1, "bad")], "pos int, prompt string").coalesce(1)

    def model():
        def ask(prompts):
            if prompts[0] == "bad":
                raise OSError("down")
            return ["1"]

        return ask

    assert [r["answer"] for r in relevance.classify(rows, model).orderBy("pos").collect()] == ["1", ""]
    with pytest.raises(Exception, match="down"):
        relevance.classify(rows.where("pos = 1"), model).collect()


@pytest.mark.parametrize("answer, flag", [("1", 1), (" 1 ", 1), ("True", 1), ("1.0", 1), ("0", 0), ("", 0), ("yes", 0), (None, 0)])
def test_masks(spark, answer, flag):
    row = spark.createDataFrame([(answer,)], "a string")
    assert row.select(relevance.mask(F.col("a")).alias("m")).first()["m"] == flag


def test_ratio_of_an_empty_list(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, 5, 1), (2, 6, 0)], "k int, pmid long, mask int")
    assert [(r["ratio"], r["fraction"]) for r in relevance.relevance_ratio(rows, ["k"]).orderBy("k").collect()] == [(0.0, "0/0"), (0.5, "1/2")]


def test_prompt_cuts_the_abstract_alone(spark):
    row = spark.createDataFrame([("x" * 14_000, "h" * 10_000)], "a string, h string")
    p = row.select(relevance.relevance_prompt(F.col("a"), F.col("h")).alias("p")).first()["p"]
    assert p.count("x") == 9000 and "h" * 10_000 in p


def test_zipped_lists_must_match(spark):
    a, b = (spark.createDataFrame([(i, str(i)) for i in range(n)], f"pos int, {c} string") for n, c in ((2, "a"), (3, "b")))
    with pytest.raises(ValueError):
        selection.zip_terms(a, b)


def test_numbers_within_keys_are_those_of_one_window(spark):
    rows = spark.range(300_000).selectExpr("id * 7 AS pmid", "IF(id % 3 = 0, 'x', 'y') AS k", "CAST(1990 + id % 5 AS int) AS pub_year", "id * 7 AS pos")
    got = relevance.position_in(rows, ["k"])
    window = Window.partitionBy("k").orderBy("pmid")
    assert got.drop("pos").join(rows.withColumn("want", F.row_number().over(window) - 1).select("pmid", "want"), "pmid").count() == 300_000
    assert got.join(rows.select("pmid", (F.row_number().over(window) - 1).alias("want")), "pmid").where("pos <> want").count() == 0
    recent = selection.by_recency(rows, ["k"])
    by_year = Window.partitionBy("k").orderBy(F.desc("pub_year"), "pos")
    assert recent.join(rows.select("pmid", F.row_number().over(by_year).alias("want")), "pmid").where("recent_rank <> want").count() == 0
