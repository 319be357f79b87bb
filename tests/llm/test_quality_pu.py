import random
import zlib

import numpy as np
import pytest

from attestor.llm.quality_pu import features, fit, keep_quality, score_quality

DOCS, LABELS = "doc_id long, text string, score string, quality int", "doc_id long, quality int, toxic int"


def corpus(n, seed=2):
    rng = random.Random(seed)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))) + "."
    bad = lambda: rng.choice(["buy $$$ ", "### | | ", "x " * 3]) * rng.randint(10, 60)
    return [(i, bad(), 0) if i % 6 == 0 else (i, good(), 1) for i in range(n)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t, _ in rows] + [(9000, None, None, None), (9001, "", "", 0), (9002, "long " * 100_000, "", 0), (None, "x", "", 1)], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(i, q, 0) for i, _, q in rows if i % 2 == 0 and i % 12 == 0] + [(None, 1, 0), (1, None, None)], LABELS)
    return rows, docs, labels, score_quality(docs, labels).collect()


def test_held_out_rows_are_told_apart(scored):
    rows, _, _, got = scored
    quality = {i: q for i, _, q in rows}
    assert len(got) == len(rows) + 4
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in held]) > 0.95


def test_null_and_empty_texts_score_alike(scored):
    by_id = {r["doc_id"]: r["score"] for r in scored[3]}
    assert by_id[9000] == by_id[9001]


def test_filter_keeps_rows_as_they_are(spark, scored):
    _, docs, labels, got = scored
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == sorted((r["doc_id"] or -1) for r in got if r["predicted"])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", "", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in score_quality(docs, none).collect()] == [0.5]
    assert score_quality(docs.limit(0), none).collect() == []


def test_negatives_are_not_needed():
    rng = np.random.default_rng(0)
    positive, mixed = rng.normal(1, 1, (800, 5)), np.vstack([rng.normal(1, 1, (1200, 5)), rng.normal(-2, 1, (400, 5))])
    model = fit(positive, mixed, 0.75)
    assert np.mean(model.score(rng.normal(1, 1, (500, 5))) > 0.5) > 0.9
    assert np.mean(model.score(rng.normal(-2, 1, (500, 5))) < 0.5) > 0.9


def test_features_are_of_the_whole_text():
    short, long = features([b"ab " * 10]), features([b"ab " * 10 + b"$" * 1000])
    assert not np.allclose(short, long)
    assert np.isfinite(features([None, b"", b"\xff\n\n", b"x" * 10])).all()


def test_labelled_negatives_do_not_matter_and_repeated_rows_score_alike(spark, scored):
    _, docs, labels, got = scored
    alone = score_quality(docs, labels.where("quality = 1")).collect()
    assert sorted(map(repr, alone)) == sorted(map(repr, got))
    twice = score_quality(docs.unionAll(docs.where("doc_id < 40")), labels).where("doc_id < 40").groupBy("doc_id").agg({"score": "count"}).collect()
    assert {r[1] for r in twice} == {2}
