import hashlib
import re

from attestor.llm.exact_dedup import _decide, drop_copies, exact_dedup, summarise
from attestor.llm.tables import keep_rows


def brute(rows):
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for x, (i, t) in enumerate(texts):
        groups.setdefault(t, []).append((i is None, i or 0, x))
    out = []
    for x, (i, t) in enumerate(texts):
        null, keep, first = min(groups[t])
        out.append((i, None if null else keep, len(groups[t]), x == first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, keep_id string")
    return sorted((tuple(r) for r in exact_dedup(docs, **options).collect()), key=repr)


def test_ties_nulls_white_space_and_repeated_rows(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (None, "a b"), (None, "alone"), (7, "z" * 200_000), (8, "z" * 200_000), (8, "z" * 200_000), (4, " a b"), (6, "a\u00a0b")]
    assert found(spark, rows) == brute(rows)


def test_heavy_hitters_take_the_broadcast_path(spark):
    rows = [(i, f"t{i % 3 if i % 2 else i}") for i in range(400)]
    assert found(spark, rows, counters=7) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_misra_gries_keeps_every_frequent_digest():
    stream = ["a", "b", "a", "c", "a", "d", "a", "e", "a"] * 20 + list("fghijklm")
    counts = {}
    for x in stream:
        counts = summarise(counts, {x: 1}, 2)
    assert len(counts) <= 2
    assert 0 < counts["a"] <= stream.count("a")
    assert stream.count("a") - counts["a"] <= len(stream) / 3


def test_one_row_of_each_text_is_left(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, "c "), (None, "c "), (4, None), (2, ""), (2, ""), (5, "a")]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key_id int, of_content string")
    for small in (100, 0):
        left = keep_rows(docs, _decide(docs, "doc_id", "text", 7), "doc_id", "text", small)
        assert left.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, "a"), (1, "b"), (None, "c "), (2, "")], key=repr)
    assert drop_copies(docs.limit(0)).collect() == []
