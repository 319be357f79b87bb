import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_bag_minhash import classes
from tests.llm.test_decontaminate import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    passage = prose(40)
    texts = [prose(rng.randint(40, 120)) if i % 6 else "### | | $$$ " * rng.randint(10, 40) for i in range(400)]
    rows = list(enumerate(texts))
    rows += [(1000, texts[1]), (1001, texts[1].replace(" ", "  ")), (1002, texts[2] + " one more"), (1003, texts[3] + " " + passage), (1004, passage), (1005, None), (1006, "")]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 6 else 0, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id int, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), texts, passage


def test_stages_take_effect(spark, tables):
    path, texts, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs.write.parquet(f"{path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{path}/{name.replace(' ', '-')}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i for i in range(400) if i % 6}
    assert not any(i in kept["quality classifier"] for i in range(0, 400, 6))
    assert good <= set(kept["quality classifier"])
    assert not {1000, 1001} & set(kept["exact dedup"]) and good <= set(kept["exact dedup"])
    assert 1002 not in kept["near-duplicate detection"] and good <= set(kept["near-duplicate detection"])
    last = kept["benchmark decontamination"]
    assert good <= set(last) and 1004 not in last
    assert all(passage.rstrip(".") not in (r["text"] or "") for r in last.values())
    assert all(last[i]["text"] == texts[i] for i in good)


def test_run_gives_the_last_stage(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    assert len(corpus_pipeline.STAGES) == 5 and os.path.exists(tables[0])


WIDE = DOCS + ", key_id int, kept string, doc string"


def stages_over(spark, docs, path, out):
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, path).write.parquet(f"{out}/{name.replace(' ', '-')}")
        docs = spark.read.schema(docs.schema).parquet(f"{out}/{name.replace(' ', '-')}")
        assert docs.columns == before
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    return docs, kept


def test_odd_rows_in_every_stage(spark, tables, tmp_path):
    path, texts, passage = tables
    long = " ".join(f"{t[:-1]}" for t in texts[1:6]) * 20
    rows = [(7, texts[7]), (7, texts[7]), (7, texts[8]), (None, texts[9]), (None, texts[9]), (None, texts[10]), (8, texts[8] + " too"), (11, None), (12, ""), (13, long), (14, long), (15, texts[13] + " " + passage), (15, texts[13] + " " + passage)]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), k, "x", None) for k, (i, t) in enumerate(rows)], WIDE)
    last, kept = stages_over(spark, docs, path, tmp_path)
    count = lambda name, row: kept[name].count(row)
    assert all(count("quality classifier", r) == rows.count(r) for r in rows if r[1])
    for name in ("exact dedup", "near-duplicate detection"):
        assert count(name, (7, texts[7])) == 1 and count(name, (None, texts[9])) == 1 and count(name, (None, texts[10])) == 1
        assert count(name, (13, long)) == 1 and count(name, (14, long)) == 0
    assert count("exact dedup", (7, texts[8])) == 1 and count("exact dedup", (8, texts[8] + " too")) == 1
    # of the two near copies the smaller id stays, and its id's other text with it
    assert count("near-duplicate detection", (7, texts[8])) == 1 and count("near-duplicate detection", (8, texts[8] + " too")) == 0
    cut = [t for i, t in kept["benchmark decontamination"] if i == 15]
    assert len(cut) == 1 and passage.rstrip(".") not in cut[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, last, path)
    assert pieces.count() >= last.count()


def test_empty_table(spark, tables, tmp_path):
    docs = spark.createDataFrame([], WIDE)
    last, kept = stages_over(spark, docs, tables[0], tmp_path)
    assert not any(kept.values()) and corpus_pipeline.STAGES[-1][1](spark, last, tables[0]).collect() == []


def test_run_agrees_with_brute_force(spark, tables):
    """All stages but the model's scores in plain Python over what the classifier keeps."""
    path, _, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_quality(spark, docs, path).collect()]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    rows = sorted(first.values())
    keep = {i for i, c, kept in classes(rows) if kept}
    rows = [(i, t) for i, t in rows if i in keep]
    clean = []
    for i, t in rows:
        w = words(t)
        grams = {tuple(words(passage)[k : k + 10]) for k in range(len(words(passage)) - 9)}
        hit = {q for p in range(len(w) - 9) if tuple(w[p : p + 10]) in grams for q in range(p, p + 10)}
        if len(hit) <= 0.5 * len(w):
            clean.append((i, w, hit, t))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, *_ in clean}
    for i, _, hit, t in clean:
        if not hit:  # what is cut out of a text is tested with its operator
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
            assert sum(r["length"] for r in got[i]) == len(ids) and len(got[i]) == -(-len(ids) // 2048)
            assert {r["ids_crc32"] for r in got[i]} == {zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()) for k in range(0, len(ids), 2048)}
    sequences = {}
    for r in (r for rs in got.values() for r in rs):
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
