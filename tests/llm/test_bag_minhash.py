import random
from collections import Counter

import numpy as np
import pytest

from attestor.llm.bag_minhash import _decide, _meetings, drop_near_duplicates, near_duplicates, signatures
from attestor.llm.components import components
from attestor.llm.decontaminate import words
from attestor.llm.tables import keep_rows
from attestor.llm.shingles import Powers, mix, shingle_bags


def bag(text):
    w = words((text or "").encode())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    """(doc_id, class_id, kept) of each row, by comparing all pairs of rows."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(t or "", bag(t)) for _, t in rows]
    for x, (s, a) in enumerate(bags):
        for y, (t, b) in enumerate(bags[:x]):
            both = sum((a & b).values())
            if (not a and not b and s == t) or (both and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8):
                root[find(x)] = find(y)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(x)
    out = []
    for members in groups.values():
        first = min(members, key=lambda x: (rows[x][0] is None, rows[x][0] or 0, x))
        out += [(rows[x][0], rows[first][0], x == first) for x in members]
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, node int, key string")
    return sorted((tuple(r) for r in near_duplicates(docs).collect()), key=repr)


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.random()}"
    return " ".join(w)


def corpus():
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    base = prose(120)
    rows = [(i, prose(rng.randint(1, 150))) for i in range(60)]
    rows += [(100 + i, edited(base, rng, rng.randint(0, 6))) for i in range(120)]
    for k in range(20):
        t = prose(100)
        rows += [(300 + 4 * k + j, edited(t, rng, j)) for j in range(4)]
    rows += [(500, "same few"), (501, "Same, few!"), (502, None), (503, ""), (504, "?!"), (505, "the word " * 4000), (506, "the word " * 3500), (507, "the word " * 2000), (100, base)]
    return rows


@pytest.mark.parametrize("block", [16, 256])
def test_classes_agree_with_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr("attestor.llm.bag_minhash.BLOCK", block)
    rows = corpus()
    assert found(spark, rows) == classes(rows)


def test_rows_of_one_id_and_repeated_rows(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    a, b = prose(80), prose(90)
    rows = [(1, a), (5, a + " and more"), (5, b), (7, b + " too"), (1, a), (5, b), (None, a), (None, prose(50)), (None, None), (3, ""), (3, "")]
    assert found(spark, rows) == classes(rows)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key_id int")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i is None, i or 0, t or "") for i, t in [(1, a), (5, b), (None, rows[7][1]), (3, "")])
    by_shuffle = keep_rows(docs, _decide(docs, "doc_id", "text", 0.8), "doc_id", "text", small=0)
    assert sorted(map(repr, by_shuffle.select("doc_id", "text").collect())) == sorted(map(repr, kept.select("doc_id", "text").collect()))


def test_meetings_grow_in_step_with_the_group(spark):
    sizes = []
    for n in (1000, 4000):
        near = [(1, 10 + k, 0.8 + 0.19 * k / n, 100) for k in range(n)]
        sizes.append(_meetings(spark.createDataFrame([*near, (1, 5, 0.79, 100)], "leader long, node long, similarity double, weight long"), 0.8).count())
    assert 4000 <= sizes[1] <= 4.5 * sizes[0]
    far = [(1, 10 + k, 0.99, 100) for k in range(1000)] + [(1, 5, 0.5, 100)]
    assert _meetings(spark.createDataFrame(far, "leader long, node long, similarity double, weight long"), 0.8).count() == 0


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "alone here it is all")], "doc_id long, text string")
    assert sorted((r["class_id"] or 0, r["kept"]) for r in near_duplicates(docs).collect()) == [(0, True), (4, False), (4, True)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_agreement_of_registers_is_the_weighted_similarity():
    rng = np.random.default_rng(0)
    a = {k: int(rng.integers(1, 40)) for k in range(60)}
    b = {k: int(rng.integers(1, 40)) for k in range(20, 75)}
    true = sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())
    text, shingle, count = [], [], []
    for repeat in range(200):
        for which, x in ((0, a), (1, b)):
            text += [2 * repeat + which] * len(x)
            shingle += [k * 1_000_003 + repeat for k in x]
            count += list(x.values())
    with np.errstate(over="ignore"):
        s = signatures(np.array(text), mix(np.array(shingle, np.uint64)), np.array(count), 400)
    assert abs((s[0::2] == s[1::2]).mean() - true) < 0.02


def test_bags_agree_with_plain_ones():
    texts = [b"a b c d e f a b c d e", b"A, b; c! d e", b"", None, b"one two", b"x " * 50, "é è é è é è".encode()]
    with np.errstate(over="ignore"):
        text, _, count = shingle_bags(texts, 5, Powers())
    for i, t in enumerate(texts):
        assert sorted(count[text == i].tolist()) == sorted(bag((t or b"").decode()).values())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7), (2000, 1999)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(1000, 1040), 1000), 1999: 1999, 2000: 1999}
