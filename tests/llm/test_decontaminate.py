import hashlib
import pickle
import random
import re
import tracemalloc

import pytest

from attestor.llm.decontaminate import automata, find_contamination, remove_contamination
from attestor.llm.tables import loaded

ITEMS = "item_id int, text string, doc_id int"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for key, item in items:
            v = words(item)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(key)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [15, 100_000])
def test_agrees_with_brute_force(spark, most):
    rng = random.Random(4)
    text = lambda n, k=4: " ".join(rng.choice("abcdefgh"[:k]) + rng.choice(["", ".", "É", "-x"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 40]), 8)) for k in range(12)] + [(50, None), (51, "!!"), (3, "A b"), (60, "zzz")]
    docs = [(i, text(rng.randint(0, 120))) for i in range(150)] + [(200, None), (201, ""), (None, "zzz"), (202, " ".join(t or "" for _, t in items)), (202, "zzz"), (203, "q " * 50_000)]
    got = find_contamination(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame([(k, t, 0) for k, t in items], ITEMS), words_per_automaton=most)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == brute(docs, items)


def test_spans_are_cut_and_clean_texts_stay_as_they_are(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, passage, 0)], ITEMS)
    rows = [(1, f"Start here, {passage.upper()}! And  the end of it all goes on and on and on.", "a"), (2, passage, "b"), (3, "clean\ttext", "c"), (4, None, "d"), (5, "", None)]
    got = {r["doc_id"]: r for r in remove_contamination(spark.createDataFrame(rows, "doc_id long, text string, spans string"), items).collect()}
    assert got[1]["text"] == "Start here, ! And  the end of it all goes on and on and on."
    assert 2 not in got and got[3]["text"] == "clean\ttext" and got[4]["text"] is None and got[5]["text"] == "" and got[3]["spans"] == "c"


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], ITEMS)
    assert [r["contaminated"] for r in find_contamination(docs, items).collect()] == [False]
    assert find_contamination(docs.limit(0), items).collect() == []
    assert remove_contamination(docs, items).collect()[0]["text"] == "a b"


def test_a_worker_holds_one_of_many_automata():
    class Sent:
        def __init__(self, n):
            self.n = n

        @property
        def value(self):
            self._value = self.n
            return self._value

    parts = [Sent(n) for n in range(20)]
    for n in loaded(parts):
        assert sum("_value" in p.__dict__ for p in parts) == 1 and parts[n]._value == n
    assert not any("_value" in p.__dict__ for p in parts)


def test_an_automaton_takes_no_more_room_than_its_numbers():
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(100)).encode()) for k in range(1000)]
    (automaton,) = automata(items)
    data = pickle.dumps(automaton)
    tracemalloc.start()
    again = pickle.loads(data)
    assert tracemalloc.get_traced_memory()[0] < 60 << 20 and again.step(0, 0) > 0
    tracemalloc.stop()


def test_repeated_rows_in_twenty_automata(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randint(0, 30)}" for _ in range(n))
    items = [(k, text(12)) for k in range(20)]
    docs = [(i % 7, " ".join([text(5), items[i % 20][1], text(5)])) for i in range(40)] * 2
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, t, 0) for k, t in items], ITEMS), words_per_automaton=12)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == brute(docs, items)
