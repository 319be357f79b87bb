import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest

from tests.conftest import ROOT

from attestor.llm.induced_sort import CAP, Scratch, sort_suffixes
from attestor.llm.suffix_dedup import remove_repeats, without_periods


def plain_order(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < CAP and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common


def sorted_by(text, chunk, symbols=None):
    scratch = Scratch()
    scratch.chunk = chunk
    parts = list(sort_suffixes(np.asarray(text, np.uint16), symbols or int(max(text)) + 1, scratch))
    scratch.close()
    return tuple(np.concatenate(x).tolist() for x in zip(*parts))


@pytest.mark.parametrize("chunk", [4, 16, 1000])
def test_suffix_order_and_common_prefixes(chunk):
    rng = np.random.default_rng(chunk)
    for trial in range(200):
        text = rng.integers(1, int(rng.integers(2, 7)), int(rng.integers(1, 100)))
        if trial % 3 == 0:
            text = np.repeat(text, rng.integers(1, 9, len(text)))
        if trial % 5 == 0:
            text = np.tile(text, 3)
        text = np.concatenate((text, [0])).tolist()
        order, common = sorted_by(text, chunk)
        want_order, want_common = plain_order(text)
        assert common == want_common and sorted(order) == sorted(want_order)
        assert all(text[a : a + CAP] == text[b : b + CAP] for a, b in zip(order, want_order))  # beyond that any order


MEASURE = """
import random, sys, threading, time
sys.path.insert(0, sys.argv[1])
import numpy.ma
from attestor.llm.suffix_dedup import Shard

def own():  # without pages of files
    resident, shared = map(int, open("/proc/self/statm").read().split()[1:3])
    return (resident - shared) * 4096

def made(n):
    rng, size, k, before = random.Random(1), 0, 0, []
    while size < n:
        before = before[-3:] + [rng.randbytes(rng.randint(100, 400)).translate(bytes(97 + i % 9 for i in range(256)))]
        yield k, 0, 0, before[-1]
        if k % 10 == 9:
            yield k, 1, 0, b"x" + before[0][:100]
        k, size = k + 1, size + len(before[-1])

def run(n, memory):
    global peak
    shard = Shard(100, memory)
    assert list(shard.add(made(n))) == []
    peak = base = own()
    found = sum(len(x[0]) for x in shard.spans())
    shard.close()
    return found, peak - base

def watch():
    global peak
    while True:
        peak = max(peak, own())
        time.sleep(0.002)

peak = 0
threading.Thread(target=watch, daemon=True).start()
run(1 << 17, 1 << 20)
for n in (2 << 20, 8 << 20):
    print(*run(n, 1 << 20), sum(d == 1 for _, d, _, _ in made(n)))
"""


def test_memory_stays_within_its_budget_whatever_the_shard():
    out = subprocess.run([sys.executable, "-c", MEASURE, ROOT], capture_output=True, text=True, check=True).stdout
    (found, small, planted), (found_more, large, planted_more) = (map(int, line.split()) for line in out.splitlines())
    assert found == planted > 100 and found_more == planted_more
    assert large < small + (1 << 20) and large < 4 << 20, out  # the longer shard is eight times the memory


def brute(rows, length=100):
    seen, out = {}, []
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    result = {}
    for null, i, t in docs:
        b = t.encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (null, i, t, p)) != (null, i, t, p):
                covered[p : p + length] = b"\1" * length
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        result[null, i, t] = (None if null else i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    for i, t in rows:
        out.append(result[i is None, i or 0, t or ""])
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    line = "the same line of boilerplate that stands in every document of the site and goes on for a good while, over a hundred bytes."
    rows = []
    for i in range(120):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 300)))
        if i % 2:
            t += line + "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        if i % 7 == 0:
            t += "a" * rng.randint(90, 700)
        if i % 11 == 0:
            t = t + "é" * 120 + t
        if i % 17 == 0:
            t += "spam " * rng.randint(30, 60)
        rows.append((rng.randint(0, 10**6), t if i % 13 else None))
    return rows + [(10**7 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(10**8, "q" * 60_000 + "r"), (None, rows[1][1]), (3, ""), (5, "twice " * 40), (5, "twice " * 40)]


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 1}, {"hot_bytes": 500, "shard_bytes": 2000, "bucket_bytes": 3000, "held": 2}, {"memory": 100}])
def test_agrees_with_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, tag int")
    got = sorted((tuple(r)[:5] for r in remove_repeats(docs, **options).collect()), key=repr)
    assert got == brute(rows)


def test_documents_of_one_id_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x" * 150), (1, "x" * 149 + "y")], "doc_id long, text string")
    assert sum(r["n_removed"] for r in remove_repeats(docs).collect()) > 200
    assert remove_repeats(docs.limit(0)).collect() == []


def test_kept_bytes_and_spans_make_up_the_text(spark):
    docs = spark.createDataFrame([(1, "a" * 100 + "b" * 100), (2, "c" * 50 + "a" * 100 + "d" * 20)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(docs, with_bytes=True).collect()}
    assert bytes(got[2]["kept"]) == b"c" * 50 + b"d" * 20 and got[2]["spans"] == [[50, 150]]
    assert bytes(got[1]["kept"]) == b"a" * 100 + b"b" * 100 and got[1]["spans"] == []


def test_long_periods_are_shortened(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    texts = [word(30) + unit * (6000 // len(unit)) + word(40) for unit in ("q", "ab", "spam ", word(37), word(61), word(99))]
    texts += [texts[2][200:1500], texts[4][1000:4000] + "!", "z" * 350 + word(3) + "z" * 900 + "spam " * 900 + "q" * 2000]
    assert any(len(without_periods(t.encode(), 100)) > 1 for t in texts)
    rows = list(enumerate(texts))
    got = sorted((tuple(r)[:5] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_a_query_with_a_shard_of_eight_times_the_memory(spark):
    rng = random.Random(7)
    line = "the same line of boilerplate in each of them, 60 bytes long. "
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(90)) + line + "".join(rng.choice("abcd") for _ in range(60))) for i in range(3000)]
    rows += [(9000 + i, "new" + rows[i * 7][1][50:]) for i in range(200)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), memory=1 << 16, shard_bytes=1 << 30)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(rows)
