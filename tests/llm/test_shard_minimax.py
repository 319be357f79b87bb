import random
import zlib

import pytest

from attestor.llm import shard_minimax
from attestor.llm.shard_minimax import minimax_shards, smallest_capacity


def greedy(sizes, shards):
    def cuts(capacity):
        out, filled, at = [], 0, 0
        for x in sizes:
            if filled + x > capacity:
                out.append(at)
                filled = 0
            filled, at = filled + x, at + x
        return out

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(cuts(mid)) < shards else (mid + 1, high)
    return cuts(low)


def lookups(sizes):
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]

    def ends_between(ranges, width):
        out = []
        for a, b in ranges:
            slices = {}
            for e in ends:
                if a < e <= b:
                    k = (e - 1 - a) // width
                    top, n = slices.get(k, (0, 0))
                    slices[k] = (max(top, e), n + 1)
            out.append(slices)
        return out

    return ends_between, ends[-1]


@pytest.mark.parametrize("slices", [4, 64, 1024])
def test_search_agrees_with_a_plain_one(monkeypatch, slices):
    monkeypatch.setattr(shard_minimax, "SLICES", slices)
    rng = random.Random(slices)
    for _ in range(100):
        sizes = [rng.choice([1, 2, rng.randint(1, 1000), rng.randint(1, 100_000)]) for _ in range(rng.randint(1, 200))]
        ends_between, total = lookups(sizes)
        assert smallest_capacity(ends_between, total, max(sizes), 8) == greedy(sizes, 8)


def brute(rows, shards):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    order = sorted(groups, key=lambda t: min(x for x in groups[t] if x >= 0))
    sizes = [len(groups[t]) * (len(t.encode()) + 1) for t in order]
    cuts, at, shard_of = greedy(sizes, shards), 0, {}
    for t, n in zip(order, sizes, strict=True):
        at += n
        shard_of[t] = sum(at > c for c in cuts)
    return shard_of


def test_shards_hold_whole_groups_and_slots_have_no_gaps(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["same", None, "", f"text {i} " * rng.randint(0, 40), "é" * 50])) for i in range(300)] + [(7, "twice"), (7, "twice"), (400, "w" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, part int")
    got = [tuple(r) for r in minimax_shards(docs, 8).collect()]
    want = brute(rows, 8)
    assert len(got) == len(rows)
    by_crc = {zlib.crc32((t or "").encode()): t or "" for _, t in rows}
    for doc_id, size, crc, law, shard, slot, grown in got:
        t = by_crc[crc]
        assert (size, law, shard, grown) == (len(t.encode()) + 1, "bytes", want[t], None), (doc_id, t[:20])
    for k in range(8):
        slots = sorted(r[5] for r in got if r[4] == k)
        assert slots == list(range(len(slots)))


def test_fewer_groups_than_shards_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    assert sorted(r["slot"] for r in minimax_shards(docs, 8).collect()) == [0, 0, 0]
    assert minimax_shards(docs.limit(0), 8).collect() == []
