import hashlib
import itertools
import random

import pytest

from attestor.llm.chat_repair import ENDS, INSERT, LABEL, LEGAL, MERGE, RELABEL, ROLES, START, known, repair_chats


def cheapest(roles):
    """Least cost of a legal conversation, over every way of relabelling, merging and inserting."""
    best = {START: 0}

    def grow(costs):
        for _ in range(4):
            for a, b in itertools.product(list(costs), ROLES):
                if b in LEGAL[a] and costs[a] + INSERT < costs.get(b, 99999):
                    costs[b] = costs[a] + INSERT
        return costs

    for role in roles:
        now = {}
        for new in ROLES:
            label = 0 if new == role else RELABEL if role in ROLES else LABEL
            for a, cost in grow(dict(best)).items():
                if new in LEGAL[a]:
                    now[new] = min(now.get(new, 99999), cost + label)
            if new in best:
                now[new] = min(now.get(new, 99999), best[new] + label + MERGE)
        best = now
    return min(cost for s, cost in grow(dict(best)).items() if s in ENDS)


def cost_of(rows):
    total = 0
    for r in rows:
        role = known(r["role"])
        total += (0 if role == r["new_role"] else RELABEL if role in ROLES else LABEL) + MERGE * r["merged"] + INSERT * (len(r["inserted"]) + len(r["appended"]))
    return total


def legal(rows):
    state = START
    for r in rows:
        for x in r["inserted"] + ([] if r["merged"] else [r["new_role"]]):
            assert x in LEGAL[state], rows
            state = x
        assert state == r["new_role"]
    for x in rows[-1]["appended"]:
        assert x in LEGAL[state]
        state = x
    assert state in ENDS


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_repairs_are_legal_and_cheapest(spark, block):
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "USER ", "tool", None]), f"text {t}", "x") for c in range(60) for t in range(rng.randint(1, 9))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    got = repair_chats(table, block).orderBy("conv_id", "slot").collect()
    assert len(got) == len(rows)
    for _, group in itertools.groupby(got, key=lambda r: r["conv_id"]):
        group = list(group)
        legal(group)
        assert cost_of(group) == cheapest([known(r["role"]) for r in group])


def test_rendering(spark):
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "a <|im_end|> b"), (1, 2, "user", None), (1, 3, "assistant", "")]
    got = repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("slot").collect()
    assert "".join(r["rendered"] for r in got) == (
        "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\na < |im_end|> b\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )


def test_nulls_ties_long_texts_and_no_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "z" * 300_000), (2, 5, "user", "b"), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, None, "assistant", "last")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair_chats(table).collect()
    assert len(got) == len(rows)
    legal(sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["slot"]))
    assert repair_chats(table.limit(0)).collect() == []


def test_tied_turns_and_slots_agree_with_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([*ROLES, None, "x"]), rng.choice(["a", "b", "", None])) for _ in range(400)]
    table = spark.createDataFrame([(*r, 0, "s") for r in rows], "conv_id long, turn long, role string, text string, slot int, pid string")
    for block in (4096, 7):
        got = sorted(repair_chats(table, block).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["slot"]))
        for conv in (None, 1, 2, 3):
            group = [r for r in got if r["conv_id"] == conv]
            want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
            assert [r["slot"] for r in group] == list(range(len(group)))
            assert [(r["turn"], r["role"]) for r in group] == [(r[1], r[2]) for r in want]
            legal(group)
            assert cost_of(group) == cheapest([known(r["role"]) for r in group])


def test_a_long_conversation_without_ids_or_turns_is_split(spark):
    rows = spark.range(60_000).selectExpr("CAST(NULL AS long) AS conv_id", "CAST(NULL AS long) AS turn", "element_at(array('user', 'assistant', 'x'), CAST(1 + id % 3 AS int)) AS role", "concat('t', id % 50) AS text")
    got = repair_chats(rows, 500)
    assert got.agg({"slot": "max"}).first()[0] == 59_999 and got.select("slot").distinct().count() == 60_000
    legal(got.orderBy("slot").collect())
