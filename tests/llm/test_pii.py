import random
import re

import pytest

from attestor.llm.pii import KINDS, find_all, find_personal_data, joined, redact

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for n, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


def test_base_spans_agree_with_the_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("1234567890.@+- ()abA..11") for _ in range(rng.randint(0, 60)))
        base, every = find_all(text)
        assert base == brute(text) and set(base) <= set(every)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("mail john.doe (at) example (dot) com now", "email:5:36"),
        ("write to john at example dot com please", "email:9:32"),
        ("joe[at]mail.example.org", "email:0:23"),
        ("ｊｏｅ@ｅｘａｍｐｌｅ.com", "email:0:15"),
        ("jоhn@exаmple.com", "email:0:16"),
        ("call plus one five five five two three four five six seven eight", "phone:5:64"),
        ("card four one one one one one one one one one one one one one one one ok", "card:5:69"),
        ("192 dot 168 dot 1 dot 10", "ip:0:24"),
        ("4111​111111111111", "card:0:17"),
        ("see you at noon dot matrix printers at home", ""),
        ("look at example.com, it is at the top", ""),
        ("one two three four five", ""),
        ("a@b.co and joe (at) c (dot) org", "email:0:6,email:11:31"),
        ("", ""),
    ],
)
def test_disguises_map_back_to_the_source(text, spans):
    assert joined(find_all(text)[1]) == spans


def test_rows(spark):
    rows = [(1, "a@b.co 10.0.0.1"), (2, None), (3, ""), (None, "x" * 300_000 + " a@b.co"), (1, "a@b.co 10.0.0.1"), (5, "1" * 100_000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in find_personal_data(docs).collect()), key=repr)
    assert len(got) == 6 and [r[-1] for r in got if r[0] == 1] == ["email:0:6,ip:7:15"] * 2
    assert [r[-1] for r in got if r[0] is None] == ["email:300001:300007"]
    assert find_personal_data(docs.limit(0)).collect() == []


def test_redaction():
    assert redact("from a@b.co, joe (at) c (dot) org") == "from [EMAIL], [EMAIL]"
