"""Texts without a sign of a disguise, told by one search through their column."""

import random

import pyarrow as pa

from attestor.llm import pii


def told(texts):
    return pii.may_be_disguised(pa.array(texts, pa.string()))


def test_no_text_with_a_window_is_left_out():
    rng = random.Random(5)
    words = [*pii._DIGITS, *pii._TIMES, "plus", "at", "dot", "one", "un", "six"]
    odd = ["ſix", "Sİx", "sıx", "FÜNF", "ZÉRO", "Double", "​", "­", "о", "ｏ", "𝐣", "＠", "K", "Å", "日本", "é", "ё"]
    marks = ["(", ")", "[", "]", "{", "}", "<", ">", "@", ".", ",", "-", "+", "4", "55", "0", "_", "x"]
    blanks = [" ", " ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", " ", "\x0b", ""]
    texts = []
    for _ in range(60_000):
        parts = rng.choices((words, odd, marks, ["joe", "and", "example.com"]), weights=(4, rng.choice([0, 1]), 3, 2), k=rng.randint(1, 6))
        texts.append("".join(rng.choice(p) + rng.choice(blanks) for p in parts))
    maybe = told(texts)
    left = [t for t, m in zip(texts, maybe, strict=True) if not m]
    assert len(left) > 10_000 and sum(maybe) > 10_000
    assert not [t for t in left if pii.windows(t)]


def test_each_sign_is_told():
    signs = ["joe (at) c", "joe[ DOT ]c", "a dot b", "five six", "+one", "4 ,(nine", "drei-5", "a​b", "ｘ", "x ſix 1", "sİx 1"]
    none = [None, "", "one of the six", "someone 5", "look at 41", "a.b@c.de +1 415 555 0199 10.0.0.1", "日本 é"]
    assert told(signs) == [True] * len(signs) and told(none) == [False] * len(none)


def test_only_texts_that_may_have_a_sign_are_searched(monkeypatch):
    seen, inner = [], pii.windows
    monkeypatch.setattr(pii, "windows", lambda text: (seen.append(text), inner(text))[1])
    texts = ["plain words a@b.co " * 200, None, "joe (at) c (dot) org", "", "one text of six words"]
    (got,) = pii._find(iter([pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])]))
    assert seen == ["joe (at) c (dot) org"]
    assert got.column("n_email").to_pylist() == [200, 0, 1, 0, 0]
    assert got.column("spans").to_pylist() == [pii.joined(pii.find_all(t or "")[1]) for t in texts]
