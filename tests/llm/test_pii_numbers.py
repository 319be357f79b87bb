"""Numbers of mixed digits and words, and bare addresses with any ending."""

import random

import pytest

from attestor.llm import pii


@pytest.mark.parametrize(
    "text, spans",
    [
        ("+1 four one five 555 0199", "phone:0:25"),
        ("4111 1111 1111 111 one", "card:0:22"),
        ("+1 two 0 two five 5 five 0 one nine 9", "phone:0:37"),
        ("+1 (four) 155550199", "phone:0:19"),
        ("10.0.0.one", "ip:0:10"),
        ("joe at example dot pl", "email:0:21"),
        ("joe at example dot museum", "email:0:25"),
        ("joe at example dot nothing", ""),
        ("ſix +1 fıve five 1 Sİx", ""),
        ("x" * 600 + " +1 four one five 555 0199", "phone:601:626"),
    ],
)
def test_single_words_open_a_window(text, spans):
    assert pii.joined(pii.find_all(text)[1]) == spans


def test_windows_miss_nothing_that_the_whole_text_shows(monkeypatch):
    rng = random.Random(3)
    parts = ["+1", "four", "One", "fünf", "double two", "plus", "0", "1", "5", "41", "555", "1111", "0199", "and", "x"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "-", ".", ", ", ""]) for _ in range(rng.randint(6, 20))) for _ in range(20_000)]
    texts += [f"+1 {' '.join(rng.choice(['four', '4', '12']) for _ in range(8))}" for _ in range(1000)]
    found = [pii.find_all(t)[1] for t in texts]
    monkeypatch.setattr(pii, "windows", lambda text: [(0, len(text))])
    assert found == [pii.find_all(t)[1] for t in texts] and sum(map(len, found)) > 1000


@pytest.mark.parametrize(
    "text, spans",
    [
        ("a" * 400 + "(at)example(dot)com", "email:0:419"),
        ("bob (at)" + " " * 300 + "example.com", "email:0:319"),
        ("plus" + " five" * 11, "phone:0:59"),
        ("x " * 700 + "joe" + " " * 600 + "(at) example (dot) com and so on", "email:1400:2025"),
        ("𝐣𝐨𝐞@example.com", "email:0:15"),
    ],
)
def test_no_length_is_too_long(text, spans):
    assert pii.joined(pii.find_all(text)[1]) == spans


def test_windows_miss_nothing_in_disguised_texts(monkeypatch):
    rng = random.Random(4)
    parts = ["a" * 400, "joe", "(at)", " at ", "[dot]", " dot ", "dot", "com", "pl", " " * 300, "\n", ".", "five", "five five", "plus", "double", "41", "555", "+", "and the", "of ordinary words", "日本", "é", "о", "\u200b", "@", "x", "joe (at) c [dot] org", "ann at example dot pl", "+1 four one five 555 0199"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "\u00a0", ", "]) for _ in range(rng.randint(2, 40))) for _ in range(1500)]
    found = [pii.find_all(t)[1] for t in texts]
    monkeypatch.setattr(pii, "windows", lambda text: [(0, len(text))])
    assert found == [pii.find_all(t)[1] for t in texts] and sum(map(len, found)) > 300


def test_long_stretches_of_white_space_cost_their_length():
    text = "joe" + " " * 200_000 + "five six" + " " * 200_000 + "(at) x"
    assert pii.find_all(text)[1] == []
