import random
import re

import pytest

from attestor.llm.url_rules import CONTRACT_RULES, LABEL_RULES, host_rule, index_rules, judge_urls, literal_tokens, read_rules, rule, split_index


def judged(spark, urls, rules=CONTRACT_RULES + LABEL_RULES, **options):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    return [tuple(r)[1:] for r in judge_urls(pages, rules, **options).orderBy("page_id").collect()]


def test_hosts_paths_and_longest_rules(spark):
    urls = ["http://a.example.com/en/1", "https://www.example.com/en/x?y", "https://x.www.example.com/en/", "HTTP://EXAMPLE.NET/es/q#f", "http://example.net/fr", "http://com", "http://com/", "http://notexample.com/en/", "ftp://spam-farm.example.org/a", "nothing", None, "http://a/b://c/d", "http://example.com/EN/"]
    got = judged(spark, urls)
    assert [g[2] for g in got] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/", "com/", None, None, None, None, "com/"]
    assert [g[3] for g in got] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[3][:2] == ("example.net", "/es/q") and got[9][:2] == ("", "") and got[10][:2] == ("", "") and got[11][:2] == ("a", "/b://c/d")


def test_rules_in_several_passes_agree_with_one(spark):
    urls = [f"http://h{i}.d{i % 7}.org/p/{i}" for i in range(60)] + [None]
    rules = [host_rule("block" if i % 2 else "allow", f"d{i}.org", "/p/") for i in range(7)] + [host_rule("block", f"h{i}.d{i % 7}.org", "/p/1") for i in range(30)] + [rule("any", "block", ".*/p/5", (0, 1))]
    assert judged(spark, urls, rules) == judged(spark, urls, rules, index_bytes=200)
    assert len(split_index(index_rules(rules, {}), 200)) > 3


def test_rules_are_filed_under_their_rarest_token():
    rule = host_rule("block", "rare.example.com", "/")
    assert index_rules([rule], {"rare": 1, "example": 50, "com": 90}) == {"rare": [rule]}


def test_no_rules_and_no_pages(spark):
    assert [g[3] for g in judged(spark, ["http://a/", None], [])] == ["allow", "allow"]
    assert judged(spark, []) == []


@pytest.mark.parametrize(
    "pattern, tokens",
    [
        (r"(?:[^/]*\.)?net/es/", ("net", "es")),
        (r"(?:[^/]*\.)?Spam\-Farm(?=[./]|\Z)", ("spam", "farm")),
        (r"www\.example\.com/en/", ("www", "example", "com", "en")),
        (r".*/p/5", ("p",)),
        (r"[a-z]+shop\.com$", ("com",)),
        (r"a?bc/x", ()),
        (r"(?:x\.)?bc/x", ("bc",)),
        (r"(ab|cd)/ef/", ("ef",)),
        (r"ab(?:\.)?cd/", ()),
        (r"ab(?=c)", ()),
    ],
)
def test_tokens_are_read_off_the_expressions(pattern, tokens):
    assert literal_tokens(pattern) == tokens


def test_every_url_that_a_pattern_matches_holds_its_tokens():
    rng = random.Random(1)
    pieces = ["ab", "c", r"\.", "/", r"(?:x\.)?", r"(?:[^/]*\.)?", ".*", "(ab|c)", "[a-c]+", "-", r"(?=[./]|\Z)", "$"]
    checked = 0
    for _ in range(12_000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        tokens = literal_tokens(pattern)
        for _ in range(20):
            url = "".join(rng.choice(["ab", "c", ".", "/", "x", "-"]) for _ in range(rng.randint(1, 8)))
            if re.match(pattern, url, re.DOTALL):
                checked += bool(tokens)
                assert set(tokens) <= set(re.findall("[a-z0-9]+", url)), (pattern, url)
    assert checked > 150


def test_a_path_token_files_its_rule_when_it_is_rarer():
    by_token = index_rules(CONTRACT_RULES, {"net": 90, "com": 99, "example": 80, "www": 70, "es": 3, "fr": 95, "en": 10})
    assert [r.name for r in by_token["es"]] == ["net/es/"] and [r.name for r in by_token["net"]] == ["net/fr/"] and len(by_token["en"]) == 2


def test_rules_of_a_table(spark):
    rows = [("block", "bad.org", None, None), ("allow", "bad.org", "/ok/", None), ("block", None, None, r".*/admin/"), ("block", None, None, None)]
    rules = list(read_rules(spark.createDataFrame(rows, "verdict string, host string, path string, pattern string")))
    assert [r.tokens for r in rules] == [("bad", "org"), ("bad", "org", "ok"), ("admin",)]
    assert [g[3] for g in judged(spark, ["http://bad.org/x", "http://a.bad.org/ok/", "http://c.org/admin/1", "http://c.org/"], rules)] == ["block", "allow", "block", "allow"]


def test_repeated_rows_and_long_urls(spark):
    long = "http://example.net/es/" + "a/" * 200_000
    assert [g[3] for g in judged(spark, [long, long, "http://" + "a." * 100_000 + "com/"])] == ["block", "block", "allow"]
