"""URL filtering by pattern rules that are indexed by their rarest literal token.

Every rule is a regular expression over "host/path". The tokens that any URL it matches must hold, of the host or
the path, are read off the expression, and the rule is filed under the one of them that fewest URLs hold, counted
over all URLs. A URL's tokens fetch its candidate rules, and only these run their expressions.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.tables import loaded

TOKEN = re.compile(r"[a-z0-9]+")
#: Pickled bytes of one rule index that is broadcast; more rules than fit are matched in further passes.
INDEX_BYTES = 32 << 20


def _simple(parsed) -> Iterator[str]:
    """A parsed expression as single characters that it must match in turn, with marks between them: "end" where no token
    goes on, "maybe" for what may be missing and otherwise ends outside a token, "any" for the rest."""
    for op, value in parsed:
        if op is sre.LITERAL:
            yield from chr(value).lower()
        elif op is sre.SUBPATTERN and not value[1] and not value[2]:
            yield from _simple(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[1] == 1:
            inner = list(_simple(value[2]))
            if value[0] == 1:
                yield from inner
            else:
                yield "maybe" if inner and (inner[-1] == "end" or len(inner[-1]) == 1 and not TOKEN.match(inner[-1])) else "any"
        elif op is sre.ASSERT and value[0] == 1 and _outside(value[1]) or op is sre.AT and value in (sre.AT_END, sre.AT_END_STRING):
            yield "end"
        else:
            yield "any"


def _outside(parsed) -> bool:
    """Whether all that the expression can begin with, or its match of nothing at the end, ends a token."""
    for op, value in list(parsed)[:1]:
        if op is sre.SUBPATTERN:
            return _outside(value[3])
        if op is sre.BRANCH:
            return all(_outside(x) for x in value[1])
        if op is sre.IN:
            return all(kind is sre.LITERAL and not TOKEN.match(chr(c).lower()) for kind, c in value)
        return op is sre.AT and value in (sre.AT_END, sre.AT_END_STRING) or op is sre.LITERAL and not TOKEN.match(chr(value).lower())
    return False


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The whole tokens that every URL which the pattern matches, from its start on, must hold."""
    found: list[str] = []
    token, after, clean = "", False, True  # clean: a token may begin here

    def end(whole: bool) -> None:
        nonlocal token
        if token and after and whole:
            found.append(token)
        token = ""

    for x in (*_simple(_parser.parse(pattern)), "any"):
        if len(x) == 1 and TOKEN.match(x):
            if not token:
                after = clean
            token += x
            clean = False
        else:
            pending = bool(token)
            end(x not in ("maybe", "any"))
            clean = clean and not pending if x == "maybe" else x != "any"
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    """name is reported; of the rules that fit, the one with the highest rank decides, then the last by name."""

    name: str
    verdict: str
    pattern: str
    rank: tuple[int, int]
    tokens: tuple[str, ...] = ()


def rule(name: str, verdict: str, pattern: str, rank: tuple[int, int] = (0, 0)) -> Rule:
    return Rule(name, verdict, pattern, rank, literal_tokens(pattern))


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains if the URL's path starts with path; longer rules outrank shorter ones and all label rules."""
    return rule(f"{host}{path}", verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (1, len(host) + len(path)))


def host_label_rule(verdict: str, words: str) -> Rule:
    """Fits hosts that have words, such as cheap-pills, as a whole label."""
    return rule(f"label:{words}", verdict, rf"(?:[^/]*\.)?{re.escape(words)}(?=[./]|\Z)", (0, len(words)))


def read_rules(table: DataFrame) -> Iterator[Rule]:
    """Rules of a table (verdict, host, path, pattern): by pattern, over "host/path", where there is one, else by host and
    path; rows with neither are passed over. Rows come to the driver one by one, where the index is built in parts."""
    for r in table.select("verdict", "host", "path", "pattern").toLocalIterator():
        if r["pattern"] is not None:
            yield rule(f"pattern:{r['pattern']}", r["verdict"], r["pattern"], (0, len(r["pattern"])))
        elif r["host"] is not None:
            yield host_rule(r["verdict"], r["host"], r["path"] or "/")


#: The host and path rules of the query's contract.
CONTRACT_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: Rules of our own for URLs that no contract rule fits; what no rule fits at all is allowed.
LABEL_RULES = tuple(host_label_rule("block", words) for words in ("spam-farm", "cheap-pills", "casino", "adult", "warez"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """How many rows of urls(host, path) hold each of the given tokens; as many rows come to the driver as tokens are given."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("[a-z0-9]+"), F.lit(0)))
    wanted = F.array(*[F.lit(t) for t in sorted(set(tokens))])
    counts = urls.select(F.explode(F.array_intersect(found, wanted)).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


def index_rules(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; a rule without tokens is filed under the empty token, which every URL has."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def split_index(index: dict[str, list[Rule]], most: int = INDEX_BYTES) -> list[dict[str, list[Rule]]]:
    """Parts of the index whose pickled sizes stay below most, or hold a single rule."""
    parts: list[dict[str, list[Rule]]] = [{}]
    size = 0
    for token, rules in index.items():
        for r in rules:
            n = len(pickle.dumps((token, r)))
            if size and size + n > most:
                parts.append({})
                size = 0
            parts[-1].setdefault(token, []).append(r)
            size += n
    return parts


def best_rule(host: str, path: str, index: dict[str, list[Rule]], compiled: dict) -> Rule | None:
    url = host + path
    best = None
    for token in {"", *TOKEN.findall(url.lower())}:
        for candidate in index.get(token, ()):
            if best is not None and (best.rank, best.name) >= (candidate.rank, candidate.name):
                continue
            if (found := compiled.get(candidate.pattern)) is None:
                found = compiled[candidate.pattern] = re.compile(candidate.pattern, re.DOTALL)
            if found.match(url):
                best = candidate
    return best


def _match(parts: list):
    """The rule that decides each row, of all parts of the index; a task holds one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict = {}
        for batch in batches:
            urls = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            best: list[Rule | None] = [None] * len(urls)
            for index in loaded(parts):
                for i, (host, path) in enumerate(urls):
                    found = best_rule(host, path, index, compiled)
                    if found and (best[i] is None or (found.rank, found.name) > (best[i].rank, best[i].name)):
                        best[i] = found
                if len(parts) > 1:
                    compiled.clear()
            made = [pa.array([b and b.rank[0] for b in best], pa.int32()), pa.array([b and b.name for b in best], pa.string()), pa.array([b.verdict if b else "allow" for b in best])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "kind", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: Iterable[Rule] = CONTRACT_RULES + LABEL_RULES, *, id_col: str = "page_id", url_col: str = "url", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, matched.

    host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; path goes on to
    "?", "#" or the end; both are empty for a null URL or one without "://". rule names the host and path rule
    that decided, or is null where a rule of another kind (matched names it) or the default, allow, did. Of rules
    of one rank that fit, the last by name decides. Rows that repeat each have their result, and a URL of any length
    is read whole; other columns, whatever their names, are not read. No rules at all allow everything; an empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    rules = list(rules)
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    index = index_rules(rules, token_counts(urls, [t for r in rules for t in r.tokens]) if rules else {})
    parts = [spark.sparkContext.broadcast(part) for part in split_index(index, index_bytes)]
    found = urls.mapInArrow(_match(parts), f"page_id {urls.schema['page_id'].dataType.simpleString()}, host string, path string, kind int, rule string, verdict string")
    return found.select("page_id", "host", "path", F.when(F.col("kind") == 1, F.col("rule")).alias("rule"), "verdict", F.col("rule").alias("matched"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    regexp_extract('.' || host || '.', '\.(spam-farm|cheap-pills|casino|adult|warez)\.', 1) AS label
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN label <> '' THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(rule, CASE WHEN label <> '' THEN 'label:' || (
    SELECT w FROM (VALUES ('spam-farm'), ('cheap-pills'), ('casino'), ('adult'), ('warez')) t(w)
    WHERE contains('.' || host || '.', '.' || w || '.') ORDER BY length(w) DESC, w DESC LIMIT 1) END) AS matched
FROM r
"""
