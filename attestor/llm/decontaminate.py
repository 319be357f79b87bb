"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words stream through the automaton, which tracks the longest match that ends at each word. Where it
reaches a window (WINDOW consecutive words of an item, or the whole of a shorter item), the matched words are
hit. Only runs of word pairs that occur in some item can hold a window, so all other words are passed over
without a step.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.tables import by_size, in_small_batches, loaded

WINDOW = 10
#: Words of items in one automaton; more items go into further automata, of which a task holds one at a time.
WORDS_PER_AUTOMATON = 100_000
BATCH_BYTES = 1 << 20
PAIR_BITS = 20

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of 0-9, a-z and anything beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the items that each window belongs to."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.ids.setdefault(w, len(self.ids)) for w in text]) for key, text in items if text]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: windows[state]: {window length: items}; the state holds a window of that length.
        self.windows: dict[int, dict[int, set]] = {}
        for key, codes in coded:
            size = min(window, len(codes))
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                if i + 1 >= size:
                    self.windows.setdefault(state, {}).setdefault(size, set()).add(key)
        #: nearest[state]: itself or the next suffix that holds a window; 0 where none does.
        self.nearest = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[state] = state if state in self.windows else self.nearest[self.link[state]]
        self.shortest = min((min(window, len(codes)) for _, codes in coded), default=window)
        pairs = {a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F for _, codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        self.pairs[[(p & (2**64 - 1)) >> (64 - PAIR_BITS) for p in pairs]] = True
        self._freeze()

    def _freeze(self) -> None:
        """Transitions as sorted numbers, state * 2 ** 32 + word, which take a twentieth of the dictionaries' room."""
        edges = sorted((state << 32 | c, to) for state, following in enumerate(self.next) for c, to in following.items())
        self.edges, self.to = array("q", (e for e, _ in edges)), array("q", (t for _, t in edges))
        self.link, self.length, self.nearest = array("q", self.link), array("q", self.length), array("q", self.nearest)
        del self.next

    def step(self, state: int, c: int) -> int:
        """Where word c leads from a state, or -1."""
        i = bisect_left(self.edges, state << 32 | c)
        return self.to[i] if i < len(self.edges) and self.edges[i] == state << 32 | c else -1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            found = self.next[last][c]
            return found if self.length[found] == self.length[last] + 1 else self._clone(last, found, c)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            found = self.next[last][c]
            self.link[new] = found if self.length[found] == self.length[last] + 1 else self._clone(last, found, c)
        return new

    def _clone(self, last: int, found: int, c: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = copy
        while last >= 0 and self.next[last].get(c) == found:
            self.next[last][c] = copy
            last = self.link[last]
        return copy

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words, at least as long as the shortest window, whose pairs all may occur in items."""
        known = codes >= 0
        both = known[:-1] & known[1:]
        with np.errstate(over="ignore"):
            pair = codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        both &= self.pairs[(pair >> np.uint64(64 - PAIR_BITS)).astype(np.int64)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], both, [False])).astype(np.int8)))
        first, last = edges[::2], edges[1::2] + 1
        if self.shortest == 1:
            alone = known.copy()
            alone[:-1] &= ~both
            alone[1:] &= ~both
            single = np.flatnonzero(alone)
            first, last = np.concatenate((first, single)), np.concatenate((last, single + 1))
        enough = last - first >= self.shortest
        return list(zip(first[enough].tolist(), last[enough].tolist(), strict=True))

    def scan(self, codes: list[int], first: int, hit: list[tuple[int, int]], items: set) -> int:
        """Adds the hit spans of words and the items with windows; returns the longest match."""
        state = length = longest = 0
        for i, c in enumerate(codes, first + 1):
            while (to := self.step(state, c)) < 0 and state:
                state = self.link[state]
                length = self.length[state]
            state, length = (to, length + 1) if to >= 0 else (0, 0)
            longest = max(longest, length)
            at = self.nearest[state]
            while at:
                for size, keys in self.windows[at].items():
                    if size <= length:
                        hit.append((i - size, i))
                        items |= keys
                at = self.nearest[self.link[at]]
        return longest


def automata(items: Iterable[tuple[object, bytes | None]], window: int = WINDOW, most: int = WORDS_PER_AUTOMATON) -> Iterator[Automaton]:
    part: list[tuple[object, list[bytes]]] = []
    size = 0
    for key, text in items:
        found = words(text)
        if part and size + len(found) > most:
            yield Automaton(part, window)
            part, size = [], 0
        part.append((key, found))
        size += len(found)
    yield Automaton(part, window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hits(texts: list[bytes | None], parts: Iterable[Automaton]) -> list[tuple[int, list[tuple[int, int]], set, int]]:
    """Of each text: its number of words, the hit spans of words, the items found, the longest match."""
    split = [words(t) for t in texts]
    starts = np.cumsum([0, *(len(w) + 1 for w in split)])
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    longest = [0] * len(texts)
    for automaton in parts:
        get = automaton.ids.get
        codes = np.fromiter((x for w in split for x in (*(get(v, -1) for v in w), -1)), np.int64, int(starts[-1]))
        for a, b in automaton.runs(codes):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            longest[k] = max(longest[k], automaton.scan(codes[a:b].tolist(), a - int(starts[k]), spans[k], items[k]))
    return [(len(w), merged(s), found, n) for w, s, found, n in zip(split, spans, items, longest, strict=True)]


def _broadcast(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> list:
    """One broadcast for each automaton, each of bounded size; the items stream to the driver."""
    in_small_batches(items)
    rows = items.select(F.col(id_col), F.col(text_col).cast("binary")).toLocalIterator()
    return [spark.sparkContext.broadcast(a) for a in automata(((r[0], r[1]) for r in rows), window, most)]


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, words_per_automaton: int = WORDS_PER_AUTOMATON) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans.

    longest is the longest match among the runs that can hold a window; spans lists the hit words as
    [first, last) pairs. Null texts and items have no words, and items without words no window; without any
    item nothing is hit. Items that repeat an id count once; texts that several items have count for each. Rows
    that repeat each have their result, and a text of any length is read whole. Other columns of either table,
    whatever their names, are not read; an empty table gives an empty result.
    """
    parts = _broadcast(docs.sparkSession, items, item_col, item_text_col, window, words_per_automaton)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES * min(8, len(parts))):
            out: dict[str, list] = {name: [] for name in schema.names}
            for n, spans, found, longest in hits(batch.column("text").to_pylist(), loaded(parts)):
                hit = sum(b - a for a, b in spans)
                row = (n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0, longest, spans)
                for name, value in zip(schema.names[1:], row, strict=True):
                    out[name].append(value)
            out["doc_id"] = batch.column("doc_id")
            yield pa.RecordBatch.from_pydict(out, schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, spans array<array<long>>")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last letter of each span of words."""
    if not spans:
        return text
    places = [m.span() for m in _WORDS.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join((*out, text[at:]))


def remove_contamination(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.5, words_per_automaton: int = WORDS_PER_AUTOMATON) -> DataFrame:
    """docs with the hit words cut out of the texts; documents of whose words more than `coverage` are hit go.

    All columns of docs stay as they are but for text_col; documents without hits keep their exact text, a
    null text stays null, an empty one empty. Spans reach the length limit, a window, by being hit at all. Rows are
    judged one by one, those that repeat alike; an empty table gives an empty result.
    """
    parts = _broadcast(docs.sparkSession, items, item_col, item_text_col, window, words_per_automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text_col, BATCH_BYTES * min(8, len(parts))):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            keep = []
            for i, (n, spans, _, _) in enumerate(hits([None if t is None else t.encode() for t in texts], loaded(parts))):
                keep.append(sum(b - a for a, b in spans) <= coverage * n)
                if spans and keep[-1]:
                    texts[i] = without_spans(texts[i], spans)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM (SELECT *, least(len(w), 10) AS m FROM i WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS u(p)),
dw AS (
  SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM t, (SELECT DISTINCT m FROM iw) AS s, unnest(range(1, len(w) - m + 2)) AS u(p)),
f AS (SELECT doc_id, p, m, item_id FROM dw JOIN iw USING (m, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM f, unnest(range(p, p + m)) AS u(q) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS keys FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(keys, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
