"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Around signs of a disguise (look-alike characters,
"(at)", "[dot]", " dot ", spelled digits) transducers rewrite the text into a normal form and keep, for each
character they write, the characters it came from; identifiers found in the normal form are mapped back
through these. Such a span is added where it does not touch a base span of its kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.endings import ENDINGS
from attestor.llm.tables import by_size, in_small_batches

KINDS = ("email", "ip", "card", "phone")
BATCH_BYTES = 1 << 20
#: Characters searched first for the edge of a window; where there is none, twice as many, and so on.
REACH = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > least and text[first - 1] in _LOCAL:
            first -= 1
        found = _DOMAIN.match(text, at) if first < at else None
        if found:
            least = found.end()
            out.append((first, least))
        at = text.find("@", max(at + 1, least))
    return out


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(map(_is_byte, m[0].split(".")))]


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

def _shapes() -> dict[str, str]:
    """The full-width forms and the mathematical alphabets of ASCII characters, by their decompositions."""
    out = {}
    for c in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        kind, _, code = unicodedata.decomposition(chr(c)).partition(" ")
        if kind in ("<wide>", "<font>") and " " not in code and int(code, 16) < 128:
            out[chr(c)] = chr(int(code, 16))
    return out


#: Look-alikes of ASCII characters: their other forms by rule, and Cyrillic and Greek letters of the same shape.
LOOKALIKES = _shapes() | dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ．＠", "aeopcyxijsdhqwABEKMHOPCTXIJSaovpABEZHIKMNOPTYX.@", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
_STRANGE = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "]")

#: Spelled digits in the corpus's languages, each list from 0 to 9.
SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {word: str(i) for words in SPELLED for i, word in enumerate(words.split())}
_TIMES = {"double": 2, "triple": 3}
_WORD = "|".join(sorted((*_DIGITS, *_TIMES, "plus"), key=len, reverse=True))
#: Runs of number words, digits and plus signs; those with a word are signs of disguise.
_RUN = rf"(?:[0-9+]|\b(?:{_WORD})\b)(?:[\s,.()-]*+(?:[0-9+]|\b(?:{_WORD})\b))++"
_NUMBERS, _NUMBERS_ANY_CASE = re.compile(_RUN), re.compile(_RUN, re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]", re.IGNORECASE)
_DOT = re.compile(r"\sdot\s", re.IGNORECASE)
#: White space is only tried from where it begins, so that long stretches of it cost no more than their length.
_SPACE = r"(?:(?<!\s)\s++)"
_RULES = re.compile(
    rf"(?P<at>{_SPACE}?[\[({{<]\s*+(?:at|@)\s*+[\])}}>]\s*+)|(?P<dot>{_SPACE}?[\[({{<]\s*+(?:dot|\.)\s*+[\])}}>]\s*+|{_SPACE}dot\s++)|(?P<bare>{_SPACE}at\s++)"
    rf"|(?P<plus>\bplus\b\s*+)|(?P<times>\b(?:{'|'.join(_TIMES)})\b\s++(?=(?:{'|'.join(_DIGITS)})\b))|(?P<digit>\b(?:{'|'.join(sorted(_DIGITS, key=len, reverse=True))})\b)|(?P<gap>(?<=\w)(?:\s*+,\s*+|\s++)(?=(?:{_WORD}|[0-9])\b))",
    re.IGNORECASE,
)

_FOLDED = str.maketrans({"ſ": "s", "ı": "i", "\u0307": None})


def _lower(word: str) -> str:
    """A word that a pattern found in any case, as the tables spell it: the pattern takes ſ for s, ı and İ for i."""
    return word.lower().translate(_FOLDED)


class Normal:
    """A normal form of text[first:last]: of each of its characters, where it begins and ends in the text, and which
    transducer wrote it (empty for a copy)."""

    def __init__(self, text: str, first: int, last: int):
        kept = [i for i in range(first, last) if text[i] not in INVISIBLE]
        plain = "".join(LOOKALIKES.get(text[i], text[i]) for i in kept)
        self.out: list[str] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.by: list[str] = []
        at = times = 0

        def copy(stop: int) -> None:
            for i in range(at, stop):
                self._write(plain[i], kept[i], kept[i] + 1, "" if plain[i] == text[kept[i]] and (i == 0 or kept[i] == kept[i - 1] + 1) else "shape")

        for m in _RULES.finditer(plain):
            copy(m.start())
            begin, end, rule = kept[m.start()], kept[m.end() - 1] + 1, m.lastgroup
            if rule == "times":
                times = _TIMES[_lower(m[0].strip())]
            elif rule == "digit":
                for _ in range(times or 1):
                    self._write(_DIGITS[_lower(m[0])], begin, end, rule)
                times = 0
            else:
                self._write({"at": "@", "dot": ".", "bare": "@", "plus": "+", "gap": " "}[rule], begin, end, rule if m[0] != " " else "")
            at = m.end()
        copy(len(plain))
        self.text = "".join(self.out)

    def _write(self, char: str, begin: int, end: int, by: str) -> None:
        self.out.append(char)
        self.begin.append(begin)
        self.end.append(end)
        self.by.append(by)

    def spans(self, kind: str) -> Iterator[Span]:
        """Identifiers that only the normal form shows. A bare " at " makes an address only with a disguised dot and one of ENDINGS."""
        for a, b in FINDERS[kind](self.text):
            by = set(self.by[a:b])
            if by <= {"", "gap"}:
                continue
            if "bare" in by and not (kind == "email" and "dot" in by and self.text[a:b].rpartition(".")[2].lower() in ENDINGS):
                continue
            yield self.begin[a], self.end[b - 1]


_ORDINARY = rf"(?!(?:{_WORD}|at|dot)\s)[A-Za-z]+(?=\s)"
#: Where no rule and no identifier can pass: between two ordinary words, or at a letter of a script without look-alikes.
_BARRIER = re.compile(rf"(?<=\s)(?P<left>{_ORDINARY})\s+(?P<right>{_ORDINARY})|[\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3]", re.IGNORECASE)


def _edge_before(text: str, at: int, least: int) -> int:
    """Where the last barrier before `at` leaves off, or `least`."""
    reach = REACH
    while True:
        first, found = max(least, at - reach), None
        for found in _BARRIER.finditer(text, max(0, first - 1), at):
            pass
        if found:
            return found.start("right") if found["right"] else found.start()
        if first == least:
            return least
        reach *= 2


def _edge_after(text: str, at: int) -> int:
    found = _BARRIER.search(text, at)
    if not found:
        return len(text)
    return found.end("left") if found["left"] else found.end()


def windows(text: str) -> list[Span]:
    """Stretches of the text around signs of a disguise, each up to the barriers next to it: what the transducers
    find in them is what they find in the whole text."""
    signs = [] if text.isascii() else [m.span() for m in _STRANGE.finditer(text)]
    signs += [m.span() for m in _BRACKETED.finditer(text)]
    low = text.lower()
    if "dot" in low:
        signs += [m.span() for m in _DOT.finditer(text)]
    cased = len(low) != len(text) or not text.isascii() and ("ſ" in text or "ı" in text)
    found = _NUMBERS_ANY_CASE.finditer(text) if cased else _NUMBERS.finditer(low)
    signs += [m.span() for m in found if m[0].lower() != m[0].upper()]
    out: list[Span] = []
    for a, b in sorted(signs):
        done = out[-1][1] if out else 0
        if b <= done:
            continue
        last = _edge_after(text, b)
        if a < done:  # a sign that begins in a window and ends beyond it
            out[-1] = (out[-1][0], last)
        else:
            out.append((_edge_before(text, a, done), last))
    return out


def _set(chars: Iterable[str]) -> str:
    """chars for a class of RE2, which knows less white space than `re`."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in chars)


_BLANK = _set(c for c in map(chr, range(0x110000)) if c.isspace())
#: What each text with a sign has, and hardly another, in RE2, which reads a whole column at a fraction of the cost. Its \b
#: goes by ASCII and so holds wherever that of `re` does around words that begin and end in ASCII; letters that `re` alone
#: takes for ASCII ones count as strange.
_MAYBE = (
    f"[{_set(LOOKALIKES)}{_set(INVISIBLE)}{_set('ſıİ')}]",
    rf"(?i)[\[({{<][{_BLANK}]*(?:at|@|dot|\.)[{_BLANK}]*[\])}}>]|[{_BLANK}]dot[{_BLANK}]"
    rf"|\b(?:{_WORD})\b[{_BLANK},.()-]*(?:[0-9+]|\b(?:{_WORD})\b)|[0-9+][{_BLANK},.()-]*\b(?:{_WORD})\b",
)


def may_be_disguised(texts: pa.Array) -> list[bool]:
    """Of each text whether it may have a sign of a disguise: where not, windows() is empty. Null texts have none."""
    found = (pc.match_substring_regex(texts, pattern) for pattern in _MAYBE)
    return pc.fill_null(pc.or_(*found), False).to_pylist()


def find_all(text: str, disguised: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's number, end) of the base spans and of all spans, sorted. disguised=False: there is no sign to look for."""
    base = {kind: find(text) for kind, find in FINDERS.items()}
    added = {kind: [] for kind in KINDS}
    for first, last in windows(text) if disguised else ():
        normal = Normal(text, first, last)
        for kind in KINDS:
            starts = [a for a, _ in base[kind]]
            for a, b in normal.spans(kind):
                k = bisect_right(starts, a) - 1
                before = k >= 0 and base[kind][k][1] > a
                if not before and not (k + 1 < len(starts) and starts[k + 1] < b):
                    added[kind].append((a, b))
    flat = [[(a, n, b) for n, kind in enumerate(KINDS) for a, b in found[kind]] for found in (base, added)]
    return sorted(flat[0]), sorted(flat[0] + flat[1])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in spans)


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "text", BATCH_BYTES):
        texts = batch.column("text")
        rows = [find_all(text or "", maybe) for text, maybe in zip(texts.to_pylist(), may_be_disguised(texts), strict=True)]
        counts = [[sum(n == k for _, n, _ in every) for _, every in rows] for k in range(len(KINDS))]
        hashes = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(hashes, pa.string()), pa.array([joined(every) for _, every in rows], pa.string())], schema=_SCHEMA)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and spans are of all spans, base and added; base_sha256 is of the base spans alone. Offsets are
    code points, end exclusive. A null text is empty and has no spans; a text of any length is read whole, in one
    task. Spans of different kinds may overlap, as base spans of two kinds may; of added spans of one kind that
    touch a base span of it the base span stays. Rows may repeat, each has its result; other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, mask: str = "[{}]") -> str:
    """text with every span replaced by its kind; of overlapping spans the first, then the first kind's, decides."""
    out, at = [], 0
    for a, n, b in find_all(text)[1]:
        if a >= at:
            out += [text[at:a], mask.format(KINDS[n].upper())]
            at = b
    return "".join((*out, text[at:]))
