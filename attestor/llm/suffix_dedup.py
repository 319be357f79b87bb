"""Removal of byte strings that repeat, by external induced sorting of suffixes.

Every string of LENGTH bytes is dealt out by its minimiser, the least hash of its grams, so equal strings meet. A
stretch of successive strings with one minimiser is a segment. Segments are first combined as a partial aggregate
would be: of those with equal 128-bit digests the first stands for all, and the others are repeats. Where one
minimiser then has several segments, these may still share strings: their bytes are gathered in shards, the suffixes
of each shard are sorted by induced_sort, in files, and runs of suffixes whose common prefixes reach LENGTH are equal
strings. A minimiser of more segments than a shard should hold is dealt out again by longer grams, of which at last
hardly two strings can share one and differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.induced_sort import CAP, MEMORY, Scratch, Stream, sort_suffixes
from attestor.llm.shingles import Powers, mix
from attestor.llm.tables import by_size, in_small_batches, settle

LENGTH = 100
#: Lengths of grams, for all strings and for those of frequent minimisers.
GRAMS = (24, 70, 99)
#: Bytes of text whose segments one bucket compares, of segments that one shard sorts, and of text in one partition.
BUCKET_BYTES, SHARD_BYTES, PART_BYTES = 4 << 20, 3 << 20, 16 << 20
#: Bytes of different segments of one minimiser beyond which they are dealt out again.
HOT_BYTES = 4 << 20
#: Segments that a task holds back because they repeat in it.
HELD = 1 << 13
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 19
NO_ID = (1 << 63) - 1

#: Kinds of rows: a repeat; a segment to sort; a segment to deal out again.
REPEAT, SORT, AGAIN = 0, 1, 2
SPANS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("key", pa.int64()), ("kind", pa.int32())])
SPANS_DDL = "id long, tag long, start long, stop long, key long, kind int"


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of one length as bytes: 64-bit integers, compressed by planes of bytes where their order makes that worthwhile."""
    planes = [np.ascontiguousarray(np.diff(c.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, n)
    return [np.cumsum(np.ascontiguousarray(p.T).view(np.int64).ravel()) for p in planes]


class Records:
    """Segments: the minimiser, 32 bits of it once sent; both halves of the digest; three 16-bit hashes of what stands around
    the minimiser; id, tag, start, stop; whether a string may repeat within."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns
        self.least, self.d1, self.d2, self.around, self.ids, self.tags, self.start, self.stop, self.loops = columns

    def __len__(self) -> int:
        return len(self.least)

    def at(self, which: np.ndarray) -> Records:
        return Records(*(x[which] for x in self.columns))

    @staticmethod
    def joined(parts: list[Records]) -> Records:
        return Records(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True)))

    def to_bytes(self) -> dict:
        return {"n": len(self), "hashes": b"".join(x.astype(t).tobytes() for x, t in ((self.least, np.uint32), (self.d1, np.uint64), (self.d2, np.uint64), (self.around[:, 0], np.uint16), (self.around[:, 1], np.uint16), (self.around[:, 2], np.uint16))), "places": pack([self.ids, self.tags, self.start, self.stop - self.start, self.loops])}

    @staticmethod
    def from_rows(rows: list[dict]) -> Records:
        parts = []
        for r in rows:
            n = r["n"]
            ids, tags, start, size, loops = unpack(r["places"], n, 5)
            parts.append(Records(np.frombuffer(r["hashes"], np.uint32, n), *(np.frombuffer(r["hashes"], np.uint64, n, k * n) for k in (4, 12)), np.frombuffer(r["hashes"], np.uint16, 3 * n, 20 * n).reshape(3, n).T, ids, tags, start, start + size, loops))
        return Records.joined(parts)

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that are the first of their digests, in order of minimiser and digest, how many rows each stands for, and those that repeat one at another place."""
        order = np.lexsort((self.d1, self.least))
        new = np.ones(len(order), bool)
        new[1:] = False
        for x in (self.least, self.d1, self.d2):
            sorted_x = x[order]
            new[1:] |= sorted_x[1:] != sorted_x[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        several = np.flatnonzero(np.repeat(count > 1, count))
        if len(several):  # within a digest by place
            rows, group = order[several], np.cumsum(new)[several]
            order[several] = rows[np.lexsort((self.start[rows], self.tags[rows], self.ids[rows], group))]
        rows, leader = order[several], order[first][np.cumsum(new) - 1][several]
        again = (self.start[rows] != self.start[leader]) | (self.tags[rows] != self.tags[leader]) | (self.ids[rows] != self.ids[leader])
        return order[first], count, rows[again]


class Hashes:
    """Hashes of the strings of a byte buffer."""

    def __init__(self, data: bytes, powers: Powers):
        n = len(data)
        up, self.down = powers.upto(n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def sliding(reduce: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least, or greatest, of each `width` successive values."""
    out, step = x, 1
    while step * 2 <= width:
        out, step = reduce(out[:-step], out[step:]), step * 2
    n = len(x) - width + 1
    return reduce(out[:n], out[width - step :][:n])


def minimisers(x: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Where values are the least of some window: where the greatest minimum of the windows around is the value itself."""
    around = np.zeros(len(least) + 2 * width - 2, x.dtype)
    around[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(sliding(np.maximum, around, width) == x)


def occurrence(x: np.ndarray, wanted: np.ndarray, places: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Where each wanted value is found first among the places, from number `at` of them on in the direction of step."""
    at = at.copy()
    left = np.flatnonzero(x[places[at]] != wanted)
    while len(left):
        at[left] += step
        left = left[x[places[at[left]]] != wanted[left]]
    return places[at]


def segments(ids: np.ndarray, tags: np.ndarray, bases: np.ndarray, texts: list[bytes], length: int, gram: int, powers: Powers) -> Records | None:
    """The segments of the texts, which begin at `bases` of their documents."""
    pieces = [(k, a, texts[k][a : a + PIECE_BYTES + length - 1]) for k in range(len(texts)) for a in range(0, max(1, len(texts[k]) - length + 1), PIECE_BYTES)]
    pieces = [p for p in pieces if len(p[2]) >= length]
    if not pieces:
        return None
    sizes = np.array([len(p[2]) for p in pieces])
    data = b"".join(p[2] for p in pieces)
    hashes = Hashes(data, powers)
    grams = hashes.grams(gram)
    least = sliding(np.minimum, grams, length - gram + 1)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    inside = piece[: len(least)] == piece[length - 1 :]
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (piece[1 : len(least)] != piece[: len(least) - 1]) | (inside[1:] != inside[:-1]))))
    last = np.concatenate((first[1:], [len(least)]))
    whole = inside[first]
    first, last = first[whole], last[whole] - 1
    # strings of a segment can only be equal if the minimiser occurs twice among their grams
    width = length - gram + 1
    places = minimisers(grams, least, width)
    at = occurrence(grams, least[first], places, np.searchsorted(places, first), 1)
    loops = at != occurrence(grams, least[first], places, np.searchsorted(places, last + width - 1, side="right") - 1, -1)
    last = last + length
    # a string holds the minimiser and `rest` bytes around it, so two that are equal share one of three surroundings
    rest, third, around = length - gram, (length - gram) // 3, np.zeros((len(first), 3), np.uint16)
    for k, (left, right) in enumerate(((0, rest - third), (third, third), (rest - third, 0))):
        has = np.flatnonzero((at - first >= left) & (last - at - gram >= right))
        around[has, k] = hashes.of(at[has] - left, at[has] + gram + right) >> np.uint64(48) | np.uint64(1)
    view, digest = memoryview(data), hashlib.blake2b
    digests = np.frombuffer(b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    own = piece[first]
    doc, offset = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    place = first - (np.cumsum(sizes) - sizes)[own] + offset[own] + bases[doc[own]]
    return Records(least[first], digests[:, 0], digests[:, 1], around, ids[doc[own]], tags[doc[own]], place, place + last - first, loops.astype(np.int64))


BLOBS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())])
BLOBS_DDL = "bucket long, kind int, n long, hashes binary, places binary"


def _dealt(found: Records, rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[dict]:
    """Rows of BLOBS of the chosen records."""
    order = np.lexsort((rows, bucket))
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(rows) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(rows)][: len(cuts)], strict=True):
        yield {"bucket": int(bucket[a]), "kind": kind} | found.at(rows[a:b]).to_bytes()


def _hash_segments(buckets: int, length: int, gram: int, held: int):
    """Of each task the first of equal segments, by buckets of their minimisers, and the others, which are repeats already.

    Segments that repeat are held back until the task ends, so that a line of every document leaves a task once;
    repeats are spread over buckets of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, waiting, turn = Powers(), None, 0
        of = lambda x: ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        for batch in by_size(batches, "text", BATCH_BYTES):
            with np.errstate(over="ignore"):
                found = segments(*(batch.column(c).to_numpy() for c in ("id", "tag", "base")), [t or b"" for t in batch.column("text").to_pylist()], length, gram, powers)
                if not found:
                    continue
                if waiting:
                    found = Records.joined([waiting, found])
                first, stands, again = found.split()
                before = first < len(waiting) if waiting else np.zeros(len(first), bool)
                back = np.flatnonzero((stands > 1) | before)
                back = back[np.argsort(-stands[back], kind="stable")[:held]]
                go = np.ones(len(first), bool)
                go[back] = False
                waiting = found.at(first[back]) if len(back) else None
                turn = (turn + (mix(found.least[:1])[0] >> np.uint64(40))) % np.uint64(buckets)
                out = [*_dealt(found, first[go], of(found.least[first[go]]), SORT), *_dealt(found, again, np.full(len(again), buckets + int(turn)), REPEAT)]
            yield pa.RecordBatch.from_pylist(out, BLOBS)
        if waiting:
            yield pa.RecordBatch.from_pylist(list(_dealt(waiting, np.arange(len(waiting)), of(waiting.least), SORT)), BLOBS)

    return run


def _spans(records: Records, kind: int, key: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (records.ids, records.tags, records.start, records.stop, np.zeros(n, np.int64) if key is None else key, np.full(n, kind, np.int32))], schema=SPANS)


def _compare_segments(hot: int | None):
    """Of a bucket: the repeats, and the segments in which strings may repeat: those that loop, and those that share their
    minimiser with a different one that loops or has the same surroundings of it."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == REPEAT:
                    yield _spans(Records.from_rows([r]), REPEAT)
                else:
                    rows.append(r)
        if not rows:
            return
        found = Records.from_rows(rows)
        first, _, again = found.split()
        yield _spans(found.at(again), REPEAT)
        firsts = found.at(first)
        group = np.flatnonzero(np.concatenate(([True], firsts.least[1:] != firsts.least[:-1])))
        sizes = np.diff(np.append(group, len(firsts)))
        each = np.repeat(np.arange(len(group)), sizes)
        loops = np.add.reduceat(firsts.loops, group)[each] > 0
        shared = np.zeros(len(firsts), bool)
        for k in range(3):
            known = np.flatnonzero(firsts.around[:, k])
            _, inverse, count = np.unique(each[known] << 16 | firsts.around[known, k], return_inverse=True, return_counts=True)
            shared[known] |= count[inverse] > 1
        chosen = (firsts.loops > 0) | (sizes[each] > 1) & (loops | shared)
        big = np.add.reduceat(np.where(chosen, firsts.stop - firsts.start, 0), group)[each] > (hot or 1 << 62)
        shard_key = (firsts.least.astype(np.int64) << 31) ^ key[0].as_py()
        for kind, which in ((SORT, chosen & ~big), (AGAIN, chosen & big)):
            yield _spans(firsts.at(which), kind, shard_key[which])

    return run


def _lists(column: pa.ListArray, *fields: str) -> Iterator[list[tuple]]:
    """The structs of each list as tuples; nothing for a null."""
    values, offsets = column.values, column.offsets.to_pylist()
    parts = [values.field(f).to_numpy() for f in fields]
    for a, b, there in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False):
        yield list(zip(*(p[a:b].tolist() for p in parts), strict=True)) if there and a < b else []


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of segments, from texts with lists of segments."""
    for batch in by_size(batches, "text", BATCH_BYTES):
        rows = []
        for doc, tag, text, found in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text")), _lists(batch.column("found"), "key", "start", "stop"), strict=True):
            rows += [(key, doc, tag, start, text[start:stop]) for key, start, stop in found]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["key", "id", "tag", "base", "text"])


def without_periods(segment: bytes, length: int) -> list[tuple[int, int]]:
    """The parts of a segment that are left where long stretches repeat what stands just before them.

    Of a stretch of one period p, all strings but the first p that lie within it repeat the one p bytes before. Whole
    periods are taken out of its middle, so that what is left still shows this.
    """
    cuts, at = [], 0
    while at + 3 * length <= len(segment):
        p = segment.find(segment[at + length : at + 2 * length], at + length + 1, at + 3 * length) - at - length
        stop = 0
        if 0 < p < length:
            data = np.frombuffer(segment, np.uint8)
            differ = np.flatnonzero(data[at + length + p :] != data[at + length : len(data) - p])
            stop = at + length + p + int(differ[0]) if len(differ) else len(segment)
            # the stretch begins before, but what is left of it from here on is enough
            gone = (stop - at - length - 2 * (length + p)) // p * p
            if gone > 0:
                cuts.append((at + 2 * length + p, at + 2 * length + p + gone))
        at = max(at + length, stop - length)
    edges = [0, *(x for cut in cuts for x in cut), len(segment)]
    return list(zip(edges[::2], edges[1::2], strict=True))


TABLE = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("at", "<i8")])


class Shard:
    """The text of a shard in files: the segments' bytes, a mark after each, and a last symbol."""

    def __init__(self, length: int, memory: int):
        self.length, self.scratch, self.before = length, Scratch(memory), None
        self.text, self.whole, self.table = Stream(self.scratch, np.uint16), Stream(self.scratch, bool), Stream(self.scratch, TABLE)

    def add(self, rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        """Takes segments in order of their places; gives the spans that need no sorting."""
        for doc, tag, start, segment in rows:
            if (doc, tag, start) == self.before:  # of a row that repeats
                continue
            self.before = doc, tag, start
            parts = without_periods(segment, self.length)
            data = segment if len(parts) == 1 else b"".join(segment[a:b] for a, b in parts)
            at = self.text.n
            for (a, b), after in zip(parts, [*parts[1:], None], strict=True):
                self.table.put(np.array([(doc, tag, start + a, at)], TABLE))
                at += b - a
                if after:
                    yield doc, tag, start + b, start + after[0] + self.length - 1
            symbols = np.frombuffer(data, np.uint8).astype(np.uint16) + 2
            self.text.put(np.append(symbols, np.uint16(1)))
            self.whole.put(np.arange(len(data) + 1) <= len(data) - self.length)

    def spans(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(id, tag, start, stop) of strings that also start earlier, in an earlier segment or in their own; those that meet are one."""
        self.text.put(np.array([0], np.uint16))
        self.whole.put(np.array([False]))
        text, whole = self.text.mapped(), self.whole.mapped()
        again = self.scratch.array(len(text), bool)
        earliest, least = -1, CAP
        for at, common in sort_suffixes(text, 258, self.scratch):
            chosen = np.flatnonzero(whole[at])
            if not len(chosen):
                least = min(least, int(common.min()))
                continue
            shared = np.minimum.reduceat(common[: chosen[-1] + 1], np.concatenate(([0], chosen[:-1] + 1)))
            shared[0] = min(int(shared[0]), least)
            least = int(common[chosen[-1] + 1 :].min(initial=CAP))
            place, new = at[chosen], shared < self.length
            new[0] |= earliest < 0
            if not new[0]:  # the run of equal strings goes on from the chunk before
                place, new = np.append(np.int32(earliest), place), np.append(True, new)
            runs = np.flatnonzero(new)
            first = np.minimum.reduceat(place, runs)
            again[place[place != np.repeat(first, np.diff(np.append(runs, len(place))))]] = True
            earliest = int(first[-1])
        yield from self._merged(again)

    def _merged(self, again: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for k in range(0, self.table.n, self.scratch.chunk // 8 + 1):
            part = self.table.at(k, self.scratch.chunk // 8 + 2)
            stop = int(part["at"][-1]) if k + self.scratch.chunk // 8 + 1 < self.table.n else len(again)
            part = part[: self.scratch.chunk // 8 + 1]
            for first in range(int(part["at"][0]), stop, self.scratch.chunk):
                found = np.flatnonzero(again[first : min(stop, first + self.scratch.chunk)]) + first
                if not len(found):
                    continue
                own = np.searchsorted(part["at"], found, side="right") - 1
                start = part["start"][own] + found - part["at"][own]
                new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + self.length))))
                ends = np.append(new[1:] - 1, len(found) - 1)
                yield part["id"][own[new]], part["tag"][own[new]], start[new], start[ends] + self.length

    def close(self) -> None:
        self.scratch.close()


def _rows(ids, tags, starts, stops) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, tags, starts, stops, np.zeros(n, np.int64))), pa.array(np.full(n, REPEAT, np.int32))], schema=SPANS)


def _sort_shards(length: int, memory: int):
    """Sorts the shards of a partition, whose rows (shard, id, tag, base, text) are in order, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        for batch in by_size(batches, "text", memory // 8):
            shards = batch.column("shard").to_numpy()
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "base", "text")), strict=True))
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != current:
                    if shard:
                        yield from (_rows(*x) for x in shard.spans())
                        shard.close()
                    current, shard = shards[a], Shard(length, memory)
                if known := list(shard.add(iter(rows[a:b]))):
                    yield _rows(*zip(*known, strict=True))
        if shard:
            yield from (_rows(*x) for x in shard.spans())
            shard.close()

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary"


def _cut(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text", BATCH_BYTES):
            out: dict[str, list] = {name: [] for name in RESULT.names}
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), _lists(batch.column("found"), "start", "stop"), strict=True):
                text = text or b""
                spans: list[list[int]] = []
                for start, stop in sorted(found):
                    if spans and start <= spans[-1][1]:
                        if stop > spans[-1][1]:
                            spans[-1][1] = stop
                    else:
                        spans.append([start, stop])
                edges = [0, *(x for span in spans for x in span), len(text)]
                rest = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if spans else text
                row = (doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), spans, rest if with_bytes else None)
                for name, value in zip(RESULT.names, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, RESULT)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grams: tuple[int, ...] = GRAMS, with_bytes: bool = False, hot_bytes: int = HOT_BYTES, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, held: int = HELD, memory: int = MEMORY) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    A byte of a text's UTF-8 form is removed if a string of `length` bytes that covers it also starts earlier:
    in a document of smaller id, or earlier in the same one; strings are those of the input. spans holds the
    removed runs as [first, last); kept, asked for by with_bytes, the other bytes. Null texts are empty, and a text
    of any length is read whole. Null ids come last. Documents of one id are ordered by their texts' checksums, and
    rows that repeat both id and text are one document. Other columns, whatever their names, are not read; an empty
    table gives an empty result. length is at most the number to which common prefixes are counted, induced_sort.CAP.
    """
    if not (all(a < b for a, b in zip(grams, grams[1:], strict=False)) and grams[-1] <= length <= CAP):
        raise ValueError(f"rising grams <= length <= {CAP} are needed")
    text, crc = F.encode(F.col(text_col), "UTF-8"), F.crc32(F.coalesce("text", F.lit(b"")))
    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    by_id = source.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size"), F.min(crc).alias("low"), F.max(crc).alias("high"))
    size, repeated = by_id.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("low") != F.col("high"))).first()
    if repeated:
        ids = settle(by_id.where("low <> high").select("id", F.lit(True).alias("again")), "repeated", narrow=True)
        source = source.join(ids, "id", "left").select("doc_id", "id", "text", F.when(F.col("again"), crc).otherwise(F.lit(0)).cast("long").alias("tag"))
    else:
        source = source.withColumn("tag", F.lit(0).cast("long"))
    placed = source.select("id", "tag", "doc_id", "text").repartition(max(source.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), "id", "tag")

    def gathered(found: DataFrame, kind: int) -> DataFrame:
        wanted = found.where(F.col("kind") == kind).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop", "key")).alias("found"))
        # with doc_id, so that one exchange of the texts serves all
        return placed.join(wanted, ["id", "tag"]).select("id", "tag", "doc_id", "text", "found").mapInArrow(_bytes_of, "key long, id long, tag long, base long, text binary")

    parts, found, level, n = [], [], source.select("id", "tag", F.lit(0).cast("long").alias("base"), "text"), size
    for k, gram in enumerate(grams):
        last = k + 1 == len(grams)
        blobs = level.mapInArrow(_hash_segments(max(1, -(-n // bucket_bytes)), length, gram, held), BLOBS_DDL)
        now = settle(blobs.groupBy("bucket").applyInArrow(_compare_segments(None if last else hot_bytes), SPANS_DDL), "segments")
        found.append(now)
        sizes = {r["kind"]: r["size"] for r in now.where(F.col("kind") != REPEAT).groupBy("kind").agg(F.sum(F.col("stop") - F.col("start")).alias("size")).collect()}
        if SORT in sizes:
            parts.append((sizes[SORT], gathered(now, SORT)))
        n = sizes.get(AGAIN, 0)
        if not n:
            break
        level = gathered(now, AGAIN).select("id", "tag", "base", "text")

    every = [x.where(F.col("kind") == REPEAT).select("id", "tag", "start", "stop") for x in found]
    for part_size, part in parts:
        # where there is less than a shard for each core, smaller ones
        shards = max(1, -(-part_size // shard_bytes), min(source.sparkSession.sparkContext.defaultParallelism, part_size // max(1, shard_bytes // 8)))
        dealt = part.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).select("shard", "id", "tag", "base", "text")
        ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "id", "tag", "base")
        every.append(ordered.mapInArrow(_sort_shards(length, memory), SPANS_DDL).select("id", "tag", "start", "stop"))
    spans = every[0]
    for more in every[1:]:
        spans = spans.unionByName(more)
    merged = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    return placed.join(merged, ["id", "tag"], "left").select("doc_id", "text", "found").mapInArrow(_cut(with_bytes), RESULT_DDL)


#: Every string of 100 bytes by its MD5: for small tables only.
ORACLE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, list_transform(range(0, length(h) // 2 - 99), lambda p: md5_number(substring(h, 2 * p + 1, 200))) AS m FROM b),
w AS (SELECT doc_id, unnest(range(0, len(m))) AS p, unnest(m) AS s FROM l),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM spans
  UNION ALL SELECT doc_id, max(z), 1000000000 FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY from_) AS k FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM b LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
