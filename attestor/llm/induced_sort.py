"""Suffix order with common-prefix values by external induced sorting.

All that grows with the text is a file in a scratch folder of the task; what is in memory at once stays within a
budget, however long the text is. A text is sorted in levels:

1. Its suffixes of type S* (the first of a rising stretch) are sampled; the pieces from each sample to the next,
   cut after WIDTH symbols, are sorted by distribution over files and named by their place.
2. Where names repeat, the string of names, at most half as long, is sorted by the same procedure. The recursion ends
   where names differ, or where a few names reach CAP symbols: these then order the suffixes.
3. From the samples all other suffixes are induced, first those of type L in rising order, then those of type S in
   falling order. A queue on disk holds tuples (suffix, common-prefix values); suffixes come out by their first
   symbol and, for each symbol, in the order they were put in; each puts its predecessor in.

The common prefix of two neighbours that were put into one lane is the first symbol's and the least common prefix
among the suffixes between those that put them in. A tuple carries this minimum up to the ends of its batch; a table
of the batches' minima has what lies between two batches. Only where neighbours are not induced alike, as the first
of a symbol, the text is compared. Common prefixes count symbols of the original text at every level, up to CAP;
the order of suffixes that agree in CAP symbols is arbitrary.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Common prefixes are counted up to this length.
CAP = 127
#: Bytes of memory that a sort may take.
MEMORY = 4 << 20
#: What one entry of a batch takes in all arrays that are made of it, and the fewest entries of a batch.
ENTRY, LEAST = 1600, 64
#: Bytes that a stream holds before they are written; files that records are dealt out to at once.
BUFFER, PARTS = 4096, 24
#: Files of a queue.
FILES = 24
#: Suffixes that are compared at once.
BLOCK = 256


class Scratch:
    """Arrays and streams in files of a folder, which goes with the task. `chunk` entries are worked on at a time."""

    def __init__(self, memory: int = MEMORY):
        self.chunk = max(LEAST, memory // ENTRY)
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.files = 0

    def path(self) -> str:
        self.files += 1
        return f"{self.folder.name}/{self.files}"

    def array(self, n: int, dtype) -> np.ndarray:
        return np.memmap(self.path(), dtype, "w+", shape=(max(1, n),)).view(np.ndarray)

    def close(self) -> None:
        self.folder.cleanup()


class Stream:
    """Records that are appended, in memory while they are few, then to a file, and read in chunks, from either end."""

    def __init__(self, scratch: Scratch, dtype):
        self.scratch, self.dtype, self.n, self.file = scratch, np.dtype(dtype), 0, None
        self.buffer: list[bytes] = []
        self.buffered = 0

    def put(self, records: np.ndarray) -> None:
        data = records.astype(self.dtype, copy=False).tobytes()
        self.buffer.append(data)
        self.buffered += len(data)
        self.n += len(records)
        if self.buffered > BUFFER:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.path = self.scratch.path()
            self.file = open(self.path, "w+b", buffering=0)  # noqa: SIM115
        if self.buffer:
            self.file.write(b"".join(self.buffer))
            self.buffer, self.buffered = [], 0

    def at(self, first: int, count: int) -> np.ndarray:
        size = self.dtype.itemsize
        if self.file is None:
            self.buffer = [b"".join(self.buffer)]
            return np.frombuffer(self.buffer[0], self.dtype)[first : first + count]
        if self.buffer:
            self._write()
        return np.frombuffer(os.pread(self.file.fileno(), count * size, first * size), self.dtype)

    def chunks(self) -> Iterator[np.ndarray]:
        for first in range(0, self.n, self.scratch.chunk):
            yield self.at(first, min(self.scratch.chunk, self.n - first))

    def backward(self) -> Iterator[np.ndarray]:
        """Chunks from the end, each in falling order; what has been read is cut off."""
        for first in reversed(range(0, self.n, self.scratch.chunk)):
            found = self.at(first, min(self.scratch.chunk, self.n - first))
            if self.file is not None:
                os.ftruncate(self.file.fileno(), first * self.dtype.itemsize)
            yield found[::-1]

    def mapped(self) -> np.ndarray:
        if self.file is None:
            return self.at(0, self.n)
        self._write()
        return np.memmap(self.path, self.dtype, "r").view(np.ndarray)

    def drop(self) -> None:
        self.buffer = []
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)


class Minima:
    """The least values of ranges of an array that grows to at most n, by a table for each power of two, on disk."""

    def __init__(self, scratch: Scratch, n: int):
        self.n, self.rows, self.table = 0, 1, scratch.array(n * max(1, n.bit_length()), np.uint8).reshape(-1, n)

    def add(self, value: int) -> None:
        i, self.n, table = self.n, self.n + 1, self.table
        table[0, i] = value
        self.rows += i + 1 == 1 << self.rows
        for j in range(1, self.rows):
            value = table[j, i] = min(value, int(table[j - 1, i - (1 << (j - 1))]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of first..last, both inclusive; CAP where last < first."""
        width = last - first + 1
        out = np.full(len(first), CAP, np.uint8)
        some = np.flatnonzero(width > 0)
        if len(some):
            j = np.frexp(width[some].astype(np.float64))[1] - 1
            out[some] = np.minimum(self.table[j, last[some]], self.table[j, first[some] + (1 << j) - 1])
        return out


def ranges_within(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair; CAP where last < first."""
    out = np.full(len(first), CAP, np.uint8)
    width = last - first + 1
    left = width > 0
    step, table = 1, values
    while left.any():
        mine = np.flatnonzero(left & (width < 2 * step))
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - step + 1])
            left[mine] = False
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


class Level:
    """A string of symbols on disk whose last is unique and the smallest.

    places: where each symbol begins in the original text, whose length comes last. lanes: the least symbol of each
    lane of the queue; heavy: whether a lane is one symbol of many suffixes.
    """

    def __init__(self, scratch: Scratch, symbols: np.ndarray, n: int, places: np.ndarray | None, text: np.ndarray, lanes: np.ndarray, heavy: np.ndarray, bits: int):
        self.scratch, self.symbols, self.n, self.places, self.text = scratch, symbols, n, places, text
        self.lanes, self.heavy, self.bits = lanes, heavy, bits

    def place(self, at: np.ndarray) -> np.ndarray:
        return at if self.places is None else self.places[at]

    def advance(self, at: np.ndarray) -> np.ndarray:
        """How many symbols of the original text the symbols at these places stand for."""
        return np.ones(len(at), np.int64) if self.places is None else self.places[at + 1].astype(np.int64) - self.places[at]

    def types(self) -> None:
        """Which suffixes are of type S."""
        self.is_s = self.scratch.array(self.n, bool)
        chunk, after = self.scratch.chunk, True
        self.is_s[self.n - 1] = True
        for first in reversed(range(0, self.n - 1, chunk)):
            t = np.asarray(self.symbols[first : min(self.n, first + chunk + 1)])
            m = len(t) - 1
            nearest = np.minimum.accumulate(np.where(t[1:] != t[:-1], np.arange(m), m)[::-1])[::-1]
            rising = np.append(t[:-1] < t[1:], after)
            self.is_s[first : first + m] = rising[nearest]
            after = bool(rising[nearest[0]])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of suffixes a and b, by comparing the text."""
        out = np.zeros(len(a), np.uint8)
        if len(a) > BLOCK:
            for first in range(0, len(a), BLOCK):
                out[first : first + BLOCK] = self.common(a[first : first + BLOCK], b[first : first + BLOCK])
            return out
        a, b = self.place(a).astype(np.int64), self.place(b).astype(np.int64)
        end, k = len(self.text) - 1, 0
        alive = np.flatnonzero(a != b)
        while len(alive) and k < CAP:
            step = np.arange(k, min(CAP, k + 16))
            differ = self.text[np.minimum(a[alive, None] + step, end)] != self.text[np.minimum(b[alive, None] + step, end)]
            ends = differ.any(1)
            out[alive] = k + np.where(ends, differ.argmax(1), len(step))
            alive, k = alive[~ends], k + 16
        return out

    def samples(self, width: int) -> tuple[Stream, Stream]:
        """Where the samples are, rising: the S* suffixes, and places so that none is more than width - 1 from the next; whether each is S*."""
        at, star = Stream(self.scratch, np.int32), Stream(self.scratch, bool)
        before: int | None = None
        for first in range(0, self.n, self.scratch.chunk):
            kinds = np.asarray(self.is_s[max(0, first - 1) : first + self.scratch.chunk])
            found = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + max(0, first - 1) + 1
            if not len(found):
                continue
            starts = found if before is None else np.concatenate(([before], found))
            before = int(found[-1])
            gaps = np.diff(starts)
            extra = np.maximum(0, (gaps - 1) // (width - 1))
            for a in range(0, len(gaps), self.scratch.chunk):  # long gaps give many places
                b = a + self.scratch.chunk
                own = np.repeat(starts[a:b][: len(gaps[a:b])], extra[a:b] + 1)
                step = np.arange(len(own)) - np.repeat(np.cumsum(extra[a:b] + 1) - extra[a:b] - 1, extra[a:b] + 1)
                at.put(own + step * (width - 1))
                star.put(step == 0)
        at.put(np.array([before]))
        star.put(np.array([True]))
        return at, star


class Pieces:
    """Records (key, number) of the pieces from each sample to the next, made as they are read.

    The order of keys is that of the samples, as far as they go. A piece that is the beginning of another is the greater
    one, as its end rises and the other falls there.
    """

    def __init__(self, level: Level, at: Stream, star: Stream):
        self.level, self.where, self.star, self.n = level, at, star, at.n
        self.per, self.words = (62 // level.bits, 2) if level.places is None else (2, 3)
        self.dtype = np.dtype([("key", "<u8", (self.words,)), ("number", "<i4")])

    def at(self, first: int, count: int) -> np.ndarray:
        level, count = self.level, min(count, self.n - first)
        starts, stars = (x.at(first, min(count + 1, self.n - first)) for x in (self.where, self.star))
        if first + count == self.n:  # the last piece is the last symbol
            starts, stars = np.append(starts, starts[-1]), np.append(stars, True)
        at, last, pad = starts[:-1].astype(np.int64), starts[1:].astype(np.int64), (1 << level.bits) - 1
        out = np.zeros(count, self.dtype)
        key = out["key"]
        for k in range(self.words * self.per):
            symbol = level.symbols[np.minimum(at + k, last)]
            key[:, k // self.per] = (key[:, k // self.per] << np.uint64(level.bits)) | np.where(at + k <= last, symbol, pad).astype(np.uint64)
        key[:, -1] = (key[:, -1] << np.uint64(1)) | stars[1:].astype(np.uint64)
        out["number"] = np.arange(first, first + count)
        return out

    def chunks(self) -> Iterator[np.ndarray]:
        for first in range(0, self.n, self.level.scratch.chunk):
            yield self.at(first, self.level.scratch.chunk)

    def drop(self) -> None:
        pass


def sorted_records(scratch: Scratch, records: Stream | Pieces, words: int, word: int = 0) -> Iterator[np.ndarray]:
    """The records (key: words, number) in order of their keys from `word` on; what is too much for memory is dealt out over files."""
    if records.n <= scratch.chunk or word == words:
        for part in records.chunks():
            yield part[np.lexsort([part["key"][:, k] for k in range(words - 1, word - 1, -1)])] if word < words else part
        records.drop()
        return
    sample = np.concatenate([records.at(int(i), 16)["key"][:, word] for i in np.linspace(0, max(0, records.n - 16), 64).astype(np.int64)])
    cuts = np.unique(np.sort(sample)[:: max(1, len(sample) // min(PARTS, 2 + 2 * records.n // scratch.chunk))])
    # odd parts hold one value of the word each, even parts what lies between two
    parts: dict[int, Stream] = {}
    for chunk in records.chunks():
        value = chunk["key"][:, word]
        part = np.searchsorted(cuts, value) + np.searchsorted(cuts, value, side="right")
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1])))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            k = int(part[order[a]])
            if k not in parts:
                parts[k] = Stream(scratch, records.dtype)
            parts[k].put(chunk[order[a:b]])
    records.drop()
    for k in sorted(parts):
        yield from sorted_records(scratch, parts[k], words, word + k % 2)


#: Words of names that end the recursion if they reach CAP symbols, two names a word.
WORDS = 28


def reaches(level: Level) -> bool:
    """Whether any 2 * WORDS names that follow each other, or those up to the end, are known to stand for CAP symbols."""
    if level.places is None:
        return False
    for first in range(0, level.n, level.scratch.chunk):
        at = np.arange(first, min(level.n, first + level.scratch.chunk))
        stop = at + 2 * WORDS
        if ((level.places[np.minimum(stop, level.n)].astype(np.int64) - level.places[at] < CAP) & (stop < level.n)).any():
            return False
    return True


def by_windows(level: Level, suffixes: Stream | range, word: int = 0) -> Iterator[np.ndarray]:
    """These suffixes of the level, which agree in `word` words, in order of their first WORDS words."""
    n, chunk, scratch = (len(suffixes) if isinstance(suffixes, range) else suffixes.n), level.scratch.chunk, level.scratch
    part_at = lambda first, count: np.arange(first, min(n, first + count), dtype=np.int32) if isinstance(suffixes, range) else suffixes.at(first, min(count, n - first))

    def words(at: np.ndarray, k: int) -> np.ndarray:
        one, two = (level.symbols[np.minimum(at.astype(np.int64) + 2 * k + i, level.n - 1)].astype(np.uint64) for i in (0, 1))
        return one << np.uint64(32) | two

    if n <= chunk or word == WORDS:
        for first in range(0, n, chunk):
            part = part_at(first, chunk)
            if word < WORDS:
                few = [words(part, k) for k in range(word, min(WORDS, word + 2))]
                order = np.lexsort(few[::-1])
                same = np.ones(len(part) - 1, bool)
                for x in few:
                    same &= x[order[1:]] == x[order[:-1]]
                if same.any() and word + 2 < WORDS:
                    order = np.lexsort([words(part, k) for k in range(WORDS - 1, word + 1, -1)] + few[::-1])
                part = part[order]
            yield part
    else:
        sample = np.concatenate([words(part_at(int(i), 16), word) for i in np.linspace(0, max(0, n - 16), 64).astype(np.int64)])
        cuts = np.unique(np.sort(sample)[:: max(1, len(sample) // min(PARTS, 2 + 2 * n // chunk))])
        parts: dict[int, Stream] = {}
        for first in range(0, n, chunk):
            found = part_at(first, chunk)
            value = words(found, word)
            part = np.searchsorted(cuts, value) + np.searchsorted(cuts, value, side="right")
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))).tolist()
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                k = int(part[order[a]])
                if k not in parts:
                    parts[k] = Stream(scratch, np.int32)
                parts[k].put(found[order[a:b]])
        for k in sorted(parts):
            yield from by_windows(level, parts[k], word + k % 2)
    if not isinstance(suffixes, range):
        suffixes.drop()


#: Columns of a queue's tuples: a suffix, the batch that put it in, and three minima of common prefixes in one number.
AT, BATCH, HEAD, TAIL, INNER = 0, 1, 0, 8, 16
NONE = np.zeros((0, 3), np.int32)


class Queue:
    """Tuples on disk that leave by lane and, within a lane, in the order they came; the newest wait in memory.

    A lane is a chain of blocks in a file: a record (length, next block, 0), then the tuples. Successive lanes share a
    file, which goes when they have been emptied.
    """

    def __init__(self, scratch: Scratch, lanes: int):
        self.scratch = scratch
        self.head, self.tail = np.full(lanes, -1, np.int32), np.full(lanes, -1, np.int32)
        self.memory: dict[int, list[np.ndarray]] = {}
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.own: list[np.ndarray] = []
        self.current = -1
        self.waiting = self.held = self.more = self.skip = 0
        self.share = max(1, -(-lanes // FILES))
        self.files: dict[int, list] = {}

    def put(self, lane: np.ndarray, tuples: np.ndarray) -> None:
        """Takes tuples, whose lanes rise."""
        a, b = np.searchsorted(lane, (self.current, self.current + 1)).tolist()
        if a < b:
            self.own.append(tuples[a:b].copy())
            self.more += b - a
            if self.more > 4 * self.scratch.chunk:
                self._write({self.current: self.own})
                self.own, self.more = [], 0
            if a == 0 and b == len(lane):
                return
            lane, tuples = np.concatenate((lane[:a], lane[b:])), np.concatenate((tuples[:a], tuples[b:]))
        self.fresh.append((lane, tuples))
        self.waiting += len(lane)
        if self.waiting > self.scratch.chunk:
            self._deal()

    def _deal(self) -> None:
        lane, tuples = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
        order = np.argsort(lane, kind="stable")
        lane, tuples = lane[order], tuples[order]
        edges = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1]))).tolist()
        for k, a, b in zip(lane[edges].tolist(), edges, [*edges[1:], len(lane)], strict=True):
            self.memory.setdefault(k, []).append(tuples[a:b].copy())
        self.held += len(lane)
        self.fresh, self.waiting = [], 0
        if self.held > 4 * self.scratch.chunk:
            self._write(self.memory)
            self.memory, self.held = {}, 0

    def _file(self, lane: int) -> list:
        """[descriptor, records written, path] of a lane's file."""
        k = lane // self.share
        if k not in self.files:
            path = self.scratch.path()
            self.files[k] = [os.open(path, os.O_RDWR | os.O_CREAT), 0, path]
        return self.files[k]

    def _write(self, lanes: dict[int, list[np.ndarray]]) -> None:
        """Adds one block to the chain of each lane."""
        tail, head = self.tail, self.head
        together: dict[int, list[np.ndarray]] = {}
        for lane, own in lanes.items():
            file, count = self._file(lane), sum(map(len, own))
            fd, written, _ = file
            together.setdefault(lane // self.share, []).extend((np.array([[count, -1, 0]], np.int32), *own))
            if head[lane] < 0:
                head[lane] = written
            else:
                os.pwrite(fd, written.to_bytes(4, "little"), 12 * int(tail[lane]) + 4)
            tail[lane] = written
            file[1] += count + 1
        for k, parts in together.items():
            data = np.concatenate(parts).tobytes()
            os.pwrite(self.files[k][0], data, 12 * self.files[k][1] - len(data))

    def _close(self, k: int) -> None:
        fd, _, path = self.files.pop(k)
        os.close(fd)
        os.unlink(path)

    def enter(self, lane: int) -> None:
        """From now on tuples are taken from this lane, and from no lane before it."""
        before = self.current // self.share
        if self.current >= 0 and lane // self.share != before and before in self.files:
            self._close(before)
        self.current, self.own, self.skip = lane, self.memory.pop(lane, []), 0
        self.held -= sum(map(len, self.own))
        if self.fresh:
            lanes, tuples = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            mine = lanes == lane
            if mine.any():
                self.own.append(tuples[mine])
                lanes, tuples = lanes[~mine], tuples[~mine]
            self.fresh, self.waiting = [(lanes, tuples)] if len(lanes) else [], len(lanes)
        self.more = sum(map(len, self.own))

    def take(self, most: int) -> np.ndarray:
        """The next tuples of the current lane, at least one if there are any."""
        out, n = [], 0
        while (at := int(self.head[self.current])) >= 0 and n < most:
            fd = self.files[self.current // self.share][0]
            count, following, _ = np.frombuffer(os.pread(fd, 12, 12 * at), np.int32).tolist()
            some = min(count - self.skip, most - n)
            out.append(np.frombuffer(os.pread(fd, 12 * some, 12 * (at + 1 + self.skip)), np.int32).reshape(-1, 3))
            n += some
            self.skip += some
            if self.skip == count:
                self.head[self.current], self.skip = following, 0
        while self.head[self.current] < 0 and n < most and self.own:
            out.append(self.own.pop(0))
            n += len(out[-1])
            self.more -= len(out[-1])
        return np.concatenate(out) if len(out) > 1 else out[0] if out else NONE

    def close(self) -> None:
        for k in list(self.files):
            self._close(k)


SORTED = np.dtype([("at", "<i4"), ("common", "u1")])
FAR = 1 << 40


class Residents:
    """Sorted suffixes that a pass starts from, taken out by lane."""

    def __init__(self, level: Level, chunks: Iterator[np.ndarray]):
        self.level, self.chunks, self.rest = level, chunks, np.zeros(0, SORTED)

    def take(self, inside: Callable[[np.ndarray], np.ndarray], most: int) -> np.ndarray:
        """The next ones whose symbols are inside, as many as there are in one chunk."""
        if not len(self.rest):
            self.rest = next(self.chunks, self.rest)
        n = min(most, int(np.count_nonzero(inside(self.level.symbols[self.rest["at"]])))) if len(self.rest) else 0
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


class Pass:
    """Induces the suffixes of one type: L in rising order, or S in falling order.

    For each symbol the induced suffixes come first, then the residents of that symbol. Keys are symbols, negative in
    falling order, so that lanes always leave in rising order of keys.
    """

    def __init__(self, level: Level, residents: Iterator[np.ndarray], falling: bool, out: Stream):
        self.level, self.falling, self.out = level, falling, out
        self.queue = Queue(level.scratch, len(level.lanes))
        self.residents = Residents(level, residents)
        self.minima = Minima(level.scratch, level.n)
        #: of the last suffix that came out: itself, its symbol, whether it was induced, its tuple
        self.last: tuple[int, int, bool, np.ndarray] = (0, -1, False, np.zeros((1, 3), np.int32))

    def run(self) -> None:
        count = len(self.level.lanes)
        for lane in range(count - 1, -1, -1) if self.falling else range(count):
            first = int(self.level.lanes[lane])
            stop = int(self.level.lanes[lane + 1]) if lane + 1 < count else 1 << 40
            inside = lambda symbols: (symbols >= first) & (symbols < stop)  # noqa: B023, E731
            self.queue.enter(lane)
            (self._heavy if self.level.heavy[lane] else self._light)(inside)
        self.queue.close()

    def _heavy(self, inside: Callable) -> None:
        chunk = self.level.scratch.chunk
        while len(found := self.queue.take(chunk)):
            self.emit(found, None, None, None)
        while len(found := self.residents.take(inside, chunk)):
            self.emit(NONE, found, None, None)

    def _light(self, inside: Callable) -> None:
        """A lane of few suffixes is held; as much of it comes out at once as nothing can still come in between."""
        sign, level = -1 if self.falling else 1, self.level
        fixed = []
        while len(found := self.residents.take(inside, level.scratch.chunk)):
            fixed.append(found)
        fixed = np.concatenate(fixed) if fixed else np.zeros(0, SORTED)
        fixed_key = sign * level.symbols[fixed["at"]].astype(np.int64)
        fixed_to = self._targets(fixed["at"], inside)
        free, free_key, free_to = NONE, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            new = self.queue.take(1 << 40)
            if len(new):
                key = sign * level.symbols[new[:, AT]].astype(np.int64)
                free, free_key, free_to = np.concatenate((free, new)), np.concatenate((free_key, key)), np.concatenate((free_to, self._targets(new[:, AT], inside)))
                order = np.argsort(free_key, kind="stable")
                free, free_key, free_to = free[order], free_key[order], free_to[order]
            if not len(free) and not len(fixed):
                return
            # nothing can come in before the least symbol that a suffix of this lane puts something into
            least = min(int(free_to.min(initial=FAR)), int(fixed_to.min(initial=FAR)))
            a, b = int(free_key.searchsorted(least, side="right")), int(fixed_key.searchsorted(least, side="left"))
            self.emit(free[:a], fixed[:b] if b else None, free_key[:a], fixed_key[:b])
            free, free_key, free_to, fixed, fixed_key, fixed_to = free[a:], free_key[a:], free_to[a:], fixed[b:], fixed_key[b:], fixed_to[b:]

    def _targets(self, at: np.ndarray, inside: Callable) -> np.ndarray:
        """The keys in this lane under which predecessors will be put in; FAR where they go elsewhere."""
        before = np.maximum(at - 1, 0)
        symbols = self.level.symbols[before].astype(np.int64)
        goes = (at > 0) & (self.level.is_s[before] == self.falling) & inside(symbols)
        return np.where(goes, -symbols if self.falling else symbols, FAR)

    def emit(self, free: np.ndarray, fixed: np.ndarray | None, free_key: np.ndarray | None, fixed_key: np.ndarray | None) -> None:
        """Suffixes come out, each symbol's induced ones before its residents; they get their common prefixes and put their predecessors in."""
        level, n = self.level, len(free)
        if fixed is None:
            at, tuples, induced, given = free[:, AT], free, np.ones(n, bool), None
        else:
            some = np.zeros((len(fixed), 3), np.int32)
            some[:, AT] = fixed["at"]
            tuples, induced = (np.concatenate((free, some)), np.arange(n + len(fixed)) < n) if n else (some, np.zeros(len(fixed), bool))
            given = np.concatenate((np.zeros(n, np.uint8), fixed["common"])) if n else fixed["common"]
            if n:
                order = np.lexsort((~induced, np.concatenate((free_key, fixed_key))))
                tuples, induced, given = tuples[order], induced[order], given[order]
            at, n = tuples[:, AT], len(tuples)
        symbol = level.symbols[at]
        p_at, p_symbol, p_induced, p_tuple = self.last
        started, self.last = p_symbol >= 0, (int(at[-1]), int(symbol[-1]), bool(induced[-1]), tuples[-1:].copy())
        alike = np.empty(n, bool)
        alike[0] = p_symbol == symbol[0] and p_induced == induced[0]
        np.equal(symbol[1:], symbol[:-1], out=alike[1:])
        if given is not None:
            alike[1:] &= induced[1:] == induced[:-1]
        common = np.zeros(n, np.uint8)
        if given is not None:
            common[alike] = given[alike]
        mine = np.flatnonzero(alike & induced if given is not None else alike)
        if len(mine):
            y, x = tuples[mine], tuples[mine - 1]  # the one before the first is put right below
            if mine[0] == 0:
                x[0] = p_tuple[0]
            between = np.minimum(np.minimum(x[:, 2] >> TAIL & 255, y[:, 2] >> HEAD & 255), self.minima.least(x[:, BATCH] + 1, y[:, BATCH] - 1))
            least = np.where(x[:, BATCH] == y[:, BATCH], y[:, 2] >> INNER & 255, between)
            common[mine] = np.minimum(CAP, least + level.advance(at[mine]))
        new = np.flatnonzero(~alike)
        if len(new):
            before = at[new - 1]
            if new[0] == 0:
                before[0] = p_at
            common[new] = level.common(before, at[new])
            if not started:
                common[0] = 0
        records = np.empty(n, SORTED)
        records["at"], records["common"] = at, common
        if self.falling or fixed is None:
            self.out.put(records)
        elif induced.any():
            self.out.put(records[induced])
        self._spread(at, common)

    def _spread(self, at: np.ndarray, common: np.ndarray) -> None:
        level, batch = self.level, self.minima.n
        self.minima.add(int(common.min()))
        before = at - 1
        if not at.all():
            before = np.maximum(before, 0)
        place = np.flatnonzero((level.is_s[before] == self.falling) & (at > 0))
        if not len(place):
            return
        found = before[place]
        symbol = level.symbols[found]
        order = np.argsort(symbol, kind="stable")
        place, found, symbol = place[order], found[order], symbol[order]
        inner = np.zeros(len(place), np.int32)
        again = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(again):
            inner[again] = ranges_within(common, place[again - 1] + 1, place[again])
        head = np.minimum.accumulate(common)[place].astype(np.int32)
        after = np.empty(len(common) + 1, np.int32)
        after[-1] = CAP
        after[:-1] = np.minimum.accumulate(common[::-1])[::-1]
        tuples = np.empty((len(place), 3), np.int32)
        tuples[:, AT], tuples[:, BATCH], tuples[:, 2] = found, batch, head << HEAD | after[place + 1] << TAIL | inner << INNER
        self.queue.put(np.searchsorted(level.lanes, symbol, side="right") - 1, tuples)


def _lanes(symbols: np.ndarray, counts: np.ndarray, size: int, slot: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
    """Where lanes begin among these symbols (which are the numbers of smaller suffixes), which of them are heavy, and the last slot."""
    heavy = counts >= size
    slots = symbols // size
    new = np.concatenate(([slots[0] != slot], slots[1:] != slots[:-1])) | heavy | np.concatenate(([slot == -2], heavy[:-1]))
    return symbols[new], heavy[new], -2 if heavy[-1] else int(slots[-1])


def sort_level(level: Level) -> Stream:
    """The suffixes of a level in falling order as records (at, common): the common prefix with the one before, which is greater."""
    scratch = level.scratch
    samples = Pieces(level, *level.samples(12 if level.places is None else 6))
    at, star, m = samples.where, samples.star, samples.n

    names, order = scratch.array(m, np.int32), Stream(scratch, np.int32)
    # about so many suffixes in a lane that few put something into their own
    size = int(min(scratch.chunk, max(64, (3 * m) ** 0.5)))
    lanes, heavy = Stream(scratch, np.int64), Stream(scratch, bool)
    done, distinct, slot, name = 0, 0, -1, -1
    held: tuple[np.ndarray, None] | None = None
    for part in sorted_records(scratch, samples, samples.words):
        key = part["key"]
        new = np.concatenate(([held is None or bool((key[0] != held).any())], (key[1:] != key[:-1]).any(1)))
        held = key[-1].copy()
        fresh = np.flatnonzero(new)
        numbers = np.where(new, done + np.arange(len(part)), -1)
        numbers = np.maximum.accumulate(np.append(name, numbers))[1:]
        # a name whose end is not seen yet waits for the next part
        begins = np.append(name, done + fresh) if name >= 0 else done + fresh
        if len(begins) > 1:
            a, b, slot = _lanes(begins[:-1], np.diff(begins), size, slot)
            lanes.put(a)
            heavy.put(b)
        names[part["number"]] = numbers
        order.put(part["number"])
        done, distinct, name = done + len(part), distinct + len(fresh), int(numbers[-1])
    a, b, slot = _lanes(np.array([name]), np.array([done - name]), size, slot)
    lanes.put(a)
    heavy.put(b)

    places = Stream(scratch, np.int32)
    for part in at.chunks():
        places.put(level.place(part))
    places.put(np.array([len(level.text)]))
    starts, stars = at.mapped(), star.mapped()
    below = Level(scratch, names, m, places.mapped(), level.text, np.array(lanes.mapped()), np.array(heavy.mapped()), 31)
    found = None
    if distinct == m:
        rising = ((part, None) for part in order.chunks())
    elif reaches(below):
        rising = ((part, None) for part in by_windows(below, range(m)))
    else:
        below.types()
        found = sort_level(below)
        rising = _rising(found)
    residents = Stream(scratch, SORTED)
    before, least = -1, CAP
    for part, common in rising:
        if common is None:  # nothing was induced below
            common = level.common(np.append(max(before, 0), starts[part[:-1]]), starts[part])
            common[0] = common[0] if before >= 0 else 0
        before = int(starts[part[-1]])
        kept = np.flatnonzero(stars[part])
        if not len(kept):
            least = min(least, int(common.min()))
            continue
        values = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))
        values[0] = min(int(values[0]), least)
        least = int(common[kept[-1] + 1 :].min(initial=CAP))
        out = np.empty(len(kept), SORTED)
        out["at"], out["common"] = starts[part[kept]], values
        residents.put(out)
    if found:
        found.drop()
    for stream in (at, star, order, lanes, heavy, places):
        stream.drop()

    rising_l, falling = Stream(scratch, SORTED), Stream(scratch, SORTED)
    Pass(level, residents.chunks(), False, rising_l).run()
    residents.drop()
    Pass(level, _shifted(rising_l), True, falling).run()
    rising_l.drop()
    falling.put(np.array([(level.n - 1, 0)], SORTED))  # the last symbol's suffix is smaller than all
    return falling


def _shifted(rising: Stream) -> Iterator[np.ndarray]:
    """Records in falling order, each with its common prefix with the greater one."""
    carried = 0
    for part in rising.backward():
        out = part.copy()
        out["common"][0], out["common"][1:] = carried, part["common"][:-1]
        carried = int(part["common"][-1])
        yield out


def _rising(falling: Stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(at, common with the smaller one) in rising order, from records in falling order."""
    carried = 0
    for part in falling.backward():
        common = np.append(carried, part["common"][:-1]).astype(np.uint8)
        carried = int(part["common"][-1])
        yield part["at"], common


def sort_suffixes(text: np.ndarray, symbols: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of text in rising order, in chunks, and each one's common prefix with the one before (0 for the
    first), up to CAP. text: numbers below `symbols`, whose last is unique and the smallest; a file or an array."""
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int32), np.zeros(1, np.uint8)
        return
    counts = np.zeros(symbols, np.int64)
    for first in range(0, n, scratch.chunk):
        counts += np.bincount(text[first : first + scratch.chunk], minlength=symbols)
    used = np.flatnonzero(counts)
    bits = max(2, symbols.bit_length())
    level = Level(scratch, text, n, None, text, used, counts[used] >= scratch.chunk, bits)
    level.types()
    found = sort_level(level)
    yield from _rising(found)
    found.drop()
