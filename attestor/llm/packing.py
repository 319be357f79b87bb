"""Best-fit packing with certified bin counts.

Pieces are dealt to partitions by hash. Each partition is packed by best-fit decreasing, and dual-feasible
functions give a lower bound of the sequences it needs: a partition that meets it is done. Partitions with a
gap keep their well-filled sequences and give up the others; what they give up is dealt anew, so that
partitions exchange documents, and best-fit decreasing runs again, as long as that saves sequences.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm.tables import by_size, give_back, in_small_batches, settle

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Pieces in a partition; sequences filled to this share are never given up; rounds of exchange at most.
PIECES, FULL, ROUNDS = 4096, 0.99, 3
#: Chunks of a text that a task remembers, and the longest of them in bytes; neither bound changes a result.
MEMORY, LONGEST = 250_000, 64
#: The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Below U+0250 the vocabulary's steps before the model are plain: lower case, then runs of letters, single
#: numbers and runs of signs. Apostrophes, white space and control characters have rules of their own.
_LATIN = [c for c in map(chr, range(0x21, 0x250)) if c != "'" and not c.isspace() and unicodedata.category(c) != "Cc"]
_CLASS = {kind: "".join(map(re.escape, (c for c in _LATIN if unicodedata.category(c)[0] in "LN" and unicodedata.category(c)[0] == kind))) for kind in "LN"}
_PLAIN = re.compile("[" + "".join(map(re.escape, _LATIN)) + "]+")
_PIECES = re.compile(f"[{_CLASS['L']}]+|[{_CLASS['N']}]|[^{_CLASS['L']}{_CLASS['N']}]+")
BATCH_BYTES = 1 << 20

PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ChunkTokenizer:
    """Token ids of a text as little-endian 32-bit integers.

    The vocabulary's tokens never cross white space, so a text's ids are those of its chunks between spaces
    and line feeds, one after another, and in plain chunks those of their words, numbers and signs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {b"": b""}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        chunks = text.replace(b"\n", b" ").split(b" ")
        found = list(map(self.known.get, chunks))
        if None in found:
            if len(self.known) > MEMORY:
                self.known = {b"": b""}
            found = [self._new(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return b"".join(found)

    def _new(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        lower = text.lower()
        plain = text.isascii()
        if lower.isalpha() and (plain or max(text) < "\u0250"):
            ids = self._piece(lower, False)  # remembered as a chunk
        elif (text.isprintable() and "'" not in text if plain else _PLAIN.fullmatch(lower) and _PLAIN.fullmatch(text)) and "<|" not in text:
            ids = b"".join(map(self._piece, _PIECES.findall(lower)))
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(chunk) <= LONGEST:
            self.known[chunk] = ids
        return ids

    def _piece(self, piece: str, remember: bool = True) -> bytes:
        """Ids of letters, a digit or signs, which the model alone turns into tokens."""
        if (ids := self.pieces.get(piece)) is None:
            seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_VISIBLE)
            ids = _packed([t.id for t in self.tokenize(seen)])
            if len(self.pieces) > MEMORY:
                self.pieces = {}
            if remember and len(piece) <= LONGEST:
                self.pieces[piece] = ids
        return ids


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and END_ID, cut every `capacity` ids."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkTokenizer(path)
        for batch in by_size(batches, "text", BATCH_BYTES):
            out: dict[str, list] = {name: [] for name in PIECE_SCHEMA.names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.encode(text or b"") + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, PIECE_SCHEMA)
        coder.known, coder.pieces = {}, {}
        give_back()

    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, PIECE_DDL)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that these lengths need at least, by two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(capacity + 1))))
    small = np.arange(0, capacity // 2 + 1)
    # lengths over capacity - small count in full, those under small not at all
    weights = (n[-1] - n[capacity - small + 1]) * capacity + total[capacity - small + 1] - total[small]
    best = int(-(-weights.max() // capacity))
    sizes = np.flatnonzero(counts)
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # f(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k; in units of 1 / (k capacity)
        value = np.where(exact, k * sizes, scaled // capacity * capacity)
        best = max(best, int(-(-(value * counts[sizes]).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each length's bin and offset, and each bin's filling. Of the bins it fits, a length takes the fullest, then the latest."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, filled = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        room = capacity - filled[b]
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(filled, np.int64)


PACKED_SCHEMA = pa.schema([*PIECE_SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())])
PACKED_DDL = f"{PIECE_DDL}, sequence_id long, offset long, settled boolean"


def _pack(capacity: int, full: float, number: int):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.select(PIECE_SCHEMA.names).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = part.column("length").to_numpy()
        bins, offsets, filled = best_fit_decreasing(lengths, capacity)
        settled = np.full(len(filled), True) if len(filled) == lower_bound(lengths, capacity) else filled >= full * capacity
        columns = [*part.columns, pa.array(bins + (key[0].as_py() << 24) + (number << 58)), pa.array(offsets), pa.array(settled[bins])]
        return pa.table(columns, schema=PACKED_SCHEMA)

    return run


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, pieces_per_part: int = PIECES, full: float = FULL, rounds: int = ROUNDS) -> DataFrame:
    """pieces (columns of PIECE_DDL) with sequence_id and offset. pieces is read several times: settle it before."""
    done: list[DataFrame] = []
    left, before = pieces, None
    for number in range(rounds + 1):
        n = left.count()
        parts = max(1, -(-n // pieces_per_part))
        dealt = left.select(*PIECE_SCHEMA.names, F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part"))
        packed = settle(dealt.groupBy("part").applyInArrow(_pack(capacity, full, number), PACKED_DDL), f"packed-{number}", narrow=True)
        first = F.col("offset") == 0
        bins, open_bins, open_pieces = packed.agg(F.count_if(first), F.count_if(first & ~F.col("settled")), F.count_if(~F.col("settled"))).first()
        if before is not None and bins >= before[1]:
            done.append(before[0])  # the exchange saved nothing
            break
        if not open_pieces or number == rounds:
            done.append(packed)
            break
        done.append(packed.where("settled"))
        left, before = packed.where("NOT settled"), (packed.where("NOT settled"), open_bins)
        if parts == 1:  # nobody to exchange with
            done.append(before[0])
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("settled")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, pieces_per_part: int = PIECES) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty; an empty text is the single id END_ID. Rows may repeat: each is a document of its
    own. Documents longer than `capacity` ids are cut at its multiples, no others are. An empty table gives an
    empty result; other columns are not read. Equal lengths are taken in order of id, piece and checksum.
    """
    pieces = settle(token_pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, capacity=capacity), "pieces")
    return pack_pieces(pieces, capacity=capacity, pieces_per_part=pieces_per_part)
