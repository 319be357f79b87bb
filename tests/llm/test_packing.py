import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestor.llm.packing import CAPACITY, TOKENIZER, ChunkTokenizer, best_fit_decreasing, lower_bound, pack_documents, pack_pieces


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def ids_of(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_chunks_give_the_ids_of_whole_texts(plain):
    rng = random.Random(3)
    signs = "abS'’st re ve.,!?é́Ésß  \n\t\x1c0９५<|endoftext|>ΣςσİıǅǄﬁ한글。、-_&#½²"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a<|ENDOFTEXT|> x<|endoftext|>.", "it's IT'S don't, we'll. I'd!", "", "word " * 3000, "x" * 3000]
    coder = ChunkTokenizer(public_tokenizers.path(TOKENIZER))
    for text in texts:
        assert coder.encode(text.encode()) == ids_of(plain, text)[:-1].tobytes(), text[:60]


def test_rows_are_whole_documents_in_sequences(spark, plain):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Été", "12", "x."]) for _ in range(rng.randint(0, 1500)))) for i in range(300)] + [(900, None), (901, ""), (902, "long one " * 20_000), (None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, length int, part int")
    got = [tuple(r) for r in pack_documents(docs, pieces_per_part=64).collect()]
    want = []
    for i, t in rows:
        ids = ids_of(plain, t)
        want += [(i, k, a, len(ids[a : a + CAPACITY]), zlib.crc32(ids[a : a + CAPACITY].tobytes())) for k, a in enumerate(range(0, len(ids), CAPACITY))]
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for *_, length, _, sequence, offset in got:
        sequences.setdefault(sequence, []).append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    lengths = np.array([r[3] for r in got])
    assert lower_bound(lengths, CAPACITY) <= len(sequences) <= 1.05 * lower_bound(lengths, CAPACITY) + 1


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(0)
    for _ in range(300):
        lengths = rng.integers(1, 61, int(rng.integers(1, 40)))
        bins, offsets, filled = best_fit_decreasing(lengths, 60)
        assert lower_bound(lengths, 60) <= len(filled)
        assert filled.max() <= 60 and np.bincount(bins, lengths).astype(int).tolist() == filled.tolist()
        assert (offsets >= 0).all()
    assert lower_bound(np.array([31, 31, 31, 29]), 60) == 3
    assert lower_bound(np.array([21, 21, 21, 21]), 60) == 2
    assert lower_bound(np.zeros(0, int), 60) == 0


def test_exchange_saves_sequences(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, rng.choice([700, 690, 670, 1000, 350]), i) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = pack_pieces(pieces, pieces_per_part=12, rounds=0).select("sequence_id").distinct().count()
    after = pack_pieces(pieces, pieces_per_part=12, rounds=3)
    assert after.count() == 600
    assert after.select("sequence_id").distinct().count() < alone


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs).collect() == []
