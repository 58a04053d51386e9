"""Packing: ids against the library, places against their rules, counts against sequential best fit."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollcall.llm import packing
from rollcall.llm.queries import QUERIES
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(sizes, capacity):
    """Sequences of best fit on falling sizes, one after the other."""
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            n += 1
            gaps.append(capacity - s)
    return n


def check_places(sizes, places, capacity):
    """Every piece once, every sequence gapless from 0 and not too long; returns the number of sequences."""
    assert sorted(k for k, _, _ in places) == sorted(sizes)
    held = collections.defaultdict(list)
    for k, seq, offset in places:
        held[seq].append((offset, sizes[k]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(held)


def packed(spark, sizes, capacity):
    df = spark.createDataFrame(list(sizes.items()), "key long, size long")
    return [tuple(r) for r in packing.pack(df, capacity).collect()]


CASES = {
    "mixed": lambda r: r.randrange(1, 65), "small": lambda r: r.randrange(1, 9), "middle": lambda r: r.randrange(13, 33),
    "equal": lambda r: 7, "full": lambda r: 64, "large": lambda r: r.randrange(33, 64), "hot": lambda r: r.choice([20, 20, 20, r.randrange(1, 65)]),
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("rows", [60, 16_384])
def test_against_sequential_best_fit(spark, monkeypatch, name, rows):
    monkeypatch.setattr(packing, "SLICE_ROWS", rows)
    rng = random.Random(5)
    sizes = {i * 11: CASES[name](rng) for i in range(500)}
    n = check_places(sizes, packed(spark, sizes, 64), 64)
    assert n <= best_fit(sizes.values(), 64) * 1.02 + 1


def test_nothing_and_one(spark):
    assert packed(spark, {}, 64) == []
    assert packed(spark, {9: 1}, 64) == [(9, 9, 0)]


def test_segments_are_a_bracket_match():
    rng = random.Random(6)
    for _ in range(200):
        docs = {i: rng.randrange(4) for i in range(6)}
        gaps = {i: rng.randrange(4) for i in range(6)}
        want, open_ = set(), []
        for i in range(6):
            for r in range(docs[i]):
                if open_:
                    want.add((i, r, *open_.pop()))
            open_ += [(i, r) for r in range(gaps[i])]
        got = {(i, a + j, k, b + n - 1 - j) for i, a, k, b, n in packing.rank_segments(docs, gaps) for j in range(n)}
        assert got == want


def test_ids_equal_the_library():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder.load(PATH, public_tokenizers.PATTERN)
    texts = ["", " ", "a<|endoftext|>b", "it's\u0085   x 12ab  \n\n", "naïve 日本語 🙂‍🙂", " " * 1_000_000, "x" * 50_000, "\0\x1c\x1d"]
    rng = random.Random(8)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000), 32, 10])) for _ in range(200)) for _ in range(200)]
    for text in texts:
        assert encoder.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_of_odd_rows(spark):
    long = "word and " * 700
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (None, "a b", 5), (3, long, 5), (3, long, 5), (4, "x" * 40, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(2)
    got = packing.pack_documents(df, PATH, public_tokenizers.PATTERN, ["doc_id", "key"], with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(head, len(ids) + 1, 1024)]
        want += [(i, p, a, ids[a:b]) for p, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(((r.row.doc_id, r.piece, r.start, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids) and r.row.key == 5 for r in got)
    check_places({r.key: r.length for r in got}, [(r.key, r.sequence_id, r.offset) for r in got], 1024)
    none = packing.pack_documents(df.limit(0), PATH, public_tokenizers.PATTERN, ["doc_id"])
    assert none.count() == 0


@pytest.mark.parametrize("rows", [30, 16_384])
def test_query(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "SLICE_ROWS", rows)
    got = QUERIES["op13_best_fit_packing"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    seen = collections.Counter()
    for r in got:
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(cut, dtype="<u4").tobytes()) and len(cut) == r.length
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    sizes = {(r.doc_id, r.piece): r.length for r in got}
    n = check_places(sizes, [((r.doc_id, r.piece), r.sequence_id, r.offset) for r in got], 1024)
    assert n <= best_fit(sizes.values(), 1024) * 1.01 + 1
