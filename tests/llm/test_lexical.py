"""Ranked search against a version that scores every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from rollcall.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, questions, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for key, text in questions:
        scored = []
        for i, b in bags:
            m = 25 + (75 * b.total() * n) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(key, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def found(spark, docs, questions, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in questions], "item_id long, text string, rank int")
    return [tuple(r) for r in lexical.rank_documents(lexical.build_index(d), q, **kw).collect()]


def order(rows):
    return sorted(rows, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    common = ["the", "of", "a", "in"]
    words = common * 12 + [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(200)]
    docs = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(n)]
    return docs, words, rng


@pytest.mark.parametrize(("shard", "wave"), [(16_384, 64), (37, 2), (1, 1)])
def test_against_all_scores(spark, monkeypatch, shard, wave):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "WAVE", wave)
    monkeypatch.setattr(lexical, "QUESTIONS", 7)
    docs, words, rng = corpus(1, 40 if shard == 1 else 400)
    docs += [(10_000 + i, docs[5][1]) for i in range(60)]  # ties between copies
    questions = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for i in range(20)] + [(99, docs[5][1])]
    assert order(found(spark, docs, questions)) == order(brute(docs, questions))
    assert order(found(spark, docs, questions[:3], k=2)) == order(brute(docs, questions[:3], 2))


def test_odd_rows(spark):
    docs = [
        (5, None), (6, ""), (7, " .,- \0"), (8, "Ärger ärger ARGER_x"), (None, "alpha beta"), (None, "alpha beta"), (9, "alpha beta"),
        (9, "alpha"), (1, "b c—d"), (2, "İstanbul İ K"), (3, "x" * 50_000), (4, "alpha " * 20_000),
    ]
    questions = [
        (1, "alpha, ALPHA beta"), (2, ""), (3, None), (4, "argER ärger"), (5, "nowhere"), (None, "alpha"), (1, "b c—d"),
        (6, "x" * 50_000), (7, "İ"), (8, "k"), (9, "ı"),
    ]
    assert order(found(spark, docs, questions)) == order(brute(docs, questions))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []


def test_large_shuffled_question_table(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    docs, words, rng = corpus(2, 100)
    questions = [(i, " ".join(rng.choices(words, k=8))) for i in range(9)]
    assert order(found(spark, docs, questions)) == order(brute(docs, questions))


def test_maxima_of_all_ranges():
    rng = np.random.default_rng(3)
    sizes = np.full(40, 10, dtype=np.int32)
    lists = [(5, np.sort(rng.choice(40, m, replace=False)).astype(np.int32), rng.integers(1, 9, m).astype(np.int32)) for m in (1, 17, 40)]
    shard = lexical.Shard(list(range(40)), sizes, lists, 40, 400)
    for slot in range(3):
        for lo in range(shard.first[slot], shard.first[slot + 1] + 1):
            for hi in range(lo, shard.first[slot + 1] + 1):
                top = shard.maxima(np.array([lo]), np.array([hi]))[0]
                want = -1 if lo == hi else lo + int(np.argmax(shard.impact[lo:hi]))
                assert top == want


def test_search_looks_at_few_documents():
    """The bounds must spare work: a shard with one clear answer is not scored as a whole."""
    rng = np.random.default_rng(4)
    n = 8000
    lists = [(100, np.arange(n, dtype=np.int32), np.ones(n, dtype=np.int32))]
    lists += [(3000, np.sort(rng.choice(n, 20, replace=False)).astype(np.int32), np.ones(20, dtype=np.int32)) for _ in range(6)]
    shard = lexical.Shard(list(range(n)), rng.integers(20, 60, n).astype(np.int32), lists, n, 40 * n)
    asked = []
    scored = shard.maxima
    shard.maxima = lambda lo, hi: (asked.append(lo.shape[0]), scored(lo, hi))[1]
    shard.search(np.arange(7), np.ones(7, dtype=np.int64), 10, 1)
    assert sum(asked) < n / 4
