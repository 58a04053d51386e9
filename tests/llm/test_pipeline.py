"""The stages of the pipeline against brute force on the smallest documents."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from rollcall.session import settle
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SF)))
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_order_and_columns(stages):
    _, columns = stages
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "mixing to target weights", "byte-level BPE"]
    assert all(c == columns[0] for c in columns[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    before, after = stages[0][0], {r["doc_id"] for r in stages[0][1]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    bad = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.3 * len(bad)


def test_near_dedup_keeps_one_of_each_class(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[0][1]]
    assert {r["doc_id"] for r in stages[0][2]} == set(brute.near_classes(rows).values())


def test_suffix_dedup_removes_later_copies(stages):
    want = brute.without_repeats([(r["doc_id"], r["text"]) for r in stages[0][2]], pipeline.PASSAGE_BYTES, True)
    text = {i: w[4].decode() for i, w in want.items() if w[1] == 0 or brute.words(w[4].decode())}
    assert {r["doc_id"]: r["text"] for r in stages[0][3]} == text
    assert all(r["n_chars"] == len(r["text"]) for r in stages[0][3] if want[r["doc_id"]][1])


def test_mix_comes_near_the_targets(stages):
    rows, taken = stages[0][3], stages[0][4]
    sources = sorted({r["source"] for r in rows})
    size, largest, got = {}, {}, dict.fromkeys(sources, 0)
    for r in rows:
        n = len(brute.words(r["text"]))
        size[r["source"]] = size.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    for r in taken:
        got[r["source"]] += len(brute.words(r["text"]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, total = {}, set(sources), 1.5 * sum(size.values())
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 2 * size[s]}
        target |= {s: min(2 * size[s], level * weight[s]) for s in (over or left)}
        left -= over or left
    assert all(abs(got[s] - target[s]) <= largest[s] for s in sources)


def test_tokens_of_what_is_left(stages):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in stages[0][4]}
    assert len(stages[0][5]) == len(stages[0][4]) > 100
    for r in stages[0][5]:
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "word " * 500, "en", "a", 2500), (3, "word " * 500, "en", "a", 2500), (None, "no id", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[1:]:
            start = settle(stage(spark, start, SF))
        assert start.count() >= 0
