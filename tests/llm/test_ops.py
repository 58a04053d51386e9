"""The ten operators against brute force, SQL, exact round trips and hand-made cases."""

import base64
import hashlib
import io
import random
import tracemalloc

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollcall.llm import bpe, compact, covertree, html_text, kdtree, minhash, mixing, quality, suffixes, warc
from rollcall.llm.common import components, shingle_hashes
from tests.conftest import SF
from tests.llm import brute
from tools.check import KINDS, TABLES, digest

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LLM_SQL = sorted(n for n in entry.oracle_sql() if n.startswith("op"))


def documents(spark, texts, source="a"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts_of(spark):
    return [(r[0], r[1]) for r in table(spark, "documents").select("doc_id", "text").collect()]


def prose(seed, n=80):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]


# ---- SQL twins ----


@pytest.mark.parametrize("name", LLM_SQL)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(names) == sorted(df.columns)
    assert {c: KINDS.get(t) for c, t in df.dtypes} == kinds
    ours, a = digest(df.columns, rows)
    theirs, b = digest(names, cursor.fetchall())
    assert ours == theirs, (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])


# ---- 1: BPE ----


def reference_encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_odd_texts():
    rng = random.Random(3)
    alphabet = "aab  \n\t\r\x1c\x1f\x85\xa0　éß日本'sdllveret123٣—…!!##​ 😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 5000, " " * 3000, "aaaa'" * 50, "<|endoftext|>", None]
    ours = bpe.Bpe.load(RANKS, public_tokenizers.PATTERN)
    library = reference_encoding()
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text or "")
        assert ours.decode(ids) == (text or "").encode()


def test_bpe_of_many_small_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    ours, library = bpe.Bpe(RANKS, public_tokenizers.PATTERN), reference_encoding()
    texts = ["one two three", "two three four five", "one five"] * 3
    assert list(ours.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_query(spark):
    library = reference_encoding()
    got = {r["doc_id"]: r for r in entry.queries()["op1_bpe_round_trip"](spark, SF).collect()}
    for doc_id, text in texts_of(spark):
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_frames(spark):
    df = documents(spark, ["x y", None, "", "x y"]).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    out = bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN, ["doc_id", "ids"])
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_ids(out, RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect()}
    assert back == {0: b"x y", 1: b"", 2: b"", 3: b"x y"}
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


# ---- 2: MinHash ----


def test_dart_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    left, right = np.sort(a), np.sort(np.concatenate([a[:250], b]))
    wl, wr = (left % np.uint64(5)).astype(float) + 0.3, (right % np.uint64(5)).astype(float) + 0.3
    for weights in ((np.ones(300), np.ones(350)), (wl, wr)):
        k = 2048
        s = minhash.dart_signatures(np.concatenate([left, right]), np.concatenate(weights), np.array([0, 300, 650, 650]), k)
        want = minhash.similarity((left, weights[0]), (right, weights[1]))
        assert abs((s[0] == s[1]).mean() - want) < 0.04
        assert (s[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert (s[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_near_duplicates_against_brute_force(spark):
    want = brute.near_classes(texts_of(spark))
    got = {r["doc_id"]: r for r in entry.queries()["op2_minhash_dedup"](spark, SF).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())


def chain(n):
    """Texts of which only neighbours are similar enough."""
    base = prose(1, 60)
    out = []
    for i in range(n):
        text = list(base)
        for j in range(i):
            text[j * 5] = f"changed{j}"
        out.append(" ".join(text))
    return out


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROWS", 2)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    texts = chain(9) + ["copy of all words here and more"] * 20 + ["", None, "   ", "two words", "two words", "a b c d e f g h i j " * 400]
    rows = list(enumerate(texts))
    got = {r["row"]["doc_id"]: r["class_id"] for r in minhash.with_classes(documents(spark, texts), bands=64, band_rows=3).collect()}
    want = brute.near_classes(rows)
    assert got == want


def test_near_duplicates_with_odd_rows(spark):
    rows = [(1, "a b c d e f", 1.0), (1, "a b c d e f", 1.0), (None, "a b c d e f", 2.0), (None, None, 3.0), (7, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id double")
    got = sorted((str(r["row"]["doc_id"]), str(r["row"]["text"]), str(r["class_id"])) for r in minhash.with_classes(df).collect())
    assert got == [("1", "a b c d e f", "1"), ("1", "a b c d e f", "1"), ("7", "", "7"), ("None", "None", "None"), ("None", "a b c d e f", "1")]
    assert minhash.with_classes(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, **{200 + i: 100 for i in range(30)}}


# ---- 3: cover trees ----


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_links(rows, least):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = (i, np.array(v, dtype=np.float32).astype(float), label)
    parts, count = brute.Sets(range(len(rows))), dict.fromkeys(range(len(rows)), 0)
    for a, (_, x, p) in good.items():
        for b, (_, y, q) in good.items():
            if a < b and p == q and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                parts.join(a, b)
                count[a] += 1
                count[b] += 1
    low = {}
    for k, (i, _, _) in enumerate(rows):
        low[parts.find(k)] = min(low.get(parts.find(k), i), i)
    return sorted((rows[k][0], count[k], low[parts.find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("sizes", [(2048, 1024), (40, 25)])
def test_cover_tree_links(spark, sizes):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 16))):
                rows.append((n, (centre + 0.09 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n + i, rows[3][1], 1) for i in range(60)] + [(n + 60, (np.array(rows[3][1]) * 7).tolist(), 1)]
    n += 61
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e-30] * 16, [1e30] * 16]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 20, rows[3][1], None)]
    got = covertree.embedding_links(vectors(spark, rows).withColumn("key", F.lit(1)), cell_rows=sizes[0], pivot_rows=sizes[1])
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == brute_links(rows, 0.98)


def test_cover_tree_query(spark):
    rows = [tuple(r) for r in table(spark, "embeddings").select("vec_id", "embedding", "label").collect()]
    got = entry.queries()["op3_cover_tree_links"](spark, SF)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == brute_links(rows, 0.98)
    assert covertree.embedding_links(vectors(spark, [])).count() == 0


# ---- 4: compact windows ----


def test_compact_windows_are_the_long_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 900).astype(np.uint64)
    values[50:60] = values[40]
    values[300:700] = np.sort(values[300:700])
    first, length = np.array([0, 5, 120, 120, 900]), 10
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        todo = [(int(a), int(b) - 1)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo + 1 >= length:
                centre = lo + int(np.argmin(values[lo : hi + 1] >> np.uint64(32)))
                want.append((lo, centre, hi))
                todo += [(lo, centre - 1), (centre + 1, hi)]
    got = compact.compact_windows(values, first, length)
    assert sorted(zip(*[x.tolist() for x in got], strict=True)) == sorted(want)


def test_passages_of_documents(spark):
    shared, line = prose(9, 70), "this line stands in every text that we have here"
    near = list(shared)
    near[20] = "other"
    texts = [
        " ".join(prose(1, 90) + shared + prose(2, 50)), " ".join(shared + prose(3, 60)), " ".join(prose(4, 60) + near), " ".join(prose(5, 200)),
        " ".join(prose(6, 100)) + " " + line, line + " " + " ".join(prose(7, 100)), " ".join(shared[:40]), "", None, " ".join(prose(8, 30000)),
    ]
    got = {r["row"]["doc_id"]: r for r in compact.passage_classes(documents(spark, texts).withColumn("p", F.lit(1))).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {0: 0, 1: 0, 2: 0, **{i: i for i in range(3, 10)}}
    assert [tuple(p) for p in got[0]["passages"]] == [(90, 160)] and [tuple(p) for p in got[1]["passages"]] == [(0, 70)]
    assert got[3]["n_links"] == 0 and got[3]["passages"] == []


def test_every_exactly_repeated_passage_is_found(spark):
    rows = {i: brute.words(t) for i, t in texts_of(spark)}
    holders = {}
    for i, w in rows.items():
        for s in range(len(w) - 49):
            holders.setdefault(tuple(w[s : s + 50]), set()).add(i)
    sets = brute.Sets(rows)
    for ids in holders.values():
        for i in ids:
            sets.join(min(ids), i)
    got = {r["doc_id"]: r for r in entry.queries()["op4_compact_windows"](spark, SF).collect()}
    for i in rows:
        assert got[i]["class_id"] == got[sets.find(i)]["class_id"]
        if sets.find(i) != i:
            assert got[i]["n_links"] > 0
    clean = [i for i, r in got.items() if r["n_links"] == 0]
    assert len(clean) > len(rows) / 2 and all(got[i]["class_id"] == i for i in clean)
    assert compact.passage_classes(documents(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [50, 52, 55, 60])
def test_passages_with_one_changed_word_at_every_position(n):
    rng = np.random.default_rng(n)
    for at in range(n):
        shared = rng.integers(0, 2**62, n).astype(np.uint64)
        near = shared.copy()
        near[at] += np.uint64(1)
        noise = [rng.integers(0, 2**62, 30).astype(np.uint64) for _ in range(4)]
        words = [np.concatenate([noise[0], shared, noise[1][:10]]), np.concatenate([noise[2][:20], near, noise[3]])]
        tokens = [shingle_hashes(w, np.array([0, w.size]), 5)[0] for w in words]
        a, b = (compact.Side(t) for t in tokens)
        # brute force: the best similarity of 46 shingles or more of one text with as many at the same distance in the other
        best, shift = 0.0, 10
        for i in range(20, 36):
            for size in range(46, n - 4 + 10):
                x, y = set(tokens[0][i : i + size].tolist()), set(tokens[1][i - shift : i - shift + size].tolist())
                best = max(best, len(x & y) / len(x | y))
        assert best >= 0.8
        for centre in np.flatnonzero(a.found_in(b)).tolist():
            for window in [(0, centre, a.tokens.size - 1, 0, centre - shift, b.tokens.size - 1), (30, centre, n + 25, 20, centre - shift, n + 15)]:
                found = compact.passages_of(a, b, [window], 46, 0.8)
                assert len(found) == 1, (at, centre)
                p, q, r, s = found[0]
                x, y = set(tokens[0][p : q + 1].tolist()), set(tokens[1][r : s + 1].tolist())
                assert min(q - p, s - r) >= 45 and len(x & y) >= 0.8 * len(x | y)
                assert window[0] <= p <= centre <= q <= window[2] and window[3] <= r <= centre - shift <= s <= window[5]


def test_passages_of_rows_without_id_and_of_repeated_ids(spark):
    shared = " ".join(prose(11, 80))
    own = [" ".join(prose(20 + i, 40)) for i in range(6)]
    rows = [
        (None, f"{own[0]} {shared}"), (None, f"{shared} {own[1]}"), (None, own[2]), (None, None), (7, f"{own[3]} {shared}"), (7, f"{shared} {own[4]}"),
        (8, own[5]), (8, own[5]), (9, None),
    ]
    got = compact.passage_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = {(r["row"]["doc_id"], r["row"]["text"]): r for r in got}
    assert len(got) == len(rows)
    linked = [by[rows[i]] for i in (0, 1, 4, 5)]
    assert {r["class_id"] for r in linked} == {7} and all(r["n_links"] > 0 and len(r["passages"]) == 1 for r in linked)
    assert [by[rows[i]]["class_id"] for i in (2, 3, 6, 8)] == [None, None, 8, 9]
    assert all(by[rows[i]]["n_links"] == 0 for i in (2, 3, 6, 8))


@pytest.mark.parametrize("group", [compact.GROUP_ROWS, 2])
def test_passages_whose_leads_hold_their_halves_apart(spark, monkeypatch, group):
    monkeypatch.setattr(compact, "GROUP_ROWS", group)
    line, n = " ".join(prose(300, 30)), 20
    halves = [(" ".join(prose(400 + i, 27)), " ".join(prose(500 + i, 27))) for i in range(n)]
    noise = [" ".join(prose(600 + i, 60)) for i in range(6 * n)]
    # earlier texts with both halves, but apart; then two texts with the passage; a line that all of them hold
    texts = [f"{noise[i]} {a} {noise[n + i]} {b} {line}" for i, (a, b) in enumerate(halves)]
    texts += [f"{line} {noise[2 * n + i]} {a} {b} {noise[3 * n + i]}" for i, (a, b) in enumerate(halves)]
    texts += [f"{noise[4 * n + i]} {a} {b} {noise[5 * n + i]} {line}" for i, (a, b) in enumerate(halves)]
    got = {r["row"]["doc_id"]: r for r in compact.passage_classes(documents(spark, texts)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == {**{i: i for i in range(2 * n)}, **{2 * n + i: n + i for i in range(n)}}
    assert [got[i]["n_links"] for i in range(3 * n)] == [0] * n + [1] * (2 * n)


def test_passages_inside_a_class_and_at_several_places(spark):
    n = 8
    own = lambda i, size: " ".join(prose(1000 + i, size))
    texts = []
    for i in range(n):
        common, a, b, twice = own(10 * i, 60), own(10 * i + 1, 27), own(10 * i + 2, 27), own(10 * i + 3, 60)
        noise = [own(100 + 10 * i + k, 55) for k in range(8)]
        # the first text leads all minima of the halves but holds them apart; the other two hold them together
        texts += [f"{common} {noise[0]} {a} {noise[1]} {b} {twice} {noise[6]} {twice}", f"{common} {noise[2]} {a} {b} {noise[3]}", f"{noise[4]} {common} {noise[5]} {a} {b} {noise[7]} {twice}"]
    got = {r["row"]["doc_id"]: r for r in compact.passage_classes(documents(spark, texts)).collect()}
    for i in range(n):
        assert [got[3 * i + k]["class_id"] for k in range(3)] == [3 * i] * 3
        held = [{x for p in got[3 * i + k]["passages"] for x in range(p[0], p[1])} for k in range(3)]
        assert set(range(60)) <= held[0] and set(range(224, 284)) <= held[0] and set(range(339, 399)) <= held[0]
        assert set(range(60)) <= held[1] and set(range(115, 169)) <= held[1]
        assert set(range(55, 115)) <= held[2] and set(range(170, 224)) <= held[2] and set(range(279, 339)) <= held[2]


def test_windows_that_no_document_can_use_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(compact, "BLOCK_BYTES", 500)
    rng = np.random.default_rng(3)
    words = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 400)) for _ in range(12)]
    line, shared = " ".join(f"l{x}" for x in range(20)), [f"s{x}" for x in range(50)]
    cut = lambda w, i, j: " ".join(w.split()[i:j])
    near = " ".join(shared[:20] + ["other"] + shared[21:])
    texts = [f"{cut(w, 0, 60)} {line} {cut(w, 60, 120)}" for w in words[:8]]
    texts += [f"{cut(words[8], 0, 60)} {' '.join(shared)} {line}", f"{line} {near} {cut(words[9], 0, 60)}"]
    texts += [" ".join(["the"] * 25 + ["in"] * 25 + [f"r{i}"] * 25 + ["of"] * 25) for i in range(2)]
    rows = documents(spark, texts).selectExpr("doc_id AS doc", "text").repartition(3)
    # all places of all texts as centres of windows that reach everywhere
    centres = [(c, 0, i, 0, c, len(t.split()) - 5) for i, t in enumerate(texts) for c in range(len(t.split()) - 4)]
    windows = spark.createDataFrame(centres, "key bigint, function int, doc bigint, lo int, centre int, hi int")
    got = {}
    for r in compact._hopeful(windows, rows, 5, 46, 0.8).collect():
        got.setdefault(r["doc"], set()).add(r["centre"])
    assert not set(got) & set(range(8))  # a line of 20 words is too short for any of them
    assert set(range(60, 106)) <= got[8] and set(range(20, 66)) <= got[9]
    assert max(got[8]) < 130 and min(got[8]) >= 48 and max(got[9]) <= 78


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_window_pairs_are_grouped_by_documents(spark, batch):
    rng = random.Random(12)
    rows = [(rng.randint(0, 3), rng.randint(4, 6), rng.randint(0, 2), *[rng.randint(0, 2)] * 6) for _ in range(60)] + [(9, 10, 1, 0, 0, 0, 0, 0, 0)] * 3
    names = ["a_doc", "b_doc", "function", *[f"{side}_{n}" for side in "ab" for n in ("lo", "centre", "hi")]]
    schema = ", ".join(f"{n} {'bigint' if n.endswith('doc') else 'int'}" for n in names)
    want = {}
    for r in set(rows):
        want.setdefault(r[:2], []).append(r[2:])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for agree in (2, 3):
            got = {(r["lead"], r["doc"]): sorted(map(tuple, r["pairs"])) for r in compact._agreed(spark.createDataFrame(rows, schema), agree).collect()}
            assert got == {k: sorted(x[1:] for x in v) for k, v in want.items() if len({x[0] for x in v}) >= agree}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_window_pairs_do_not_add_up_in_the_shuffle(spark, monkeypatch):
    # 200 texts with one line: each batch sends a row per minimum, its pairs go along as bytes, and all of them come back
    line = " ".join(prose(80, 60))
    texts = [f"{line} {' '.join(prose(800 + i, 50))}" for i in range(200)]
    rows = documents(spark, texts).selectExpr("doc_id AS doc", "text").coalesce(1)
    for most in (4000, 7):
        monkeypatch.setattr(compact, "LED_PAIRS", most)
        windows = compact._windows(rows, 46, 5, 6).cache()
        alone = windows.where("led IS NULL")
        assert alone.count() == alone.select("key").distinct().count()
        pairs = compact._joined(windows)
        widths = windows.selectExpr("sum(octet_length(led))").first()[0]
        assert pairs.count() == widths / compact._PAIR.itemsize and windows.where("led IS NOT NULL").count() <= pairs.count() / most + 10
        assert pairs.groupBy("b_doc").agg(F.countDistinct("function").alias("n")).where("n >= 2").count() == 199
        windows.unpersist()


def test_hopeless_chains_are_not_measured_by_window():
    rng = np.random.default_rng(13)
    line, noise = rng.integers(0, 2**62, 20).astype(np.uint64), rng.integers(0, 2**62, 300).astype(np.uint64)
    a, b = compact.Side(np.concatenate([noise[:80], line, noise[80:160]])), compact.Side(np.concatenate([noise[160:240], line, noise[240:]]))
    pair = compact._Pair(a, b, (a.found_in(b), b.found_in(a)), [compact._sums(x, 4.0) for x in (a.found_in(b), b.found_in(a))], 4.0)
    assert pair.around(85, 85, 46, 0.8) is None and pair.around(85, 85, 15, 0.8) is None  # what is known stays
    assert compact._Pair(a, b, (a.found_in(b), b.found_in(a)), pair.before, 4.0).around(85, 85, 20, 0.8) is not None


def test_passages_of_texts_that_repeat_themselves():
    rng = np.random.default_rng(5)
    line, noise = rng.integers(0, 2**62, 60).astype(np.uint64), rng.integers(0, 2**62, 400).astype(np.uint64)
    long = np.concatenate([np.tile(line, 60), noise])
    a, b = (compact.Side(t) for t in (long, np.concatenate([noise[:20], np.tile(line, 50)])))
    centres = np.arange(0, 60 * 59, 60)
    windows = np.stack([centres * 0, centres, centres * 0 + a.tokens.size - 1, centres * 0, centres * 0 + 20, centres * 0 + b.tokens.size - 1], axis=1)
    found = compact.passages_of(a, b, windows, 46, 0.8)
    assert found
    for p, q, r, s in found:
        x, y = set(a.tokens[p : q + 1].tolist()), set(b.tokens[r : s + 1].tolist())
        assert min(q - p, s - r) >= 45 and len(x & y) >= 0.8 * len(x | y)


# ---- 5: KD-trees ----


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist(), 0) for i in range(300)]
    rows += [(300, None, 0), (301, [None] * 6, 0), (302, [float("nan")] * 6, 0), (303, [1.0, 2.0], 0), (400, [1.0, 2.0], 0), (None, [3.0] * 6, 0)]
    df = vectors(spark, rows)
    got = kdtree.top_k(df.withColumn("row", F.lit(1)), F.col("id") % 20 == 0, shard_rows=64, query_rows=4)
    usable = [(i, np.floor(1024 * np.array(v))) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in usable:
        if q is not None and q % 20 == 0:
            scores = sorted((-int(x @ y), (c is None, c or 0), c) for c, y in usable if c != q and len(x) == len(y))[:10]
            want += [(q, r + 1, c, -s) for r, (s, _, c) in enumerate(scores)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert kdtree.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


# ---- 6: mixing ----


def test_targets_stop_and_the_rest_is_shared(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 300), ("~", None, 50), ("=é", "é", 0)], "key string, source string, source_size long")
    got = {r["key"]: r["target"] for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    weights, caps, total = {"=a": 3, "=b": 1, "=c": 2, "=é": 3, "~": 1}, {"=a": 20, "=b": 2000, "=c": 600, "=é": 0, "~": 100}, 1.5 * 1360
    want, left = dict.fromkeys(caps, 0.0), set(caps)
    while left:
        share = (total - sum(want[k] for k in caps if k not in left)) / sum(weights[k] for k in left)
        over = {k for k in left if share * weights[k] >= caps[k]}
        for k in over or left:
            want[k] = float(min(caps[k], share * weights[k]))
        left -= over or left
    assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None if s == 3 else f"s{s}", "x") for i in range(600) for s in [rng.choice((0, 0, 0, 1, 2, 3))]]
    rows += [(None, "null id", "s1", "x"), (900, None, "s1", "x"), (901, "", "s9", "x"), (5, "again", "s0", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["row"]["source"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["size"] == len(brute.words(r["row"]["text"]))
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 40
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(str(r) for r in got) == sorted(str(r) for r in again)
    assert mixing.mix_sources(df.limit(0)).count() == 0


# ---- 7: suffix order ----


def test_memory_of_suffix_order():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 5000).astype(np.uint8).tobytes()
    pieces = [base[a : a + 400] for a in rng.integers(0, 4500, 2000).tolist()]
    tracemalloc.start()
    found = suffixes.repeated_starts(pieces, [(i, 0) for i in range(2000)], 250, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(f.size for f in found) > 200_000
    assert peak < 85 * sum(map(len, pieces)), peak / sum(map(len, pieces))


def repeats():
    rng = random.Random(6)
    bits = ["".join(rng.choice("abcé ") for _ in range(60)) for _ in range(4)]
    texts = ["".join(rng.choice([*bits, "".join(rng.choice("xyzü") for _ in range(30))]) for _ in range(8)) for _ in range(40)]
    return texts + ["a" * 300, "ab" * 200, "", None, "short", texts[0], texts[0], bits[0] * 5]


@pytest.mark.parametrize(("first", "group"), [(False, 4000), (True, 4000), (False, 1), (True, 1)])
def test_repeats_against_brute_force(spark, first, group):
    rows = list(enumerate(repeats()))
    want = brute.without_repeats(rows, 50, first)
    df = documents(spark, repeats()).withColumn("doc", F.lit(1))
    got = suffixes.remove_repeats(df, length=50, first=first, group_runs=group).collect()
    assert {r["row"]["doc_id"]: (r[1], r[2], r[3], r[4], r["kept"].encode()) for r in got} == want


@pytest.mark.parametrize("first", [True, False])
def test_copies_come_back_as_one_row_per_text(spark, monkeypatch, first):
    seen = []
    by_row = suffixes._by_row
    monkeypatch.setattr(suffixes, "_by_row", lambda blocks: seen.append(by_row(blocks)) or seen[-1])
    one, two, three = (" ".join(prose(s, 60)) for s in (70, 71, 72))
    texts = [f"{i} {one} {(two, three)[i % 2]} {one}" for i in range(30)]
    found = suffixes.remove_repeats(documents(spark, texts), length=50, first=first)
    rows = {r["row"]["doc_id"]: tuple(r)[1:5] for r in found.collect()}
    assert rows == {i: w[:4] for i, w in brute.without_repeats(list(enumerate(texts)), 50, first).items()}
    keys = [r["key"] for r in seen[0].collect()]
    assert keys and len(keys) == len(set(keys)) <= len(texts)


def test_repeats_query(spark):
    want = brute.without_repeats(texts_of(spark), 400, False)
    got = entry.queries()["op7_suffix_dedup"](spark, SF).collect()
    assert {r[0]: tuple(r[1:5]) for r in got} == {i: w[:4] for i, w in want.items()}


def test_repeats_with_odd_rows(spark):
    rows = [(1, "x" * 60), (1, "x" * 60), (None, "y" * 70 + "z" * 60), (None, None), (3, "z" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["row"]["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(df, length=50, first=False).collect())
    assert got == [("1", 60, 60), ("1", 60, 60), ("3", 60, 60), ("None", 0, 0), ("None", 130, 130)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [4000, 1])
def test_repeats_of_rows_that_share_an_id_or_have_none(spark, group):
    p, q = (" ".join(prose(s, 12)) for s in (31, 32))
    a, b, c, d = (" ".join(prose(s, 30)) for s in range(33, 37))
    # rows without an id, and rows of one id, each with a passage somewhere else
    rows = [(None, a + p), (None, p + b), (None, "n" + c), (7, c + q), (7, d), (7, q + d[:20] + "!"), (None, a + p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for first in (False, True):
        # brute force on ids of our own, in the order of (id, digest of the text)
        parts = [r[0] for r in df.select(F.xxhash64("text")).collect()]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] or 2**63, parts[i], i))
        want = brute.without_repeats([(n, rows[i][1]) for n, i in enumerate(order)], 50, first)
        want = sorted((str(rows[i][0]), *want[n]) for n, i in enumerate(order))
        for input_ in (df, df.repartition(5)):
            got = suffixes.remove_repeats(input_, length=50, first=first, group_runs=group).collect()
            assert sorted((str(r["row"]["doc_id"]), r[1], r[2], r[3], r[4], r["kept"].encode()) for r in got) == want


# ---- 8: quality ----


def test_gradients():
    rng = np.random.default_rng(0)
    x, bag, y = rng.standard_normal((9, 5)), np.array([0, 2, 3, 9]), np.array([0.0, 1.0, 1.0])
    model = quality.fit_attention(x.astype(np.float32), bag, y.astype(np.float32), hidden=4, inner=3, steps=1)
    model.p = {k: np.array(w, dtype=np.float64) for k, w in model.p.items()}

    def loss():
        s = model.forward(x, bag)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.backward(model.forward(x, bag), bag, y)
    for k, w in model.p.items():
        flat = np.atleast_1d(w.reshape(-1))
        for i in range(min(3, flat.size)):
            old = flat[i]
            step = 1e-6
            model.p[k] = w.copy()
            np.atleast_1d(model.p[k].reshape(-1))[i] = old + step
            up = loss()
            np.atleast_1d(model.p[k].reshape(-1))[i] = old - step
            down = loss()
            model.p[k] = w
            assert np.atleast_1d(grads[k].reshape(-1))[i] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["op8_quality_attention"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    right = np.mean([r["quality"] == r["predicted"] for r in rows])
    kept = np.mean([r["predicted"] for r in rows if r["quality"] == 1])
    assert len(rows) > 1000 and right > 0.985 and kept > 0.99


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (2, "", 1), (3, "word", 1), (3, "word", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")
    model = quality.train_quality(df, labels)
    assert model is None and [r["score"] for r in quality.score_quality(df, model).collect()] == [0.5] * 4
    some = quality.train_quality(table(spark, "documents"), table(spark, "labels"))
    scores = [r["score"] for r in quality.score_quality(df, some).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]
    assert quality.score_quality(df.limit(0), some).count() == 0


# ---- 9: WARC ----


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    pages = [(i, f"http://x/{i} a\r\nb", "é" * (i * 700)) for i in range(6)] + [(6, None, None), (7, "u", ""), (8, "u", "é" * 700), (None, "u", "é" * 700), (9, "u", "WARC/1.1\r\n\r\nx")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, lead int")
    folder = f"file://{tmp_path}/w"
    files, n = warc.write_archives(warc.plan_records(df), folder)
    assert n >= 2 and files.agg(F.sum("records")).first()[0] == len(pages)
    chunks = warc.read_archives(files, n, folder, chunk_bytes=1000).collect()
    whole = {}
    for r in sorted((c for c in chunks if c["page_id"] is not None), key=lambda c: (c["page_id"], c["chunk_no"])):
        assert len(r["data"]) <= 1000
        whole[r["page_id"]] = whole.get(r["page_id"], b"") + bytes(r["data"])
        assert r["bytes_so_far"] == len(whole[r["page_id"]])
        assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(whole[r["page_id"]]).digest()).decode()
    revisits = {r["page_id"]: r["refers_to"] for r in chunks if r["record_type"] == "revisit"}
    assert revisits == {0: 7, 6: 7, 1: 8, None: 8}
    for i, _, html in pages:
        if i is not None and i not in revisits:
            assert whole[i] == (html or "").encode()
    got = {r["page_id"]: r for r in warc.archive_round_trip(df).collect()}
    assert got[1]["payload_bytes"] == 1400 and got[6]["payload_bytes"] == 0 and got[9]["record_type"] == "response"
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_broken_archives():
    with pytest.raises(Exception):  # noqa: B017
        list(warc.record_chunks(io.BytesIO(b"no archive"), 10))
    out = io.BytesIO()
    warc._write_record(out, 1, "u", "text" * 100, "00" * 20, None, "2000-01-01T00:00:00Z")
    with pytest.raises(EOFError):
        list(warc.record_chunks(io.BytesIO(out.getvalue()[:-30]), 10))


# ---- 10: HTML ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="no-sidebar">
<header class="site">Site name</header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="wrap"><div class="sidebar"><p>Other news of the day that nobody asked for, at some length.</p></div>
<article><header><h1>A  title &amp; more</h1></header><p>First <b>bold</b>&nbsp;paragraph, with a <a href=x>link</a> in it.<p>Second
paragraph&hellip;<br>after a break<!-- hidden --></p><div class="ad">Buy</div><ul><li>item one<li>item two</ul>
<form><p>Your mail</p></form><section class="comments"><p>Nice text, I liked it very much!</p></section></article></div>
<footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    want = "A title & more\nFirst bold paragraph, with a link in it.\nSecond paragraph… after a break\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>open <b>tags", "open tags"), ("a < b and b > a", "a < b and b > a"),
        ("<!-- never closed <p>x</p>", ""), ("<script>x", ""), ("<p>&lt;p&gt; &#65;&notanentity;</p>", "<p> A¬anentity;"), ("<nav>only a menu</nav>", ""),
        ("<a" * 20000, "<a" * 20000), ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text_of_odd_pages(source, want):
    assert html_text.main_text(source) == want


def test_extraction_query(spark):
    got = entry.queries()["op10_html_text"](spark, SF).collect()
    assert len(got) == table(spark, "pages").count()
    assert all(r["n_chars"] == len(r["text"]) and "<p>" not in r["text"] for r in got)
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html_text.extract_text(df, keep=("page_id", "url", "text")).collect()] == ["", "a"]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_dealt_rows_of_a_large_class_grow_linearly(spark, monkeypatch):
    """One bucket of many near copies of one text and a few strangers: the strangers alone meet everyone."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 10)
    seen = []
    check = minhash._check_blocks
    monkeypatch.setattr(minhash, "_check_blocks", lambda rows, *a: (seen.append(rows.count()), check(rows, *a))[1])
    base = prose(3, 200)
    for n in (100, 400):
        texts = [" ".join([*base[: i % 200], f"new{i}", *base[i % 200 + 1 :]]) for i in range(n)]
        texts += [" ".join([*prose(20 + i, 5), *base[: 60 + 9 * i]]) for i in range(5)]
        got = {r["row"]["doc_id"]: r["class_id"] for r in minhash.with_classes(documents(spark, texts), bands=4, band_rows=1).collect()}
        assert got == brute.near_classes(list(enumerate(texts)))
    assert 0 < seen[1] <= 6 * seen[0]


# ---- 10: pages whose best subtree lies outside an article, and unmatched tags ----


def test_a_teaser_article_does_not_displace_the_story():
    story = [f"Paragraph {i} of the long story goes on and on." for i in range(12)]
    page = "<body><div>" + "".join(f"<p>{p}</p>" for p in story) + "</div><article><p>Teaser.</p></article></body>"
    assert html_text.main_text(page).split("\n")[:12] == story


def test_unmatched_tags_take_linear_time():
    import time

    started = time.process_time()
    assert html_text.main_text("<b>" * 8_000 + "</i>" * 8_000) == ""
    assert html_text.main_text("<i><div>" + "<b>x" * 9_000 + "</i>" * 9_000 + "<tr>" * 9_000) == "x" * 9_000
    assert time.process_time() - started < 5
