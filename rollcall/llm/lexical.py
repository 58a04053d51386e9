"""Ranked lexical search: posting lists with range-maximum tables, searched best first.

The index is a written table: documents are dealt into shards, and each shard has one
row per term with its posting list.  A search brings the lists of the asked terms
together, shard by shard.  In a shard the impacts of a list are constants, so a sparse
table answers the greatest impact in any range of postings at once.  The sum of
these answers over the terms of a question bounds every document of an interval.  The
interval with the greatest bound is split at its document of maximum impact, which is
scored, until no interval can hold a better document than the k-th found.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollcall.session import settle

#: bytes of text in a shard (one document at least), and documents in it at most
SHARD_BYTES, SHARD_DOCS = 16_000_000, 16_384
#: questions that a task has in hand together
QUESTIONS = 256
#: bytes of the asked terms with their questions up to which they are broadcast
BROADCAST_BYTES = 32_000_000
#: intervals that are split at once
WAVE = 64

#: bytes that separate terms become spaces, A-Z become a-z; all other bytes are parts of terms
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

_INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.IntegerType()),
    T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
    T.StructField("ids", T.ArrayType(T.LongType())),
])


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


# ---- index ----


def _shard_rows(shard: int, ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
    """The posting lists of a shard; the row without a term has the ids and lengths of its documents."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    number = defaultdict(count().__next__)
    term, freq = array("i"), array("i")
    distinct = np.zeros(len(ids), dtype=np.int64)
    length = np.zeros(len(ids), dtype=np.int32)
    for place, i in enumerate(order):
        found = Counter(terms_of(texts[i]))
        term.extend(map(number.__getitem__, found))
        freq.extend(found.values())
        distinct[place] = len(found)
        length[place] = found.total()
    terms = np.frombuffer(term, dtype=np.int32) if term else np.zeros(0, dtype=np.int32)
    freqs = np.frombuffer(freq, dtype=np.int32) if freq else np.zeros(0, dtype=np.int32)
    by_term = np.argsort(terms, kind="stable")
    places = np.repeat(np.arange(len(ids), dtype=np.int32), distinct)[by_term]
    df = np.bincount(terms, minlength=len(number)).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(df)])
    # the row of the documents comes first
    head = len(ids)
    offsets = np.concatenate([[0], head + ends]).astype(np.int32)
    columns = [
        pa.array(np.full(len(number) + 1, shard, dtype=np.int64)),
        pa.array([None, *[t.decode() for t in number]], pa.string()),
        pa.array(np.concatenate([[0], df]).astype(np.int32)),
        pa.ListArray.from_arrays(offsets, np.concatenate([np.arange(head, dtype=np.int32), places])),
        pa.ListArray.from_arrays(offsets, np.concatenate([length, freqs[by_term]])),
        pa.array([[ids[i] for i in order], *[None] * len(number)], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_INDEX.names)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written index of all terms of all documents: shard, term, df, places, counts, ids.

    ``places`` are the documents of the shard in the order of their ids (NULL last) that
    hold the term, ``counts`` how often.  The row of a shard whose term is NULL lists the
    ids and, in ``counts``, the number of terms of all its documents, also of those
    without any.  Terms are the runs of letters and digits of ASCII and of all characters
    beyond it, with A-Z in lower case.  Every row is a document of its own, also where
    ids repeat or are NULL; other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for part in parts:
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist()
            for i, t, size in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), sizes, strict=True):
                if ids and (held + size > SHARD_BYTES or len(ids) == SHARD_DOCS):
                    yield _shard_rows(shard, ids, texts)
                    shard, ids, texts, held = shard + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += size
        if ids:
            yield _shard_rows(shard, ids, texts)

    return settle(narrow.mapInArrow(batches, _INDEX))


# ---- search ----


class Shard:
    """Posting lists of one shard with impacts and, per list, a sparse table of the places of maxima."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray]], n: int, total: int):
        self.ids = ids
        damp = 8 * (25 + (75 * sizes.astype(np.int64) * n) // total) if total else np.zeros(0, dtype=np.int64)
        lengths = [places.size for _, places, _ in lists]
        self.first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.place = np.concatenate([p for _, p, _ in lists]).astype(np.int64)
        freq = np.concatenate([c for _, _, c in lists]).astype(np.int64) * 1000
        weight = np.repeat(np.array([w for w, _, _ in lists], dtype=np.int64), lengths)
        self.impact = weight * (freq * 1_000_000 // (freq + damp[self.place]))
        self.key = np.repeat(np.arange(len(lists), dtype=np.int64) << 32, lengths) + self.place
        # all lists in one table: level j of posting i has the maximum of postings i to i + 2**j - 1
        best = np.arange(self.place.size)
        self.levels = [best]
        width = 1
        while width < max(lengths, default=0):
            ahead = np.minimum(np.arange(best.size) + width, best.size - 1)
            other = best[ahead]
            best = np.where(self.impact[other] > self.impact[best], other, best)
            self.levels.append(best)
            width *= 2
        self.table = np.stack(self.levels).astype(np.int32)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Posting of maximum impact in each range [lo, hi) of one list; -1 where it is empty."""
        size = hi - lo
        level = np.frexp(np.maximum(size, 1))[1] - 1  # floor of the logarithm
        a = self.table[level, np.minimum(lo, self.place.size - 1)]
        b = self.table[level, np.maximum(hi - (1 << level), 0)]
        return np.where(size > 0, np.where(self.impact[b] > self.impact[a], b, a), -1)

    def search(self, slots: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents that reach ``floor`` (1 at least); ties go to the earlier place."""
        times = times.astype(np.int64)

        def bounded(lo, a, b):
            """Bounds of intervals and the documents they are split at."""
            top = self.maxima(a, b)
            share = np.where(top >= 0, self.impact[top], -1) * times
            widest = share.argmax(axis=1)
            rows = np.arange(lo.size)
            return np.maximum(share, 0).sum(axis=1), self.place[top[rows, widest]]

        lo = np.zeros(1, dtype=np.int64)
        a, b = self.first[slots][None, :], self.first[slots + 1][None, :]
        bound, split = bounded(lo, a, b)
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least, last = max(floor, 1), len(self.ids)  # what an equal score must come before
        while lo.size:
            if lo.size > WAVE:
                taken = np.argpartition(-bound, WAVE)[:WAVE]
                rest = np.ones(lo.size, dtype=bool)
                rest[taken] = False
                old = lo[rest], a[rest], b[rest], bound[rest], split[rest]
                lo, a, b, split = lo[taken], a[taken], b[taken], split[taken]
            else:
                old = None
            # score the documents at which the intervals are split
            at = np.searchsorted(self.key, (slots << 32) + split[:, None])
            hit = (at < b) & (self.place[np.minimum(at, self.place.size - 1)] == split[:, None])
            score = np.where(hit, self.impact[np.minimum(at, self.place.size - 1)] * times, 0).sum(axis=1)
            places, scores = np.concatenate([places, split]), np.concatenate([scores, score])
            keep = scores >= least
            places, scores = places[keep], scores[keep]
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
            if places.size == k:
                least, last = int(scores[-1]), int(places[-1])
            # the two sides of each
            lo = np.concatenate([lo, split + 1])
            a, b = np.concatenate([a, at + hit]), np.concatenate([at, b])
            some = (a < b).any(axis=1)
            lo, a, b = lo[some], a[some], b[some]
            if lo.size:
                bound, split = bounded(lo, a, b)
            else:
                bound, split = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if old is not None:
                lo, a, b, bound, split = (np.concatenate([x, y]) for x, y in zip(old, (lo, a, b, bound, split)))
            open_ = (bound > least) | ((bound == least) & (lo < last))
            lo, a, b, bound, split = lo[open_], a[open_], b[open_], bound[open_], split[open_]
        return places, scores


_HITS = T.StructType([T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def _rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(
            part.column("block").to_pylist(), part.column("shard").to_pylist(), part.column("weight").to_pylist(),
            part.column("places"), part.column("counts"), part.column("ids"), part.column("slots"), part.column("times"), strict=True,
        )


def _searched(rows: Iterator[tuple], k: int, n: int, total: int) -> Iterator[pa.RecordBatch]:
    """Search the shards one after the other; the k-th scores found so far go along."""
    block = shard = ids = sizes = None
    lists, asked, best = [], defaultdict(list), {}

    def flush():
        if not lists:
            return None
        here = Shard(ids, sizes, lists, n, total)
        out = []
        for slot in sorted(asked):
            terms = np.array([t for t, _ in asked[slot]], dtype=np.int64)
            times = np.array([c for _, c in asked[slot]], dtype=np.int64)
            seen = best.get(slot, [])
            places, scores = here.search(terms, times, k, seen[-1] if len(seen) == k else 1)
            out += [(block, slot, ids[p], s) for p, s in zip(places.tolist(), scores.tolist())]
            best[slot] = sorted([*seen, *scores.tolist()], reverse=True)[:k]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))], names=_HITS.names
        ) if out else None

    for b, s, weight, places, counts, found_ids, slots, times in rows:
        if (b, s) != (block, shard):
            made = flush()
            if made is not None:
                yield made
            if b != block:
                best = {}
            block, shard, lists, asked = b, s, [], defaultdict(list)
        if weight is None:  # the documents of the shard come before its lists
            ids, sizes = found_ids.as_py(), counts.values.to_numpy()
            continue
        for slot, c in zip(slots.as_py(), times.as_py()):
            asked[slot].append((len(lists), c))
        lists.append((weight, places.values.to_numpy(), counts.values.to_numpy()))
    made = flush()
    if made is not None:
        yield made


def rank_documents(index: DataFrame, questions: DataFrame, key: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` best documents of every question: the key, rank, doc_id, score.

    ``index`` comes from ``build_index``.  A question without terms, or whose terms no
    document holds, has no rows.  Questions may repeat a key; those with equal keys and
    texts rank alike, each on its own.  Equal scores go by ascending id, NULL last.
    """
    spark = index.sparkSession

    # questions in blocks, each with a small number in its block; all terms with their repeats
    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for part in parts:
            rows = []
            for q, t in zip(part.column("q").to_pylist(), part.column("text").to_pylist()):
                block = TaskContext.get().partitionId() << 32 | row // QUESTIONS
                rows += [(block, row % QUESTIONS, q, w.decode(), c) for w, c in Counter(terms_of(t)).items()]
                row += 1
            yield pa.RecordBatch.from_pylist([dict(zip(asks.names, r)) for r in rows], schema=arrow)

    whole = questions.select(F.col(key).alias("q"), F.col(text).alias("text"))
    asks = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("q", whole.schema["q"].dataType),
        T.StructField("term", T.StringType()), T.StructField("times", T.IntegerType()),
    ])
    arrow = to_arrow_schema(asks)
    pairs = settle(whole.mapInArrow(asked, asks))
    wanted = settle(pairs.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("slot", "times"))).alias("by")))
    held = wanted.agg(F.sum(F.octet_length("term") + 8 * F.size("by") + 64)).first()[0] or 0
    small = F.broadcast if held <= BROADCAST_BYTES else (lambda table: table)

    documents = index.where("term IS NULL")
    sums = documents.agg(
        F.sum(F.size(F.filter("counts", lambda c: c > 0))).alias("n"),
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("total"),
    ).first()
    n, total = int(sums["n"] or 0), int(sums["total"] or 0)

    words = wanted.select("term").distinct()
    df = index.join(small(words), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = settle(wanted.join(df.select("term", weight.alias("weight")), "term"))
    lists = index.join(
        small(weighted.select("block", "term", "weight", F.col("by.slot").alias("slots"), F.col("by.times").alias("times"))), "term"
    )
    columns = ["block", "shard", "weight", "places", "counts", "ids", "slots", "times"]
    nothing = F.lit(None).cast("array<int>")
    # each shard brings its documents once per block that asks it
    asking = lists.select("block", "shard").distinct()
    heads = documents.join(asking, "shard").withColumns({"weight": F.lit(None).cast("long"), "slots": nothing, "times": nothing})
    together = lists.select(*columns).unionByName(heads.select(*columns))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = together.repartition(tasks, "block", "shard").sortWithinPartitions("block", "shard", F.col("weight").asc_nulls_first())

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _searched(_rows_of(parts), k, n, total)

    hits = dealt.mapInArrow(search, _HITS)
    place = Window.partitionBy("block", "slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    names = pairs.select("block", "slot", "q").distinct()
    return ranked.join(names, ["block", "slot"]).select(F.col("q").alias(key), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS total FROM d),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * n) // total AS m FROM d, s WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n),
q AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY i, item_id, term
), scored AS (
  SELECT i, item_id, m.r, m.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m ON p.r = m.r GROUP BY i, item_id, m.r, m.doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
