"""Packing documents into sequences of fixed length by bulk-synchronous best fit.

Documents become token ids with an end token; those longer than a sequence are cut.
Packing goes in rounds over tables of documents and gaps.  A round sorts both by size
into ranges and sweeps every range from large to small: a document takes the smallest
gap that holds it.  What a range could not settle is matched across ranges by rank,
from the counts of the ranges alone, so that two documents never take one gap.  Gaps
are updated and the next round begins.  Where no gap holds any document, the largest
documents open sequences of their own.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rollcall.session import settle

#: tokens of a sequence
CAPACITY = 1024
#: documents and gaps that one task sweeps when there are few, and when there are many
SLICE_ROWS, SLICE_MOST = 16_384, 1_000_000
#: characters of text that are encoded before their pieces are handed on (one text at least)
BLOCK_CHARS = 2_000_000

#: what a row of a round is
PLACED, DOC, GAP, SPENT = 0, 1, 2, 3

_encoders: dict[tuple[str, str], "Encoder"] = {}


# ---- tokens ----


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level file, several times as fast.

    Ids of the file are ranks; added tokens are found in texts, as that library does.
    Where the faster library gives up (very long runs of white space), ``tokenizers``
    itself encodes the text.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as lines:
            said = json.load(lines)
        # the alphabet of byte-level files: printable bytes stand for themselves, the others follow from 256 on
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        ranks = {bytes(byte[c] for c in word): i for word, i in said["model"]["vocab"].items() if word not in added}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.whole = Tokenizer.from_file(path)

    @classmethod
    def load(cls, path: str, pattern: str) -> "Encoder":
        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = cls(path, pattern)
        return _encoders[path, pattern]

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            return self.whole.encode(text, add_special_tokens=False).ids


def token_pieces(
    docs: DataFrame, path: str, pattern: str, keep: Sequence[str], end: int = 2, capacity: int = CAPACITY, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """A written table of the pieces of all documents: row (the columns ``keep``), key, piece, start, length, ids_crc32.

    A document is its ids and ``end``; NULL is an empty text, of which ``end`` is left.
    What is longer than ``capacity`` is cut so that all pieces but the first are full.
    ``key`` numbers the pieces of all documents, also where ids repeat or are NULL.
    ``with_ids`` adds the ids themselves.
    """
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))
    fields = [
        narrow.schema["row"], T.StructField("key", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        key = TaskContext.get().partitionId() << 36
        for part in parts:
            texts = part.column("text")
            row = 0
            while row < part.num_rows:
                owner, made, lists, chars, first = [], [], [], 0, row
                while row < part.num_rows and (chars < BLOCK_CHARS or row == first):
                    t = texts[row].as_py() or ""
                    chars += len(t)
                    ids = np.array([*encoder.ids(t), end], dtype="<u4")
                    begin = 0
                    for piece, stop in enumerate(range((ids.size - 1) % capacity + 1, ids.size + 1, capacity)):
                        made.append((key, piece, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())))
                        owner.append(row)
                        if with_ids:
                            lists.append(ids[begin:stop].astype(np.int32))
                        begin, key = stop, key + 1
                    row += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [part.column("row").take(pa.array(owner)), *[pa.array(c, k) for c, k in zip(zip(*made), kinds)]]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return settle(narrow.mapInArrow(batches, T.StructType(fields)))


# ---- packing ----

_ROUND = T.StructType([
    T.StructField("what", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("slice", T.LongType()), T.StructField("rank", T.LongType()),
])


class Sweep:
    """One range from large to small: gaps come in, every document takes the smallest that holds it.

    Sizes are small integers; a bit per size tells which gaps there are.
    """

    def __init__(self, capacity: int, may_open: bool):
        self.capacity, self.may_open = capacity, may_open
        self.sizes, self.bins, self.left, self.smallest = 0, defaultdict(list), 0, capacity

    def step(self, kind: list[int], size: list[int], ids: list[int]) -> list[tuple]:
        """Rows (what, id, bin, size, offset, rank) for events in order."""
        out = []
        for k, s, i in zip(kind, size, ids):
            self.smallest = s
            if k == GAP:
                self.bins[s].append(i)
                self.sizes |= 1 << s
                continue
            fits = self.sizes >> s
            if fits:
                gap = s + (fits & -fits).bit_length() - 1
                held = self.bins[gap]
                target = held.pop()
                if not held:
                    self.sizes ^= 1 << gap
            elif self.may_open:
                gap, target = self.capacity, i
            else:
                out.append((DOC, i, None, s, None, self.left))
                self.left += 1
                continue
            out.append((PLACED, i, target, s, self.capacity - gap, None))
            if gap > s:
                self.bins[gap - s].append(target)
                self.sizes |= 1 << (gap - s)
        return out

    def end(self) -> list[tuple]:
        """The gaps that remain, from large to small; those that no later range can use are SPENT for this round."""
        out, rank = [], 0
        for s in sorted(self.bins, reverse=True):
            for b in self.bins[s]:
                if s >= self.smallest:
                    out.append((GAP, None, b, s, None, rank))
                    rank += 1
                else:
                    out.append((SPENT, None, b, s, None, None))
        return out


def _swept(events: DataFrame, capacity: int, may_open: bool) -> DataFrame:
    """Sweep every partition of sorted events."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, here = Sweep(capacity, may_open), TaskContext.get().partitionId()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            what, ids, bins, size, offset, rank = zip(*found)
            columns = [ids, bins, size, offset, [here] * len(found), rank]
            return pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], names=_ROUND.names)

        for part in parts:
            found = sweep.step(part.column("what").to_pylist(), part.column("size").to_pylist(), part.column("id").to_pylist())
            if found:
                yield rows(found)
        found = sweep.end()
        if found:
            yield rows(found)

    return events.mapInArrow(batches, _ROUND)


def rank_segments(docs: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Which leftover documents of a range take which leftover gaps of ranges before it.

    From counts by range: (range of the documents, first rank, range of the gaps, first
    rank, how many).  The nearest range before has the smallest gaps, and in it the last
    rank.  There are at most twice as many segments as ranges.
    """
    out, open_ = [], []
    for k in sorted(docs.keys() | gaps.keys()):
        start, left = 0, docs.get(k, 0)
        while left and open_:
            at, hi = open_.pop()
            n = min(left, hi)
            out.append((k, start, at, hi - n, n))
            start, left = start + n, left - n
            if hi > n:
                open_.append((at, hi - n))
        if gaps.get(k):
            open_.append((k, gaps[k]))
    return out


def _paired(rows: DataFrame, segments: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Leftover documents and gaps with the number of their pair, NULL without one."""
    cuts = np.array(segments, dtype=np.int64).reshape(-1, 5)

    def numbers(slices, ranks, at, first):
        """Segment and place in it of every row; -1 where it has none."""
        order = np.lexsort((first, at))
        low = (at << 40) + first
        k = np.searchsorted(low[order], (slices << 40) + ranks, side="right") - 1
        seg = order[np.maximum(k, 0)]
        place = ranks - first[seg]
        return np.where((k >= 0) & (at[seg] == slices) & (place < cuts[seg, 4]), seg, -1), place

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            slices, ranks = part.column("slice").to_numpy(), part.column("rank").to_numpy()
            doc = part.column("what").to_numpy() == DOC
            if cuts.size:
                a, p = numbers(slices, ranks, cuts[:, 0], cuts[:, 1])
                b, q = numbers(slices, ranks, cuts[:, 2], cuts[:, 3])
                # the first document of a segment is the largest, its gap the last of the segment
                seg, place = np.where(doc, a, b), np.where(doc, p, cuts[np.maximum(b, 0), 4] - 1 - q)
            else:
                seg, place = np.full(doc.size, -1), np.zeros(doc.size, dtype=np.int64)
            pair = pa.array(np.where(seg < 0, 0, (seg << 32) + place), pa.int64(), mask=seg < 0)
            yield pa.RecordBatch.from_arrays([*part.columns, pair], names=[*part.schema.names, "pair"])

    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, T.StructField("pair", T.LongType())]))


def _round(events: DataFrame, slices: int, capacity: int) -> DataFrame:
    """One round over documents and gaps: a written table of placed documents, documents and gaps."""
    order = [F.col("size").desc(), F.col("what").desc(), F.col("id")]
    swept = settle(_swept(events.repartitionByRange(slices, *order).sortWithinPartitions(*order), capacity, False))
    open_ = swept.where(F.col("what").isin(DOC, GAP))
    counts = {DOC: {}, GAP: {}}
    for row in open_.groupBy("slice", "what").count().collect():  # two numbers per range
        counts[row["what"]][row["slice"]] = row["count"]
    paired = settle(_paired(open_, rank_segments(counts[DOC], counts[GAP])))
    docs = paired.where((F.col("what") == DOC) & F.col("pair").isNotNull()).select("pair", "id", F.col("size").alias("taken"))
    gaps = paired.where((F.col("what") == GAP) & F.col("pair").isNotNull()).select("pair", "bin", "size")
    met = docs.join(gaps, "pair")
    none = F.lit(None).cast("long")
    columns = ["what", "id", "bin", "size", "offset"]
    return settle(
        swept.where(F.col("what") == PLACED).select(*columns)
        .unionByName(paired.where(F.col("pair").isNull()).select(*columns))
        .unionByName(swept.where(F.col("what") == SPENT).withColumn("what", F.lit(GAP)).select(*columns))
        .unionByName(met.select(F.lit(PLACED).alias("what"), "id", "bin", F.col("taken").alias("size"), (capacity - F.col("size")).alias("offset")))
        .unionByName(
            met.where("size > taken").select(F.lit(GAP).alias("what"), none.alias("id"), "bin", (F.col("size") - F.col("taken")).alias("size"), none.alias("offset"))
        )
    )


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``key``, sequence_id and offset of every row of (key, size): as few sequences of ``capacity`` as best fit finds.

    Keys are distinct and not NULL, sizes 1 to ``capacity``.  A sequence has the key of the
    row at its start.  An empty table gives none.  Equal sizes are told apart by their keys.
    """
    spark = sizes.sparkSession
    sizes = sizes.select("key", F.col("size").cast("long").alias("size"))
    alone = sizes.where(F.col("size") == capacity)
    found = [alone.select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    none = F.lit(None).cast("long")
    table = settle(
        sizes.where(F.col("size") < capacity)
        .select(F.lit(DOC).alias("what"), F.col("key").alias("id"), none.alias("bin"), "size", none.alias("offset"))
    )
    while True:
        # a number per size and kind
        counted = {(r["what"], r["size"]): r["count"] for r in table.where(F.col("what") != PLACED).groupBy("what", "size").count().collect()}
        by_size = {s: n for (what, s), n in counted.items() if what == DOC}
        n_docs = sum(by_size.values())
        if not n_docs:
            break
        least = min(by_size)
        n_gaps = sum(n for (what, s), n in counted.items() if what == GAP and s >= least)
        docs = table.where(F.col("what") == DOC)
        gaps = table.where((F.col("what") == GAP) & (F.col("size") >= least))
        events = docs.select("what", "size", "id").unionByName(gaps.select("what", "size", F.col("bin").alias("id")))
        if n_docs + n_gaps <= SLICE_ROWS:  # one range is left: it opens sequences as it goes
            last = events.repartition(1).sortWithinPartitions(F.col("size").desc(), F.col("what").desc(), "id")
            table = settle(_swept(last, capacity, True))
            found.append(_placements(table))
            break
        if n_gaps:
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            slices = min(-(-(n_docs + n_gaps) // SLICE_ROWS), max(tasks, -(-(n_docs + n_gaps) // SLICE_MOST)))
            table = _round(events, slices, capacity)
            found.append(_placements(table))
            continue
        # nothing fits anywhere: open as many sequences as are surely needed, with the largest documents
        needed = max(sum(n for s, n in by_size.items() if 2 * s > capacity), -(-sum(s * n for s, n in by_size.items()) // capacity))
        cut, share = 0, 1.0
        for s in sorted(by_size, reverse=True):
            if needed <= by_size[s]:
                cut, share = s, needed / by_size[s]
                break
            needed -= by_size[s]
        drawn = F.pmod(F.xxhash64("id", F.lit(len(found))), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))
        opens = (F.col("size") > cut) | ((F.col("size") == cut) & drawn)
        first = docs.where(opens)
        found.append(first.select(F.col("id").alias("key"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
        table = docs.where(~opens).unionByName(
            first.select(F.lit(GAP).alias("what"), none.alias("id"), F.col("id").alias("bin"), (capacity - F.col("size")).alias("size"), "offset")
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _placements(table: DataFrame) -> DataFrame:
    return table.where(F.col("what") == PLACED).select(F.col("id").alias("key"), F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, keep: Sequence[str], end: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``token_pieces`` of all documents with sequence_id and offset."""
    pieces = token_pieces(docs, path, pattern, keep, end, capacity, with_ids=with_ids)
    return pieces.join(pack(pieces.select("key", F.col("length").alias("size")), capacity), "key")
