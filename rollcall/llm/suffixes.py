"""Substring dedup with longest-previous-factor arrays over suffix order.

A text of ``length`` bytes that occurs twice has the same anchor in both places: the
leftmost smallest hash of its 32-byte grams.  So the starts of a document fall into runs
that share an anchor, and only runs with equal anchor grams can hold equal strings.  Runs
whose gram occurs once are done; of equal runs one stands for all.  What is left is put
into suffix order group by group; the previous and next smaller positions in that order
give each start its earlier match, without a limit on how often a string occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import mix64, prefix_hash, range_hash, utf8_blocks
from rollcall.session import settle

GRAM = 32
#: what names a row, and puts rows in order: id as a number, digest of the text, number of the row
_OWN = ["doc", "part", "key"]
#: different runs around one gram that one task puts into suffix order; larger groups are counted by hashes
GROUP_RUNS = 4_000
#: bytes that are put into suffix order together
ORDER_BYTES = 1_500_000

_U = np.uint64
_POSITION = np.uint64((1 << 31) - 1)


def anchor_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor, for all rows of a block.

    Arrays: row, gram and full (hashes of the anchor's gram and of all bytes the run's strings cover), and lo, hi (first and
    last start, relative to the block).  Rows shorter than ``length`` have none.
    """
    none = np.zeros(0, dtype=np.int64)
    starts_of = np.maximum(np.diff(bounds) - length + 1, 0)
    if not starts_of.sum():
        return {"row": none, "gram": none, "full": none, "lo": none, "hi": none}
    prefix = prefix_hash(data)
    at = np.arange(data.size - GRAM + 1)
    grams = range_hash(prefix, at, at + GRAM)
    window = length - GRAM + 1
    packed = ((grams >> _U(31)) << _U(31)) | at.astype(_U)
    pad = -packed.size % window
    table = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, dtype=_U)]).reshape(-1, window)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    row = np.repeat(np.arange(starts_of.size), starts_of)
    start = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(starts_of)[:-1]]), starts_of) + np.arange(row.size)
    anchor = (np.minimum(ahead[start], behind[start + window - 1]) & _POSITION).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    tail = np.concatenate([head[1:], [row.size]]) - 1
    lo, hi, anchor = start[head], start[tail], anchor[head]
    full = mix64(range_hash(prefix, lo, hi + length) ^ mix64(((anchor - lo) * 4096 + (hi - lo)).astype(_U)))
    return {"row": row[head], "gram": grams[anchor].astype(np.int64), "full": full.astype(np.int64), "lo": lo, "hi": hi}


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1."""
    near = np.arange(values.size) - 1
    live = np.flatnonzero(near >= 0)
    while live.size:
        live = live[values[near[live]] >= values[live]]
        near[live] = near[near[live]]
        live = live[near[live] >= 0]
    return near


def ranks_of(data: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place among all such strings, -1 where ``room`` is less.

    Prefix doubling: ranks of 8 bytes make ranks of 16, and so on; the last step joins two
    overlapping halves.
    """
    n, size = data.size, min(8, length)
    ranks = np.full(n, -1, dtype=np.int32)
    at = np.flatnonzero(room >= size)
    value = np.zeros(at.size, dtype=_U)
    for i in range(size):
        value = (value << _U(8)) | data[at + i].astype(_U)
    if at.size:
        ranks[at] = np.unique(value, return_inverse=True)[1]
    while size < length:
        step = min(size, length - size)
        size += step
        at = np.flatnonzero(room >= size)
        both = ranks[at].astype(np.int64)
        both <<= 32
        both |= ranks[at + step]
        ranks = np.full(n, -1, dtype=np.int32)
        if at.size:
            ranks[at] = np.unique(both, return_inverse=True)[1]
    return ranks


def repeated_starts(pieces: Sequence[bytes], places: Sequence[tuple[int, int]], length: int, first: bool) -> list[np.ndarray]:
    """Starts (relative to each piece) whose ``length`` bytes have another, or an earlier, match.

    ``places`` order the pieces as (document, position).  The starts are put into suffix
    order; the previous and next smaller place there are the only candidates for the
    longest match that begins earlier.  With ``first`` a start counts if that longest
    previous factor has ``length`` bytes; otherwise a later match of that length counts as well.
    """
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    piece = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    ranks = ranks_of(data, (begin[piece + 1] - np.arange(data.size)).astype(np.int32), length)
    order = np.lexsort((np.array([p[1] for p in places]), np.array([p[0] for p in places])))
    turn = np.empty(sizes.size, dtype=np.int64)
    turn[order] = np.arange(sizes.size)
    start = np.flatnonzero(ranks >= 0)
    when = turn[piece[start]] * (int(sizes.max(initial=0)) + 1) + (start - begin[piece[start]])
    array = np.lexsort((when, ranks[start]))  # suffix order, up to ``length`` bytes
    value, rank = when[array], ranks[start][array]
    when = ranks = piece = None  # places and ranks in suffix order are all that is still looked at

    def matched(values: np.ndarray) -> np.ndarray:
        before = _smaller_before(values)
        after = values.size - 1 - _smaller_before(values[::-1])[::-1]
        hit = (before >= 0) & (rank[np.maximum(before, 0)] == rank)
        return hit | ((after < values.size) & (rank[np.minimum(after, values.size - 1)] == rank))

    hit = matched(value) if value.size else np.zeros(0, dtype=bool)
    if not first and value.size:
        hit |= matched(-value)
    found = np.sort(start[array[hit]])
    cut = np.searchsorted(found, begin)
    return [found[a:b] - begin[i] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not starts.size:
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.concatenate([gap, [starts.size - 1]])].tolist(), strict=True))


_VERDICT = "gram bigint, full bigint, a int, b int"


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [part.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            for row, bounds, data in utf8_blocks(part.column(3), 1_000_000):
                r = anchor_runs(data, bounds, length)
                base = bounds[r["row"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["gram"]), pa.array(r["full"]), *[pa.array(o[row + r["row"]], pa.int64()) for o in own],
                     pa.array((r["lo"] - base).astype(np.int32)), pa.array((r["hi"] - base).astype(np.int32))],
                    names=["gram", "full", *_OWN, "lo", "hi"],
                )

    return rows.select(*_OWN, "text").mapInArrow(work, "gram bigint, full bigint, doc bigint, part bigint, key bigint, lo int, hi int")


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs: rows (doc, part, key, text, wanted array of (gram, full, lo, hi, hot))."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "full", "hot", *_OWN, "lo", "piece"]
        for part in parts:
            out: dict[str, list] = {n: [] for n in names}
            size = 0
            slices = (part.slice(at, 128) for at in range(0, part.num_rows, 128))
            for *own, text, wanted in (r for p in slices for r in zip(*[c.to_pylist() for c in p.columns], strict=True)):
                raw = (text or "").encode()
                for w in wanted:
                    for n in ("gram", "full", "hot", "lo"):
                        out[n].append(w[n])
                    for n, o in zip(_OWN, own, strict=True):
                        out[n].append(o)
                    out["piece"].append(raw[w["lo"] : w["hi"] + length])
                    size += w["hi"] + length - w["lo"]
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out, size = {n: [] for n in names}, 0
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("gram", pa.int64()), ("full", pa.int64()), ("hot", pa.bool_()), *[(n, pa.int64()) for n in _OWN], ("lo", pa.int32()), ("piece", pa.binary())])
    return rows.mapInArrow(work, "gram bigint, full bigint, hot boolean, doc bigint, part bigint, key bigint, lo int, piece binary")


def _order_groups(pieces: DataFrame, length: int, first: bool) -> DataFrame:
    """Verdicts on the runs of groups that fit a task: whole groups are put into suffix order together."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            once = {(g, f): (own, lo, p) for g, f, *own, lo, p in reversed(held)}
            keys, values = list(once), list(once.values())
            turn = {own: i for i, own in enumerate(sorted({tuple(v[0]) for v in values}))}
            hits = repeated_starts([v[2] for v in values], [(turn[tuple(v[0])], v[1]) for v in values], length, first) if keys else []
            out = [(*k, a, b) for k, h in zip(keys, hits, strict=True) for a, b in _runs(h)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "full", "a", "b"])

        for part in parts:
            for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if row[0] != last and size > ORDER_BYTES:
                    yield flush()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[-1])
        yield flush()

    dealt = pieces.select("gram", "full", *_OWN, "lo", "piece").repartition("gram").sortWithinPartitions("gram", "full", *_OWN, "lo")
    return dealt.mapInArrow(work, _VERDICT)


def _count_starts(pieces: DataFrame, length: int, first: bool) -> DataFrame:
    """Verdicts on the runs of huge groups: the strings are counted by two hashes, a row for each start."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for gram, full, *own, lo, piece in zip(*[c.to_pylist() for c in part.columns], strict=True):
                data = np.frombuffer(piece, dtype=np.uint8)
                at = np.arange(data.size - length + 1)
                n = at.size
                one = range_hash(prefix_hash(data), at, at + length)
                two = range_hash(prefix_hash(data ^ np.uint8(0x5A)), at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), pa.array(np.full(n, gram)), pa.array(np.full(n, full)),
                     *[pa.array(np.full(n, o)) for o in own], pa.array((lo + at).astype(np.int64)), pa.array(at.astype(np.int32))],
                    names=["one", "two", "gram", "full", *_OWN, "place", "a"],
                )

    starts = settle(
        pieces.select("gram", "full", *_OWN, "lo", "piece").dropDuplicates(["gram", "full"])
        .mapInArrow(work, "one bigint, two bigint, gram bigint, full bigint, doc bigint, part bigint, key bigint, place bigint, a int")
    )
    seen = settle(starts.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_OWN, "place")).alias("lead")).where("n > 1"))
    hits = starts.join(seen, ["one", "two"])
    if first:
        hits = hits.where(F.struct(*_OWN, "place") > F.col("lead"))
    return hits.select("gram", "full", "a", F.col("a").alias("b"))


def document_order(doc_id: Column) -> Column:
    """Ids as whole numbers; rows without one come last."""
    return F.coalesce(doc_id.cast("long"), F.lit(0x7FFFFFFFFFFFFFFF))


def numbered_rows(docs: DataFrame, keep: Sequence[str], text: str, doc_id: str) -> DataFrame:
    """(row, doc, part, key, text), written once: ``key`` is different in every row, whatever ids and texts recur."""
    rows = docs.select(F.struct(*keep).alias("row"), document_order(F.col(doc_id)).alias("doc"), F.col(text).cast("string").alias("text"))
    return settle(rows.select("row", "doc", F.xxhash64("text").alias("part"), F.monotonically_increasing_id().alias("key"), "text"))


def repeated_spans(numbered: DataFrame, length: int = 400, first: bool = True, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(key, starts): for rows with repeats, the runs (from, to) of starts of repeated strings.

    ``numbered`` are rows (doc, part, key, text) of a written table.  With ``first`` a start
    counts if its ``length`` bytes also start earlier, in order of (doc, part, key,
    position); without, if they start anywhere else.  Matches never cross rows; those in
    one row and overlapping ones count.
    """
    rows = numbered.where(F.octet_length("text") >= length)
    found = settle(_anchors(rows, length))
    place = F.struct(*_OWN, "lo", "hi")
    twice = settle(
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("full") == F.max("full")).alias("alike"), F.min(place).alias("lead"))
        .where("n > 1").drop("n")
    )
    again = settle(found.join(twice, "gram"))
    # a gram with one neighbourhood only: all its runs are equal, nothing is left to compare
    alike = again.where("alike")
    alike = (alike.where(place > F.col("lead")) if first else alike).select("key", F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("starts"))
    runs = again.where(~F.col("alike")).drop("alike", "lead")
    # equal runs of neighbouring rows go on as one row: at most 256 rows and 4,096 starts in each
    slices = settle(
        runs.groupBy("gram", "full", F.shiftright("key", 8).alias("near"), F.shiftright("lo", 12).alias("reach"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("lead"), F.collect_list(F.struct("key", "lo", "hi")).alias("places"))
    )
    kinds = settle(slices.groupBy("gram", "full").agg(F.sum("n").alias("n"), F.min("lead").alias("lead")))
    # groups in which different runs meet, and something is left to decide
    groups = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1")
    if not first:
        groups = groups.where("least = 1")
    groups = settle(groups.select("gram", (F.col("kinds") > group_runs).alias("hot")))
    wanted = (
        kinds.join(groups, "gram")
        .groupBy(F.col("lead.key").alias("key"))
        .agg(F.collect_list(F.struct("gram", "full", F.col("lead.lo").alias("lo"), F.col("lead.hi").alias("hi"), "hot")).alias("wanted"))
    )
    texts = rows.join(wanted.hint("shuffle_hash"), "key").select(*_OWN, "text", "wanted")
    pieces = settle(_contexts(texts, length))
    verdicts = _order_groups(pieces.where(~F.col("hot")), length, first).unionByName(_count_starts(pieces.where("hot"), length, first))
    verdicts = settle(verdicts).groupBy("gram", "full").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    # the order decides on the run that stands for its kind; its copies have an earlier, or another, match by themselves
    leads = (kinds if first else kinds.where("n = 1")).join(verdicts, ["gram", "full"]).select(
        F.col("lead.key").alias("key"),
        F.transform("parts", lambda p: F.struct((F.col("lead.lo") + p["a"]).alias("a"), (F.col("lead.lo") + p["b"]).alias("b"))).alias("starts"),
    )
    copied = slices.select("gram", "full", "near", "places").join(kinds.where("n > 1").select("gram", "full", "lead"), ["gram", "full"])
    if first:
        copied = copied.withColumn("places", F.filter("places", lambda p: (p["key"] != F.col("lead.key")) | (p["lo"] != F.col("lead.lo"))))
    copies = _by_row(copied.groupBy("near").agg(F.flatten(F.collect_list("places")).alias("places")))
    found = leads.unionByName(copies).unionByName(alike)
    return found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _by_row(blocks: DataFrame) -> DataFrame:
    """(key, starts) of neighbouring rows, one row per key, from the places of equal runs in blocks of rows."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            key, a, b = (f.to_numpy() for f in part.column(0).flatten().flatten())
            order = np.argsort(key, kind="stable")
            key = key[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, dtype=np.int64)
            runs = pa.StructArray.from_arrays([pa.array(a[order]), pa.array(b[order])], names=["a", "b"])
            starts = pa.ListArray.from_arrays(pa.array(np.concatenate([head, [key.size]]).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([pa.array(key[head]), starts], names=["key", "starts"])

    return blocks.select("places").mapInArrow(work, "key bigint, starts array<struct<a:int,b:int>>")


def _covered(starts: list[dict] | None, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal byte spans that the strings from ``starts`` cover."""
    spans: list[list[int]] = []
    for a, b in sorted((s["a"], min(s["b"] + length, size)) for s in starts or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        elif a < b:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def remove_repeats(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", length: int = 400, first: bool = True, group_runs: int = GROUP_RUNS
) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    ``row`` is the struct of the ``keep`` columns.  The figures are about the UTF-8 bytes;
    ``kept`` is the remaining text, in which a character that a removed span covers only in
    part stays whole.  NULL and empty texts have 0 bytes and keep an empty text.  Every row
    is a document of its own: those that repeat an id follow each other in the order of
    digests of their texts, those without an id come last in the same order.
    """
    rows = numbered_rows(docs, keep, text, doc_id)
    spans = repeated_spans(rows, length, first, group_runs)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                out: list[tuple] = []
                for text_, starts in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    raw = (text_ or "").encode()
                    cut = _covered(starts, length, len(raw))
                    exact, soft, done, soft_done = [], [], 0, 0
                    for a, b in cut:
                        exact.append(raw[done:a])
                        done = b
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        soft.append(raw[soft_done:a])
                        soft_done = b
                    exact.append(raw[done:])
                    soft.append(raw[soft_done:])
                    sha = hashlib.sha256(b"".join(exact)).hexdigest()
                    out.append((len(raw), sum(b - a for a, b in cut), len(cut), sha, b"".join(soft).decode()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    joined = rows.join(spans.hint("shuffle_hash"), "key", "left").select("row", "text", "starts")
    long, string = T.LongType(), T.StringType()
    fields = [("n_bytes", long), ("n_removed", long), ("n_spans", long), ("kept_sha256", string), ("kept", string)]
    return joined.mapInArrow(work, T.StructType([joined.schema["row"], *[T.StructField(n, k) for n, k in fields]]))
