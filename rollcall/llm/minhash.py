"""Near-duplicate documents by DartMinHash signatures and a banded join.

Every element of a weighted set owns a region of the plane (weight times rank) into
which darts have been thrown, the same ones in every set.  The darts that hit the set
below some rank are few and do not grow with the set; each belongs to one coordinate of
the signature, and the earliest dart of each coordinate is kept.  Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import components, mix64, shingle_hashes, utf8_blocks, word_hashes
from rollcall.session import settle

#: bands and rows of a band: at a similarity of 0.8 a pair shares no band once in 16,000 times
BANDS, ROWS = 32, 6
#: members of one task in a comparison with a centre, and documents of one block in a bucket
STAR_ROWS, BLOCK_ROWS = 100, 96

_U = np.uint64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def weighted_shingles(data: np.ndarray, bounds: np.ndarray, width: int, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row of a block: hashes in order, weights, first of each row.

    A weight is 1, or with ``counts`` how often the row has the shingle.
    """
    hashes, first = shingle_hashes(*word_hashes(data, bounds), width)
    sets, weights = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if counts:
            s, w = np.unique(hashes[a:b], return_counts=True)
            weights.append(w)
        else:
            s = np.unique(hashes[a:b])
        sets.append(s)
    out = np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    return flat, (np.concatenate(weights).astype(np.float64) if counts and weights else np.ones(flat.size)), out


def dart_signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) signatures of weighted sets; a row without elements is all ones.

    Darts of an element form a Poisson process: along the rank they arrive after
    exponential gaps, drawn from a hash of element, weight region and number, at a rate of
    the region's height.  Regions are [0, 1), [1, 2), [2, 4) and so on; a dart counts if
    its height is below the weight.  The rank limit is set so that k coordinates are
    filled by about k ln k + 2k darts; rows with a gap are done again with a doubled limit.
    """
    n = first.size - 1
    best = np.full(n * k, _EMPTY, dtype=_U)
    mass = np.concatenate([[0.0], np.cumsum(weights)])
    mass = mass[first[1:]] - mass[first[:-1]]
    todo = np.flatnonzero(mass > 0)
    reach = k * np.log(k) + 2 * k
    while todo.size:
        sizes = first[todo + 1] - first[todo]
        at = np.repeat(first[todo] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        rows, limit = np.repeat(todo, sizes), np.repeat(reach / mass[todo], sizes)
        best.reshape(n, k)[todo] = _EMPTY
        top = float(weights[at].max())
        low, region = 0.0, 0
        while low < top:
            height = 1.0 if region == 0 else low
            live = np.flatnonzero(weights[at] > low)
            element, weight, row, end = elements[at[live]], weights[at[live]], rows[live], limit[live]
            rank = np.zeros(live.size)
            number = 0
            while element.size:
                draw = mix64(element ^ _U((0xA24BAED4963EE407 * (number + 1) + 0x9FB21C651E98DF25 * region) & 0xFFFFFFFFFFFFFFFF))
                rank = rank - np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / height
                stay = rank <= end
                element, weight, row, end, rank, draw = element[stay], weight[stay], row[stay], end[stay], rank[stay], draw[stay]
                other = mix64(draw ^ _U(0x2545F4914F6CDD1D))
                hit = slice(None)
                if top > 1.0 or low > 0 or weight.size and weight.min() < 1.0:
                    hit = low + (other >> _U(40)).astype(np.float64) * 2.0**-24 * height < weight
                place = row[hit] * k + ((other[hit] & _U(0xFFFFFFFF)) * _U(k) >> _U(32)).astype(np.int64)
                # a rank as bits of a positive float sorts like the rank; the low half names the dart
                packed = (rank[hit].astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (mix64(other[hit]) & _U(0xFFFFFFFF))
                np.minimum.at(best, place, packed)
                number += 1
            low, region = height * (1 if region == 0 else 2), region + 1
        todo = todo[(best.reshape(n, k)[todo] == _EMPTY).any(axis=1)]
        reach *= 2
    return best.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys; sets that agree in all rows of a band share its key."""
    names = (signatures & _U(0xFFFFFFFF)).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=_U), names.shape[:2])
    for r in range(rows):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + names[:, :, r])
    return key.astype(np.int64)


def _signed(rows: DataFrame, width: int, bands: int, band_rows: int, counts: bool) -> DataFrame:
    """(key, doc_id, bands) of rows (key, doc_id, text); rows without words are left out."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, bounds, data in utf8_blocks(part.column(2), 1_000_000):
                elements, weights, first = weighted_shingles(data, bounds, width, counts)
                keys = band_keys(dart_signatures(elements, weights, first, bands * band_rows), bands, band_rows)
                full = np.flatnonzero(np.diff(first) > 0)
                piece = part.slice(row, bounds.size - 1).take(pa.array(full))
                lists = pa.ListArray.from_arrays(np.arange(0, full.size * bands + 1, bands, dtype=np.int32), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), lists], names=["key", "doc_id", "bands"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"key string, doc_id {kind}, bands array<bigint>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (sorted hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not both.size:
        return 0.0
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def _sets(texts: pa.Array, width: int, counts: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _, bounds, data in utf8_blocks(texts, 1_000_000):
        elements, weights, first = weighted_shingles(data, bounds, width, counts)
        out += [(elements[a:b], weights[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _check_stars(rows: DataFrame, width: int, counts: bool, least: float) -> DataFrame:
    """Links (a, b) from rows (centre, cut, member, node, text), one centre and its members per group.

    Rows arrive sorted with the centre first, so a task holds one set and streams the
    others past it.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for part in parts:
            sets = _sets(part.column("text"), width, counts)
            a, b = [], []
            ids = zip(part.column("centre").to_pylist(), part.column("cut").to_pylist(), part.column("member").to_pylist(), part.column("node").to_pylist(), sets, strict=True)
            for centre, cut, member, node, s in ids:
                if not member:
                    held, of = s, (centre, cut)
                elif of == (centre, cut) and similarity(held, s) >= least:
                    a.append(centre)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("centre", "cut").sortWithinPartitions("centre", "cut", "member")
    return dealt.mapInArrow(work, "a bigint, b bigint")


def _check_blocks(rows: DataFrame, width: int, counts: bool, least: float) -> DataFrame:
    """Links from rows (bucket, i, j, left, rest, node, root, text): in each cell (bucket, i, j) the left rows are
    compared with the others.  Two members of the rest meet on either side; one of the two is passed over."""

    def work(cell: pa.Table) -> pa.Table:
        sets = _sets(cell.column("text"), width, counts)
        nodes, left, rest = (cell.column(n).to_pylist() for n in ("node", "left", "rest"))
        root = dict(zip(nodes, cell.column("root").to_pylist(), strict=True))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        size = [float(s[1].sum()) for s in sets]
        a, b = [], []
        ours, others = [p for p, x in enumerate(left) if x], [q for q, x in enumerate(left) if not x]
        for p in ours:
            for q in others:
                if rest[q] and nodes[q] <= nodes[p]:
                    continue
                if min(size[p], size[q]) < least * max(size[p], size[q]):
                    continue
                u, v = find(root[nodes[p]]), find(root[nodes[q]])
                if u != v and similarity(sets[p], sets[q]) >= least:
                    up[u] = v
                    a.append(nodes[p])
                    b.append(nodes[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(work, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = 5,
    least: float = 0.8,
    bands: int = BANDS,
    band_rows: int = ROWS,
    counts: bool = False,
) -> DataFrame:
    """(key, class_id, copies): the class of every distinct text that has words.

    ``key`` is the md5 of the text, ``class_id`` the smallest id of all documents of its
    class, ``copies`` the rows with this very text.  Documents are linked if the (weighted)
    Jaccard similarity of their sets of ``width``-word shingles is ``least`` or more; a
    class is everything that links reach.  Words are split at ASCII white space; a text of
    fewer words is one shingle.  NULL texts, empty ones and such without words have no row:
    each is a class of its own.  NULL ids are not looked at for ``class_id``.

    Equal texts are put together first.  In every bucket of every band each text is
    compared with one centre, the text with the most copies.  Where members of a bucket
    are still in different classes, those outside its largest class are compared with all
    others in blocks, until each pair of classes is decided; only links leave a task.  So
    all pairs that share a band are settled, however many share it, and no group is gathered.
    """
    rows = docs.select(F.md5(F.col(text).cast("string")).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.where("text IS NOT NULL")
    reps = settle(
        _signed(rows, width, bands, band_rows, counts)
        .groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    narrow = reps.select("node", "copies", F.explode("bands").alias("band"))
    rank = F.struct((-F.col("copies")).alias("fewer"), F.col("node").alias("node"))
    buckets = settle(
        narrow.groupBy("band").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first.node <> last.node")
        .select("band", F.col("first.node").alias("centre"))
    )
    members = settle(narrow.join(buckets, "band").where("node <> centre").select("band", "centre", "node"))
    pairs = settle(members.select("centre", "node").distinct())
    # small sides of joins on hot keys are written first: Spark splits a hot key only between two plain shuffles
    cuts = settle(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("cuts")))
    of_members = pairs.join(cuts, "centre").select(
        "centre", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("cut"), F.lit(True).alias("member"), "node"
    )
    of_centres = cuts.select("centre", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(False).alias("member"), F.col("centre").alias("node"))
    links = settle(_check_stars(_with_text(of_members.unionByName(of_centres), reps, rows), width, counts, least))

    # members of a bucket that the centre did not bring together
    roots = components(links)
    named = settle(members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    by_root = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("of"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    open_buckets = settle(
        by_root.groupBy("band")
        .agg(F.max(F.struct("of", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("of").alias("n"), F.sum("same").alias("same"))
        .where("roots > 1").groupBy("n", "same").agg(F.min(F.struct("band", "main")).alias("one"))
        .select(
            F.col("one.band").alias("band"), F.col("one.main.root").alias("main"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"),
            F.ceil((F.col("n") - F.col("one.main.of")) / BLOCK_ROWS).cast("int").alias("rest_blocks"),
        )
    )
    # members outside the largest class meet all members: (n - largest) x blocks + n x blocks of the rest
    opened = named.join(open_buckets, "band").withColumn("rest", F.col("root") != F.col("main"))
    place = lambda blocks: F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = [F.col("band").alias("bucket"), "i", "j", "left", "rest", "node", "root"]
    dealt = settle(
        opened.where("rest").withColumns({"i": place("rest_blocks"), "left": F.lit(True)}).withColumn("j", each("blocks")).select(*columns)
        .unionByName(opened.withColumns({"j": place("blocks"), "left": F.lit(False)}).withColumn("i", each("rest_blocks")).select(*columns))
    )
    more = settle(_check_blocks(_with_text(dealt, reps, rows), width, counts, least))
    roots = components(links.unionByName(more))
    named = reps.join(roots, "node", "left").select("key", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    classes = settle(named.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    return named.join(classes, "root").select("key", "class_id", "copies")


def _with_text(wanted: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the wanted nodes, read from the row that stands for all equal texts."""
    named = wanted.join(reps.select("node", "key", F.col("doc_id").alias("_id")), "node")
    one = named.select("*").withColumn("_k", F.xxhash64("key", "_id"))
    texts = rows.select(F.xxhash64("key", "doc_id").alias("_k"), F.col("key").alias("_key"), "text")
    joined = one.hint("shuffle_hash").join(texts, (one["_k"] == texts["_k"]) & (one["key"] == texts["_key"]))
    return joined.drop("_k", "_key", "key", "_id")


def with_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(row, class_id): every row of ``docs`` as a struct with the class of its text."""
    found = near_duplicates(docs, text, doc_id, **options).select("key", "class_id", F.lit(True).alias("known"))
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.col(text).cast("string")).alias("key"), F.col(doc_id).alias("own"))
    return rows.join(found, "key", "left").select("row", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("own")).alias("class_id"))
