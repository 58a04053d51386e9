"""Embedding near-dedup: exact threshold pairs by a dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import components
from rollcall.llm.vectors import matrices
from rollcall.operators.grouped import lookup_join
from rollcall.session import settle, settle_counted

#: most pivots of all labels together; they are sent to every task, and labels for which fewer than two are left have none
PIVOTS = 4_096
#: distinct vectors for each pivot, as far as pivots go, and rows of one side of a cell
PIVOT_ROWS, CELL_ROWS = 1_024, 2_048
#: pairs below which two nodes are compared point by point, and room for rounding
_DIRECT, _ROOM = 4_096, 1e-9


class CoverTree:
    """Nested levels with halving radii over unit vectors.

    A node's children are points of the node, more than its child radius apart, that
    cover it; the node's own centre is one of them.  ``radius`` is the true distance to the
    farthest point below.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.rows, self.kids = [], [], [], []
        todo = [(np.arange(len(points)), 0, 2.0, -1)] if len(points) else []
        while todo:
            rows, centre, cover, parent = todo.pop()
            far = self._from(centre, rows)
            node, reach = len(self.centre), float(far.max())
            self.centre.append(centre)
            self.radius.append(reach)
            self.rows.append(rows)
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if rows.size <= 16 or reach <= 1e-7:
                continue
            while cover / 2 >= reach:  # levels that would hold this one child only
                cover /= 2
            cover /= 2
            left, heart = rows, centre
            while left.size:
                near = self._from(heart, left) <= cover
                todo.append((left[near], heart, cover, node))
                left = left[~near]
                heart = int(left[0]) if left.size else -1

    def _from(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.points[rows] @ self.points[centre]))) if rows.size > 1 or rows[0] != centre else np.zeros(1)


def linked_pairs(left: CoverTree, right: CoverTree, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of row pairs whose cosine may be ``least`` or more; all others are pruned.

    Node pairs go down together: centres farther apart than the threshold distance plus both
    covering radii cannot hold a pair.
    """
    if not left.centre or not right.centre:
        return
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least))) + _ROOM
    todo = [(0, 0)]
    lp, rp = left.points, right.points
    lc, rc = np.array(left.centre), np.array(right.centre)
    lr, rr = np.array(left.radius), np.array(right.radius)
    while todo:
        a, b = todo.pop()
        ka, kb = left.kids[a], right.kids[b]
        if left.rows[a].size * right.rows[b].size <= _DIRECT or not (ka or kb):
            rows, cols = left.rows[a], right.rows[b]
            for at in range(0, rows.size, 1024):
                i, j = np.nonzero(lp[rows[at : at + 1024]] @ rp[cols].T >= least - _ROOM)
                if i.size:
                    yield rows[at + i], cols[j]
            continue
        us = np.array(ka if ka and (not kb or lr[a] >= rr[b] / 2) else [a])
        vs = np.array(kb if kb and (not ka or rr[b] >= lr[a] / 2) else [b])
        for at in range(0, us.size, 512):
            some = us[at : at + 512]
            apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (lp[lc[some]] @ rp[rc[vs]].T)))
            i, j = np.nonzero(apart <= reach + lr[some][:, None] + rr[vs][None, :])
            todo += zip(some[i].tolist(), vs[j].tolist(), strict=True)


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; scaled first, so that no square over- or underflows."""
    top = np.abs(matrix).max(axis=1, initial=0.0)
    scaled = matrix / np.where(top > 0, top, 1.0)[:, None]
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / np.where(norm > 0, norm, 1.0)[:, None], norm


def _usable(vectors: DataFrame) -> DataFrame:
    """(label, key, id, size, unit) of vectors that can link: labelled, finite and not zero."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, matrix in matrices(part.column(2)):
                unit, norm = _unit(matrix)
                good = norm > 0
                unit = unit[good]
                lists = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, max(1, unit.shape[1]), dtype=np.int32), pa.array(unit.ravel())) if unit.size else pa.array([], pa.list_(pa.float64()))
                at = pa.array(rows[good])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), lists], names=["label", "key", "unit"])

    rows = vectors.where("label IS NOT NULL AND v IS NOT NULL").select("label", "key", "v")
    return rows.mapInArrow(work, "label string, key string, unit array<double>")


def _nearest(classes: DataFrame, pivots: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """Every class with its home pivot and its distances to all pivots of its label."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            labels = np.array(part.column(1).to_pylist(), dtype=object)
            home, far = np.zeros(part.num_rows, dtype=np.int32), [None] * part.num_rows
            for rows, matrix in matrices(part.column(3)):
                for label in set(labels[rows].tolist()):
                    at = rows[labels[rows] == label]
                    centres = pivots.get((label, matrix.shape[1]))
                    if centres is None:  # a label of one cell
                        for row in at.tolist():
                            far[row] = [0.0]
                        continue
                    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (matrix[labels[rows] == label] @ centres.T)))
                    home[at] = apart.argmin(axis=1)
                    for i, row in enumerate(at.tolist()):
                        far[row] = apart[i]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(far, pa.list_(pa.float64()))], names=[*part.schema.names, "home", "far"])

    return classes.mapInArrow(work, "node bigint, label string, n bigint, unit array<double>, home int, far array<double>")


def _compare_cells(cells: DataFrame, least: float) -> DataFrame:
    """(node, links, other): links of home classes, and edges that connect what is linked in a cell."""

    def work(cell: pa.Table) -> pa.Table:
        column = cell.column("unit").combine_chunks()
        mine = cell.column("mine").to_numpy(zero_copy_only=False)
        nodes, n = cell.column("node").to_numpy(), cell.column("n").to_numpy()
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        names, local = np.unique(nodes, return_inverse=True)
        root = np.arange(names.size)  # of the links seen so far

        for rows, matrix in matrices(column):
            own = mine[rows]
            a, b = rows[own], rows[~own]
            if not a.size or not b.size:
                continue
            left, right = matrix[own], matrix[~own]
            total = np.zeros(a.size, dtype=np.int64)
            for i, j in linked_pairs(CoverTree(left), CoverTree(right), least):
                other = nodes[a[i]] != nodes[b[j]]
                i, j = i[other], j[other]
                exact = (left[i] * right[j]).sum(axis=1) >= least
                i, j = i[exact], j[exact]
                np.add.at(total, i, n[b[j]])
                # an edge from each point to every part that it is not connected with yet
                xs, ys = local[a[i]], local[b[j]]
                apart = root[xs] != root[ys]
                xs, ys = xs[apart], ys[apart]
                heads = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]])) if xs.size else []
                for lo, hi in zip(heads, [*heads[1:], xs.size]):
                    x, near = xs[lo], ys[lo:hi]
                    parts, at = np.unique(root[near], return_index=True)
                    new = parts != root[x]
                    if new.any():
                        edges += [(int(names[x]), int(names[y])) for y in near[at[new]]]
                        root[np.isin(root, parts)] = root[x]
            links.update(zip(nodes[a].tolist(), total.tolist(), strict=True))
        found = [(x, c, None) for x, c in links.items() if c] + [(x, 0, y) for x, y in edges]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "other"])

    return cells.groupBy("label", "home", "i", "j").applyInArrow(work, "node bigint, links bigint, other bigint")


def embedding_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, cell_rows: int = CELL_ROWS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Two vectors link if their labels are equal and not NULL and their cosine, in doubles, is
    ``least`` or more.  Vectors that are NULL, zero, empty, or hold NULL or non-finite
    components link with nothing; vectors of different length do not link.  Equal vectors are
    one class in the search, and their links are counted from its size; rows that repeat an
    id count as vectors of their own.  ``component_id`` is the smallest id of a component,
    NULL only if none of its rows has one.

    Classes go to the nearest pivot of their label, the top of the cover tree, and also to
    every other pivot whose ball comes within the threshold; a cell compares the home classes
    of a pivot with all that came.  Large cells are cut into blocks.  Only counts and the
    edges that connect a cell leave it.
    """
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v")
    ).withColumn("key", F.md5(F.col("v").cast("string")))
    classes, n = settle_counted(
        _usable(rows).groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")).withColumn("node", F.monotonically_increasing_id())
    )
    # pivots: a bounded sample, more for larger labels; in sum not more than PIVOTS
    groups, n_groups = settle_counted(classes.groupBy("label", F.size("unit").alias("dim")).agg(F.count(F.lit(1)).alias("size")))
    share = F.least(F.ceil(F.col("size") / pivot_rows), F.floor(F.col("size") * F.lit(PIVOTS / max(1, n)))).cast("int")
    slots = groups.select("label", "dim", share.alias("pivots")).where("pivots >= 2")
    sample = (
        classes.withColumn("dim", F.size("unit")).join(F.broadcast(slots), ["label", "dim"])
        .groupBy("label", "dim", F.pmod(F.xxhash64("node"), F.col("pivots")).cast("int").alias("slot"))
        .agg(F.min_by("unit", F.struct(F.xxhash64("node", F.lit(1)), "node")).alias("unit"))
    )
    pivots: dict[tuple[str, int], list] = {}
    for row in sample.orderBy("label", "dim", "slot").limit(PIVOTS).collect():
        pivots.setdefault((row["label"], row["dim"]), []).append(row["unit"])
    placed = settle(_nearest(classes.select("node", "label", "n", "unit"), {k: np.array(v) for k, v in pivots.items()}))
    # balls of the pivots, as many as there are pivots
    balls = (
        placed.withColumn("dim", F.size("unit")).join(F.broadcast(slots), ["label", "dim"])
        .groupBy("label", "dim", "home").agg(F.max(F.element_at("far", F.col("home") + 1)).alias("radius"))
    )
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least))) + _ROOM
    by_label = settle(balls.groupBy("label", "dim").agg(F.map_from_entries(F.collect_list(F.struct("home", "radius"))).alias("balls")))
    spread = placed.withColumn("dim", F.size("unit")).join(F.broadcast(by_label), ["label", "dim"], "left").withColumn("slot", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)))
    near = F.filter(F.map_keys("balls"), lambda q: F.element_at("far", q + 1) <= F.element_at("balls", q) + F.lit(reach + _ROOM))
    visits = F.coalesce(near, F.array(F.lit(0)))
    came = spread.select("label", "dim", "node", "n", "unit", "slot", F.col("home").alias("own_home"), F.explode(visits).alias("home"))
    sizes = (came.groupBy("label", "dim", "home").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("own_home") == F.col("home")).cast("int")).alias("own")))
    came = lookup_join(came, sizes, ["label", "dim", "home"], "inner", n_groups + PIVOTS)
    cuts = F.ceil(F.col("own") / cell_rows).cast("int")
    blocks = F.ceil(F.col("all") / cell_rows).cast("int")
    block = F.pmod("slot", blocks).cast("int")
    visiting = came.select("label", "home", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("i"), block.alias("j"), F.lit(False).alias("mine"), "node", "n", "unit")
    owning = came.where("own_home = home").select("label", "home", F.pmod("slot", cuts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(True).alias("mine"), "node", "n", "unit")
    found = settle(_compare_cells(owning.unionByName(visiting), least))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = settle(
        classes.select("node", "label", "key", "n").join(counts, "node", "left").join(roots, "node", "left")
        .select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    mine = rows.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    mine = settle(mine.select("vec_id", "links", "root"))
    lowest = settle(mine.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("low")))
    linked = mine.where("root IS NOT NULL").join(lowest, "root").select("vec_id", F.col("links").alias("n_links"), F.col("low").alias("component_id"))
    alone = mine.where("root IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""
