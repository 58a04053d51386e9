"""Bins, strata, splits, folds, samples and batches.

Every choice is a function of a seed and the row's key, so repartitioning or
rerunning gives the same answer.  Ranks come from ``grouped.positions``, which
slices groups that are too large for one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.hashing import hash_order, hash_uniform
from rollcall.functions.numbers import bounded
from rollcall.operators.grouped import attach, first_n, fits_task, group_quantiles, lookup_join, positions, running, same_keys
from rollcall.session import settle, settle_counted

SPLITS = ("train", "val", "test")
#: seeds of a sweep that go along with a row, and the byte of a seed whose label another row has
SEED_BLOCK, NO_LABEL = 24, 255
#: parts into which a sweep cuts the values of a metric
VALUE_SLICES = 32


def quantile_edges(df: DataFrame, column: str, bins: int) -> Column:
    """Distinct quantile edges as one array, a scalar subquery; NULL if there are too few values."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = group_quantiles(df, [], column, probs)
    n = df.agg(F.count(column).alias("n")).select("n").scalar()
    listed = edges.select(F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))
    found = listed.select("edges").scalar()
    return F.when((n >= max(2, bins)) & (F.size(found) >= 2), found)


def quantile_bin(c: Column, edges: Column, prefix: str, missing: str = "unknown") -> Column:
    """``<prefix>_q<i>``; the last bin is open, without edges everything is ``<prefix>_all``."""
    inner = F.slice(edges, 1, F.size(edges) - 1)
    place = F.size(F.filter(inner, lambda e: e <= c))
    return (
        F.when(c.isNull(), F.lit(missing))
        .when(edges.isNull(), F.lit(f"{prefix}_all"))
        .when(place == 0, F.lit("unknown"))
        .otherwise(F.concat(F.lit(f"{prefix}_q"), place.cast("string")))
    )


def stratum(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def _free_places(sizes: DataFrame, source: Sequence[str], ratios: Mapping[str, float], share: Mapping[str, Column], known: int) -> DataFrame:
    """(source, _rank, _s): the places that splits offer to leftovers, from strata sizes ``_n``."""
    names = list(ratios)
    totals = sizes.groupBy(*source).agg(
        F.sum("_n").alias("_total"), *[F.sum(share[s]).alias(f"_got_{s}") for s in names]
    )
    wanted = {s: F.bround(F.col("_total") * F.lit(r)) for s, r in list(ratios.items())[:-1]}
    last = F.col("_total")
    for target in wanted.values():
        last = last - target
    wanted[names[-1]] = last
    places = totals.select(
        *source,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("_o"), F.lit(s).alias("_s"), (wanted[s] - F.col(f"_got_{s}")).cast("long").alias("_d")) for i, s in enumerate(names)])
        ).alias("_p"),
    ).filter("_p._d > 0")
    places = places.select(*source, "_p._o", "_p._s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_p._d"))).alias("_level"))
    return positions(places, list(source), [F.desc("_level"), "_o"], "_rank", known).select(*source, "_rank", "_s")


def stratified_split(
    df: DataFrame, key: str, source: Sequence[str], strata: str, ratios: Mapping[str, float], seed: object, keep: Sequence[str] = ()
) -> DataFrame:
    """Split per stratum; leftovers go to the split of the source that lacks most.  ``keep`` columns ride along.

    ``source`` may hold several columns (e.g. a seed and a source).  A split
    that lacks d rows offers d places at levels d, d-1, ..., 1; leftovers in
    hash order take the places from the highest level down.
    """
    by = [*source, strata]
    rows, known = settle_counted(df.select(key, *by, *keep))
    rows = rows.withColumn("_h", hash_order(seed, *[F.col(c).cast("string") for c in (*source, key)]))
    ranked = positions(rows, by, ["_h", key], "_pos", known)
    ranked = attach(ranked, by, {"_n": F.count(F.lit(1))}, known)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    share = {s: F.floor(F.col("_n") * F.lit(r)) for s, r in ratios.items()}
    upto, label = F.lit(0), F.when(F.lit(False), F.lit(""))
    for name in ratios:
        upto = upto + share[name]
        label = label.when(F.col("_pos") <= upto, F.lit(name))
    ranked = ranked.withColumn("split", label)

    names = list(ratios)
    places = _free_places(sizes, source, ratios, share, known)
    left = positions(ranked.filter("split IS NULL").select(key, *by, *keep, "_h"), list(source), ["_h", key], "_rank", known)
    left = same_keys(left, places, [*source, "_rank"], "left")
    placed = left.select(key, *by, *keep, F.coalesce("_s", F.lit(names[0])).alias("split"))
    return ranked.filter("split IS NOT NULL").select(key, *by, *keep, "split").unionByName(placed)


def split_objective(
    df: DataFrame, keys: Sequence[str], source: str, split: str, values: Sequence[str], ratios: Mapping[str, float]
) -> DataFrame:
    """100 x mean KS of train against val and test, plus 2 x the source ratio penalty."""
    from rollcall.operators.profile import ks, unpivot

    first, *others = list(ratios)
    long = unpivot(df, [*keys, split], values)
    gaps = ks(long, [*keys, "metric"], "value", split, [(first, o) for o in others])
    mean = gaps.groupBy(*keys).agg(F.avg("d").alias("avg_ks"))
    counts = df.groupBy(*keys, source).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(split) == s).alias(f"_{s}") for s in ratios]
    )
    off = sum((F.abs(F.col(f"_{s}") - F.col("_n") * F.lit(r)) / F.greatest(F.col("_n"), F.lit(1)) for s, r in ratios.items()), F.lit(0.0))
    penalty = counts.groupBy(*keys).agg(F.sum(off).alias("penalty"))
    out = same_keys(mean, penalty, keys, "left")
    return out.withColumn("objective", F.col("avg_ks") * 100.0 + F.col("penalty") * 2.0)


def _one_label(width: int, at: Column, label: Column) -> Column:
    """Labels of a block of seeds with one of them set."""
    none = F.lit(f"{NO_LABEL:02X}")
    return F.unhex(F.concat(F.repeat(none, at), F.lpad(F.hex(label), 2, "0"), F.repeat(none, F.lit(width - 1) - at)))


def _sweep_labels(rows: DataFrame, known: int, key: str, source: str, strata: str, values: Sequence[str], ratios: Mapping[str, float], seeds: Sequence[int]) -> DataFrame:
    """(key, source, strata, values, block, labels): the splits of a row under all seeds of a block, a byte for each.

    ``NO_LABEL`` says that another row has the label; every row has one label per seed.
    Strata that fit a task are ranked there for a block of seeds at a time; if one does
    not, the rows are repeated by seed and ranked in slices.
    """
    names, columns = list(ratios), [key, source, strata, *values]
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)])
    index = F.create_map(*[F.lit(x) for i, s in enumerate(seeds) for x in (s, i)])

    def alone(labelled: DataFrame) -> DataFrame:
        at = index[F.col("seed")]
        return labelled.select(
            *columns, F.floor(at / SEED_BLOCK).cast("int").alias("block"), _one_label(SEED_BLOCK, (at % SEED_BLOCK).cast("int"), number[F.col("split")]).alias("labels")
        )

    if not fits_task(rows, [source, strata], known):
        tried = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
        return settle(alone(stratified_split(tried, key, ["seed", source], strata, ratios, "sweep", keep=values)))

    def work(group: pa.Table) -> pa.Table:
        n, block = group.num_rows, group.column("block")[0].as_py()
        upto = np.cumsum([math.floor(n * r) for r in ratios.values()])
        by_place = np.searchsorted(upto, np.arange(1, n + 1)).astype(np.uint8)
        by_place[by_place == upto.size] = NO_LABEL
        tails = [t.encode() for t in group.column("tail").to_pylist()]
        labels = np.full((n, SEED_BLOCK), NO_LABEL, dtype=np.uint8)
        for i, seed in enumerate(seeds[block * SEED_BLOCK : (block + 1) * SEED_BLOCK]):
            start = f"sweep:{seed}".encode()
            hashes = np.frombuffer(b"".join([md5(start + t).digest() for t in tails]), dtype=">u8").astype(np.uint64).reshape(n, 2)
            labels[np.lexsort((hashes[:, 1], hashes[:, 0])), i] = by_place
        data = pa.py_buffer(labels.tobytes())
        bounds = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * SEED_BLOCK).tobytes())
        return group.drop_columns(["tail"]).append_column("labels", pa.Array.from_buffers(pa.binary(), n, [None, bounds, data]))

    # the text that ``hash_order`` makes of seed, source and key, without its beginning
    tail = F.concat_ws(":", F.lit(""), F.col(source).cast("string"), F.col(key).cast("string"))
    blocks = F.array(*[F.lit(b) for b in range(-(-len(seeds) // SEED_BLOCK))])
    tried = rows.select(*columns, F.explode(blocks).alias("block"), tail.alias("tail"))
    schema = T.StructType([*[f for f in tried.schema.fields if f.name != "tail"], T.StructField("labels", T.BinaryType())])
    ranked = settle(tried.groupBy("block", source, strata).applyInArrow(work, schema))

    # leftovers of a stratum are fewer than its splits where the ratios add up to 1
    byte = lambda i: F.hex(F.substring("labels", i + 1, 1)) == f"{NO_LABEL:02X}"
    missing = F.array_compact(F.array(*[F.when(byte(i), F.lit(i)) for i in range(SEED_BLOCK)]))
    left = ranked.select(*columns, "block", F.explode(missing).alias("_in")).withColumn("_at", F.col("block") * SEED_BLOCK + F.col("_in"))
    left = left.filter(F.col("_at") < len(seeds)).withColumn("seed", F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col("_at") + 1)).drop("block", "_in", "_at")
    left, n_left = settle_counted(left.withColumn("_h", hash_order("sweep", *[F.col(c).cast("string") for c in ("seed", source, key)])))
    sizes = rows.groupBy(source, strata).agg(F.count(F.lit(1)).alias("_n"))
    places = _free_places(sizes, [source], ratios, {s: F.floor(F.col("_n") * F.lit(r)) for s, r in ratios.items()}, known)
    left = positions(left, ["seed", source], ["_h", key], "_rank", n_left)
    placed = same_keys(left, places, [source, "_rank"], "left").withColumn("split", F.coalesce("_s", F.lit(names[0])))
    return settle(ranked.select(*columns, "block", "labels").unionByName(alone(placed)))


def _label_matrix(column: pa.Array) -> np.ndarray:
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]].reshape(len(column), SEED_BLOCK)


def _label_counts(group: np.ndarray, n_groups: int, labels: np.ndarray, splits: int) -> np.ndarray:
    """How often each split is the label of each seed, by group: (groups, seeds * splits)."""
    cell = (group[:, None] * SEED_BLOCK + np.arange(SEED_BLOCK)[None, :]) * splits + labels
    found = np.bincount(cell[labels != NO_LABEL], minlength=n_groups * SEED_BLOCK * splits)
    return found.reshape(n_groups, SEED_BLOCK * splits)


def _sweep_counts(labels: DataFrame, by: str, splits: int) -> DataFrame:
    """(block, ``by``, cell, n): rows by split and seed, cell = place of the seed in the block * splits + split."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, block = part.column(1).dictionary_encode(null_encoding="encode"), part.column(0).to_numpy()
            n = len(keys.dictionary)
            for b in np.unique(block).tolist():
                at = np.flatnonzero(block == b)
                counts = _label_counts(keys.indices.to_numpy()[at].astype(np.int64), n, _label_matrix(part.column(2))[at], splits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b, dtype=np.int32)), keys.dictionary, pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["block", by, "counts"]
                )

    partial = labels.select("block", by, "labels")
    schema = T.StructType([*partial.schema.fields[:2], T.StructField("counts", T.ArrayType(T.LongType()))])
    cells = partial.mapInArrow(work, schema).select("block", by, F.posexplode("counts").alias("cell", "n"))
    return cells.groupBy("block", by, "cell").agg(F.sum("n").alias("n"))


def _sweep_gaps(labels: DataFrame, rows: DataFrame, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(block, seed_at, metric, gap): KS distances of the first split to each other one, for all seeds at once.

    Rows with their labels are sorted by value in slices of the values; counts run along
    for all seeds of a block, from the totals of the slices before.  A slice may be of any size: it is streamed.
    """
    splits = len(names)
    doubles = [F.col(v).cast("double").alias(v) for v in values]
    probs = [i / VALUE_SLICES for i in range(1, VALUE_SLICES)]
    row = rows.select(*doubles).agg(*[F.percentile_approx(v, probs, 1000).alias(v) for v in values]).first()
    edges = {v: sorted(set(row[v] or [])) for v in values}
    placed = lambda v: F.when(F.col(v).isNotNull(), F.size(F.filter(F.lit(edges[v]).cast("array<double>"), lambda e: e <= F.col(v))))
    metrics = F.array(*[F.struct(F.lit(i).alias("metric"), F.col(v).alias("value"), placed(v).alias("slice")) for i, v in enumerate(values)])
    long = labels.select("block", "labels", *doubles).select("block", "labels", F.explode(metrics).alias("m"))
    long = long.where("m.value IS NOT NULL").select("block", F.col("m.metric").alias("metric"), F.col("m.slice").alias("slice"), F.col("m.value").alias("value"), "labels")
    tables = []
    for i, v in enumerate(values):
        found = _sweep_counts(labels.select("block", "labels", placed(v).alias("slice")).where("slice IS NOT NULL"), "slice", splits)
        tables.append(found.withColumn("metric", F.lit(i)))
    cells = reduce(DataFrame.unionByName, tables)
    # of each slice: what lies before it, and the totals; at most blocks x metrics x slices rows
    upto = Window.partitionBy("block", "metric", "cell").orderBy("slice")
    cells = cells.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("block", "metric", "cell"))})
    ends = cells.groupBy("block", "metric", "slice").agg(F.array_sort(F.collect_list(F.struct("cell", "before", "total"))).alias("c"))
    ends = ends.select("block", "metric", "slice", F.lit(None).cast("double").alias("value"), F.lit(None).cast("binary").alias("labels"), F.transform("c", lambda c: c["before"]).alias("before"), F.transform("c", lambda c: c["total"]).alias("total"))
    none = F.lit(None).cast("array<bigint>")
    dealt = ends.unionByName(long.withColumns({"before": none, "total": none}))
    # the row with the totals has no value and comes first
    dealt = dealt.repartition("block", "metric", "slice").sortWithinPartitions("block", "metric", "slice", F.col("labels").isNotNull(), "value")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = value = total = None
        count = best = np.zeros((SEED_BLOCK, splits))

        def gaps(counts: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore", divide="ignore"):
                share = counts / total
            return np.abs(share[..., :1] - share[..., 1:])

        def done() -> pa.RecordBatch:
            found = np.fmax(best, gaps(count))
            at = np.repeat(np.arange(SEED_BLOCK), splits - 1)
            size, gap = at.size, found.ravel()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, of[0], dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(size, of[1], dtype=np.int32)),
                 pa.array(np.tile(np.arange(1, splits), SEED_BLOCK).astype(np.int32)), pa.array(gap, mask=np.isnan(gap))], names=["block", "seed_at", "metric", "other", "gap"]
            )

        for part in parts:
            keys = np.stack([part.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            number = part.column(3).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for a, b in zip(head.tolist(), [*head[1:].tolist(), part.num_rows], strict=True):
                if of != tuple(keys[a].tolist()):
                    if of is not None:
                        yield done()
                    of, value = tuple(keys[a].tolist()), None
                    count, total = (np.array(part.column(i)[a].as_py(), dtype=np.int64).reshape(SEED_BLOCK, splits) for i in (5, 6))
                    best = np.full((SEED_BLOCK, splits - 1), np.nan)
                    a += 1
                for lo in range(a, b, 4096):
                    here = number[lo : min(lo + 4096, b)]
                    labels_ = _label_matrix(part.column(4).slice(lo, here.size))
                    ran = count + np.cumsum(labels_[:, :, None] == np.arange(splits, dtype=np.uint8), axis=0)
                    same = (here[1:] == here[:-1]) | (np.isnan(here[1:]) & np.isnan(here[:-1]))
                    if value is not None and not (here[0] == value or (np.isnan(here[0]) and np.isnan(value))):
                        best = np.fmax(best, gaps(count))
                    if not same.all():
                        best = np.fmax(best, np.fmax.reduce(gaps(ran[:-1][~same]), axis=0))
                    count, value = ran[-1], here[-1]
        if of is not None:
            yield done()

    found = dealt.mapInArrow(work, "block int, seed_at int, metric int, other int, gap double")
    return found.groupBy("block", "seed_at", "metric", "other").agg(F.max("gap").alias("gap"))


def seed_sweep(
    df: DataFrame, key: str, source: str, strata: str, values: Sequence[str], ratios: Mapping[str, float], seeds: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """(objective per seed, split of the best seed), all seeds in one pass.

    The same split and objective as ``stratified_split`` and ``split_objective`` give seed
    by seed; but a row goes along with its labels under a block of seeds, a byte for each.
    """
    seeds, names = [int(s) for s in dict.fromkeys(seeds)], list(ratios)
    rows, known = settle_counted(df.select(key, source, strata, *values))
    labels = _sweep_labels(rows, known, key, source, strata, values, ratios, seeds)
    at = F.col("block") * SEED_BLOCK + F.col("seed_at")
    listed = F.array(*[F.lit(s) for s in seeds])
    seed = F.element_at(listed, at + 1).alias("seed")
    mean = _sweep_gaps(labels, rows, values, names).filter(at < len(seeds)).groupBy(seed).agg(F.avg("gap").alias("avg_ks"))
    by_source = _sweep_counts(labels, source, len(names)).withColumn("seed_at", F.floor(F.col("cell") / len(names)).cast("int"))
    counts = by_source.filter(at < len(seeds)).groupBy(seed, source).agg(
        F.sum("n").alias("_n"), *[F.sum(F.when(F.col("cell") % len(names) == i, F.col("n"))).alias(f"_{s}") for i, s in enumerate(names)]
    )
    off = sum((F.abs(F.col(f"_{s}") - F.col("_n") * F.lit(r)) / F.greatest(F.col("_n"), F.lit(1)) for s, r in ratios.items()), F.lit(0.0))
    scores = same_keys(mean, counts.groupBy("seed").agg(F.sum(off).alias("penalty")), ["seed"], "left")
    scores = settle(scores.withColumn("objective", F.col("avg_ks") * 100.0 + F.col("penalty") * 2.0))
    best = scores.agg(F.min_by("seed", F.struct("objective", "seed")).alias("seed")).select((F.array_position(listed, F.col("seed")) - 1).cast("int").alias("at"))
    found = labels.withColumn("_at", best.select("at").scalar()).filter(F.col("block") == F.floor(F.col("_at") / SEED_BLOCK))
    label = F.conv(F.hex(F.substr("labels", F.col("_at") % SEED_BLOCK + 1, F.lit(1))), 16, 10).cast("int")
    found = found.withColumn("_label", label).filter(F.col("_label") != NO_LABEL)
    split = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("_label") + 1)
    return scores, found.select(key, F.element_at(listed, F.col("_at") + 1).alias("seed"), source, strata, split.alias("split"))


def stratified_folds(df: DataFrame, key: str, levels: Sequence[Column], folds: int, seed: object, reduce_to_smallest: bool = True) -> DataFrame:
    """Fold number per row, even within the finest stratum that has ``folds`` members everywhere.

    ``levels`` go from fine to coarse.  With one level and ``reduce_to_smallest``
    the number of folds drops to the smallest stratum; fewer than two is an error.
    """
    chosen, used = levels[-1], folds
    for level in levels:
        least = df.groupBy(level.alias("_s")).count().agg(F.min("count").alias("n")).first()["n"] or 0
        if least >= folds:
            chosen, used = level, folds
            break
        if reduce_to_smallest and len(levels) == 1:
            chosen, used = level, int(min(folds, least))
    if used < 2:
        raise ValueError("every stratum needs at least two rows")
    rows = df.select(key, chosen.alias("stratum")).withColumn("_h", hash_order(seed, F.col(key).cast("string")))
    ranked = positions(rows, ["stratum"], ["_h", key], "_pos")
    shift = F.conv(F.substring(hash_order(seed, "stratum"), 1, 6), 16, 10).cast("long")
    return ranked.select(key, "stratum", ((F.col("_pos") - 1 + shift) % used).cast("int").alias("fold"))


def draw_with_replacement(df: DataFrame, key: str, weight: str, seed: object) -> DataFrame:
    """As many weighted draws as there are rows: how often each key was drawn.

    Row intervals on the cumulative weight and the draws are put in one order;
    a running maximum hands every draw the last interval that starts before it.
    """
    rows = df.select(key, F.col(weight).alias("_w"))
    known = rows.count()
    cum = running(rows, [], [key], {"_end": ("sum", F.col("_w"))}, known)
    total = rows.agg(F.sum("_w").alias("t")).select("t").scalar()
    starts = cum.select((F.col("_end") - F.col("_w")).alias("_at"), F.lit(0).alias("_kind"), F.col(key).alias("_id"), F.struct((F.col("_end") - F.col("_w")).alias("s"), F.col(key).alias("k")).alias("_last"))
    draws = df.select(
        (hash_uniform(seed, F.col(key).cast("string")) * total).alias("_at"), F.lit(1).alias("_kind"), F.col(key).alias("_id"),
        F.lit(None).cast(starts.schema["_last"].dataType).alias("_last"),
    )
    ordered = running(starts.unionByName(draws), [], ["_at", "_kind", "_id"], {"_hit": ("max", F.col("_last"))}, 2 * known)
    return ordered.filter("_kind = 1").groupBy(F.col("_hit.k").alias(key)).agg(F.count(F.lit(1)).alias("n_drawn"))


def draw_without_replacement(df: DataFrame, key: str, weight: Column, k: int, seed: object) -> DataFrame:
    """k distinct keys, weighted: the k smallest exponential arrival times."""
    u = hash_uniform(seed, F.col(key).cast("string"))
    arrival = -F.ln(F.greatest(u, F.lit(2.0**-53))) / F.greatest(weight, F.lit(1e-12))
    return df.select(key, arrival.alias("arrival")).orderBy("arrival", key).limit(k)


def entity_batches(
    df: DataFrame, entity: str, item: str, per_batch: int, paired: int, clips: int, seed: object, epoch: int, drop_last: bool = False
) -> DataFrame:
    """Batches of ``per_batch`` entities; the first ``paired`` of each give ``clips`` items, the others one.

    Entities with too few items repeat theirs.
    """
    tag = f"{seed}:{epoch}"
    order = df.select(entity).distinct().withColumn("_h", hash_order(tag, F.col(entity).cast("string")))
    placed = positions(order, [], ["_h", entity], "_pos").select(
        entity, F.floor((F.col("_pos") - 1) / per_batch).cast("long").alias("batch"), ((F.col("_pos") - 1) % per_batch).cast("int").alias("_slot")
    )
    if drop_last:
        full = order.agg(F.floor(F.count(F.lit(1)) / per_batch).alias("n")).select("n").scalar()
        placed = placed.filter(F.col("batch") < full)
    rows = df.select(entity, item).withColumn("_h", hash_order(tag, F.col(entity).cast("string"), F.col(item).cast("string")))
    # at most ``clips`` rows per entity are left, so these windows are small
    few = positions(first_n(rows, [entity], ["_h", item], clips), [entity], ["_h", item], "_rank", known=clips)
    few = attach(few, [entity], {"_have": F.max("_rank")}, known=clips)
    few = same_keys(few, placed, [entity], "inner")
    wanted = F.when(F.col("_slot") < paired, F.lit(clips)).otherwise(F.lit(1)).cast("long")
    slots = F.when(F.col("_rank") <= wanted, F.sequence(F.col("_rank"), wanted, F.col("_have")))
    return few.select("batch", entity, item, F.explode(slots).alias("copy"))


def balanced_weights(
    df: DataFrame, entity: str, bin_: str, group: str, source: str, bins: Mapping[str, float], sources: Mapping[str, float],
    group_bins: Mapping[str, float], strength: float = 0.20, cap: float = 4.0,
) -> DataFrame:
    """Entity weight: bin x damped inverse group frequency x source x group-bin, capped."""
    from rollcall.functions.weights import table_weight

    counts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k"))
    rows = lookup_join(df.select(entity, bin_, group, source), counts, [group])
    inverse = known.select("t").scalar() / (F.col("_n") * 2.0)
    prior = bounded(1.0 + (inverse - 1.0) * strength, 0.80, 1.25)
    prior = F.when(F.col("_n").isNotNull() & (known.select("k").scalar() == 2), prior).otherwise(F.lit(1.0))
    weight = (
        table_weight(F.col(bin_), bins) * prior * table_weight(F.upper(source), sources)
        * table_weight(F.concat_ws("_", F.col(group).cast("string"), F.col(bin_)), group_bins)
    )
    return rows.select(entity, bounded(weight, 1e-6, max(1.0, cap)).alias("weight"))


def hash_subset(df: DataFrame, key: str, n: int, seed: object) -> DataFrame:
    """n distinct keys in hash order."""
    return df.select(key).distinct().orderBy(hash_order(seed, F.col(key).cast("string")), key).limit(n)


def variant_plan(df: DataFrame, entity: str, item_no: str, split: Column, source: Column, train_factor: int, source_factors: Mapping[str, int]) -> DataFrame:
    """Names of the derived variants of train items; none for other splits."""
    extra = F.lit(0)
    for name, factor in source_factors.items():
        extra = extra + F.when(F.upper(source) == name, max(0, factor)).otherwise(0)
    total = F.when(split == "train", F.lit(max(0, train_factor)) + extra).otherwise(F.lit(0))
    stem = F.concat(F.col(entity).cast("string"), F.lit("_"), F.lpad(F.col(item_no).cast("string"), 3, "0"))
    rows = df.withColumns({"_total": total, "_stem": stem}).filter("_total > 0")
    return rows.select(
        entity, item_no, F.explode(F.sequence(F.lit(0), F.col("_total") - 1)).alias("variant"), "_stem"
    ).select(entity, item_no, "variant", F.concat("_stem", F.lit("_aug"), F.lpad(F.col("variant").cast("string"), 2, "0")).alias("name"))


def mask_frames(df: DataFrame, key: str, frames: str, width: int, seed: object, epoch: int, total_epochs: int = 100, min_frames: int = 4, min_drop: int = 8) -> DataFrame:
    """Seeded noise, time and dimension masks, gain and frame drop; strength falls with the epoch.

    Fixed values: the probabilities and fractions of each step.
    """
    strength = 1.0 - 0.70 * min(1.0, max(0.0, epoch / max(1, total_epochs - 1)))
    drop_strength = strength * 0.5 if strength < 0.5 else strength
    base = f"{seed}:{epoch}"
    item = F.col(key).cast("string")
    u = lambda name, *more: hash_uniform(f"{base}:{name}", item, *[m.cast("string") for m in more])

    def normal(name: str, *more: Column) -> Column:
        radius = F.sqrt(F.ln(F.greatest(u(name + "a", *more), F.lit(2.0**-53))) * -2.0)
        return radius * F.cos(u(name + "b", *more) * (2.0 * math.pi))

    x, n = F.col(frames), F.size(frames)
    span = lambda size, frac: F.greatest(F.floor(size * frac * strength), F.lit(1)).cast("int")
    pick = lambda name, top: F.floor(u(name) * top).cast("int")

    std = 0.05 * (0.5 + 0.5 * strength)
    noisy = F.transform(x, lambda f, i: F.transform(f, lambda v, j: v + normal("noise", i, j) * std))
    out = df.withColumn(frames, F.when(u("p_noise") < 0.75 * strength, noisy).otherwise(x))

    length = pick("t_len", span(n, 0.20)) + 1
    start = pick("t_start", n - length + 1)
    blank = F.transform(x, lambda f, i: F.when((i >= start) & (i < start + length), F.transform(f, lambda v: F.lit(0.0))).otherwise(f))
    out = out.withColumn(frames, F.when((u("p_time") < 0.65 * strength) & (n > min_frames), blank).otherwise(x))

    if width > 10:
        for name, p, frac in (("dim", 0.55, 0.15), ("freq", 0.50, 0.25)):
            order = F.array_sort(F.array(*[F.struct(u(f"{name}{d}").alias("u"), F.lit(d).alias("d")) for d in range(width)]))
            dims = F.transform(F.slice(order, 1, pick(f"{name}_n", span(F.lit(width), frac)) + 1), lambda s: s["d"])
            zeroed = F.transform(x, lambda f: F.transform(f, lambda v, j: F.when(F.array_contains(dims, j), F.lit(0.0)).otherwise(v)))
            out = out.withColumn(frames, F.when(u(f"p_{name}") < p * strength, zeroed).otherwise(x))

    gain = bounded(1.0 + normal("gain") * (0.15 * strength), 0.85, 1.15)
    scaled = F.transform(x, lambda f: F.transform(f, lambda v: v * gain))
    out = out.withColumn(frames, F.when(u("p_gain") < 0.55 * strength, scaled).otherwise(x))

    drops = pick("j_n", span(n, 0.12)) + 1
    ranks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(u("j", i).alias("u"), i.alias("i")))
    gone = F.transform(F.slice(F.array_sort(ranks), 1, drops), lambda s: s["i"])
    kept = F.filter(x, lambda f, i: ~F.array_contains(gone, i))
    return out.withColumn(frames, F.when((u("p_drop") < 0.45 * drop_strength) & (n > min_drop), kept).otherwise(x))
