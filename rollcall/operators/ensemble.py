"""Combining out-of-fold predictions: blends, weights, diversity, recipes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators import calibrate as C
from rollcall.operators.grouped import group_quantiles
from rollcall.operators.metrics import regression_metrics
from rollcall.session import settle, settle_counted


def gated(base: Column, external: Column, threshold: Column, scale: Column, blend: Column) -> Column:
    """Sigmoid gate on the base prediction that mixes in the external one."""
    gate = 1.0 / (1.0 + F.exp((base - threshold) / scale))
    return base + blend * gate * (external - base)


def wide(preds: DataFrame, key: str, candidate: str, pred: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per entity with one column per named candidate."""
    return preds.filter(F.col(candidate).isin(*names)).groupBy(key, *keep).agg(
        *[F.max(F.when(F.col(candidate) == n, F.col(pred))).alias(n) for n in names]
    )


def blend(preds: DataFrame, keys: Sequence[str], candidate: str, pred: str, recipes: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Weighted sums per recipe; the recipes ride along as one literal map per candidate."""
    per: dict[str, list[Column]] = {}
    for recipe, weights in recipes.items():
        for name, weight in weights.items():
            if weight != 0:
                per.setdefault(name, []).append(F.struct(F.lit(recipe).alias("recipe"), F.lit(float(weight)).alias("w")))
    terms = F.when(F.lit(False), F.array(F.struct(F.lit("").alias("recipe"), F.lit(0.0).alias("w"))))
    for name, structs in per.items():
        terms = terms.when(F.col(candidate) == name, F.array(*structs))
    long = preds.filter(F.col(candidate).isin(*per)).select(*keys, F.col(pred).alias("_p"), F.explode(terms).alias("_t"))
    return long.groupBy(*keys, F.col("_t.recipe").alias("recipe")).agg(F.sum(F.col("_t.w") * F.col("_p")).alias("pred"))


def member_average(preds: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """Plain mean and median over the members."""
    aggs = {"mean_pred": F.avg(pred), "n_members": F.count(F.lit(1))}
    return group_quantiles(preds, keys, pred, {"median_pred": 0.5}, aggs=aggs)


def equal_top(names: Sequence[str], top: int = 3) -> dict[str, float]:
    chosen = list(names)[:top]
    return {n: 1.0 / len(chosen) for n in chosen}


def recipe_weights(names: Sequence[str], fitted: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float]]:
    """Fitted weightings, the first three alone, and the mean of the first three."""
    out = {k: dict(v) for k, v in fitted.items()}
    for name in list(names)[:3]:
        out[f"single__{name}"] = {name: 1.0}
    if len(names) >= 3:
        out["equal_top3"] = equal_top(names)
    return out


def correlations(table: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float]:
    """All pairwise correlations of prediction columns, from one aggregation."""
    pairs = list(combinations(names, 2))
    if not pairs:
        return {}
    row = table.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    out = {}
    for i, (a, b) in enumerate(pairs):
        value = row[f"c{i}"]
        value = 1.0 if value is None or not np.isfinite(value) else float(value)
        out[(a, b)] = out[(b, a)] = value
    return out


# Candidate families that always send their best member.
SPECIAL_FAMILIES = (("short_weighted", "short_male_weighted"), ("medium_weighted",), ("short_male_weighted",))


def select_diverse(
    maes: Mapping[str, float], corr: Mapping[tuple[str, str], float], limit: int = 8, max_corr: float = 0.995,
    special: Sequence[Sequence[str]] = SPECIAL_FAMILIES,
) -> list[str]:
    """Best special candidates, then by error whatever adds diversity or a new family."""
    order = sorted(maes, key=lambda n: (maes[n], n))
    chosen: list[str] = []
    for tags in special:
        best = next((n for n in order if any(t in n for t in tags)), None)
        if best is not None and best not in chosen:
            chosen.append(best)
    for name in order:
        if len(chosen) >= limit and chosen:
            break
        if name in chosen:
            continue
        family = name.split("__", 1)[0]
        lowest = min((corr[(name, c)] for c in chosen), default=0.0)
        if not chosen or lowest < max_corr or family not in {c.split("__", 1)[0] for c in chosen}:
            chosen.append(name)
    return chosen


#: weight vectors scored by one matrix product
BLOCK = 256
MASKS = ("all", "short", "medium", "short_group")


def _losses(table: DataFrame, names: Sequence[str], y: str, group: str | None, weights: np.ndarray) -> np.ndarray:
    """Mean absolute error of every weight vector on every mask: (vectors, masks).

    Each Arrow batch is one matrix product; only sums per vector leave a task.
    """
    k = len(weights)
    columns = list(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((k, len(MASKS)))
        sizes = np.zeros(len(MASKS))
        for batch in batches:
            truth, members = batch[y].to_numpy(float), batch[columns].to_numpy(float)
            short = truth < 160.0
            mask = np.stack(
                [np.ones_like(short), short, (truth >= 160.0) & (truth < 175.0),
                 short & (batch[group].to_numpy() == 1) if group else np.zeros_like(short)]
            ).astype(float)
            for at in range(0, k, BLOCK):  # a block of vectors at a time bounds the matrix
                block = slice(at, at + BLOCK)
                sums[block] += (mask @ np.abs(members @ weights[block].T - truth[:, None])).T
            sizes += mask.sum(axis=1)
        yield pd.DataFrame(
            {"vector": np.repeat(np.arange(k), len(MASKS)), "mask": np.tile(np.arange(len(MASKS)), k),
             "total": sums.ravel(), "n": np.tile(sizes, k)}
        )

    keep = [y, *columns, *([group] if group else [])]
    rows = (
        table.select(*keep).mapInPandas(partial, "vector int, mask int, total double, n double")
        .groupBy("vector", "mask").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    )
    out = np.zeros((k, len(MASKS)))
    for r in rows:
        out[r["vector"], r["mask"]] = r["total"] / r["n"] if r["n"] else 0.0
    return out


def error_prior(maes: np.ndarray, floor: float) -> np.ndarray:
    """Weights that fall off exponentially with the error."""
    scale = max(float(np.std(maes)), floor)
    raw = np.exp(-(maes - maes.min()) / scale)
    return raw / raw.sum()


def convex_weights(
    table: DataFrame, names: Sequence[str], y: str, group: str | None = None, prior: Sequence[float] | None = None,
    penalty: float = 0.02, short: float = 0.0, medium: float = 0.15, short_group: float = 0.0, rounds: int = 500,
) -> dict[str, float]:
    """Non-negative weights summing to one that minimise error plus slice terms.

    Every round scores all pairwise transfers at several step sizes in one
    Spark pass and moves to the best; steps shrink when nothing improves, until the
    smallest step gains nothing.  Not getting there in ``rounds`` is an error.
    """
    count = len(names)
    if count == 1:
        return {names[0]: 1.0}
    table = settle(table.select(y, *names, *([group] if group else [])))
    if prior is None:
        singles = _losses(table, names, y, group, np.eye(count))[:, 0]
        start = error_prior(singles, 0.1)
    else:
        start = np.clip(np.asarray(prior, float), 0.0, None)
        start = start / start.sum()
    factors = np.array([1.0, short, medium, short_group])

    def score(vectors: np.ndarray) -> np.ndarray:
        losses = _losses(table, names, y, group, vectors)
        return losses @ factors + penalty * np.square(vectors - start).sum(axis=1)

    best, value, step = start, None, 0.5
    for _ in range(rounds):
        moves = [best]
        for size in (step, step / 4, step / 16, step / 64):
            for i in range(count):
                for j in range(count):
                    if i != j and best[j] > 0:
                        move = best.copy()
                        given = min(size, best[j])
                        move[i] += given
                        move[j] -= given
                        moves.append(move)
        scores = score(np.array(moves))
        if value is None:
            value = scores[0]
        winner = int(np.argmin(scores))
        if scores[winner] < value - 1e-12:
            gained = value - scores[winner]
            best, value = moves[winner], scores[winner]
            if gained < 1e-7:
                break
        else:
            step /= 256
            if step < 1e-7:
                break
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    best = np.clip(best, 0.0, None)
    best = best / best.sum()
    return {n: float(w) for n, w in zip(names, best)}


def weight_search(table: DataFrame, names: Sequence[str], y: str, seed: int, trials: int = 5000) -> dict[str, float]:
    """Best of: the error prior, every single candidate, and Dirichlet draws mixed with the prior."""
    count = len(names)
    table = settle(table.select(y, *names))
    singles = _losses(table, names, y, None, np.eye(count))[:, 0]
    # fixed values: floor of the spread, concentration and share of the draws, smallest weight kept
    base = error_prior(singles, 0.20)
    draws = np.random.default_rng(seed).dirichlet(np.clip(base * 30.0 + 0.25, 0.25, None), size=trials)
    vectors = np.vstack([base, np.eye(count), 0.65 * draws + 0.35 * base])
    vectors = vectors / vectors.sum(axis=1, keepdims=True)
    best = vectors[int(np.argmin(_losses(table, names, y, None, vectors)[:, 0]))]
    kept = {n: float(w) for n, w in zip(names, best) if w >= 1e-4}
    total = sum(kept.values())
    return {n: w / total for n, w in kept.items()}


def finalists(
    metrics: DataFrame, tolerance: float = 0.20, recipe: str = "recipe", limit: int | None = 1, external: str | None = None
) -> DataFrame:
    """Recipes within ``tolerance`` of the best error, by the tie rules.

    Ties: blends before single candidates, low slice error, error, complexity,
    name.  ``metrics`` has mae, short_mae and complexity.
    """
    pool_ = metrics if external is None else metrics.filter(~F.col(external))
    best = pool_.agg(F.min("mae").alias("m")).select("m").scalar()
    near = pool_.filter(F.col("mae") <= best + tolerance)
    ordered = near.orderBy(F.col(recipe).startswith("single__"), "short_mae", "mae", "complexity", recipe)
    return ordered if limit is None else ordered.limit(limit)


def choose_recipe(
    oof: DataFrame, val: DataFrame, recipes: Mapping[str, Mapping[str, float]], kinds: Sequence[str] = C.KINDS,
    key: str = "entity_id", snapped: Sequence[str] = (), low: float = 160.0,
) -> tuple[DataFrame, DataFrame]:
    """(metrics of every recipe x calibrator, scored rows).

    Calibrators are fitted on out-of-fold blends and scored on validation
    blends; both tables are long with (key, source, g, y, candidate, pred).
    """
    keep = [key, "source", "g", "y"]
    train, known = settle_counted(blend(oof, keep, "candidate", "pred", recipes))
    query = settle(blend(val, keep, "candidate", "pred", recipes))
    scored = None
    for kind in kinds:
        params = C.fit(train, kind, ["recipe"], known=known)
        out = C.apply(query, params, kind, ["recipe"], snapped=snapped, known=known)
        out = out.select(key, "source", "g", "y", F.concat("recipe", F.lit("__"), F.lit(kind)).alias("recipe"), F.col("calibrated").alias("pred"),
                         (F.lit(int(kind != "raw"))).alias("_extra"), F.col("recipe").alias("_base"))
        scored = out if scored is None else scored.unionByName(out)
    scored, known = settle_counted(scored)
    used = {name: sum(1 for w in weights.values() if w > 1e-6) for name, weights in recipes.items()}
    parts = F.when(F.lit(False), F.lit(0))
    for name, n in used.items():
        parts = parts.when(F.col("_base") == name, F.lit(n))
    more = {
        "short_mae": F.coalesce(F.avg(F.when(F.col("y") < low, F.abs(F.col("pred") - F.col("y")))), F.lit(0.0)),
        "complexity": F.max(parts + F.col("_extra")),
    }
    metrics = regression_metrics(scored, ["recipe"], "y", "pred", more, known)
    return metrics, scored.drop("_extra", "_base")


def support_rule(metrics: DataFrame, baseline: Column, slack: float = 1e-12) -> DataFrame:
    """Lowest error among candidates no worse than the best baseline on the low slice."""
    base = metrics.filter(baseline).agg(F.min_by("short_mae", F.struct("mae", "short_mae")).alias("s")).select("s").scalar()
    return metrics.filter(F.col("short_mae") <= base + slack).orderBy("mae", "short_mae", "candidate").limit(1)
