"""Linear models whose every step is fitted inside the fold, from sums by fold.

One pass over the rows gives, per fold and sample weighting, the matrix of products of
all columns.  Imputation, scaling, selection, principal components, ridge and the whole
elastic-net grid are solved from these matrices on the driver, where nothing depends on
the number of rows; the matrices of a training part are those of its folds added up, so no step
sees a held-out row.  Huber's loss needs the residuals and takes one pass per step, for
all folds together.  A fitted model is one vector of coefficients per held-out fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.grouped import group_quantiles

#: tasks that add up the matrices of all tasks, at most
SUM_TASKS = 64
#: held-out fold of a model that is fitted on all rows
NOTHING = -1

# Factors of the sample weightings, by name of the candidate's family.
_WEIGHTINGS = {
    "plain": (),
    "short_weighted": ((None, None, 160.0, 2.5), (None, None, 152.0, 4.0)),
    "medium_weighted": ((None, 160.0, 175.0, 2.5),),
    "short_male_weighted": ((1, None, 160.0, 6.0), (0, None, 160.0, 3.0), (None, None, 152.0, 4.0)),
}
# The grid of the elastic net and the constants of Huber's loss.
ELASTIC_ALPHAS = tuple(float(a) for a in np.logspace(-4, 1, 18))
ELASTIC_RATIOS = (0.05, 0.15, 0.35, 0.65, 0.90)
HUBER_ALPHA, HUBER_EPSILON = 0.003, 1.35


def sample_weight(weighting: str, y: Column, group: Column) -> Column:
    """Weight of a training row: the product of the factors whose range holds its target."""
    weight = F.lit(1.0)
    for only, low, high, factor in _WEIGHTINGS[weighting]:
        test = F.lit(True)
        if only is not None:
            test = test & (group == only)
        if low is not None:
            test = test & (y >= low)
        if high is not None:
            test = test & (y < high)
        weight = weight * F.when(test, F.lit(factor)).otherwise(F.lit(1.0))
    return weight


def weighting_of(candidate: str) -> str:
    """The weighting that a candidate's name asks for."""
    for name in ("short_male_weighted", "medium_weighted", "short_weighted"):
        if name in candidate:
            return name
    return "plain"


@dataclass(frozen=True)
class Candidate:
    """A model to try: ``kind`` is ridge, pca, elastic or huber; ``k`` columns or components, all if None."""

    name: str
    kind: str = "ridge"
    k: int | None = None
    alpha: float = 1.0

    @property
    def weighting(self) -> str:
        return weighting_of(self.name)


@dataclass
class FoldSums:
    """Matrices of [1, columns, y] per (held-out fold, fold, weighting) and what fills the holes."""

    width: int
    #: dimensions of the vector that are missing somewhere; each has a flag column
    holes: list[int]
    folds: list[int]
    #: what missing values become when a fold is held out
    fills: dict[int, np.ndarray]
    parts: dict[tuple[int, int, str], np.ndarray] = field(default_factory=dict)

    @property
    def columns(self) -> int:
        return self.width + len(self.holes)

    def part(self, held: int, fold: int, weighting: str = "plain") -> np.ndarray:
        """The matrix of one fold as it is prepared for models that do not see ``held``."""
        zero = np.zeros((self.columns + 2, self.columns + 2))
        return self.parts.get((NOTHING - 1, fold, weighting), zero) + self.parts.get((held, fold, weighting), zero)

    def train(self, held: int, weighting: str = "plain", without: int | None = None) -> np.ndarray:
        """The matrix of all folds but ``held`` (and ``without``)."""
        return sum(
            (self.part(held, f, weighting) for f in self.folds if f not in (held, without)), np.zeros((self.columns + 2, self.columns + 2))
        )


def prepared(vectors: Iterable[np.ndarray], fill: np.ndarray, holes: Sequence[int]) -> np.ndarray:
    """[1, filled columns, missing flags] of rows; missing is NaN."""
    x = np.array([np.asarray(v, dtype=float) for v in vectors])
    gone = np.isnan(x)
    return np.column_stack([np.ones(len(x)), np.where(gone, fill, x), gone[:, list(holes)].astype(float)])


def fold_fills(df: DataFrame, vector: str, fold: str, width: int, folds: Sequence[int]) -> tuple[dict[int, np.ndarray], list[int]]:
    """Exact medians of every dimension over the rows outside each fold, for dimensions that are missing somewhere.

    A dimension without any value is filled with 0.
    """
    long = df.select(fold, F.posexplode(vector).alias("dim", "value"))
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    seen = {r["dim"]: r for r in long.groupBy("dim").agg(F.count_if(F.col("value").isNull()).alias("gone")).collect()}
    holes = sorted(d for d, r in seen.items() if r["gone"])
    fills = {h: np.zeros(width) for h in (*folds, NOTHING)}
    if holes:
        others = F.filter(F.array(*[F.lit(h) for h in (*folds, NOTHING)]), lambda h: h != F.col(fold))
        rows = long.where(F.col("dim").isin(holes)).withColumn("held", F.explode(others))
        for r in group_quantiles(rows, ["held", "dim"], "value", {"m": 0.5}).collect():  # folds x dimensions
            fills[r["held"]][r["dim"]] = r["m"]
    return fills, holes


def _added(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum arrays of equal length by key: first in few tasks, then number by number."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                group = tuple(row[:-2])
                sums[group] = sums.get(group, 0.0) + np.asarray(row[-1])
        if sums:
            out = pd.DataFrame(list(sums), columns=list(keys))
            out["task"], out["cells"] = 0, list(sums.values())
            yield out

    tasks = min(SUM_TASKS, int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = partials.repartition(tasks, "task").mapInPandas(add, partials.schema)
    return near.select(*keys, F.posexplode("cells").alias("cell", "value")).groupBy(*keys, "cell").agg(F.sum("value").alias("value"))


def _collected(sums: DataFrame, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Arrays per key; their number and length do not depend on the rows."""
    pdf = sums.toPandas()
    return {g: p.sort_values("cell")["value"].to_numpy() for g, p in pdf.groupby(list(keys))}


def _square(cells: np.ndarray, size: int) -> np.ndarray:
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = cells
    return matrix + np.triu(matrix, 1).T


def fold_sums(
    df: DataFrame, vector: str, y: str, group: str, fold: str, width: int, weightings: Sequence[str] = ("plain",)
) -> FoldSums:
    """Sums by fold for all ``weightings``, in one pass.

    Complete rows enter the matrix of their fold once.  Rows with missing values are
    filled as each held-out fold demands, and enter one matrix per fold that may be
    held out.  Vectors are arrays of double with NULL or NaN where a value is missing.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    fills, holes = fold_fills(df, vector, fold, width, folds)
    names = list(dict.fromkeys(["plain", *weightings]))
    rows = df.select(vector, F.col(y).cast("double").alias("_y"), F.col(fold).alias("_fold"), *[sample_weight(n, F.col(y), F.col(group)).alias(n) for n in names])
    size = width + len(holes) + 2
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}

        def add(held: int, own: int, part: pd.DataFrame) -> None:
            z = np.column_stack([prepared(part[vector], fills.get(held, fills[NOTHING]), holes), part["_y"]])
            for i, name in enumerate(names):
                cells = ((z * part[name].to_numpy()[:, None]).T @ z)[upper]
                sums[held, own, i] = sums.get((held, own, i), 0.0) + cells

        for batch in batches:
            whole = np.array([not np.isnan(np.asarray(v, dtype=float)).any() for v in batch[vector]], dtype=bool)
            for own, part in batch[whole].groupby("_fold"):
                add(NOTHING - 1, int(own), part)
            for own, part in batch[~whole].groupby("_fold"):
                for held in (*folds, NOTHING):
                    if held != own:
                        add(held, int(own), part)
        if sums:
            out = pd.DataFrame(list(sums), columns=["held", "own", "weighting"])
            out["task"], out["cells"] = TaskContext.get().partitionId(), list(sums.values())
            yield out

    partials = rows.mapInPandas(partial, "held int, own int, weighting int, task int, cells array<double>")
    keys = ["held", "own", "weighting"]
    found = _collected(_added(partials, keys), keys)
    parts = {(int(h), int(o), names[int(w)]): _square(cells, size) for (h, o, w), cells in found.items()}
    return FoldSums(width, holes, folds, fills, parts)


# ---- solving ----


def _scales(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd of every column; the sd of a constant column is 1."""
    n = gram[0, 0]
    mean = gram[0, 1:-1] / n
    sd = np.sqrt(np.maximum(np.diag(gram)[1:-1] / n - mean**2, 0.0))
    return mean, np.where(sd > 1e-9 * (np.abs(mean) + 1.0), sd, 1.0)


def _centred(gram: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Products of the scaled columns around this matrix's own means: (X'X, X'y, means of the raw columns, mean of y)."""
    n = gram[0, 0]
    own, y_mean = gram[0, 1:-1] / n, gram[0, -1] / n
    xx = (gram[1:-1, 1:-1] - n * np.outer(own, own)) / np.outer(sd, sd)
    xy = (gram[1:-1, -1] - n * own * y_mean) / sd
    return xx, xy, own, float(y_mean)


def best_columns(gram: np.ndarray, k: int) -> np.ndarray:
    """The k columns that correlate most with y, in their order; constant columns come last."""
    n = gram[0, 0]
    mean, y_mean = gram[0, 1:-1] / n, gram[0, -1] / n
    var = np.diag(gram)[1:-1] / n - mean**2
    y_var = gram[-1, -1] / n - y_mean**2
    cov = gram[1:-1, -1] / n - mean * y_mean
    score = np.where(var > 1e-12 * (mean**2 + 1.0), cov**2 / np.maximum(var * y_var, 1e-300), -1.0)
    return np.sort(np.lexsort((np.arange(score.size), -score))[:k])


def _checked_k(k: int | None, most: int) -> int:
    if k is not None and not 1 <= k <= most:
        raise ValueError(f"{k} of {most} columns")
    return most if k is None else k


def ridge_coefficients(plain: np.ndarray, weighted: np.ndarray, k: int | None, alpha: float) -> np.ndarray:
    """[intercept, coefficients on raw columns]: scale, select the k best columns, weighted ridge."""
    mean, sd = _scales(plain)
    kept = best_columns(plain, _checked_k(k, mean.size))
    xx, xy, own, y_mean = _centred(weighted, mean, sd)
    beta = np.zeros(mean.size)
    beta[kept] = np.linalg.solve(xx[np.ix_(kept, kept)] + alpha * np.eye(kept.size), xy[kept]) / sd[kept]
    return np.concatenate([[y_mean - own @ beta], beta])


def pca_coefficients(plain: np.ndarray, weighted: np.ndarray, k: int | None, alpha: float) -> np.ndarray:
    """The same behind k whitened principal components of the scaled columns."""
    mean, sd = _scales(plain)
    k = _checked_k(k, mean.size)
    n = plain[0, 0]
    spread, axes = np.linalg.eigh(_centred(plain, mean, sd)[0] / max(n - 1, 1))
    spread, axes = spread[::-1][:k], axes[:, ::-1][:, :k]
    if spread.min() <= 1e-12:
        raise ValueError(f"fewer than {k} components vary")
    turn = axes / np.sqrt(spread)
    xx, xy, own, y_mean = _centred(weighted, mean, sd)
    beta = turn @ np.linalg.solve(turn.T @ xx @ turn + alpha * np.eye(k), turn.T @ xy) / sd
    return np.concatenate([[y_mean - own @ beta], beta])


def elastic_path(
    xx: np.ndarray, xy: np.ndarray, n: np.ndarray, alphas: Sequence[float], ratios: np.ndarray, tolerance: float = 1e-9, sweeps: int = 8000
) -> np.ndarray:
    """Elastic-net coefficients of many problems along falling alphas: (alphas, problems, columns).

    Minimises |y - Xb|^2 / 2n + alpha (ratio |b|_1 + (1 - ratio) |b|^2 / 2) by coordinate
    descent on the matrices, one coordinate of all problems at a time, each alpha from
    the solution of the one before.
    """
    p, d = xy.shape
    b = np.zeros((p, d))
    diagonal = np.einsum("pii->pi", xx)
    out = np.zeros((len(alphas), p, d))
    for at in np.argsort(alphas)[::-1]:
        soft, ridge = n * alphas[at] * ratios, n * alphas[at] * (1.0 - ratios)
        rest = xy - np.einsum("pij,pj->pi", xx, b)
        for _ in range(sweeps):
            moved = 0.0
            for j in range(d):
                old = b[:, j]
                pull = rest[:, j] + diagonal[:, j] * old
                new = np.sign(pull) * np.maximum(np.abs(pull) - soft, 0.0) / np.maximum(diagonal[:, j] + ridge, 1e-300)
                step = new - old
                if step.any():
                    b[:, j] = new
                    rest -= xx[:, :, j] * step[:, None]
                    moved = max(moved, float((np.abs(step) * np.sqrt(np.maximum(diagonal[:, j] / n, 0.0))).max()))
            if moved < tolerance:
                break
        else:
            raise ValueError(f"no convergence in {sweeps} sweeps")
        out[at] = b
    return out


def elastic_coefficients(
    sums: FoldSums, held: Sequence[int], alphas: Sequence[float] = ELASTIC_ALPHAS, ratios: Sequence[float] = ELASTIC_RATIOS
) -> tuple[dict[int, np.ndarray], dict[int, tuple[float, float]]]:
    """Per held-out fold the elastic net with the alpha and ratio of least cross-validated error, and these two.

    The folds of the training part take turns as validation part; every grid point of
    every held-out fold and turn is solved in one descent.  Equal errors: the larger
    alpha, then the smaller ratio.
    """
    problems = [(h, turn) for h in held for turn in (None, *[f for f in sums.folds if f != h])]
    prepared_ = []
    for h, turn in problems:
        mean, sd = _scales(sums.train(h))
        gram = sums.train(h, without=turn)
        prepared_.append((*_centred(gram, mean, sd), gram[0, 0], sd))
    grid = np.repeat(np.arange(len(problems)), len(ratios))
    ratio = np.tile(np.asarray(ratios, dtype=float), len(problems))
    path = elastic_path(
        np.stack([prepared_[i][0] for i in grid]), np.stack([prepared_[i][1] for i in grid]), np.array([prepared_[i][4] for i in grid]), alphas, ratio
    )
    errors: dict[int, np.ndarray] = {h: np.zeros((len(alphas), len(ratios))) for h in held}
    final: dict[int, int] = {}
    coefficients = np.zeros((len(alphas), grid.size, sums.columns + 1))
    for g, i in enumerate(grid):
        _, _, own, y_mean, _, sd = prepared_[i]
        coefficients[:, g, 1:] = path[:, g] / sd
        coefficients[:, g, 0] = y_mean - coefficients[:, g, 1:] @ own
        h, turn = problems[i]
        if turn is None:
            final[h] = i
            continue
        gram = sums.part(h, turn)
        c = np.column_stack([coefficients[:, g], -np.ones(len(alphas))])  # prediction minus y
        errors[h][:, g % len(ratios)] += np.einsum("ai,ij,aj->a", c, gram, c) / gram[0, 0] / (len(sums.folds) - (h != NOTHING))
    out, chosen = {}, {}
    for h in held:
        points = [(errors[h][a, r], -alphas[a], ratios[r], a, r) for a in range(len(alphas)) for r in range(len(ratios))]
        *_, a, r = min(points)
        out[h], chosen[h] = coefficients[a, final[h] * len(ratios) + r], (alphas[a], ratios[r])
    return out, chosen


def _settled(cells: np.ndarray, size: int, turn: np.ndarray, sigma: float, alpha: float, epsilon: float) -> tuple[np.ndarray, float]:
    """Coefficients and scale that are best while the same rows lie beyond ``epsilon``.

    ``turn`` leads from [1, columns] to [1, scaled columns].
    """
    gram, (beyond, n) = _square(cells[: -size - 2], size), cells[-2:]
    pull = cells[-size - 2 : -3]  # signs of the rows beyond, times [1, columns]
    xx, xy = turn.T @ gram[:-1, :-1] @ turn, turn.T @ gram[:-1, -1]
    penalty = np.diag([0.0] + [alpha] * (size - 2))
    for _ in range(200):
        theta = np.linalg.solve(xx + sigma * penalty, xy + epsilon * sigma * (turn.T @ pull))
        inside = max(gram[-1, -1] - 2 * theta @ xy + theta @ xx @ theta, 0.0)
        new = float(np.sqrt(max(inside, 1e-24) / max(n - epsilon**2 * beyond, 1e-3 * n)))
        if abs(new - sigma) <= 1e-13 * sigma:
            break
        sigma = new
    return turn @ theta, sigma


def huber_coefficients(
    df: DataFrame, vector: str, y: str, group: str, fold: str, sums: FoldSums, held: Sequence[int], weighting: str = "plain",
    alpha: float = HUBER_ALPHA, epsilon: float = HUBER_EPSILON, tolerance: float = 1e-8, passes: int = 100,
) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Per held-out fold Huber's regression on scaled columns, and its scale.

    Minimises the sum of w (s + H(r / s) s) plus alpha |b|^2 over coefficients and scale s, H being
    quadratic up to ``epsilon`` and linear beyond.  Each pass tells for all held-out folds
    which rows lie beyond and sums the others; the problem with these rows fixed is solved
    on the driver.  A step that raises the loss is halved.  It ends when nothing moves.
    """
    size = sums.columns + 2
    upper = np.triu_indices(size)
    turns, trial, sigma, best = {}, {}, {}, {}
    for h in held:
        gram = sums.train(h, weighting)
        mean, sd = _scales(sums.train(h))
        turns[h] = np.block([[np.ones((1, 1)), -(mean / sd)[None, :]], [np.zeros((size - 2, 1)), np.diag(1.0 / sd)]])
        trial[h] = ridge_coefficients(sums.train(h), gram, None, alpha)
        c = np.append(trial[h], -1.0)
        sigma[h] = float(np.sqrt(max(c @ gram @ c / gram[0, 0], 1e-12)))
    rows = df.select(vector, F.col(y).cast("double").alias("_y"), F.col(fold).alias("_fold"), sample_weight(weighting, F.col(y), F.col(group)).alias("_w"))
    fills, holes = sums.fills, sums.holes
    left = list(held)
    for _ in range(passes):
        now = {h: (trial[h], sigma[h]) for h in left}

        def partial(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for h, (beta, s) in now.items():
                    part = batch[batch["_fold"] != h]
                    if not len(part):
                        continue
                    x = prepared(part[vector], fills[h], holes)
                    r = part["_y"].to_numpy() - x @ beta
                    w = part["_w"].to_numpy()
                    far = np.abs(r) > epsilon * s
                    z = np.column_stack([x, part["_y"]])
                    gram = ((z * np.where(far, 0.0, w)[:, None]).T @ z)[upper]
                    pull = x.T @ (w * np.sign(r) * far)
                    loss = (w * (s + np.where(far, 2 * epsilon * np.abs(r) - epsilon**2 * s, r * r / s))).sum()
                    total[h] = total.get(h, 0.0) + np.concatenate([gram, pull, [loss, w[far].sum(), w.sum()]])
            if total:
                yield pd.DataFrame({"held": list(total), "task": TaskContext.get().partitionId(), "cells": list(total.values())})

        found = _collected(_added(rows.mapInPandas(partial, "held int, task int, cells array<double>"), ["held"]), ["held"])
        for (h,), cells in found.items():
            h = int(h)
            scaled = np.linalg.solve(turns[h], trial[h])[1:]
            loss = cells[-3] + alpha * scaled @ scaled
            if h in best and loss > best[h][0] + 1e-12 * abs(best[h][0]):
                trial[h], sigma[h] = (best[h][1] + trial[h]) / 2, (best[h][2] + sigma[h]) / 2
            else:
                best[h] = loss, trial[h], sigma[h]
                trial[h], sigma[h] = _settled(cells, size, turns[h], sigma[h], alpha, epsilon)
            step = np.abs(np.linalg.solve(turns[h], trial[h] - best[h][1])).max()
            if max(step, abs(sigma[h] - best[h][2])) <= tolerance * max(1.0, sigma[h]):
                left.remove(h)
        if not left:
            return {h: best[h][1] for h in held}, {h: best[h][2] for h in held}
    raise ValueError(f"no convergence in {passes} passes")


# ---- candidates ----


def fit_candidates(
    df: DataFrame, vector: str, y: str, group: str, fold: str, sums: FoldSums, candidates: Sequence[Candidate], held: Sequence[int]
) -> tuple[dict[str, dict[int, np.ndarray]], dict[str, str]]:
    """Coefficients per candidate and held-out fold, and what went wrong with those that cannot be fitted.

    Only unusable parameters and unsolvable or unbounded systems are recorded; a failing
    cluster or a mistake in the code is raised.
    """
    out: dict[str, dict[int, np.ndarray]] = {}
    failures: dict[str, str] = {}
    for c in candidates:
        try:
            if c.kind in ("ridge", "pca"):
                solve = ridge_coefficients if c.kind == "ridge" else pca_coefficients
                fitted = {h: solve(sums.train(h), sums.train(h, c.weighting), c.k, c.alpha) for h in held}
            elif c.kind == "elastic":
                fitted = elastic_coefficients(sums, held)[0]
            elif c.kind == "huber":
                fitted = huber_coefficients(df, vector, y, group, fold, sums, held, c.weighting)[0]
            else:
                raise ValueError(f"unknown kind {c.kind!r}")
            if not all(np.isfinite(b).all() for b in fitted.values()):
                raise ValueError("coefficients are not finite")
            out[c.name] = fitted
        except (ValueError, np.linalg.LinAlgError) as exc:
            failures[c.name] = f"{type(exc).__name__}: {exc}"
    if not out:
        raise RuntimeError(f"every candidate failed: {failures}")
    return out, failures


def predictions(
    df: DataFrame, keep: Sequence[str], vector: str, fitted: Mapping[str, Mapping[int, np.ndarray]], sums: FoldSums, fold: str | None = None
) -> DataFrame:
    """(keep, candidate, pred): with ``fold`` by the model that did not see it, else by the model of all rows."""
    names = list(fitted)
    held = sums.folds if fold else [NOTHING]
    stacked = {h: np.stack([fitted[n][h] for n in names], axis=1) for h in held}
    fills, holes = sums.fills, sums.holes
    rows = df.select(*keep, F.col(vector).alias("_x"), (F.col(fold) if fold else F.lit(NOTHING)).alias("_held"))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, part in batch.groupby("_held", sort=False):
                pred = prepared(part["_x"], fills[h], holes) @ stacked[h]
                out = part[list(keep)].loc[part.index.repeat(len(names))].reset_index(drop=True)
                out["candidate"], out["pred"] = np.tile(names, len(part)), pred.ravel()
                yield out

    types = dict(rows.dtypes)
    return rows.mapInPandas(predict, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", candidate string, pred double")


def weightings_of(candidates: Sequence[Candidate]) -> list[str]:
    return sorted({c.weighting for c in candidates})


def out_of_fold(
    df: DataFrame, keep: Sequence[str], vector: str, y: str, group: str, fold: str, width: int, candidates: Sequence[Candidate]
) -> tuple[DataFrame, dict[str, str]]:
    """Out-of-fold predictions of all candidates that could be fitted, long, and the failures of the others."""
    sums = fold_sums(df, vector, y, group, fold, width, weightings_of(candidates))
    fitted, failures = fit_candidates(df, vector, y, group, fold, sums, candidates, sums.folds)
    return predictions(df, keep, vector, fitted, sums, fold), failures


def refit_predict(
    train: DataFrame, query: DataFrame, keep: Sequence[str], vector: str, y: str, group: str, fold: str, width: int, candidates: Sequence[Candidate]
) -> DataFrame:
    """Candidates fitted on all training rows; their predictions of the query rows, long."""
    sums = fold_sums(train, vector, y, group, fold, width, weightings_of(candidates))
    fitted, failures = fit_candidates(train, vector, y, group, fold, sums, candidates, [NOTHING])
    if failures:
        raise RuntimeError(f"selected candidates failed: {failures}")
    return predictions(query, keep, vector, fitted, sums)
