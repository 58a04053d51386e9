"""Models fitted inside folds against plain NumPy, and optimality conditions."""

import numpy as np
import pytest

from rollcall.operators import linear as L
from rollcall.operators import vectors as V


def table(n=90, d=5, seed=3, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (1.0 + np.arange(d)) + 3.0
    y = 158.0 + x @ np.linspace(2.0, -1.0, d) + rng.normal(size=n) * 3.0
    y[::17] += 25.0
    x[rng.random((n, d)) < missing] = np.nan
    x[:, d - 1] = np.nan_to_num(x[:, d - 1], nan=1.0)  # one dimension without holes
    return x, y, rng.integers(0, 2, n), rng.integers(0, 4, n)


def frame(spark, x, y, g, fold):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t), int(a), int(f)) for i, (r, t, a, f) in enumerate(zip(x, y, g, fold))]
    return spark.createDataFrame(rows, "id long, v array<double>, y double, g int, fold int").repartition(3)


def weights(name, y, g):
    w = np.ones_like(y)
    if name == "short_male_weighted":
        w[(y < 160) & (g == 1)] *= 6
        w[(y < 160) & (g == 0)] *= 3
        w[y < 152] *= 4
    elif name == "medium_weighted":
        w[(y >= 160) & (y < 175)] *= 2.5
    elif name == "short_weighted":
        w[y < 160] *= 2.5
        w[y < 152] *= 4
    return w


def design(train, rows):
    """Filled, flagged and scaled columns of rows, all fitted on train."""
    holes = [j for j in range(train.shape[1]) if np.isnan(ALL[:, j]).any()]
    fill = np.nanmedian(train, axis=0)
    full = lambda a: np.column_stack([np.where(np.isnan(a), fill, a), np.isnan(a)[:, holes]])
    t = full(train)
    sd = t.std(axis=0)
    return (full(rows) - t.mean(axis=0)) / np.where(sd > 0, sd, 1.0), (t - t.mean(axis=0)) / np.where(sd > 0, sd, 1.0)


def weighted_ridge(z, y, w, alpha):
    m, t = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    zc = z - m
    b = np.linalg.solve((zc * w[:, None]).T @ zc + alpha * np.eye(z.shape[1]), (zc * w[:, None]).T @ (y - t))
    return lambda q: t + (q - m) @ b


def brute(x, y, g, fold, c):
    out = np.zeros_like(y)
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        q, z = design(x[tr], x[te])
        w = weights(c.weighting, y[tr], g[tr])
        if c.kind == "ridge":
            r = [abs(np.corrcoef(z[:, j], y[tr])[0, 1]) if z[:, j].std() > 0 else -1 for j in range(z.shape[1])]
            kept = np.sort(np.argsort(-np.array(r), kind="stable")[: c.k or z.shape[1]])
            out[te] = weighted_ridge(z[:, kept], y[tr], w, c.alpha)(q[:, kept])
        else:
            s, u = np.linalg.eigh(np.cov(z.T))
            s, u = s[::-1][: c.k], u[:, ::-1][:, : c.k]
            out[te] = weighted_ridge(z @ u / np.sqrt(s), y[tr], w, c.alpha)(q @ u / np.sqrt(s))
    return out


CANDIDATES = [
    L.Candidate("ridge__all", alpha=2.0), L.Candidate("ridge__three", k=3, alpha=0.5), L.Candidate("pca__4", "pca", 4, 1.0),
    L.Candidate("short_weighted__ridge", alpha=1.0), L.Candidate("medium_weighted__pca", "pca", 3, 1.0), L.Candidate("short_male_weighted__ridge", k=4, alpha=1.0),
]
ALL = None


def collected(preds):
    out = {}
    for r in preds.collect():
        out.setdefault(r["candidate"], {})[r["id"]] = r["pred"]
    return out


def test_every_step_is_fitted_in_the_fold(spark):
    global ALL
    x, y, g, fold = table()
    ALL = x
    preds, failures = L.out_of_fold(frame(spark, x, y, g, fold), ["id", "y"], "v", "y", "g", "fold", 5, [*CANDIDATES, L.Candidate("broken", k=99), L.Candidate("odd", "none")])
    assert set(failures) == {"broken", "odd"} and failures["broken"].startswith("ValueError")
    got = collected(preds)
    assert set(got) == {c.name for c in CANDIDATES}
    for c in CANDIDATES:
        np.testing.assert_allclose([got[c.name][i] for i in range(len(y))], brute(x, y, g, fold, c), rtol=0, atol=1e-6)


def test_held_out_rows_change_nothing(spark):
    """The models of a fold stay the same whatever its own rows are."""
    x, y, g, fold = table()
    other_x, other_y = x.copy(), y.copy()
    other_x[fold == 2] = np.nan_to_num(other_x[fold == 2]) * 9.0 + 100.0
    other_x[fold == 2, 0] = np.nan
    other_y[fold == 2] += 500.0
    fitted = []
    for a, b in ((x, y), (other_x, other_y)):
        df = frame(spark, a, b, g, fold)
        sums = L.fold_sums(df, "v", "y", "g", "fold", 5, L.weightings_of(CANDIDATES))
        fitted.append(L.fit_candidates(df, "v", "y", "g", "fold", sums, [*CANDIDATES, L.Candidate("elastic", "elastic"), L.Candidate("huber", "huber")], [2])[0])
    for name in fitted[0]:
        np.testing.assert_allclose(fitted[0][name][2], fitted[1][name][2], rtol=1e-6, atol=1e-6)


def test_elastic_net_meets_its_conditions_and_picks_the_best_point(spark):
    global ALL
    x, y, g, fold = table(missing=0.0)
    ALL = x
    sums = L.fold_sums(frame(spark, x, y, g, fold), "v", "y", "g", "fold", 5)
    alphas, ratios = (3.0, 0.3, 0.01), (0.1, 0.9)
    fitted, chosen = L.elastic_coefficients(sums, [1], alphas, ratios)
    tr = fold != 1
    z = (x[tr] - x[tr].mean(axis=0)) / x[tr].std(axis=0)

    def solve(z, y, alpha, ratio):
        xx, yc = z - z.mean(axis=0), y - y.mean()
        b = L.elastic_path((xx.T @ xx)[None], (xx.T @ yc)[None], np.array([float(len(y))]), [alpha], np.array([ratio]))[0, 0]
        grad = xx.T @ (xx @ b - yc) / len(y) + alpha * (1 - ratio) * b
        assert np.all(np.where(b != 0, np.abs(grad + alpha * ratio * np.sign(b)), np.maximum(np.abs(grad) - alpha * ratio, 0)) < 1e-6)
        return b, y.mean() - z.mean(axis=0) @ b

    errors = {}
    for alpha in alphas:
        for ratio in ratios:
            e = []
            for turn in (0, 2, 3):
                inner = fold[tr] != turn
                b, a = solve(z[inner], y[tr][inner], alpha, ratio)
                e.append(np.mean((z[~inner] @ b + a - y[tr][~inner]) ** 2))
            errors[alpha, ratio] = np.mean(e)
    assert chosen[1] == min(errors, key=errors.get)
    b, a = solve(z, y[tr], *chosen[1])
    np.testing.assert_allclose(fitted[1][1:], b / x[tr].std(axis=0), atol=1e-6)
    assert fitted[1][0] == pytest.approx(a - (x[tr].mean(axis=0) / x[tr].std(axis=0)) @ b, abs=1e-5)


@pytest.mark.parametrize("weighting", ["plain", "short_weighted"])
def test_huber_meets_its_conditions(spark, weighting):
    x, y, g, fold = table(missing=0.0)
    df = frame(spark, x, y, g, fold)
    sums = L.fold_sums(df, "v", "y", "g", "fold", 5, [weighting])
    fitted, sigma = L.huber_coefficients(df, "v", "y", "g", "fold", sums, [0, L.NOTHING], weighting)
    for h in (0, L.NOTHING):
        tr = fold != h
        sd = x[tr].std(axis=0)
        z, w, s = (x[tr] - x[tr].mean(axis=0)) / sd, weights(weighting, y[tr], g[tr]), sigma[h]
        b = fitted[h][1:] * sd
        r = y[tr] - (fitted[h][0] + x[tr] @ fitted[h][1:])
        pull = w * np.where(np.abs(r) <= 1.35 * s, 2 * r / s, 2 * 1.35 * np.sign(r))
        assert np.abs(-z.T @ pull + 2 * L.HUBER_ALPHA * b).max() < 1e-3
        assert abs(pull.sum()) < 1e-3
        inside = np.abs(r) <= 1.35 * s
        assert abs(w.sum() - (w * r**2)[inside].sum() / s**2 - 1.35**2 * w[~inside].sum()) < 1e-3 * w.sum()
        assert (~inside).sum() > 2


def test_refit_predicts_new_rows(spark):
    global ALL
    x, y, g, fold = table()
    ALL = x
    df = frame(spark, x, y, g, fold)
    got = collected(L.refit_predict(df.where("id < 60"), df.where("id >= 60").drop("y", "fold"), ["id"], "v", "y", "g", "fold", 5, CANDIDATES[:1]))
    ALL = x[:60]
    q, z = design(x[:60], x[60:])
    want = weighted_ridge(z, y[:60], np.ones(60), 2.0)(q)
    np.testing.assert_allclose([got["ridge__all"][i] for i in range(60, 90)], want, atol=1e-6)


def test_a_mistake_in_the_code_is_raised(spark, monkeypatch):
    x, y, g, fold = table()
    df = frame(spark, x, y, g, fold)
    sums = L.fold_sums(df, "v", "y", "g", "fold", 5)
    monkeypatch.setattr(L, "best_columns", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        L.fit_candidates(df, "v", "y", "g", "fold", sums, CANDIDATES[:1], sums.folds)


@pytest.mark.parametrize(("rows", "block"), [(50_000, 10_000), (50_000, 7), (6, 10_000)])
def test_vector_statistics(spark, monkeypatch, rows, block):
    monkeypatch.setattr(V, "ENTITY_ROWS", rows)
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    sizes = [1, 2, 9, 30, 4, 8]
    data = []
    for e, n in enumerate(sizes):
        for v in rng.normal(size=(n, 4)):
            v[rng.random(4) < 0.2] = np.nan
            if e == 2:
                v[1] = np.nan
            data.append((None if e == 5 else f"e{e}", [None if np.isnan(a) else float(a) for a in v], float(rng.random() + 0.1), "clash"))
    data.append(("e0", None, 1.0, "clash"))
    df = spark.createDataFrame(data, "entity string, v array<double>, w double, mean string").repartition(4)
    got = {(r["entity"], r["dim"]): r for r in V.vector_statistics_long(df, "entity", "v", "w").collect()}
    assert len(got) == 6 * 4
    for e in {r[0] for r in data}:
        mine = [(v, w) for k, v, w, _ in data if k == e and v is not None]
        for d in range(4):
            x = np.array([v[d] for v, _ in mine if v[d] is not None])
            w = np.array([w for v, w in mine if v[d] is not None])
            r = got[e, d]
            assert r["n"] == len(x)
            if not len(x):
                assert r["mean"] is None and r["median"] is None and r["std"] is None
                continue
            want = [np.average(x, weights=w), x.std(), *np.percentile(x, [50, 10, 90])]
            np.testing.assert_allclose([r[c] for c in ("mean", "std", "median", "p10", "p90")], want, atol=1e-12)
    features = {r["entity"]: r["features"] for r in V.entity_vectors(df, "entity", "v", "w").collect()}
    assert all(len(f) == 4 * 5 + 5 for f in features.values()) and features["e3"][20] == 30.0


def test_vector_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "entity string, v array<double>, w double")
    assert V.vector_statistics_long(df, "entity", "v", "w").count() == 0
