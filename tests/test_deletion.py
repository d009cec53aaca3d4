"""Case deletion and separation against dense algebra and constructed data."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.plan_size import f_quantile, incomplete_beta
from tallyspark.operators import inference, logistic

TERMS = {"za": ("a", "identity"), "zb": ("b", "identity")}
BOTH = {"Both": logistic.Model(("za", "zb"), 0.0)}


def test_distribution_functions():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert incomplete_beta(0.5, 0.5, 0.3) == pytest.approx(2 / math.pi * math.asin(math.sqrt(0.3)))
    # the median of F(2, m) is m/2 (2^(2/m) - 1); F(m, m) has median 1
    assert f_quantile(0.5, 2, 37) == pytest.approx(37 / 2 * (2 ** (2 / 37) - 1)) and f_quantile(0.5, 9, 9) == pytest.approx(1)


def test_deletion_measures(spark):
    r = np.random.default_rng(2)
    n = 60
    a, b = r.normal(size=n), r.normal(size=n)
    y = (r.random(n) < 1 / (1 + np.exp(-a))).astype(int)
    a[0], y[0] = 6.0, 0
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), int(y[i])) for i in range(n)], "i int, a double, b double, y int")
    fit = logistic.fit_batch(df, "y", TERMS, BOTH).get("Both")
    got = {x.i: x for x in inference.deletion(df, "y", fit, TERMS, ["i"]).collect()}
    x = np.column_stack([np.ones(n), (a - fit.center[0]) / fit.scale[0], (b - fit.center[1]) / fit.scale[1]])
    p = 1 / (1 + np.exp(-x @ fit.beta))
    w = p * (1 - p)
    xw = x * np.sqrt(w)[:, None]
    e = np.sign(y - p) * np.sqrt(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)))
    info = xw.T @ xw
    h = np.einsum("ij,jk,ik->i", xw, np.linalg.inv(info), xw)
    full = np.sum(e**2) / (n - 3)
    flags = 0
    for i in range(n):
        keep = np.arange(n) != i
        # the weighted least-squares step on residuals, with and without the row
        less = np.linalg.inv(xw[keep].T @ xw[keep])
        change = np.linalg.inv(info) @ xw.T @ e - less @ xw[keep].T @ e[keep]
        rest = e[keep] - xw[keep] @ (less @ xw[keep].T @ e[keep])
        whole = e - xw @ (np.linalg.inv(info) @ xw.T @ e)
        del rest, whole
        si = math.sqrt((np.sum(e**2) - e[i] ** 2 / (1 - h[i])) / (n - 4))
        step = np.linalg.inv(info) @ xw[i] * e[i] / (1 - h[i])
        dfbetas = step / (si * np.sqrt(np.diag(np.linalg.inv(info))))
        ratio = (si**2 / full) ** 3 * np.linalg.det(info) / np.linalg.det(xw[keep].T @ xw[keep])
        cook = (y[i] - p[i]) ** 2 / w[i] * h[i] / (3 * (1 - h[i]) ** 2)
        g = got[i]
        assert [g.dfbeta_intercept, g.dfbeta_za, g.dfbeta_zb] == pytest.approx(list(dfbetas), abs=1e-6)
        assert g.covariance_ratio == pytest.approx(ratio, rel=1e-6) and g.cook == pytest.approx(cook, rel=1e-6) and g.leverage == pytest.approx(h[i], rel=1e-6)
        assert g.dffits == pytest.approx(e[i] * math.sqrt(h[i]) / (si * (1 - h[i])), rel=1e-6)
        want = [h[i] > 9 / n, abs(g.dffits) > 3 * math.sqrt(3 / (n - 3)), cook > f_quantile(0.5, 3, n - 3), abs(1 - ratio) > 9 / (n - 3), max(abs(dfbetas)) > 1]
        assert [g[f] for f in inference.DELETION_FLAGS] == want and g.influential == any(want)
        flags += any(want)
        assert np.all(np.isfinite(change))
    assert got[0].influential and flags < n / 2


def test_separation(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a, b = float(r.normal()), float(r.normal())
        rows.append((i, i % 3 + 1, a, b, int(a + 0.2 * b > 0), int(r.random() < 1 / (1 + math.exp(-a))), int(b > 0 or i % 2), float(b > 0)))
    df = spark.createDataFrame(rows, "i int, fold int, a double, b double, cut int, mixed int, half int, over double")
    m = {"Both": logistic.Model(("za", "zb"), 0.0)}

    def kinds(y, terms=TERMS, models=m):
        return {(x.model, x.fold): (x.separation, x.training_events, x.events_per_slope) for x in inference.separation(df, y, "fold", (1, 2, 3), models, terms).collect()}

    cut, mixed = kinds("cut"), kinds("mixed")
    assert {v[0] for v in cut.values()} == {"complete"} and {v[0] for v in mixed.values()} == {"none"}
    # one value of an indicator has a single outcome, the other has both
    terms = {"zo": ("over", "identity"), "za": ("a", "identity")}
    half = kinds("half", terms, {"Indicator": logistic.Model(("zo",), 0.0)})
    assert {v[0] for v in half.values()} == {"quasi-complete"}
    for f in (1, 2, 3):
        e = sum(x[5] for x in rows if x[1] != f)
        assert mixed["Both", f][1:] == (e, e / 2)


def test_loss_of_a_separated_fit_keeps_its_digits():
    y = np.tile([0, 1], 50_000)
    batch = pa.RecordBatch.from_pydict({"y": y, "fold": np.ones(len(y), dtype=np.int32), "n": np.ones(len(y), dtype=np.int32), "z0": np.where(y, 1.0, -1.0)})
    beta = np.array([[0.3], [24.0]])
    out = next(logistic._statistics(iter([batch]), 1, [([0], logistic.NO_FOLD, [0, 1], np.array([0]), beta)], 6)).to_pydict()
    losses = [math.log1p(math.exp(-24.3)), math.log1p(math.exp(-23.7))]
    assert out["s0"][0] == pytest.approx(50_000 * sum(losses), rel=1e-12)
    away = [-1 / (1 + math.exp(24.3)), 1 / (1 + math.exp(23.7))]
    assert out["s1"][0] == pytest.approx(50_000 * sum(away), rel=1e-12) and out["s2"][0] == pytest.approx(50_000 * (away[0] - away[1]), rel=1e-12)
