import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqc.functions import filters as f

H, W = 6, 9


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(8)
    made = [rng.integers(0, 256, (H, W)).astype(float) for _ in range(6)] + [np.zeros((H, W)), np.full((H, W), 7.0)]
    masks = [(rng.random((H, W)) < p).astype(float) for p in (0.0, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9, 1.0)]
    rows = [(i, v.ravel().tolist(), m.ravel().tolist()) for i, (v, m) in enumerate(zip(made, masks, strict=True))] + [(99, None, None)]
    return made, masks, spark.createDataFrame(rows, "id int, v array<double>, m array<double>")


def got(table, column, shape=(H, W)):
    return {r.id: None if r.x is None else np.array(r.x, float).reshape(shape) for r in table.select("id", column.alias("x")).collect()}


def same(found, want):
    assert found.pop(99) is None
    for i, w in enumerate(want):
        assert np.allclose(found[i], w, atol=1e-8), i


def windows(v, r):
    p = np.pad(v, r, mode="edge")
    return np.stack([p[a : a + v.shape[0], b : b + v.shape[1]] for a in range(2 * r + 1) for b in range(2 * r + 1)])


@pytest.mark.parametrize("radius", [1, 2, 7])
def test_windows(cases, radius):
    made, _, table = cases
    same(got(table, f.box_mean(F.col("v"), H, W, radius)), [windows(v, radius).mean(0) for v in made])
    same(got(table, f.maximum(F.col("v"), H, W, radius)), [windows(v, radius).max(0) for v in made])
    same(got(table, f.minimum(F.col("v"), H, W, radius)), [windows(v, radius).min(0) for v in made])


def test_local_deviation(cases):
    made, _, table = cases
    found = got(table, f.local_std(F.col("v"), H, W))
    assert found.pop(99) is None
    for i, v in enumerate(made):
        assert np.allclose(found[i], windows(v, 2).std(0), atol=1e-5)


def test_gaussian(cases):
    made, _, table = cases
    sigma, reach = 1.3, int(4 * 1.3 + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    two = np.outer(k / k.sum(), k / k.sum())
    want = [(windows(v, reach) * two.reshape(-1, 1, 1)).sum(0) for v in made]
    same(got(table, f.gaussian(F.col("v"), H, W, sigma)), want)


def test_guided_filter(cases):
    made, _, table = cases
    mean = lambda x: windows(x, 2).mean(0)
    want = []
    for v in made:
        i, p = v / 255, v[::-1] / 255
        a = (mean(i * p) - mean(i) * mean(p)) / (np.maximum(mean(i * i) - mean(i) ** 2, 0) + 1e-3)
        b = mean(p) - a * mean(i)
        want.append(mean(a) * i + mean(b))
    guide = F.transform("v", lambda x: x / 255)
    rows = F.flatten(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(H - 1)), lambda y: F.slice("v", y * W + 1, F.lit(W)))))
    same(got(table, f.guided(guide, F.transform(rows, lambda x: x / 255), H, W, 2, 1e-3)), want)


@pytest.mark.parametrize(("kernel", "half"), [("bilinear", 1), ("lanczos", 3)])
@pytest.mark.parametrize("shape", [(3, 4), (6, 9), (11, 20), (1, 1)])
def test_resampling(cases, kernel, half, shape):
    """Every new pixel is the mean of the old ones, weighed by the kernel stretched over both directions."""
    made, _, table = cases

    def weights(size, to):
        stretch, out = max(1.0, size / to), np.zeros((to, size))
        for k in range(to):
            for i in range(size):
                x = (i + 0.5 - (k + 0.5) * size / to) / stretch
                out[k, i] = max(0.0, 1 - abs(x)) if half == 1 else np.sinc(x) * np.sinc(x / 3) * (abs(x) < 3)
        return out / out.sum(1, keepdims=True)

    want = [weights(H, shape[0]) @ v @ weights(W, shape[1]).T for v in made]
    same(got(table, f.resampled(F.col("v"), H, W, *shape, kernel), shape), want)


def test_nearest_members(cases):
    made, masks, table = cases
    table = table.withColumn("n", f.nearest_member(F.col("m"), H, W))
    away, value = got(table, f.distances(F.col("n"))), got(table, f.nearest_values(F.col("n"), F.col("v")))
    for i, (v, m) in enumerate(zip(made, masks, strict=True)):
        places = sorted(zip(*np.nonzero(m), strict=True), reverse=True)
        for y in range(H):
            for x in range(W):
                best = min(places, key=lambda p: (p[0] - y) ** 2 + (p[1] - x) ** 2, default=None)
                assert away[i][y, x] == (1e6 if best is None else math.sqrt((best[0] - y) ** 2 + (best[1] - x) ** 2))
                assert value[i][y, x] == (0 if best is None else v[best])
