import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqc.functions import neighbourhood as n

SIDE = 7


def label(mask, shape):
    """Flood fill; a component's label is its largest place, from 1."""
    out = np.zeros(mask.shape, int)
    for at in sorted(zip(*np.nonzero(mask), strict=True), reverse=True):
        if out[at]:
            continue
        todo, name = [at], at[0] * mask.shape[1] + at[1] + 1
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = name
                todo += [(y + a, x + b) for a, b in shape]
    return out


def snake():
    m = np.zeros((SIDE, SIDE), int)
    m[::2] = 1
    m[1, -1] = m[3, 0] = m[5, -1] = 1
    return m


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(3)
    made = [(rng.random((SIDE, SIDE)) < p).astype(int) for p in (0.0, 0.3, 0.5, 0.6, 0.8, 1.0) for _ in range(3)] + [snake()]
    table = spark.createDataFrame([(i, m.ravel().astype(float).tolist(), (m * 40.0 + np.arange(SIDE * SIDE).reshape(SIDE, SIDE)).ravel().tolist()) for i, m in enumerate(made)], "id int, m array<double>, v array<double>")
    return made, table


def got(table, column):
    return {r.id: np.array(r.x).reshape(SIDE, SIDE) if r.x is not None and len(r.x) == SIDE * SIDE else r.x for r in table.select("id", column.alias("x")).collect()}


@pytest.mark.parametrize("shape", [n.CROSS, n.SQUARE])
def test_components(cases, shape):
    made, table = cases
    found = got(table, n.components(F.col("m"), SIDE, shape))
    for i, m in enumerate(made):
        assert (found[i] == label(m, shape)).all(), m
    sizes = {r.id: r.x for r in table.select("id", n.sizes(n.components(F.col("m"), SIDE, shape)).alias("x")).collect()}
    for i, m in enumerate(made):
        assert sizes[i] == sorted(np.unique(label(m, shape)[m > 0], return_counts=True)[1].tolist(), reverse=True)


def test_holes_are_filled(cases):
    made, table = cases
    found = got(table, n.filled(F.col("m"), SIDE))
    for i, m in enumerate(made):
        around = label(1 - np.pad(m, 1), n.CROSS)
        assert (found[i] == (around != around[0, 0])[1:-1, 1:-1]).all()


@pytest.mark.parametrize("shape", [n.CROSS, n.SQUARE])
def test_morphology(cases, shape):
    made, table = cases
    shifted = lambda m: [np.pad(m, 1)[1 + a : 1 + a + SIDE, 1 + b : 1 + b + SIDE] for a, b in shape]
    big, small = (lambda m: np.max(shifted(m), 0)), (lambda m: np.min(shifted(m), 0))
    m = F.col("m")
    for column, want in ((n.dilated(m, SIDE, shape), big), (n.eroded(m, SIDE, shape), small), (n.opened(m, SIDE, shape), lambda x: big(small(x))), (n.closed(m, SIDE, shape), lambda x: small(big(x)))):
        found = got(table, column)
        for i, x in enumerate(made):
            assert (found[i] == want(x)).all()


def test_gradient_and_spread(cases):
    made, table = cases
    grad, std = got(table, n.gradient(F.col("v"), SIDE)), got(table, n.local_std(F.col("v"), SIDE, 3))
    for i, m in enumerate(made):
        v = np.pad(m * 40.0 + np.arange(SIDE * SIDE).reshape(SIDE, SIDE), 1, mode="edge")
        assert np.allclose(grad[i], np.hypot((v[1:-1, 2:] - v[1:-1, :-2]) / 2, (v[2:, 1:-1] - v[:-2, 1:-1]) / 2))
        windows = np.stack([v[a : a + SIDE, b : b + SIDE] for a in range(3) for b in range(3)])
        assert np.allclose(std[i], windows.std(0), atol=1e-6)


def test_box(cases):
    made, table = cases
    found = {r.id: r.x for r in table.select("id", n.box(F.col("m"), SIDE).alias("x")).collect()}
    for i, m in enumerate(made):
        ys, xs = np.nonzero(m)
        assert (tuple(found[i]) if found[i] else None) == ((ys.min(), ys.max(), xs.min(), xs.max()) if len(ys) else None)
