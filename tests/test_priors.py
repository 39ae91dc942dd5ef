"""Priors, shadow and evidence against a plain version in numpy, on drawn pictures with a product, a shadow and an odd floor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqc.plans import priors as p
from tests.test_neighbourhood import label

SIDE = 12
SIZE = p.Sizes(SIDE, ring=1, enough=6, smoothing=1, growth=1, most_growth=3, halo=2, penumbra=1)
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def around(m):
    q = np.pad(m, 1)
    return np.stack([q[1 + a : 1 + a + SIDE, 1 + b : 1 + b + SIDE] for a, b in CROSS])


def dilate(m, n):
    for _ in range(n):
        m = around(m).max(0)
    return m


def erode(m, n):
    for _ in range(n):
        m = around(m).min(0)
    return m


def measures(rgb):
    lum = rgb @ np.array([0.299, 0.587, 0.114])
    e = np.pad(lum, 1, mode="edge")
    edge = np.hypot((e[1:-1, 2:] - e[1:-1, :-2]) / 2, (e[2:, 1:-1] - e[:-2, 1:-1]) / 2)
    w = np.pad(lum, 2, mode="edge")
    tex = np.stack([w[a : a + SIDE, b : b + SIDE] for a in range(5) for b in range(5)]).std(0)
    ring = np.ones((SIDE, SIDE), bool)
    ring[SIZE.ring : -SIZE.ring, SIZE.ring : -SIZE.ring] = False
    bg, std = np.median(lum[ring]), lum[ring].std()
    d_col = np.sqrt(((rgb - rgb[ring].mean(0)) ** 2).sum(2))
    return lum, edge, tex, bg, std, np.abs(lum - bg), d_col, (rgb >= 248).all(2)


def raw_prior(m):
    lum, edge, tex, bg, std, d_lum, d_col, white = m
    like = (d_lum <= max(16, 1.8 * std)) & (d_col <= 26)
    on = ~white & ~like & ((lum <= bg - max(22, 0.85 * std)) | (lum >= bg + max(28, 1.1 * std)) | (d_col >= 42) | ((edge >= 16) & (tex >= 7) & (d_lum >= 14)))
    k = SIZE.smoothing
    on = erode(dilate(dilate(erode(on, k), k), k), k)
    labels = label(on, CROSS)
    parts = sorted(((int((labels == n).sum()), n) for n in np.unique(labels[labels > 0])), reverse=True)
    kept, held = [], 0
    for n, name in parts[:3]:
        if n < max(SIZE.enough, 0.004 * SIDE * SIDE):
            break
        kept.append(name)
        held += n
        if held / SIDE**2 >= 0.42:
            break
    return np.isin(labels, kept or [name for _, name in parts[:1]]) & (labels > 0)


def near(soft, portion, margins):
    ys, xs = np.nonzero(soft)
    top, bottom, left, right = ys.min(), ys.max(), xs.min(), xs.max()
    h, w = bottom - top + 1, right - left + 1
    grown = dilate(soft, int(min(SIZE.most_growth, max(SIZE.growth, portion * max(h, w) / 3))))
    room, (my, mx) = np.zeros_like(soft), margins(h, w)
    room[max(0, top - my) : bottom + my + 1, max(0, left - mx) : right + mx + 1] = True
    return grown & room


def mask_prior(m, alpha):
    _, edge, tex, *_, white = m
    soft = alpha >= 40
    if soft.sum() < SIZE.enough:
        return raw_prior(m)
    margin = lambda h, w: (int(0.22 * max(h, w)),) * 2
    bars = max(5.5, np.percentile(edge[soft], 50)), max(4.0, np.percentile(tex[soft], 48))
    return near(soft, 0.12, margin) & ~white & ((edge >= bars[0]) | (tex >= bars[1]) | (alpha >= 80))


def shadow(m, alpha):
    lum, edge, tex, bg, std, d_lum, d_col, white = m
    soft, solid = alpha >= 40, alpha >= 80
    darker = lum <= bg - max(8, 0.35 * std)
    return (dilate(soft, SIZE.halo) & ~solid & darker & (edge < 10) & (tex < 6.5) & (d_col < 28) & ~white) | (dilate(soft, SIZE.penumbra) & ~solid & darker & (edge < 8) & (tex < 5) & (d_lum < 55))


def evidence(m, alpha, unreliable):
    lum, edge, tex, bg, std, d_lum, d_col, white = m
    soft, solid, prior, shade = alpha >= 40, alpha >= 80, raw_prior(m), shadow(m, alpha)
    if not unreliable and 0 < prior.mean() <= 0.42:
        return prior & ~white & ~shade, 1.0, "independent_prior"
    if not soft.any():
        return prior & ~white & ~shade, 0.0, "structured_near_support"
    core = solid if solid.any() else soft
    e, t = (max(7.0, np.percentile(edge[core], 52)), max(5.0, np.percentile(tex[core], 50))) if core.sum() >= SIZE.enough else (9.0, 7.0)
    formed = (edge >= e) | (tex >= t) | (d_col >= 36)
    like = (d_lum <= max(14, 1.6 * std)) & (d_col <= 24)
    found = near(soft, 0.14, lambda h, w: (int(0.28 * h), int(0.28 * w))) & ~white & ~shade & ~like & formed
    if 0 < prior.mean() < 0.85:
        found &= prior | soft
    found |= solid & ~white & ~shade
    return found, (found & formed).sum() / max(1, found.sum()), "structured_near_support"


def picture(rng, k):
    floor = rng.choice([120.0, 200.0, 250.0]) + rng.normal(0, rng.choice([0, 2, 12]), (SIDE, SIDE, 1)) + rng.normal(0, 1, (SIDE, SIDE, 3))
    alpha = rng.integers(0, 40, (SIDE, SIDE)).astype(float)
    for _ in range(rng.integers(0, 4)):
        y, x, h, w = *rng.integers(1, SIDE - 4, 2), *rng.integers(2, 8, 2)
        floor[y : y + h, x : x + w] = rng.integers(0, 256, 3) + rng.normal(0, rng.choice([0, 15]), (*floor[y : y + h, x : x + w].shape[:2], 3))
        alpha[y : y + h, x : x + w] = rng.choice([60.0, 120.0, 255.0])
        if k % 3 == 0:  # a wide, flat shadow below, on which the mask is faint
            floor[y + h :] = floor[0, 0] - 14
            alpha[y + h :] = 50
    if k % 7 == 0:
        alpha[:] = 0
    return np.clip(np.round(floor), 0, 255), alpha


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(11)
    made = [picture(rng, k) for k in range(60)] + [(np.zeros((SIDE, SIDE, 3)), np.zeros((SIDE, SIDE))), (np.full((SIDE, SIDE, 3), 255.0), np.full((SIDE, SIDE), 255.0))]
    rows = [(k, *(x[..., c].ravel().tolist() for c in range(3)), a.ravel().tolist()) for k, (x, a) in enumerate(made)]
    table = spark.createDataFrame(rows, "id int, r array<double>, g array<double>, b array<double>, alpha array<double>")
    told = p.contact_shadow(p.anchored_prior(p.raw_prior(p.background(table, SIZE), SIZE), SIZE), SIZE)
    told = p.product_evidence(told, SIZE, F.col("id") % 2 == 0).drop("luma", "edge", "texture", "white", "d_luma", "d_colour")
    return made, {r.id: r for r in told.collect()}


def test_priors_shadow_and_evidence(judged):
    made, found = judged
    seen = dict.fromkeys(("prior", "mask_prior", "shadow", "evidence", "near"), 0)
    for k, (rgb, alpha) in enumerate(made):
        m, r = measures(rgb), found[k]
        raster = lambda name, r=r: np.array(r[name]).reshape(SIDE, SIDE) >= 1
        ev, formed, mode = evidence(m, alpha, k % 2 == 0)
        for name, want in (("prior", raw_prior(m)), ("mask_prior", mask_prior(m, alpha)), ("shadow", shadow(m, alpha)), ("evidence", ev)):
            assert (raster(name) == want).all(), (k, name)
            seen[name] += int(want.any())
        assert r.evidence_mode == mode and abs(r.structured_evidence_frac - formed) < 1e-9
        assert r.evidence_pixels == ev.sum() and abs(r.prior_shadow_excluded - shadow(m, alpha).mean()) < 1e-9
        seen["near"] += mode != "independent_prior"
    assert all(n >= 4 for n in seen.values()), seen
