"""Measures of masks, cutouts and finished pictures against a plain version in numpy, on drawn pictures and odd ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqc.plans import measures as m
from tests.test_neighbourhood import label

SIDE = 12
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
NEED = m.Need(foreground=6, solid=3, band=3, band_radius=1, prior=6, fallback=4, tones=4, selective=8, edges=4)


def gradient(x):
    e = np.pad(x, 1, mode="edge")
    return np.hypot((e[1:-1, 2:] - e[1:-1, :-2]) / 2, (e[2:, 1:-1] - e[:-2, 1:-1]) / 2)


def deviations(x):
    w = np.pad(x, 2, mode="edge")
    return np.stack([w[a : a + SIDE, b : b + SIDE] for a in range(5) for b in range(5)]).std(0)


def drawn():
    """(colours, alpha, finished colours): noise, products with soft rims, washed out ones, specks and no product at all."""
    rng = np.random.default_rng(4)
    for k in range(24):
        rgb = rng.integers(225, 256, (SIDE, SIDE, 3)).astype(float)
        alpha = np.zeros((SIDE, SIDE))
        top, left, size = rng.integers(1, 4), rng.integers(1, 4), [0, 1, 2, 5, 7, 8][k % 6]
        alpha[top - 1 : top + size + 1, left - 1 : left + size + 1] = 90 if size else 0
        alpha[top : top + size, left : left + size] = 255
        rgb[top : top + size, left : left + size] = rng.integers(0, 256, (size, size, 3)) if k % 4 else rng.integers(246, 256, (size, size, 3))
        if k % 5 == 4:  # part of the product is lost
            alpha[: SIDE // 2] = 0
        out = np.floor((rgb * alpha[..., None] + (255 - alpha[..., None]) * 255) / 255 + 0.5)
        yield rgb, alpha, np.full_like(out, 252.0) if k % 7 == 3 else out
    yield rng.integers(0, 256, (SIDE, SIDE, 3)).astype(float), rng.integers(0, 256, (SIDE, SIDE)).astype(float), rng.integers(0, 256, (SIDE, SIDE, 3)).astype(float)
    yield np.zeros((SIDE, SIDE, 3)), np.full((SIDE, SIDE), 255.0), np.zeros((SIDE, SIDE, 3))


PICTURES = list(drawn())


@pytest.fixture(scope="module")
def pictures(spark):
    flat = lambda x: [float(v) for v in np.asarray(x).ravel()]
    rng, rows = np.random.default_rng(8), []
    for k, (rgb, alpha, out) in enumerate(PICTURES):
        luma = rgb @ np.array([0.299, 0.587, 0.114])
        prior, near = (alpha >= 80) ^ (rng.random(alpha.shape) < 0.05), (alpha >= 40) & (rng.random(alpha.shape) < 0.9)
        rows.append((k, *(flat(rgb[..., i]) for i in range(3)), flat(alpha), *(flat(out[..., i]) for i in range(3)), flat(prior), flat(near), flat(luma), flat(gradient(luma)), flat(deviations(luma))))
    lists = "r g b alpha out_r out_g out_b prior mask_prior luma edge texture".split()
    schema = "k long, " + ", ".join(f"{n} array<double>" for n in lists)
    return spark.createDataFrame([*rows, (-1, *[None] * len(lists))], schema)


def close(got, want, names):
    for name in names:
        assert (got[name] is None and want[name] is None) or got[name] == pytest.approx(want[name], abs=1e-6), name


def test_mask_confidence(pictures):
    got = {r.k: r for r in m.mask_confidence(pictures, SIDE).collect()}
    for k, (_, a, _) in enumerate(PICTURES):
        soft, solid = a >= 40, a >= 128
        n = max(1, soft.sum())
        border = np.concatenate([soft[0], soft[-1], soft[:, 0], soft[:, -1]]).mean()
        pieces, mean, fog = len(set(label(solid, CROSS).ravel()) - {0}), a[soft].sum() / n, ((a >= 40) & (a < 140)).sum() / n
        costs = [0.55 * (soft.mean() < 0.01), 0.35 * (soft.mean() > 0.55), 0.18 * (border > 0.15), 0.22 * (pieces >= 8), 0.10 * (4 <= pieces < 8), 0.08 * (solid.any() and 1 - solid.sum() / n > 0.45), 0.15 * (fog > 0.55), 0.12 * (mean < 95)]
        close(got[k], {"confidence": max(0.0, 1 - sum(costs)), "border_hit": border, "n_components": pieces, "fog_ratio": fog, "mean_alpha_soft": mean}, ["confidence", "border_hit", "n_components", "fog_ratio", "mean_alpha_soft"])
        assert len(got[k].warnings) == sum(c > 0 for c in costs)
    assert got[-1].confidence is None
    assert got[0].warnings == ["tiny_foreground", "weak_alpha"]


def test_cutout(pictures):
    said = m.cutout_said(F.lit(False), NEED)
    got = {r.k: r for r in m.cutout_measures(pictures, SIDE, NEED).select("*", *(v.alias(k) for k, v in said.items())).collect()}
    for k, (rgb, a, _) in enumerate(PICTURES):
        fg, solid = a >= 40, a >= 160
        e = np.pad(solid, 1)
        ring = np.stack([e[i : i + SIDE, j : j + SIDE] for i in range(3) for j in range(3)]).max(0) & ~solid & fg
        seen = rgb[solid]
        want = dict.fromkeys(("visibility", "solid_std", "near_white_in_solid", "edge_band_frac", "edge_band_mean_alpha", "roi_solid_fill"))
        want["fog_of_fg"] = ((a >= 40) & (a < 150)).sum() / fg.sum() if fg.any() else 1.0
        want["solid_of_fg"] = solid.sum() / max(1, fg.sum())
        if fg.any():
            sides = []
            for on in (np.flatnonzero(fg.any(1)), np.flatnonzero(fg.any(0))):
                low, high = on[0], on[-1] + 1
                pad = max(1, int((high - low) * 0.03))
                sides.append(min(SIDE, high + pad) - max(0, low - pad))
            want["roi_solid_fill"] = solid.sum() / (sides[0] * sides[1])
        if solid.sum() >= 3:
            want |= {"visibility": (255 - seen).max(1).mean(), "solid_std": seen.std(), "near_white_in_solid": (seen >= 245).all(1).mean()}
            if fg.sum() > solid.sum() and ring.sum() >= 3:
                want |= {"edge_band_frac": ring.sum() / fg.sum(), "edge_band_mean_alpha": a[ring].mean()}
        close(got[k], want, want)
        if fg.sum() < 6:
            assert (got[k].bads, got[k].warns, got[k].posits) == (["foreground_too_small"], [], [])
        elif solid.sum() < 3:
            assert got[k].bads[-1] == "foggy_alpha_edges"
        elif want["visibility"] < 8:
            assert "product_faded" in got[k].bads
    assert any("product_faded" in r.bads for r in got.values() if r.bads) and any("dark_high_contrast" in r.posits for r in got.values() if r.posits)
    assert got[-1].visibility is None


def test_integrity(pictures):
    made = m.integrity_measures(pictures, SIDE, NEED).withColumn("foreground_survival_score", F.lit(90.0))
    said = m.integrity_said(NEED)
    got = {r.k: r for r in made.select("*", *(v.alias(k) for k, v in said.items())).collect()}
    modes = set()
    for row in pictures.where("k >= 0").collect():
        grid = lambda name: np.array(row[name]).reshape(SIDE, SIDE)  # noqa: E731, B023
        rgb_out, a, luma, edge, texture = PICTURES[row.k][2], grid("alpha"), grid("luma"), grid("edge"), grid("texture")
        ol = rgb_out @ np.array([0.299, 0.587, 0.114])
        oe, ot, prior = gradient(ol), deviations(ol), grid("prior") >= 1
        mode = "independent"
        if prior.mean() > 0.42:
            prior, mode = grid("mask_prior") >= 1, "mask_anchored"
        small = False
        if prior.sum() < 6:
            prior, mode = a >= 40, "alpha_fallback"
            small = prior.sum() < 4
        modes.add(mode)
        n, kept, mid, dark = max(1, prior.sum()), prior & (a >= 80), prior & (luma >= 95) & (luma <= 220), prior & (luma < 95)
        bar = max(6.0, np.percentile(edge[prior], 70)) if prior.any() else 10.0
        strong, lit = prior & (edge >= bar), prior & (luma < 245)
        want = {
            "prior_kept_frac": kept.sum() / n, "prior_wipe_frac": (prior & (a < 48)).sum() / n, "mid_prior_wipe": (mid & (a < 48)).sum() / mid.sum() if mid.sum() >= 4 else 0.0,
            "dark_prior_wipe": (dark & (a < 48)).sum() / dark.sum() if dark.sum() >= 4 else 0.0, "texture_ratio": ot[kept].mean() / max(1e-3, texture[kept].mean()) if kept.any() else 0.0,
            "edge_energy_ratio": oe[kept].mean() / max(1e-3, edge[kept].mean()) if kept.any() else 0.0, "strong_edge_keep": (strong & (a >= 80)).sum() / strong.sum() if strong.sum() >= 4 else kept.sum() / n,
            "whiteout_frac": (lit & (a >= 40) & (rgb_out >= 248).all(2) & (ot < 3.5)).sum() / max(1, lit.sum()), "blown_frac": (lit & (a >= 80) & (luma < 200) & (ol >= 245) & (ot < 5)).sum() / max(1, lit.sum()),
        }
        close(got[row.k], want, want)
        assert got[row.k].prior_mode == mode
        if small:
            assert got[row.k].bads == ["empty_or_tiny_foreground"] and got[row.k].structure_preservation_score == 8.0 and got[row.k].raw_final_integrity is None
        elif max(want["whiteout_frac"], want["blown_frac"]) >= 0.28:
            assert "product_whiteout" in got[row.k].bads and got[row.k].foreground_overexposure_score <= 22
    assert modes == {"independent", "mask_anchored", "alpha_fallback"}
    assert any("product_whiteout" in r.bads for r in got.values() if r.bads) and -1 in got
