"""What marks near pairs misses none, whatever the vectors, and stacked blocks give the rows of single ones."""

from __future__ import annotations

import numpy as np
import pytest

from lacuna.operators import neighbors as N
from lacuna.operators.tiles import Tile, distances, prepare

METRICS = ("cosine", "correlation", "manhattan", "chebyshev", "euclidean")


def _cases():
    pick = np.random.default_rng(3)
    wide = pick.standard_normal((160, 24))
    yield "normal", wide
    yield "far from zero", wide + 1e6
    yield "tiny", wide * 1e-9
    yield "large", wide * 1e12
    yield "whole numbers", np.round(wide * 2)
    yield "one far out", np.concatenate([wide, wide[:1] * 1e9])
    yield "scales", wide * 10.0 ** np.arange(-6, 18)
    yield "heavy tails", pick.standard_cauchy((160, 24))
    yield "copies", np.repeat(wide[:8], 20, axis=0)
    yield "equal", np.ones((50, 24))
    yield "one entry", wide[:, :1]
    yield "zeros", np.concatenate([wide, np.zeros((5, 24))])


@pytest.mark.parametrize("metric", METRICS)
def test_no_near_pair_is_missed(metric):
    for name, x in _cases():
        half = len(x) // 2
        a, b = prepare(x[:half], metric), prepare(x[half:], metric)
        d = distances(a, b, metric)
        for rank in (0, 3, 20):
            reach = np.sort(d, axis=1)[:, rank].copy()
            reach[::7] = -np.inf
            mask = Tile(a, b, metric).nearby(reach)
            assert not (mask[::7]).any(), name
            known = np.isfinite(reach) & (np.isfinite(d).all(axis=1) if metric == "correlation" else True)
            assert mask[known][d[known] <= reach[known, None]].all(), (name, rank)
            if name == "normal" and rank == 3:
                assert mask[known].mean() < 0.1, name  # 4 of 80 are as near


@pytest.mark.parametrize("metric", METRICS[2:])
def test_single_pairs_have_the_distance_of_whole_tiles(metric):
    for name, x in _cases():
        a = prepare(x, metric)
        d = distances(a, a, metric)
        i, j = np.divmod(np.arange(d.size), len(x))
        assert np.array_equal(Tile(a, a, metric).exact(i, j), d.ravel()), name


@pytest.mark.parametrize("metric", METRICS)
def test_small_blocks_are_computed_in_large_tiles(metric, monkeypatch):
    """Blocks of 8 rows meet in stacks: far fewer tiles than pairs of blocks, and the same nearest rows."""
    pick = np.random.default_rng(5)
    x = pick.standard_normal((256, 6))
    x[::5] = x[::5, :1]  # without spread

    def block(lo, donor, n=8):
        v, far = x[lo:lo + n], np.zeros((n, 1))
        keys = np.arange(lo, lo + n)
        return {"team": 0, "slot": 0, "is_donor": donor, "n": n, "ids": np.stack([keys, keys], axis=1).tobytes(), "mat": v.tobytes(), "counts": np.ones(n, np.int32).tobytes(),
                "keys": keys.tobytes(), "vals": b"", "far": far.tobytes(), "lo": far[0].tobytes(), "hi": far[0].tobytes(), "bound": b""}

    import pandas as pd
    rows = pd.DataFrame([block(lo, False) for lo in range(0, 256, 8)] + [block(lo, True) for lo in range(0, 256, 8)])
    tiles = []
    inner = N.Tile
    monkeypatch.setattr(N, "Tile", lambda *args: tiles.append(1) or inner(*args))
    found = pd.concat(N._tile_task(4, metric, 0, "<f8", 64)([rows]))
    assert len(tiles) == 16
    d = distances(prepare(x, metric), prepare(x, metric), metric)
    for q, got in found.groupby("h1"):
        want = sorted(zip(d[q], range(256)))[:4]
        assert sorted(zip(got["dist"], got["key"])) == [(v, c) for v, c in want]


def test_donors_without_a_wanted_cell_are_left_out(monkeypatch):
    """Three donors of four have no cell that a query lacks: they are no column of a tile, and the fills are those of all pairs."""
    pick = np.random.default_rng(7)
    x = pick.standard_normal((64, 5))
    vals = np.stack([np.arange(64.0), np.where(np.arange(64) % 4 == 0, np.arange(64.0), np.nan)], axis=1)
    far, ids = np.zeros((64, 1)), np.arange(64)
    row = {"n": 64, "ids": np.stack([ids, ids], axis=1).tobytes(), "mat": x.tobytes(), "counts": np.ones(64, np.int32).tobytes(), "keys": ids.tobytes(), "vals": vals.tobytes(),
           "far": far.tobytes(), "lo": far[0].tobytes(), "hi": far[0].tobytes(), "bound": b""}
    shapes, inner = [], N.Tile
    monkeypatch.setattr(N, "Tile", lambda a, b, metric: shapes.append((len(a[0]), len(b[0]))) or inner(a, b, metric))
    best = N._Best(N.Block(row, False, "cosine", 2, "<f8"), 3, 2)
    best.add([N.Block(row, True, "cosine", 2, "<f8")], "cosine")
    assert shapes == [(48, 16)]
    d = distances(prepare(x, "cosine"), prepare(x, "cosine"), "cosine")
    (found,) = best.rows()
    for q, got in found.groupby("h1"):
        assert [*zip(got["dist"], got["key"])] == sorted(zip(d[q][::4], range(0, 64, 4)))[:3] and (got["f"] == 1).all() and (got["value"] == got["key"]).all()
    assert found["h1"].nunique() == 48
