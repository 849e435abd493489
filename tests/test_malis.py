import numpy as np
import pytest

from silvagrid.operators import malis
from silvagrid.session import small_frame


def brute(truth, pred):
    """All pixel pairs: maximin affinity by thresholding at every weight."""
    h, w, _ = truth.shape
    edges = [((r, c), (r + 1, c), 0) for r in range(h - 1) for c in range(w)] + [((r, c), (r, c + 1), 1) for r in range(h) for c in range(w - 1)]

    def comps(keep):
        parent = {(r, c): (r, c) for r in range(h) for c in range(w)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b, d in edges:
            if keep(a, d):
                parent[find(a)] = find(b)
        return {p: find(p) for p in parent}

    seg = comps(lambda a, d: truth[a][d] == 1)
    sizes = {}
    for s in seg.values():
        sizes[s] = sizes.get(s, 0) + 1
    levels = sorted({pred[a][d] for a, b, d in edges}, reverse=True)
    seen, loss = set(), 0.0
    nodes = list(seg)
    for level in levels:
        comp = comps(lambda a, d, t=level: pred[a][d] >= t)
        for i, p in enumerate(nodes):
            for q in nodes[i + 1:]:
                if comp[p] == comp[q] and (p, q) not in seen:
                    seen.add((p, q))
                    same = seg[p] == seg[q] and sizes[seg[p]] > 1
                    loss += (1 - level) ** 2 if same else level**2
    n = h * w
    return loss * 2 / (n * (n - 1))


def run(truth, pred):
    h, w, _ = truth.shape
    r, c = np.divmod(np.arange(h * w), w)
    return malis.window_loss(r, c, truth.reshape(-1, 2), pred.reshape(-1, 2))


def test_hand_example():
    pred = np.zeros((2, 2, 2))
    pred[0, 0] = (0.9, 0.4)
    pred[0, 1, 0], pred[1, 0, 1] = 0.8, 0.2
    truth = np.zeros((2, 2, 2))
    truth[0, 0, 0] = truth[0, 1, 0] = 1
    grad, loss = run(truth, pred)
    assert loss == pytest.approx(0.115)
    assert grad[0] == pytest.approx((0.1 / 6, -1.6 / 6)) and grad[1] == pytest.approx((0.2 / 6, 0)) and not grad[2:].any()


@pytest.mark.parametrize("levels", [None, 4])
def test_loss_matches_all_pairs(levels):
    rng = np.random.default_rng(7)
    for _ in range(5):
        pred = rng.random((6, 5, 2)) if levels is None else rng.integers(0, levels, (6, 5, 2)) / levels
        truth = (rng.random((6, 5, 2)) < 0.4).astype(float)
        _, loss = run(truth, pred)
        assert loss == pytest.approx(brute(truth, pred))


def test_gradient_is_the_descent_direction():
    rng = np.random.default_rng(8)
    pred, truth = rng.random((5, 5, 2)), (rng.random((5, 5, 2)) < 0.5).astype(float)
    grad, loss = run(truth, pred)
    for k in range(50):
        r, c, d = k // 10, k // 2 % 5, k % 2
        moved = pred.copy()
        moved[r, c, d] += 1e-7
        slope = (run(truth, moved)[1] - loss) / 1e-7
        assert slope == pytest.approx(-2 * grad[r * 5 + c, d], abs=1e-5)


def test_row_order_does_not_matter():
    rng = np.random.default_rng(9)
    pred, truth = rng.random((20, 2)), (rng.random((20, 2)) < 0.5).astype(float)
    r, c = np.divmod(np.arange(20), 5)
    grad, loss = malis.window_loss(r, c, truth, pred)
    mix = rng.permutation(20)
    grad2, loss2 = malis.window_loss(r[mix], c[mix], truth[mix], pred[mix])
    assert loss2 == pytest.approx(loss) and np.allclose(grad2, grad[mix])


def test_windows(spark):
    dims = small_frame(spark, [(0, 200, 90), (1, 30, 500)], "tile bigint, h bigint, w bigint")
    rows = malis.sample_windows(dims, 2.0, 3).collect()
    per_tile = {t: [x for x in rows if x["tile"] == t] for t in (0, 1)}
    assert len(per_tile[0]) == 200 * 90 * 2 // 4096 + 1 and len(per_tile[1]) == 30 * 500 * 2 // 4096 + 1
    for x in rows:
        h, w = (200, 90) if x["tile"] == 0 else (30, 500)
        assert 0 <= x["wr"] <= h - x["wh"] and 0 <= x["wc"] <= w - x["ww"] and x["wh"] == min(64, h)
    cover = malis.tiling_windows(dims, 64).collect()
    assert sum(x["wh"] * x["ww"] for x in cover if x["tile"] == 1) == 30 * 500
