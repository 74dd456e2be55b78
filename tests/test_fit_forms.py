"""The digamma form of the fixed-point update on marginal histograms against plain finite sums
over the cells (psi(n + a) - psi(a) = sum of 1 / (a + k) for k < n)."""

import numpy as np

from ctrkit.operators import smoothing as B


def plain(s, t, w, rounds):
    a = b = 1.0
    harmonic = lambda n, x: sum(1.0 / (x + k) for k in range(int(n)))
    for _ in range(rounds):
        m = sum(c * harmonic(n, a + b) for n, c in zip(t, w))
        sa = sum(c * harmonic(n, a) for n, c in zip(s, w))
        sb = sum(c * harmonic(n, b) for n, c in zip(t - s, w))
        a, b = a * sa / m, b * sb / m
    return a, b


def test_marginal_fit_equals_finite_sums():
    rng = np.random.default_rng(11)
    for _ in range(5):
        t = rng.integers(1, 40, size=60).astype("float64")
        s = np.floor(t * rng.beta(2.0, 5.0, size=60))
        w = rng.integers(1, 9, size=60).astype("float64")
        parts = {}
        for name, n in (("s", s), ("f", t - s), ("t", t)):
            values, at = np.unique(n, return_inverse=True)
            parts[name] = values, np.bincount(at, w)
        a, b, n, _ = B._fit_histogram(parts, 1.0, 1.0, 30, 0.0)
        want = plain(s, t, w, 30)
        assert n == 30 and abs(a - want[0]) < 1e-8 * want[0] and abs(b - want[1]) < 1e-8 * want[1]


def test_null_groups_are_fitted_and_smoothed(spark):
    rows = [(g, c, c + n) for g in (None, "a") for c in range(6) for n in range(1, 6)]
    cells = spark.createDataFrame(rows, "factor_name string, clicks long, impressions long")
    fitted = {r.factor_name: r for r in B.fit_beta(cells, ["factor_name"]).collect()}
    assert set(fitted) == {None, "a"} and abs(fitted[None].alpha - fitted["a"].alpha) < 1e-9
    smoothed = B.fit_and_smooth(cells, ["factor_name"], adjust_counts=False).collect()
    assert len(smoothed) == len(rows)
    assert all(abs(r.ctr - (r.clicks + fitted["a"].alpha) / (r.impressions + fitted["a"].alpha + fitted["a"].beta)) < 1e-9
               for r in smoothed)
