"""Aggregates of spreads against plain loops and pandas."""

import numpy as np
import pandas as pd

from tickloom.operators import recursive, spreads


def test_against_loops(spark):
    rng, frames = np.random.default_rng(2), []
    for c, n in (("a", 400), ("b", 3), ("flat", 60)):
        vol = np.zeros(n) if c == "flat" else np.where(rng.random(n) < 0.2, 0, rng.random(n))
        frames.append(pd.DataFrame({"k": c, "row_at": np.arange(n), "x": rng.normal(10, 2, n), "v": rng.integers(0, 3, n).astype(float), "vol": vol}))
    df = spark.createDataFrame(pd.concat(frames)).repartition(3)
    got = spreads.adaptive_means(df, ["k"], "row_at", "vol", {"a20": ("x", 20), "a5": ("x", 5)})
    got = spreads.decayed_means(got, ["k"], ["row_at"], "row_at", {"e": ("x", 30)})
    got = spreads.volume_means(got, ["k"], ["row_at"], "v", {"w": ("x", 25)}).toPandas().sort_values(["k", "row_at"], ignore_index=True)
    assert len(got) == 463
    for f in frames:
        g = got[got.k == f.k[0]]
        for name, base in (("a20", 20), ("a5", 5)):
            np.testing.assert_allclose(g[name], recursive.adaptive_mean(f.x.to_numpy(), f.vol.to_numpy(), base), rtol=1e-9)
        np.testing.assert_allclose(g.e, f.x.ewm(span=30, adjust=False).mean(), rtol=1e-9)
        num, den = (f.x * f.v).rolling(25, 1).sum(), f.v.rolling(25, 1).sum()
        np.testing.assert_allclose(g.w.astype(float), np.where(den > 0, num / den.where(den > 0, 1), np.nan), rtol=1e-9)
