"""Order statistics of frames against sorting each frame."""

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import order_stats
from tickloom.operators.order_stats import Frames, Quantile, Rank, frame_order


def plain(x, w):
    out = []
    for i in range(len(x)):
        f = x[max(i - w.rows + 1, 0) : i + 1]
        f = f[~np.isnan(f)]
        if len(f) < max(w.least, 1) or (isinstance(w, Rank) and np.isnan(x[i])):
            out.append(np.nan)
        elif isinstance(w, Quantile):
            out.append(np.quantile(f, w.q))
        else:
            out.append(0.5 if f.min() == f.max() else min(((f < x[i]).sum() + 0.5) / (len(f) - 1), 1))
    return np.array(out)


def series(rng, n, kind):
    x = {"ties": lambda: rng.integers(0, 4, n).astype(float), "normal": lambda: rng.normal(size=n), "flat": lambda: np.full(n, 7.0), "unknown": lambda: np.full(n, np.nan), "zeros": lambda: rng.choice([-0.0, 0.0, 1e300, -1e300], n)}[kind]()
    return np.where(rng.random(n) < 0.2, np.nan, x)


@pytest.mark.parametrize("kind", ["ties", "normal", "flat", "unknown", "zeros"])
@pytest.mark.parametrize("n", [0, 1, 2, 65, 300])
def test_frames(kind, n):
    x = series(np.random.default_rng(n), n, kind)
    f = Frames(x)
    for rows in (1, 2, 30, 500):
        for least in (1, 5):
            for q in (0.0, 0.05, 0.5, 0.8, 1.0):
                np.testing.assert_allclose(f.quantile(q, rows, least), plain(x, Quantile("x", q, rows, least)), rtol=1e-12)
            np.testing.assert_allclose(f.rank(rows, least), plain(x, Rank("x", rows, least)), rtol=1e-12)


def test_blocks(spark, monkeypatch):
    """Frames reach over blocks and days; columns of any kind stay as they are."""
    monkeypatch.setattr(order_stats, "BLOCK_ROWS", 40)
    rng, parts = np.random.default_rng(3), []
    for k, n in (("a", 700), ("b", 3), (None, 90)):
        parts.append(pd.DataFrame({"k": k, "trade_day": np.sort(rng.integers(0, 5, n)), "t": np.arange(n), "x": series(rng, n, "ties"), "big": 2**60 + np.arange(n)}))
    wide = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in wide.astype(object).itertuples(index=False)], "k string, trade_day int, t long, x double, big long").repartition(3)
    wanted = {"q": Quantile("x", 0.8, 50, 10), "r": Rank("x", 7, 2)}
    got = frame_order(df, ["k"], ["t"], wanted).toPandas()
    assert len(got) == len(wide)
    for part in parts:  # a NULL key is a key
        g = got[got.k.isna() if part.k.iloc[0] is None else got.k == part.k.iloc[0]].sort_values("t")
        assert g.big.tolist() == part.big.tolist()
        for n, w in wanted.items():
            np.testing.assert_allclose(g[n].astype(float), plain(part.x.to_numpy(), w), rtol=1e-12)
    by_day = frame_order(df, ["k", "trade_day"], ["t"], wanted).where("k = 'a'").toPandas().sort_values("t")
    want = parts[0].groupby("trade_day", group_keys=False).x.apply(lambda v: pd.Series(plain(v.to_numpy(), wanted["q"]), v.index))
    np.testing.assert_allclose(by_day.q.astype(float), want, rtol=1e-12)
    assert frame_order(df.where("t < 0"), ["k"], ["t"], wanted).count() == 0
