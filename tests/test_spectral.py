"""Spectral features of whole series against numpy."""

import numpy as np

from larkspur.operators.aggregates import spectral_features


def test_whole_series_by_default(spark):
    t = np.arange(400)
    series = {1: np.sin(2 * np.pi * t / 100), 2: 0.1 * t[:90] + np.cos(2 * np.pi * 40 * t[:90] / 90), 3: t[:1] + 2.0}
    rows = [(u, int(i), float(v)) for u, x in series.items() for i, v in enumerate(x)]
    got = {r.u: r for r in spectral_features(spark.createDataFrame(rows, "u int, i bigint, x double"), ["u"], "i", "i", "x").collect()}
    assert got.keys() == series.keys() and got[1].dominant == 4 and got[3].dominant is None
    for u, x in series.items():
        mag = np.abs(np.fft.rfft(x))
        assert len(mag) < 2 or got[u].dominant == np.argmax(np.round(mag[1:], 6)) + 1
        assert np.isclose(got[u].energy, (mag ** 2).sum()) and np.isclose(got[u].high_share, mag[30:].sum() / (mag.sum() + 1e-10))
