"""What the registered autoencoder is trained on."""

import numpy as np
import pytest

from simsift.operators import encode as enc
from simsift.operators import training
from simsift.plans import catalogue


def test_noise():
    x = np.arange(1.0, 1 + 50 * 16 * 32).reshape(50, -1)
    a, b = enc.noisy(x, 16, 3, 4, np.random.default_rng(1))
    a, b, x = (v.reshape(50, 16, 32) for v in (a, b, x))
    gone = (a == 0).all(axis=2)
    assert (gone.sum(axis=1) == 3).all() and len({tuple(g) for g in gone.tolist()}) > 10
    assert (a[~gone] == b[~gone]).all()  # words move alike
    moved = (b != x).any(axis=2).sum(axis=1)
    assert (moved <= 4).all() and moved.any()
    assert (np.sort(b[:, :, 0], axis=1) == x[:, :, 0]).all()


def test_the_autoencoder_sees_all_titles(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(rows, net, *_, **__):
        raise Seen(rows.count())

    monkeypatch.setattr(training, "fit", fit)
    sf = "/root/testdata/sf0.01"
    with pytest.raises(Seen) as seen:
        catalogue.autoencoder_codes(spark, sf)
    n = catalogue.titles(spark, sf).count()
    assert n > 256 and seen.value.args[0] == n
