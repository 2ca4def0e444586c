"""Postings carry half a byte for each coordinate, and never count fewer agreements than there are."""

import numpy as np

from lumenframe.llm import nearcopies


def test_agreements_of_short_signatures():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**32, (2, 500, nearcopies.COORDINATES), np.uint32)
    same = rng.random(a.shape) < rng.random((500, 1))
    b[same] = a[same]
    low = [nearcopies._low(x) for x in (a, b)]
    assert low[0].shape == (500, 32) and low[0].dtype == np.uint8
    assert (nearcopies._agreements(*low) == ((a & 15) == (b & 15)).sum(1)).all()
    assert (nearcopies._agreements(*low) >= (a == b).sum(1)).all()
