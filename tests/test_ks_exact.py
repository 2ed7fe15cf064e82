import itertools
import math

import pytest

from faultline.operators.quality import exact_ks_p


def by_counting(n, m, gap):
    """Over all orders of n a's and m b's."""
    hits = 0
    for places in itertools.combinations(range(n + m), n):
        i, far = 0, 0
        for k in range(1, n + m + 1):
            i += (k - 1) in places
            far = max(far, abs(i * m - (k - i) * n))
        hits += far >= gap
    return hits / math.comb(n + m, n)


@pytest.mark.parametrize("n,m", [(1, 1), (3, 5), (6, 6), (7, 4)])
def test_equals_counting_every_order(n, m):
    for gap in range(0, n * m + 1):
        assert exact_ks_p(n, m, gap) == pytest.approx(by_counting(n, m, gap), rel=1e-12)


def test_large_samples_and_small_values():
    assert exact_ks_p(300, 300, 300 * 300) == pytest.approx(2 / math.comb(600, 300), rel=1e-9)
    assert 0.9 < exact_ks_p(2000, 1500, 20_000) <= 1.0
