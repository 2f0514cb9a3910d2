from fractions import Fraction
from math import factorial, exp

import numpy as np
import pytest

from verseframe.llm import truncation


def test_poisson_tail_at_small_rates():
    for rate in (0.01, 0.5, 2.3, 40.0):
        for n in (0, 1, 2, 5, 30, 70):
            below = sum(Fraction(rate) ** k / factorial(k) for k in range(n))
            above = sum(Fraction(rate) ** k / factorial(k) for k in range(n, n + 150))
            want = float(above) * exp(-rate) if n > rate else 1 - float(below) * exp(-rate)
            assert truncation._poisson_tail(n, rate) == pytest.approx(want, rel=1e-9)
    assert truncation._poisson_tail(1, 0.0) == 0 and truncation._poisson_tail(0, 0.0) == 1


def test_poisson_tail_at_large_rates():
    for rate in (800.0, 5000.0, 1e6):
        assert truncation._poisson_tail(int(rate * 1.5), rate) < 1e-9
        assert truncation._poisson_tail(int(rate * 0.5), rate) == pytest.approx(1)
        x = np.random.default_rng(1).poisson(rate, 200_000)
        n = int(rate + rate**0.5)
        assert truncation._poisson_tail(n, rate) == pytest.approx((x >= n).mean(), abs=0.005)
