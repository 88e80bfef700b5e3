"""Gamma functions and quantiles, vectorised (SciPy is not at hand)."""

from __future__ import annotations

from math import lgamma

import numpy as np

ln_gamma = np.vectorize(lgamma, otypes=[float])


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: the series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    some = x > 0
    front = np.exp(np.where(some, a * np.log(np.where(some, x, 1)) - x - ln_gamma(a), -np.inf))
    low = some & (x < a + 1)
    if low.any():
        b, y = a[low], x[low]
        term = total = 1 / b
        for n in range(1, 2000):
            term = term * y / (b + n)
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[low] = front[low] * total
    high = some & ~low
    if high.any():
        b, y = a[high], x[high]
        tiny = 1e-300
        bn = y + 1 - b
        c, d = np.full(b.shape, 1 / tiny), 1 / np.where(bn == 0, tiny, bn)
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - b)
            bn = bn + 2
            d = an * d + bn
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = bn + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1)


def gamma_quantile(p: np.ndarray, shape: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Quantiles of gamma distributions, by bisection on a bracket that is doubled until it holds them."""
    p, shape, rate = np.broadcast_arrays(np.asarray(p, float), np.asarray(shape, float), np.asarray(rate, float))
    low, high = np.zeros(p.shape), np.maximum(shape, 1.0) * 2
    for _ in range(200):
        short = gamma_p(shape, high) < p
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(200):
        mid = (low + high) / 2
        below = gamma_p(shape, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2 / rate
