"""Student t and F tails from the regularised incomplete beta function."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    """Quantile, by bisection on the tail and Newton's steps."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > 1 - p else (lo, mid)
    x = (lo + hi) / 2
    for _ in range(3):
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * math.log1p(x * x / df))
        x += (t_sf(x, df) - (1 - p)) / density
    return x


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0
