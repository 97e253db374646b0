"""Distribution functions: normal as native expressions; tails of counts by series and continued fractions on whole Arrow columns."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (numerator, denominator) as published by West.
TAIL_UP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_DOWN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# Acklam's rational approximation of the normal quantile (centre a / b, tails c / d).
QUANTILE_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239]
QUANTILE_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0]
P_LOW = 0.02425


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column, mean: float = 0.0, variance: float = 1.0) -> Column:
    """P(X <= x); within 1e-14 of the exact value."""
    z = (x - mean) / math.sqrt(variance)
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    near = e * _horner(TAIL_UP, a) / _horner(TAIL_DOWN, a)
    far = a + 0.65
    for i in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(i) / far
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(e / far / 2.506628274631)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column, mean: float = 0.0, variance: float = 1.0) -> Column:
    """x with P(X <= x) = p, relative error below 1.2e-9; null outside (0, 1)."""
    q = p - 0.5
    r = q * q
    centre = _horner(QUANTILE_A, r) * q / _horner(QUANTILE_B, r)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    z = (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < P_LOW, _horner(QUANTILE_C, low) / _horner(QUANTILE_D, low))
        .when(p <= 1 - P_LOW, centre)
        .otherwise(-_horner(QUANTILE_C, high) / _horner(QUANTILE_D, high))
    )
    return z * math.sqrt(variance) + mean


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! minus Stirling's formula for it, for whole n >= 0 (0 for n = 0, where it is not used)."""
    x = np.maximum(n, 1.0)
    y = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / y) / y) / y) / y) / x
    return np.where(n > 15, series, _SMALL[np.minimum(n, 15).astype(np.int64)])


_SMALL = np.array([0.0] + [math.lgamma(n + 1.0) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) for n in range(1, 16)])


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x for x, mean > 0, by a series where both are close, so that nothing cancels."""
    near = np.abs(x - mean) < 0.1 * (x + mean)
    v = np.where(near, (x - mean) / (x + mean), 0.0)
    s, term = (x - mean) * v, 2 * x * v
    for j in range(1, 12):
        term = term * v * v
        s = s + term / (2 * j + 1)
    return np.where(near, s, x * np.log(x / mean) + mean - x)


def poisson_density(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Saddle-point form: the relative error does not grow with k and lam."""
    x, mean = np.maximum(k, 1.0), np.where(lam > 0, lam, 1.0)
    inner = np.exp(-_stirling_error(x) - _deviance(x, mean)) / np.sqrt(2 * math.pi * x)
    out = np.where(k < 0, 0.0, np.where(k == 0, np.exp(-mean), inner))
    return np.where(lam > 0, out, np.where(k == 0, 1.0, 0.0))


def binomial_density(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    inside = (k > 0) & (k < n) & (p > 0) & (p < 1)
    x, m, q = np.where(inside, k, 1.0), np.where(inside, n, 2.0), np.where(inside, p, 0.5)
    logs = _stirling_error(m) - _stirling_error(x) - _stirling_error(m - x) - _deviance(x, m * q) - _deviance(m - x, m * (1 - q))
    inner = np.exp(logs) * np.sqrt(m / (2 * math.pi * x * (m - x)))
    r = np.clip(p, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        edge = np.where(k == 0, np.where(n == 0, 1.0, np.exp(n * np.log1p(-r))), np.where(k == n, r**n, 0.0))
    return np.where(inside, inner, np.where((k < 0) | (k > n), 0.0, edge))


def _until_still(step, state: tuple[np.ndarray, ...], most: int = 10**7) -> np.ndarray:
    """Repeat ``step`` (i, state) -> (state, moving) on the rows that still move; the first part of the state is the result."""
    out, rows = np.empty(len(state[0])), np.arange(len(state[0]))
    for i in range(1, most):
        if not len(rows):
            break
        state, moving = step(i, state)
        if i % 8 == 0 or len(rows) < 64:
            still = ~moving
            out[rows[still]] = state[0][still]
            rows, state = rows[moving], tuple(s[moving] for s in state)
    out[rows] = state[0]
    return out


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 + x / (a + 1) + x**2 / ((a + 1) (a + 2)) + ..., for x < a + 1."""

    def step(i, state):
        total, term, a, x = state
        term = term * (x / (a + i))
        return (total + term, term, a, x), term > total * 1e-17

    return _until_still(step, (np.ones(len(a)), np.ones(len(a)), a, x))


def _gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper incomplete gamma function, for x >= a + 1, by Lentz's method."""
    b = x + 1 - a

    def step(i, state):
        h, c, d, b, a = state
        an = -i * (i - a)
        b = b + 2
        d, c = 1 / (an * d + b), b + an / c
        change = c * d
        return (h * change, c, d, b, a), np.abs(change - 1) > 1e-16

    return _until_still(step, (1 / b, np.full(len(a), 1e300), 1 / b, b, a))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, for x < (a + 1) / (a + b + 2), by Lentz's method."""
    d = 1 / (1 - (a + b) * x / (a + 1))

    def step(m, state):
        h, c, d, a, b, x = state
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + even * d), 1 + even / c
        h = h * c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + odd * d), 1 + odd / c
        return (h * c * d, c, d, a, b, x), np.abs(c * d - 1) > 1e-16

    return _until_still(step, (d, np.ones(len(a)), d, a, b, x))


def _chosen(rows: np.ndarray, value, *columns: np.ndarray) -> np.ndarray:
    """``value`` of the columns at ``rows``, 0 elsewhere."""
    out = np.zeros(len(rows))
    if rows.any():
        out[rows] = value(*(c[rows] for c in columns))
    return out


def poisson_tail(k: np.ndarray, lam: np.ndarray, upper: bool) -> np.ndarray:
    """P(X > k) or P(X <= k): incomplete gamma functions of k + 1 and lam. The smaller tail is computed, the other is what it leaves."""
    real = (k >= 0) & (lam > 0) & np.isfinite(lam)
    series = real & (lam < k + 2)
    above = _chosen(series, lambda k, m: poisson_density(k + 1, m) * _gamma_series(k + 1, m), k, lam)
    below = _chosen(real & ~series, lambda k, m: poisson_density(k + 1, m) * (k + 1) * _gamma_fraction(k + 1, m), k, lam)
    out = np.where(series, above, 1 - below) if upper else np.where(series, 1 - above, below)
    out = np.where(real, out, np.where(k < 0, float(upper), np.where(lam <= 0, float(not upper), np.where(lam == np.inf, float(upper), np.nan))))
    return np.clip(out, 0.0, 1.0)


def binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray, upper: bool) -> np.ndarray:
    """P(X > k) or P(X <= k): incomplete beta functions of k + 1 and n - k; exact at p 0 and 1, below 0 and from n on."""
    real = (k >= 0) & (k < n) & (p > 0) & (p < 1)
    direct = real & (p < (k + 2) / (n + 3))
    above = _chosen(direct, lambda k, n, p: binomial_density(k + 1, n, p) * (1 - p) * _beta_fraction(k + 1, n - k, p), k, n, p)
    below = _chosen(real & ~direct, lambda k, n, p: binomial_density(k, n, p) * p * _beta_fraction(n - k, k + 1, 1 - p), k, n, p)
    out = np.where(direct, above, 1 - below) if upper else np.where(direct, 1 - above, below)
    all_below = (k >= n) | ((k >= 0) & (p <= 0))
    return np.clip(np.where(real, out, np.where(all_below, float(not upper), float(upper))), 0.0, 1.0)


def hypergeometric_tail(k: np.ndarray, good: np.ndarray, bad: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """P(X > k): terms fall from k + 1 upwards above the mode and from k downwards below it, so they are added from there and, below it, taken from 1."""
    least, most = np.maximum(draws - bad, 0.0), np.minimum(good, draws)
    share = np.where(good + bad > 0, draws / np.maximum(good + bad, 1.0), 0.0)

    def density(x, g, b, n, q):
        return binomial_density(x, g, q) * binomial_density(n - x, b, q) / binomial_density(n, g + b, q)

    def rising(i, state):
        total, term, x, g, b, n = state
        at = x + i - 1
        term = term * (g - at) * (n - at) / ((at + 1) * (b - n + at + 1))
        return (total + term, term, x, g, b, n), term > total * 1e-17

    def falling(i, state):
        total, term, x, g, b, n = state
        at = x - i + 1
        term = term * at * (b - n + at) / ((g - at + 1) * (n - at + 1))
        return (total + term, term, x, g, b, n), term > total * 1e-17

    inside = (k >= least) & (k < most)
    high = inside & (k + 1 > (draws + 1) * (good + 1) / (good + bad + 2))

    def added(step, shift):
        return lambda k, g, b, n, q: density(k + shift, g, b, n, q) * _until_still(step, (np.ones(len(k)), np.ones(len(k)), k + shift, g, b, n))

    above = _chosen(high, added(rising, 1), k, good, bad, draws, share)
    below = _chosen(inside & ~high, added(falling, 0), k, good, bad, draws, share)
    return np.clip(np.where(inside, np.where(high, above, 1 - below), np.where(k >= most, 0.0, 1.0)), 0.0, 1.0)


def _smallest(p: np.ndarray, low: np.ndarray, high: np.ndarray, cdf) -> np.ndarray:
    """Smallest whole number in (low, high] whose cdf reaches p, by halving all rows at once; ``high`` where none does."""
    low, high = low.copy(), high.copy()
    while (open_ := high - low > 1).any():
        middle = np.floor((low + high) / 2)
        reached = cdf(middle) >= p
        high, low = np.where(open_ & reached, middle, high), np.where(open_ & ~reached, middle, low)
    return high


def _on_arrays(value):
    """A column function of double arrays; null where an argument is null."""

    @F.arrow_udf("double")
    def run(*columns: pa.Array) -> pa.Array:
        null = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        arrays = [c.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in columns]
        with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
            return pa.array(np.asarray(value(*arrays), dtype=float), pa.float64(), mask=null)

    return run


def _doubles(*columns: Column) -> list[Column]:
    return [c.cast("double") for c in columns]


def poisson_cdf(k: Column, lam: Column) -> Column:
    """P(X <= k)."""
    return _on_arrays(lambda k, m: poisson_tail(k, m, False))(*_doubles(k.cast("long"), lam))


def poisson_upper(k: Column, lam: Column) -> Column:
    """P(X > k)."""
    return _on_arrays(lambda k, m: poisson_tail(k, m, True))(*_doubles(k.cast("long"), lam))


def poisson_pdf(k: Column, lam: Column) -> Column:
    return _on_arrays(poisson_density)(*_doubles(k.cast("long"), lam))


def poisson_quantile(p: Column, lam: Column) -> Column:
    """Smallest k with P(X <= k) >= p."""

    def value(p: np.ndarray, m: np.ndarray) -> np.ndarray:
        reach = 40 * np.sqrt(np.maximum(m, 0)) + 60
        return _smallest(p, np.maximum(np.floor(m - reach), 0) - 1, np.ceil(np.maximum(m, 0) + reach), lambda k: poisson_tail(k, m, False))

    return _on_arrays(value)(*_doubles(p, lam))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    return _on_arrays(lambda k, n, p: binomial_tail(k, n, p, False))(*_doubles(k.cast("long"), n.cast("long"), p))


def binomial_upper(k: Column, n: Column, p: Column) -> Column:
    return _on_arrays(lambda k, n, p: binomial_tail(k, n, p, True))(*_doubles(k.cast("long"), n.cast("long"), p))


def binomial_pdf(k: Column, n: Column, p: Column) -> Column:
    return _on_arrays(binomial_density)(*_doubles(k.cast("long"), n.cast("long"), p))


def hypergeometric_upper(k: Column, good: Column, bad: Column, draws: Column) -> Column:
    """P(X > k) of the good ones among ``draws`` without replacement."""
    return _on_arrays(hypergeometric_tail)(*_doubles(*(c.cast("long") for c in (k, good, bad, draws))))


def poisson_tail_value(k: int, lam: float, upper: bool) -> float:
    return float(poisson_tail(np.array([float(k)]), np.array([float(lam)]), upper)[0])


def binomial_tail_value(k: int, n: int, p: float, upper: bool) -> float:
    return float(binomial_tail(*(np.array([float(x)]) for x in (k, n, p)), upper)[0])


def hypergeometric_upper_value(k: int, good: int, bad: int, draws: int) -> float:
    return float(hypergeometric_tail(*(np.array([float(x)]) for x in (k, good, bad, draws)))[0])


def minus_ten_log10(p: Column, most: float = 3100.0) -> Column:
    """-10 log10 p; ``most`` where p is not positive."""
    return F.when(p <= 0, most).otherwise(-10 * F.log10(p))


def binomial_quantile(p: Column, n: Column, chance: Column) -> Column:
    """Smallest k with P(X <= k) >= p."""

    def value(p: np.ndarray, n: np.ndarray, chance: np.ndarray) -> np.ndarray:
        return _smallest(p, np.full(len(p), -1.0), n, lambda k: binomial_tail(k, n, chance, False))

    return _on_arrays(value)(*_doubles(p, n.cast("long"), chance))
