"""Negative binomial and Poisson demand, as Column expressions and as array helpers for tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Demand of at most this many units is summed unit by unit; beyond, both figures come from integrals.
DIRECT_UNITS = 256
#: The array helpers walk demand of at most this many units one by one.
WALKED_UNITS = 4096
#: Gauss-Legendre points on (0, 1); there are as many terms in a sum whatever the stock and the demand.
_POINTS = [((z + 1) / 2, w / 2) for z, w in zip(*(x.tolist() for x in np.polynomial.legendre.leggauss(64)), strict=True)]
#: An integral ends where its integrand has fallen by this many powers of e.
_FALL = 40.0


def leftover_and_risk(on_hand: Column, mean: Column, k: Column) -> Column:
    """struct(leftover, risk): expected unsold units and P(some are unsold).

    ``k`` null means Poisson; a null stock gives null figures. Few units are summed one by one with a recursion on
    the probabilities. Beyond, the distribution function is an incomplete beta (Poisson: gamma) function, taken as
    an integral with a fixed number of points, and the leftover follows from it and the density at its border. So
    the work for a row has a fixed bound, whatever its stock and demand: no Python, no shuffle.
    """
    q = F.greatest(F.rint(on_hand), F.lit(0.0)).cast("double")
    mu = F.greatest(mean, F.lit(1e-9)).cast("double")
    k = k.cast("double")
    spread = F.sqrt(mu + F.when(k.isNull(), F.lit(0.0)).otherwise(mu * mu / k))
    stop = F.least(q, F.ceil(mu + 40 * spread + 50).cast("double"))
    first = F.when(k.isNull(), -mu).otherwise(-k * F.log1p(mu / k))
    given = F.struct(q.alias("q"), mu.alias("mu"), k.alias("k"), stop.alias("stop"), first.alias("first"))

    def figures(x: Column) -> Column:
        few = (x["stop"] <= DIRECT_UNITS) & (x["first"] > -600)  # below, the first probability could underflow
        found = F.when(few, _summed(x)).otherwise(_integrated(x))
        return F.when(x["q"] > 0, found).when(x["q"] <= 0, F.struct(F.lit(0.0).alias("leftover"), F.lit(0.0).alias("risk")))

    return _let(given, figures)


def _let(values: Column, use) -> Column:
    """``use(values)`` with the struct computed once: an expression inside a lambda is otherwise evaluated at every use."""
    return F.element_at(F.transform(F.array(values), use), 1)


def _summed(x: Column) -> Column:
    """Both figures from the probabilities of 0, 1, ... units; past ``stop`` each further unit adds one to what is left."""

    def grow(state: Column, i: Column) -> Column:
        ratio = F.when(x["k"].isNull(), x["mu"] / i).otherwise((x["k"] + i - 1) / i * (x["mu"] / (x["k"] + x["mu"])))
        pmf = state["pmf"] * ratio
        return F.struct(pmf.alias("pmf"), (state["cdf"] + pmf).alias("cdf"), (state["total"] + state["cdf"] + pmf).alias("total"))

    terms = F.when(x["stop"] > 1, F.sequence(F.lit(1), x["stop"].cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    none = F.exp(x["first"])
    return F.aggregate(
        terms, F.struct(none.alias("pmf"), none.alias("cdf"), none.alias("total")), grow,
        lambda end: F.struct((end["total"] + (x["q"] - x["stop"])).alias("leftover"), F.least(end["cdf"], F.lit(1.0)).alias("risk")),
    )


def _integrated(x: Column) -> Column:
    """Both figures from one integral over the logarithm of a ratio of gamma variables.

    With G(s) a gamma variable of shape s, P(D < q) = P(G(k)/k * mu < G(q)), and for Poisson demand P(mu < G(q)). Let
    a and b be the smaller and larger of k and q (Poisson: b infinite), and W = log((G(a)/a) / (G(b)/b)). Its density
    is exp(-D(w)) / T with D(w) = (a + b) log(1 + a/(a+b) (e^w - 1)) - a w, least and zero at 0, convex, and without
    cancellation for large a and b. The border w0 is log(q/mu) if k < q, else log(mu/q). The tail beyond the border, away from 0, and
    the whole T are each integrated from their highest point. From the recursion of the probabilities,
    leftover = (q - mu) P(D < q) + (1 + mu/k) exp(-D(w0)) / T.
    """
    q, mu, k = x["q"], x["mu"], x["k"]
    falls = F.coalesce(k < q, F.lit(False))
    points = F.expr("array(" + ", ".join(f"named_struct('z', {z * z!r}D, 'w', {2 * z * w!r}D)" for z, w in _POINTS) + ")")
    shapes = F.struct(
        F.when(falls, k).otherwise(q).alias("a"), F.when(falls, q).otherwise(k).alias("b"),
        F.when(falls, F.log(q / mu)).otherwise(F.log(mu / q)).alias("w0"),
    )

    def depth(s: Column, w: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.coalesce((a + b) * F.log1p(a / (a + b) * F.expm1(w)) - a * w, a * (F.expm1(w) - w))

    def reach(s: Column, start: Column, side: Column) -> Column:
        """How far from ``start`` the integrand falls by e^-40: bounds by curvature, by growth and by slope."""
        a, b_inverse = s["a"], F.coalesce(1 / s["b"], F.lit(0.0))
        curved = F.sqrt(2 * _FALL * (1 / a + b_inverse))
        right = F.least(curved + _FALL * b_inverse, F.log(2 + 2 * _FALL / a) + 2 * _FALL * b_inverse)
        slope = F.abs(a * F.expm1(start) / (1 + a * b_inverse * F.exp(start)))
        return F.least(F.when(side > 0, right).otherwise(curved + _FALL / a), F.when(slope > 0, _FALL / slope))

    def area(s: Column, start: Column, side: Column) -> Column:
        """Integral of exp(D(start) - D(w)) from ``start`` to one side; points lie closer near the start."""
        given = F.struct(start.alias("start"), depth(s, start).alias("top"), (side * reach(s, start, side)).alias("way"))
        return _let(
            given,
            lambda g: F.abs(g["way"]) * F.aggregate(
                points, F.lit(0.0), lambda total, p: total + p["w"] * F.exp(g["top"] - depth(s, g["start"] + g["way"] * p["z"]))
            ),
        )

    def parts(s: Column) -> Column:
        w0, side = s["w0"], F.when(s["w0"] > 0, 1.0).otherwise(-1.0)
        spans = F.array(*[F.struct(F.lit(at).alias("start"), F.lit(to).alias("side")) for at, to in ((0.0, -1.0), (0.0, 1.0), (w0, side))])
        areas = F.transform(spans, lambda span: area(s, span["start"], span["side"]))
        return _let(
            areas, lambda x: F.struct(w0.alias("w0"), (F.exp(-depth(s, w0)) / (x[0] + x[1])).alias("height"), x[2].alias("tail"))
        )

    def figures(p: Column) -> Column:
        beyond = p["height"] * p["tail"]
        below = F.when(falls == (p["w0"] > 0), 1 - beyond).otherwise(beyond)
        risk = F.greatest(F.least(below, F.lit(1.0)), F.lit(0.0))
        left = (q - mu) * risk + (1 + F.coalesce(mu / k, F.lit(0.0))) * p["height"]
        return F.struct(F.greatest(left, F.lit(0.0)).alias("leftover"), risk.alias("risk"))

    return _let(_let(shapes, parts), figures)


def quantile(mean: np.ndarray, k: float, q: np.ndarray) -> np.ndarray:
    """Smallest x with P(D <= x) >= q, for each row; ``k`` infinite means Poisson.

    Rows whose demand ends within ``WALKED_UNITS`` are walked unit by unit; for the others the value is bracketed by
    halves. So the work for a row has a fixed bound, whatever its demand.
    """
    mean = np.maximum(np.asarray(mean, float), 1e-9)
    q = np.broadcast_to(np.asarray(q, float), mean.shape)
    end = _end(mean, k)
    few = ~(end > WALKED_UNITS)
    answer = np.zeros_like(mean)
    answer[few] = _walk(mean[few], k, q[few])
    answer[~few] = _halved(mean[~few], k, q[~few], np.ceil(end[~few]))
    return answer


def cdf(x: np.ndarray, mean: np.ndarray, k: float) -> np.ndarray:
    """P(D <= x) for each row: a sum for at most ``WALKED_UNITS``, else an integral."""
    mean = np.maximum(np.asarray(mean, float), 1e-9)
    x = np.asarray(x, float)
    many = x > WALKED_UNITS
    total = np.zeros_like(mean)
    total[many] = _integral(np.floor(x[many]) + 1, mean[many], k)
    log_pmf, i = _log_start(mean, k), 0
    while (alive := (x >= i) & ~many).any():
        total[alive] += np.exp(log_pmf[alive])
        i += 1
        log_pmf = log_pmf + _log_step(mean, k, i)
    return np.minimum(total, 1.0)


def _end(mean: np.ndarray, k: float) -> np.ndarray:
    """Far past the mean the remaining mass is below rounding: no quantile lies beyond."""
    return mean + 40 * np.sqrt(mean + (0 if np.isinf(k) else mean**2 / k)) + 50


def _halved(mean: np.ndarray, k: float, q: np.ndarray, end: np.ndarray) -> np.ndarray:
    low, high = np.full_like(mean, -1.0), end.copy()
    while (wide := high - low > 1).any():
        middle = np.floor((low + high) / 2)
        reached = _integral(np.maximum(middle, 0.0) + 1, mean, k) >= q
        low, high = np.where(wide & ~reached, middle, low), np.where(wide & reached, middle, high)
    return high


def _integral(q: np.ndarray, mu: np.ndarray, k: float) -> np.ndarray:
    """P(D < q) for q > 0, by the integral of ``_integrated`` on arrays."""
    poisson = bool(np.isinf(k))
    falls = np.zeros(q.shape, bool) if poisson else k < q
    a = np.where(falls, k, q)
    b_inverse = np.zeros_like(q) if poisson else 1 / np.where(falls, q, k)
    w0 = np.where(falls, np.log(q / mu), np.log(mu / q))
    z, weight = (np.array(p)[:, None] for p in zip(*((z * z, 2 * z * w) for z, w in _POINTS), strict=True))

    def depth(w: np.ndarray) -> np.ndarray:
        if poisson:
            return a * (np.expm1(w) - w)
        return (a + 1 / b_inverse) * np.log1p(a / (a + 1 / b_inverse) * np.expm1(w)) - a * w

    def area(start: np.ndarray, side: np.ndarray) -> np.ndarray:
        curved = np.sqrt(2 * _FALL * (1 / a + b_inverse))
        right = np.minimum(curved + _FALL * b_inverse, np.log(2 + 2 * _FALL / a) + 2 * _FALL * b_inverse)
        slope = np.abs(a * np.expm1(start) / (1 + a * b_inverse * np.exp(start)))
        by_slope = np.divide(_FALL, slope, out=np.full_like(slope, np.inf), where=slope > 0)
        way = side * np.minimum(np.where(side > 0, right, curved + _FALL / a), by_slope)
        return np.abs(way) * (weight * np.exp(depth(start) - depth(start + way * z))).sum(axis=0)

    one = np.ones_like(w0)
    whole = area(0 * one, -one) + area(0 * one, one)
    # From a border far off, nothing is left: its slope may be too large for a number.
    with np.errstate(over="ignore", invalid="ignore"):
        beyond = np.nan_to_num(np.exp(-depth(w0)) / whole * area(w0, np.where(w0 > 0, 1.0, -1.0)))
    return np.clip(np.where(falls == (w0 > 0), 1 - beyond, beyond), 0.0, 1.0)


def _log_start(mean: np.ndarray, k: float) -> np.ndarray:
    return -mean if np.isinf(k) else k * np.log(k / (k + mean))


def _log_step(mean: np.ndarray, k: float, i: int) -> np.ndarray:
    if np.isinf(k):
        return np.log(mean / i)
    return np.log((k + i - 1) / i * (mean / (k + mean)))


def _walk(mean: np.ndarray, k: float, q: np.ndarray) -> np.ndarray:
    answer = np.zeros_like(mean)
    done = np.zeros(mean.shape, bool)
    log_pmf, total, i = _log_start(mean, k), np.zeros_like(mean), 0
    end = _end(mean, k)
    while not done.all():
        total = total + np.exp(log_pmf)
        now = done | (total >= q) | (i >= end)
        answer[now & ~done] = i
        done = now
        i += 1
        log_pmf = log_pmf + _log_step(mean, k, i)
    return answer
