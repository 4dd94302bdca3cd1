"""Draws of the seating of Pitman-Yor restaurants.

A dish with c customers and discount d sits at t tables with a weight of
S(c, t) x ** t, S being generalised Stirling numbers. S(c, t) d ** t t! / c! is
the probability that t independent sizes of the Sibuya distribution add up to
c, so tables are a Poisson number of such sizes, given their sum. Up to LISTED
customers the weights are listed; beyond, an independence sampler draws all
tables but one and gives that one the rest, so that its target is the same
conditional.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

LISTED = 256
STEPS = 16
_AT_ONCE = 1 << 20


@lru_cache(8)
def stirling(discount: float) -> np.ndarray:
    """Logs of generalised Stirling numbers, [customers, tables], up to LISTED."""
    s = np.full((LISTED + 1, LISTED + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, LISTED):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = s[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 0))
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], stay)
    s.flags.writeable = False
    return s


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logs of the gamma function for positive x: Stirling's series above 8, brought there by its recurrence."""
    x = np.asarray(x, float)
    shift = np.where(x < 8, 8.0, 0.0)
    down = np.zeros_like(x)
    small = x < 8
    for k in range(8):
        down[small] += np.log(x[small] + k)
    x = x + shift
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - down


def _sibuya(n: int, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes with generating function 1 - (1 - z) ** discount: geometric with a beta distributed chance."""
    stop = rng.beta(discount, 1 - discount, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.floor(np.log(rng.random(n)) / np.log1p(-stop))
    return 1 + np.where(np.isfinite(size), size, 1e18)


def _tilted(tilt: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sibuya sizes reweighted by tilt ** size: by rejection, or counted up where most would be rejected."""
    out, kept = np.zeros(len(tilt)), 1 - (1 - tilt) ** discount
    left = np.flatnonzero(kept >= 0.3)
    while len(left):
        size = _sibuya(len(left), discount, rng)
        good = np.log(rng.random(len(left))) < size * np.log(tilt[left])
        out[left[good]] = size[good]
        left = left[~good]
    left = np.flatnonzero(kept < 0.3)
    mass, u, size = discount * tilt[left], rng.random(len(left)) * kept[left], 1
    while len(left):
        out[left] = size
        u = u - mass
        on = (u > 0) & (mass > 0)
        left, u, mass = left[on], u[on], mass[on] * (size - discount) / (size + 1) * tilt[left[on]]
        size += 1
    return out


def _tilts(customers: np.ndarray, rate: np.ndarray, discount: float) -> np.ndarray:
    """Tilts at which a Poisson number of sizes adds up to the customers in the mean: rate d z (1 - z) ** (d - 1) = customers."""
    low, high = np.full(len(customers), 1e-6), 1 - 0.1 / customers
    for _ in range(40):
        z = (low + high) / 2
        more = rate * discount * z * (1 - z) ** (discount - 1) > customers
        low, high = np.where(more, low, z), np.where(more, z, high)
    return low


def _large(customers: np.ndarray, rate: np.ndarray, others: Callable[[np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells with many customers. others(chance): how many tables besides the largest to propose.

    A seating is the largest table and the others in any order; as many largest
    ones as there are share its weight.
    """
    tilt = _tilts(customers, rate, discount)
    log_tilt, chance = np.log(tilt), 1 - (1 - tilt) ** discount
    tables = np.ones(len(customers), np.int64)
    size_score = lambda k: log_gamma(k - discount) - log_gamma(k + 1)
    score = np.full(len(customers), -np.inf)
    for _ in range(STEPS):
        # As many tables as customers already leave none for the largest.
        more = np.minimum(others(chance), customers).astype(np.int64)
        for a, b in _runs(np.cumsum(more)):
            own = np.repeat(np.arange(b - a), more[a:b])
            sizes = _tilted(tilt[a:b][own], discount, rng)
            last = customers[a:b] - np.bincount(own, sizes, b - a)
            fits, ties = last >= 1, np.ones(b - a)
            np.logical_and.at(fits, own, sizes <= last[own])
            np.add.at(ties, own, sizes == last[own])
            new = np.where(fits, size_score(np.where(fits, last, 1)) + last * log_tilt[a:b] - np.log(ties), -np.inf)
            take = fits & (np.log(rng.random(b - a)) + score[a:b] < new)
            tables[a:b][take], score[a:b][take] = 1 + more[a:b][take], new[take]
    return tables


def _runs(ends: np.ndarray):
    """Bounds of runs of cells with about _AT_ONCE tables together."""
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _AT_ONCE, "right")))
        yield at, to
        at = to


def _listed(customers: np.ndarray, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], logs: np.ndarray, out: np.ndarray, rng: np.random.Generator) -> None:
    small = np.flatnonzero((customers > 1) & (customers <= LISTED))
    small = small[np.argsort(customers[small], kind="stable")]
    for some in np.split(small, np.flatnonzero(np.diff(customers[small])) + 1) if len(small) else ():
        c = int(customers[some[0]])
        for at in np.array_split(some, max(1, len(some) * c // 400_000)):
            weight = weigh(at, np.arange(1, c + 1)) + logs[c, 1 : c + 1]
            upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            u = rng.random(len(at)) * upto[:, -1]
            out[at] = 1 + np.minimum(np.count_nonzero(upto <= u[:, None], axis=1), c - 1)


def tables_at(customers: np.ndarray, rate: np.ndarray, discount: float, rng: np.random.Generator, logs: np.ndarray) -> np.ndarray:
    """Tables of dishes, each on its own: t tables have a weight of S(c, t) (discount * rate) ** t."""
    out = np.ones(len(customers), np.int64)
    log_x = np.log(discount * rate)
    _listed(customers, lambda at, t: log_x[at, None] * t, logs, out, rng)
    big = np.flatnonzero(customers > LISTED)
    if len(big):
        c, lam = customers[big].astype(float), rate[big]
        out[big] = _large(c, lam, lambda chance: rng.poisson(lam * chance), discount, rng)
    return out


def draw_tables(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator, logs: np.ndarray) -> np.ndarray:
    """Tables of dishes given a dish's parent probability and the other tables of its restaurant, whose weight is integrated out."""
    out = np.ones(len(customers), np.int64)
    log_base, room = np.log(base), strength / discount + others
    _listed(customers, lambda at, t: np.cumsum(np.log(discount * (room[at, None] + t - 1)), axis=1) + log_base[at, None] * t, logs, out, rng)
    big = np.flatnonzero(customers > LISTED)
    if len(big):
        c, r, p = customers[big].astype(float), room[big] + 1, np.minimum(base[big], 1 - 1e-9)
        out[big] = _large(c, r * p, lambda chance: rng.negative_binomial(r, 1 - p * chance), discount, rng)
    return out


def rest_masses(n: int, shape: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """n independent masses with Laplace transform exp(-shape * ((1 + s) ** discount - 1)): tempered stable.

    Divided by their sum, and with `shape` a gamma variate of strength /
    discount over n, they are what a Pitman-Yor process with a uniform base
    gives to n dishes. Each mass adds up shares whose shape is one at most,
    which are stable variates (Kanter's form) kept with chance exp(-mass).
    """
    if n == 0:
        return np.zeros(0)
    parts = max(1, int(np.ceil(shape)))
    out, each = np.zeros(n), shape / parts
    for _ in range(parts):
        left = np.arange(n)
        while len(left):
            u, e = rng.random(len(left)) * np.pi, rng.exponential(size=len(left))
            stable = np.sin(discount * u) / np.sin(u) ** (1 / discount) * (np.sin((1 - discount) * u) / e) ** ((1 - discount) / discount)
            mass = each ** (1 / discount) * stable
            good = rng.random(len(left)) < np.exp(-mass)
            out[left[good]] += mass[good]
            left = left[~good]
    return out


def rest_mass(shape: float, discount: float, rng: np.random.Generator) -> float:
    """One mass as rest_masses() draws, in a time that does not grow with its shape: the sum of that of many dishes.

    Devroye's double rejection for exponentially tilted stable variates (2009),
    whose tilt to the power of the discount is `shape`.
    """
    if shape <= 0:
        return 0.0
    a, b, tilt = discount, (1 - discount) / discount, shape ** (1 / discount)
    half = math.sqrt(math.pi / 2)
    gamma = shape * a * (1 - a)
    root = math.sqrt(gamma)
    xi = ((2 + half) * math.sqrt(2) * root + 1) / math.pi
    log_psi = math.log((2 + half) * root / math.sqrt(math.pi)) - gamma * math.pi**2 / 8
    psi = math.exp(log_psi)
    w1, w2, w3 = xi * math.sqrt(math.pi / 2 / gamma), 2 * psi * math.sqrt(math.pi), xi * math.pi
    # Zolotarev's function is ratio(u) ** (-1 / (1 - a)), but for its value at 0.
    at_zero = a**-a * (1 - a) ** (a - 1)
    while True:
        while True:
            if gamma >= 1:
                u = abs(rng.standard_normal()) / root if rng.random() < w1 / (w1 + w2) else math.pi * (1 - rng.random() ** 2)
            else:
                u = math.pi * rng.random() if rng.random() < w3 / (w2 + w3) else math.pi * (1 - rng.random() ** 2)
            if not 0 < u < math.pi:
                continue
            ratio = math.sin(u) / (math.sin(a * u) ** a * math.sin((1 - a) * u) ** (1 - a))
            zeta = math.sqrt(ratio / at_zero)
            phi = (root + a * zeta) ** (1 / a)
            z = phi / (phi - root ** (1 / a))
            cover = np.logaddexp(math.log(xi) - (gamma * u * u / 2 if gamma >= 1 else 0), log_psi - math.log(math.pi - u) / 2)
            log_z = math.log(1 - rng.random()) + math.log(math.pi) - shape * (1 - zeta**-2) + cover - math.log((1 + half) * root / zeta + z)
            if log_z <= 0:
                break
        zolotarev = ratio ** (-1 / (1 - a))
        mode = (b * tilt / zolotarev) ** a
        spread = math.sqrt(mode * a / zolotarev)
        left, tail = spread * half, z / zolotarev
        v, n, e = rng.random() * (left + spread + tail), 0.0, 0.0
        if v < left:
            n = rng.standard_normal()
            x = mode - spread * abs(n)
        elif v < left + spread:
            x = mode + spread * rng.random()
        else:
            e = rng.exponential()
            x = mode + spread + e * tail
        if x > 0 and zolotarev * (x - mode) + tilt * (x**-b - mode**-b) - n * n / 2 - e <= -log_z:
            return x**-b * shape ** (1 / a)
