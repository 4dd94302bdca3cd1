"""Error measures of functional dependencies as functions of group statistics."""

from __future__ import annotations

import math

from ..plans.kernel import GroupStats


def g1(n: int, x: GroupStats, xa: GroupStats) -> float:
    """Share of row pairs that agree on X and differ on A."""
    return (x.pairs - xa.pairs) / (n * (n - 1) / 2) if n > 1 else 0.0


def rho(x: GroupStats, xa: GroupStats) -> float:
    """Groups of X for each group of XA; 1 if the dependency holds."""
    return x.groups / xa.groups if xa.groups else 1.0


def pdep_self(n: int, a: GroupStats) -> float:
    return a.squares / (n * n) if n else 1.0


def tau(pdep: float, own: float) -> float:
    return 1.0 if own == 1 else (pdep - own) / (1 - own)


def mu_plus(n: int, pdep: float, own: float, x_groups: int) -> float:
    if own == 1 or x_groups == n:
        return 1.0
    return max(0.0, 1 - (1 - pdep) / (1 - own) * (n - 1) / (n - x_groups))


def entropy(n: int, s: GroupStats) -> float:
    """In nats."""
    return math.log(n) - s.log_sum / n if n else 0.0


def information_share(n: int, x: GroupStats, a: GroupStats, xa: GroupStats) -> float:
    """Fraction of A's information that X gives; 0 if A is constant."""
    h = entropy(n, a)
    return (entropy(n, x) + h - entropy(n, xa)) / h if a.groups > 1 else 0.0
