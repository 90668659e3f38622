"""Disproportionality scores of a 2x2 contingency table, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected(w00: Column, w01: Column, w10: Column, w11: Column) -> Column:
    """Count expected of exposed cases if exposure and outcome were independent."""
    total = w00 + w01 + w10 + w11
    return F.when(total > 0, ((w00 + w10) * (w00 + w01)).cast("double") / total)


def information_component(w00: Column, w01: Column, w10: Column, w11: Column, prior: float = 0.5) -> Column:
    """ln((w00 + prior) / (E + prior)); null where nothing is expected."""
    e = expected(w00, w01, w10, w11)
    return F.when(e > 0, F.log((w00 + F.lit(prior)) / (e + F.lit(prior))))


def log_reporting_ratio(w00: Column, w01: Column, w10: Column, w11: Column, prior: float = 1e-5) -> Column:
    """Logarithm of the proportional reporting ratio, kept finite by ``prior``."""
    p = F.lit(float(prior))
    return F.log((w00 / (w00 + w01 + p) + p) / (w10 / (w10 + w11 + p) + p))


def unit_hash(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone: stands in for a random tie-break."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def ranked_where_unsupported(score: Column, floor: Column, *keys: Column) -> Column:
    """``score``; where it's null, a value below ``floor`` that depends on the keys."""
    return F.coalesce(score, floor - 1.0 - unit_hash(*keys))


#: The level of a risk category, by how its name begins.
RISK_LEVELS = {"Small": 1, "Moderate": 2, "Large": 3}


def risk_level(category: Column) -> Column:
    """The level of a risk category; null for other names."""
    return F.coalesce(*(F.when(category.startswith(name), level) for name, level in RISK_LEVELS.items()))
