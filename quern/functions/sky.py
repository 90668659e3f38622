"""Cosmological distances, positions in space and logarithmic wavelength axes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the flat model: matter and vacuum densities, Hubble constant in km/s/Mpc, speed of light in km/s.
OMEGA_M, OMEGA_L, HUBBLE, LIGHT = 0.27, 0.73, 71.0, 299_792.458
NODES = 16


def comoving_distance(z: Column, nodes: int = NODES) -> Column:
    """Megaparsecs to redshift ``z``: the integral of c / H, by Gauss-Legendre quadrature."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    out = F.lit(0.0)
    for x, w in zip(at.tolist(), weight.tolist(), strict=True):
        here = 1 + z * (x + 1) / 2
        out = out + F.lit(w) / F.sqrt(F.lit(OMEGA_M) * here * here * here + F.lit(OMEGA_L))
    return out * z / 2 * (LIGHT / HUBBLE)


def comoving_distance_sql(z: str, nodes: int = NODES) -> str:
    """The same sum as SQL."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    terms = " + ".join(
        f"{w!r}::DOUBLE / sqrt({OMEGA_M}::DOUBLE * pow(1 + {z} * ({x!r}::DOUBLE + 1) / 2, 3) + {OMEGA_L}::DOUBLE)"
        for x, w in zip(at.tolist(), weight.tolist(), strict=True)
    )
    return f"(({terms}) * {z} / 2 * {LIGHT / HUBBLE!r}::DOUBLE)"


def position(ra: Column, dec: Column, distance: Column) -> dict[str, Column]:
    """Cartesian coordinates of degrees of right ascension and declination at a distance."""
    a, d = F.radians(ra), F.radians(dec)
    return {"x": distance * F.cos(d) * F.cos(a), "y": distance * F.cos(d) * F.sin(a), "z": distance * F.sin(d)}


def rest_start(c0: Column, z: Column) -> Column:
    """Start of a log-wavelength axis moved to rest."""
    return c0 - F.log10(1 + z)


def wavelengths(c0: Column, c1: Column, n: Column) -> Column:
    """10 ** (c0 + c1 i) for i below n."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pow(F.lit(10.0), c0 + c1 * i))
