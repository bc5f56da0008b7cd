"""Force-dependent rates and starting guesses for rupture-force fits."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KB = 0.01380649  # pN nm / K


def bell_rate(force: Column, k0: float, x_dagger: float, kelvin: float = 298.15) -> Column:
    return k0 * F.exp(force * (x_dagger / (KB * kelvin)))


def chs_rate(force: Column, k0: float, x_dagger: float, dg: float, nu: float = 0.5,
             kelvin: float = 298.15) -> Column:
    """Rate with a force-dependent barrier; ``dg`` in units of kT."""
    z = 1 - force * (nu * x_dagger / (dg * KB * kelvin))
    return k0 * F.pow(z, F.lit(2 - 1 / nu)) * F.exp(dg * (1 - F.pow(z, F.lit(1 / nu))))


def guess_x_dagger(sigma_f: Column, kelvin: float = 298.15) -> Column:
    return math.pi / math.sqrt(6) * F.try_divide(F.lit(KB * kelvin), sigma_f)


def guess_k0(mean_f: Column, loading_rate: Column, x_dagger: Column, kelvin: float = 298.15) -> Column:
    kt = KB * kelvin
    return loading_rate * x_dagger / kt * F.exp(-mean_f * x_dagger / kt)
