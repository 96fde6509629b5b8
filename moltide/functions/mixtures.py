"""Mixtures: mass fractions, densities, volumes and molecule counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

AVOGADRO = 6.02214076e23


def mass_fraction(moles: Column, molar_mass: Column, *keys: str) -> Column:
    part = moles * molar_mass
    return part / F.sum(part).over(Window.partitionBy(*keys))


def mixture_density(fraction: Column, density: Column, *keys: str) -> Column:
    return F.sum(fraction * density).over(Window.partitionBy(*keys))


def volume(shape: str, length: float) -> float:
    """Cubic metres of a cube of that side, or a sphere of that diameter, in angstrom."""
    metres = length * 1e-10
    if shape == "box":
        return metres**3
    if shape == "sphere":
        return 4.0 / 3.0 * math.pi * (metres / 2.0) ** 3
    raise ValueError("shape is 'box' or 'sphere'")


def molecules_in(fraction: Column, density: Column, molar_mass: Column, length: float, shape: str = "box") -> Column:
    """Whole molecules (cut, not rounded) of a kind in a container at the mixture's density (kg/m3)."""
    return F.floor(fraction * volume(shape, length) * density * 1000.0 / molar_mass * AVOGADRO + 1e-9).cast("bigint")
