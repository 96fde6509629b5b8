"""Element and unit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moltide.functions.unit_grammar import ENERGY_UNITS, LENGTH_UNITS

# Symbol and mass of the most abundant isotope, by atomic number.
ELEMENTS = {
    1: ("H", 1.00782503223), 2: ("He", 4.00260325413), 3: ("Li", 7.0160034366), 4: ("Be", 9.012183065), 5: ("B", 11.00930536),
    6: ("C", 12.0), 7: ("N", 14.00307400443), 8: ("O", 15.99491461957), 9: ("F", 18.99840316273), 10: ("Ne", 19.9924401762),
    11: ("Na", 22.989769282), 12: ("Mg", 23.985041697), 13: ("Al", 26.98153853), 14: ("Si", 27.97692653465), 15: ("P", 30.97376199842),
    16: ("S", 31.9720711744), 17: ("Cl", 34.968852682), 18: ("Ar", 39.9623831237),
}


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def symbol(z: Column) -> Column:
    """Element symbol; null beyond the table."""
    return _lookup({k: s for k, (s, _) in ELEMENTS.items()}, z)


def atomic_number(element: Column) -> Column:
    return _lookup({s: k for k, (s, _) in ELEMENTS.items()}, element)


def mass(z: Column) -> Column:
    return _lookup({k: m for k, (_, m) in ELEMENTS.items()}, z)


def convert_energy(e: Column, source: str, target: str) -> Column:
    """Energies from one unit to another; an unknown unit raises ValueError."""
    return e * F.lit(_size(ENERGY_UNITS, source) / _size(ENERGY_UNITS, target))


def convert_length(r: Column, source: str, target: str) -> Column:
    return r * F.lit(_size(LENGTH_UNITS, source) / _size(LENGTH_UNITS, target))


def convert_force(f: Column, source: tuple[str, str], target: tuple[str, str]) -> Column:
    """Forces from (energy, length) units to others: the energy part as energies, the length part inversely."""
    return f * F.lit(_size(ENERGY_UNITS, source[0]) / _size(ENERGY_UNITS, target[0]) / (_size(LENGTH_UNITS, source[1]) / _size(LENGTH_UNITS, target[1])))


def _size(units: dict[str, float], name: str) -> float:
    if name not in units:
        raise ValueError(f"unknown unit {name!r}; known: {', '.join(units)}")
    return units[name]


def repeat_ids(count: Column, each: Column, start: int = 0) -> Column:
    """Fragment ids start, start + 1, ... each ``each`` times: one per atom of ``count`` equal fragments."""
    ids = F.when(count > 0, F.sequence(F.lit(start), F.lit(start) + count - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(ids, lambda i: F.array_repeat(i.cast("int"), each)))


def repeat_labels(label: Column, count: Column) -> Column:
    return F.array_repeat(label, count)


def switched(x: Column, factor: Column) -> Column:
    """factor * x; a factor outside 0 ... 1 fails the query."""
    return F.when(F.assert_true((factor >= 0) & (factor <= 1), "the factor must lie between 0 and 1").isNull(), factor * x)


def voigt(w: Column) -> Column:
    """Six components xx, yy, zz, yx, xz, xy of a row-major 3 x 3 array (the fourth is yx by convention here)."""
    return F.array(*[F.get(w, F.lit(i)) for i in (0, 4, 8, 3, 2, 1)])
