"""Geometry of packed records as expressions: no shuffle, no Python.

``r`` holds x, y, z of atom 0, then atom 1, ...; pair lists are in row-major order of
the lower triangle, (1,0), (2,0), (2,1), (3,0), ... unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from moltide.functions.chemistry import mass


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once: inside an array function any other expression is computed anew for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def n_atoms(r: Column) -> Column:
    return F.floor(F.size(r) / 3).cast("int")


def position(r: Column, i: Column) -> list[Column]:
    return [F.get(r, i * 3 + k) for k in range(3)]


def norm(d: list[Column]) -> Column:
    return F.sqrt(sum(x * x for x in d))


def minimum_image(d: list[Column], cell: tuple[float, float, float] | None) -> list[Column]:
    """Shortest image of a difference in an orthorhombic cell (half-even rounding); unchanged without a cell."""
    return d if cell is None else [x - F.lit(a) * F.rint(x / F.lit(a)) for x, a in zip(d, cell, strict=True)]


def over_pairs(r: Column, make: Callable[[Column, Column, list[Column]], Column], cell: tuple[float, float, float] | None = None) -> Column:
    """An array of make(i, j, r_i - r_j) over all pairs i > j; empty for fewer than two atoms."""

    def row(i: Column) -> Column:
        def at(j: Column) -> Column:
            d = [a - b for a, b in zip(position(r, i), position(r, j), strict=True)]
            return make(i, j, minimum_image(d, cell))

        return F.transform(F.sequence(F.lit(0), i - 1), at)

    n = n_atoms(r)
    return F.flatten(F.transform(F.sequence(F.least(F.lit(1), n - 1), n - 1), lambda i: F.when(i >= 1, row(i)).otherwise(F.array())))


def pair_distances(r: Column, cell: tuple[float, float, float] | None = None) -> Column:
    return over_pairs(r, lambda i, j, d: norm(d), cell)


def upper_pair_distances(r: Column) -> Column:
    """Distances in the order (0,1), (0,2), ..., (1,2), ..."""
    n = n_atoms(r)

    def row(i: Column) -> Column:
        return F.transform(F.sequence(i + 1, n - 1), lambda j: norm([a - b for a, b in zip(position(r, i), position(r, j), strict=True)]))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 2), row))


def inverse_distances(r: Column, cell: tuple[float, float, float] | None = None) -> Column:
    """The descriptor 1 / d of every pair."""
    return over_pairs(r, lambda i, j, d: 1.0 / norm(d), cell)


def descriptor_jacobian(r: Column, cell: tuple[float, float, float] | None = None) -> Column:
    """(r_i - r_j) / d^3 of every pair as an array of three."""
    return over_pairs(r, lambda i, j, d: let(F.pow(norm(d), F.lit(3)), lambda cube: F.array(*[x / cube for x in d])), cell)


def scatter_to_atoms(r: Column, pair_values: Column) -> Column:
    """Forces on atoms from a number per pair: for pair (i, j) its Jacobian times the number on j, minus that on i; 3 numbers an atom.

    On atom a that is the sum over all others b of -(r_a - r_b) / d^3 times the pair's number.
    """
    n = n_atoms(r)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])

    def on_atom(values: Column, a: Column) -> Column:
        def add(s: Column, b: Column) -> Column:
            high, low = F.greatest(a, b), F.least(a, b)
            d = [p - q for p, q in zip(position(r, a), position(r, b), strict=True)]
            pull = F.get(values, F.floor(high * (high - 1) / 2).cast("int") + low) / F.pow(norm(d), F.lit(3))
            return F.when(a == b, s).otherwise(let(pull, lambda v: F.struct(*[(s[c] - x * v).alias(c) for c, x in zip("xyz", d, strict=True)])))

        return let(F.aggregate(F.sequence(F.lit(0), n - 1), zero, add), lambda s: F.array(s["x"], s["y"], s["z"]))

    return let(pair_values, lambda values: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda a: on_atom(values, a))))


def jacobian_times(r: Column, v: Column) -> Column:
    """For every pair its Jacobian's product with v_j - v_i, v three numbers an atom: how the descriptor moves with the atoms."""

    def product(i: Column, j: Column, d: list[Column]) -> Column:
        move = sum(x * (b - a) for x, a, b in zip(d, position(v, i), position(v, j), strict=True))
        return move / F.pow(norm(d), F.lit(3))

    return over_pairs(r, product)


def center_of_mass(r: Column, z: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Mass-weighted mean of the atoms for which keep(atom index) holds, as struct x, y, z, m."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("x", "y", "z", "m")])

    def add(s: Column, i: Column) -> Column:
        m = mass(F.get(z, i)) if keep is None else F.when(keep(i), mass(F.get(z, i))).otherwise(0.0)
        x, y, c = position(r, i)
        return F.struct((s["x"] + m * x).alias("x"), (s["y"] + m * y).alias("y"), (s["z"] + m * c).alias("z"), (s["m"] + m).alias("m"))

    mean = lambda s: F.struct(*[(s[n] / s["m"]).alias(n) for n in ("x", "y", "z")], s["m"].alias("m"))
    return F.aggregate(F.sequence(F.lit(0), n_atoms(r) - 1), zero, add, mean)


def centered(r: Column, z: Column) -> Column:
    """Coordinates relative to the center of mass."""
    return let(center_of_mass(r, z), lambda c: F.transform(r, lambda x, i: x - F.when(i % 3 == 0, c["x"]).when(i % 3 == 1, c["y"]).otherwise(c["z"])))


def max_pair_distance(r: Column) -> Column:
    return F.array_max(pair_distances(r))


def com_distance_sum(r: Column, z: Column, entity_ids: Column) -> Column:
    """Sum over fragments of the distance of their center of mass to the whole's."""
    def to_whole(whole: Column, entity: Column) -> Column:
        part = center_of_mass(r, z, lambda i: F.get(entity_ids, i) == entity)
        return let(part, lambda p: norm([p[n] - whole[n] for n in ("x", "y", "z")]))

    lengths = let(center_of_mass(r, z), lambda whole: F.transform(F.array_distinct(entity_ids), lambda entity: to_whole(whole, entity)))
    return F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x)


def accepted(value: Column, cutoff: float | tuple[float, float] | None, bound: str = "upper") -> Column:
    """Strict cutoff test: below ('upper'), above ('lower'), between two cutoffs, or always (None)."""
    if cutoff is None:
        return F.lit(True)
    if isinstance(cutoff, (tuple, list)):
        low, high = sorted(cutoff)
        return (value > low) & (value < high)
    if bound not in ("upper", "lower"):
        raise ValueError("bound is 'upper' or 'lower'")
    return value < cutoff if bound == "upper" else value > cutoff


def relative_to_first(r: Column, cell: tuple[float, float, float]) -> Column:
    """Coordinates as minimum images relative to the first atom."""
    def coordinate(x: Column, i: Column) -> Column:
        d = x - F.get(r, i % 3)
        side = F.when(i % 3 == 0, cell[0]).when(i % 3 == 1, cell[1]).otherwise(cell[2])
        return d - side * F.rint(d / side)

    return F.transform(r, coordinate)


def cell_volume(cell: tuple[float, float, float]) -> float:
    return cell[0] * cell[1] * cell[2]


def virial(r: Column, f: Column) -> Column:
    """Sum over atoms of r (x) f, row-major 3 x 3."""
    def entry(a: int, b: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), n_atoms(r) - 1), F.lit(0.0), lambda s, i: s + F.get(r, i * 3 + a) * F.get(f, i * 3 + b))

    return F.array(*[entry(a, b) for a in range(3) for b in range(3)])


def isotropic_stress(w: Column, volume: float) -> Column:
    """Mean of the virial's diagonal over the volume on the diagonal, zero elsewhere; row-major."""
    p = (F.get(w, F.lit(0)) + F.get(w, F.lit(4)) + F.get(w, F.lit(8))) / 3.0 / F.lit(volume)
    return F.array(*[p if i in (0, 4, 8) else F.lit(0.0) for i in range(9)])
