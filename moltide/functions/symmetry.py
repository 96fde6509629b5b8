"""Permutations of equal atoms: composition, inverse, cycles and the group they generate."""

from __future__ import annotations

import numpy as np


def inverse(p: np.ndarray) -> np.ndarray:
    out = np.empty_like(p)
    out[p] = np.arange(len(p))
    return out


def cycles(p: np.ndarray) -> list[list[int]]:
    """Cycles of two and more elements, each from its smallest."""
    seen, out = set(), []
    for start in range(len(p)):
        if start in seen:
            continue
        at, cycle = start, []
        while at not in seen:
            seen.add(at)
            cycle.append(at)
            at = int(p[at])
        if len(cycle) > 1:
            out.append(cycle)
    return out


def group(generators: np.ndarray, most: int = 100) -> np.ndarray:
    """All products of the permutations, in lexical order; more than ``most`` raise ValueError."""
    n = len(generators[0])
    known, front = {tuple(range(n))}, [tuple(range(n))]
    while front:
        grown = []
        for p in front:
            for g in generators:
                q = tuple(int(p[i]) for i in g)
                if q not in known:
                    known.add(q)
                    grown.append(q)
                    if len(known) > most:
                        raise ValueError(f"more than {most} permutations")
        front = grown
    return np.array(sorted(known))


def swaps_of_equal_atoms(z: list[int], entity_ids: list[int]) -> np.ndarray:
    """Generators that exchange equal hydrogens inside a fragment."""
    out = []
    for e in dict.fromkeys(entity_ids):
        same = [i for i, x in enumerate(z) if x == 1 and entity_ids[i] == e]
        for a, b in zip(same, same[1:], strict=False):
            p = list(range(len(z)))
            p[a], p[b] = b, a
            out.append(p)
    return np.array(out or [list(range(len(z)))])
