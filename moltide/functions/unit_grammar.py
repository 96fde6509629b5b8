"""Unit strings as a small grammar: tries of prefixes, roots and exponents, cut
into the cheapest sequence by dynamic programming, ambiguous cuts settled by a
prior on the dimension that the field can have.

``read_label(text, field)`` reads a cell that should hold nothing but a unit.
``scan_text(text)`` finds unit phrases inside prose and tells for each whether it
is a quantity (a number stands before it) and which field its clause speaks of.

Both are pure functions of one short string; Spark calls them from Arrow batches
on the distinct strings of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Conversion factors given with the test data.
KCAL_PER_HARTREE = 627.5094740631
KCAL_PER_EV = 23.0605478306
KJ_PER_KCAL = 4.184
ANGSTROM_PER_BOHR = 0.529177210903

ENERGY_UNITS = {  # name -> kcal/mol
    "kcal/mol": 1.0,
    "hartree": KCAL_PER_HARTREE,
    "kj/mol": 1.0 / KJ_PER_KCAL,
    "ev": KCAL_PER_EV,
    "mev": KCAL_PER_EV / 1000.0,
    "mhartree": KCAL_PER_HARTREE / 1000.0,
}
LENGTH_UNITS = {"angstrom": 1.0, "bohr": ANGSTROM_PER_BOHR, "nm": 10.0, "pm": 0.01}  # name -> angstrom

#: Factors of a cut; the fields' dimensions have an energy, a mole and a length, so a longer product names none of them. Texts may have any length.
MOST_FACTORS = 5

#: Dimension that each field can have, as (energy, length) exponents.
FIELD_DIMENSION = {"e": (1, 0), "r": (0, 1), "f": (1, -1)}

# (spelling, power of ten)
_PREFIXES = [
    ("k", 3), ("kilo", 3), ("m", -3), ("milli", -3), ("n", -9), ("nano", -9),
    ("p", -12), ("pico", -12), ("c", -2), ("centi", -2), ("u", -6), ("micro", -6),
    ("milli-", -3), ("kilo-", 3), ("nano-", -9), ("pico-", -12),
]
# (spelling, root, extra cost); the root gives dimension and size
_ROOTS = [
    ("cal", "cal", 0), ("calorie", "cal", 0), ("calories", "cal", 0),
    ("J", "joule", 0), ("joule", "joule", 0), ("joules", "joule", 0),
    ("eV", "ev", 0), ("electronvolt", "ev", 0), ("electronvolts", "ev", 0),
    ("electron volt", "ev", 0), ("electron volts", "ev", 0), ("electron-volt", "ev", 0), ("electron-volts", "ev", 0),
    ("hartree", "hartree", 0), ("hartrees", "hartree", 0), ("Ha", "hartree", 0), ("Eh", "hartree", 0), ("E_h", "hartree", 0),
    ("a.u.", "hartree", 0.6), ("a.u.", "bohr", 0.6), ("au", "hartree", 0.6), ("au", "bohr", 0.6),
    ("atomic units", "hartree", 0.6), ("atomic units", "bohr", 0.6), ("atomic unit", "hartree", 0.6), ("atomic unit", "bohr", 0.6),
    ("atomic units (hartree)", "hartree", 0), ("atomic units (bohr)", "bohr", 0),
    ("atomic units of length", "bohr", 0), ("atomic units of energy", "hartree", 0),
    ("bohr", "bohr", 0), ("bohrs", "bohr", 0), ("a0", "bohr", 0), ("a_0", "bohr", 0),
    ("angstrom", "angstrom", 0), ("angstroms", "angstrom", 0), ("ang", "angstrom", 0), ("A", "angstrom", 0.5),
    ("å", "angstrom", 0), ("ångström", "angstrom", 0), ("ångströms", "angstrom", 0),
    ("m", "metre", 0.2), ("meter", "metre", 0), ("metre", "metre", 0), ("meters", "metre", 0), ("metres", "metre", 0),
    ("mol", "mole", 0), ("mole", "mole", 0), ("moles", "mole", 0),
]
# (spelling, exponent)
_EXPONENTS = [("-1", -1), ("^-1", -1), ("**-1", -1), ("⁻¹", -1), ("^(-1)", -1), ("1", 1), ("^1", 1)]
# (spelling, what follows is divided)
_SEPARATORS = [("/", True), (" / ", True), ("/ ", True), (" /", True), (" per ", True), (" ", False), (".", False), ("*", False), ("·", False), ("-", False)]

# root -> (energy, length, mole exponents, size in joule-like or metre-like units)
_ROOT_SIZE = {
    "cal": (1, 0, 0, "molar", 1.0 / 1000.0),  # kcal/mol per cal/mol
    "joule": (1, 0, 0, "molar", 1.0 / KJ_PER_KCAL / 1000.0),
    "ev": (1, 0, 0, "particle", KCAL_PER_EV),
    "hartree": (1, 0, 0, "particle", KCAL_PER_HARTREE),
    "bohr": (0, 1, 0, "", ANGSTROM_PER_BOHR),
    "angstrom": (0, 1, 0, "", 1.0),
    "metre": (0, 1, 0, "", 1e10),
    "mole": (0, 0, 1, "", 1.0),
}


def _trie(entries: list[tuple]) -> dict:
    top: dict = {}
    for spelling, *value in entries:
        node = top
        for ch in spelling.casefold():
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((spelling, *value))
    return top


_PREFIX_TRIE, _ROOT_TRIE, _EXPONENT_TRIE, _SEPARATOR_TRIE = map(_trie, (_PREFIXES, _ROOTS, _EXPONENTS, _SEPARATORS))


def _walk(trie: dict, text: str, folded: str, at: int):
    """Entries of the trie that start at ``at``: (end, case cost, value)."""
    node = trie
    for end in range(at, len(folded)):
        node = node.get(folded[end])
        if node is None:
            return
        for spelling, *value in node.get("", ()):
            yield end + 1, (0.0 if text[at : end + 1] == spelling else 0.3), value


def _fold(text: str) -> str:
    """Case folding that keeps every position, so both strings can be indexed alike."""
    return "".join(c if len(c.casefold()) != 1 else c.casefold() for c in text)


class _Parse:
    """Cheapest cuts of the text from one start. A cut is a list of (root, exponent, power of ten)."""

    def __init__(self, text: str):
        self.text, self.folded, self.memo = text, _fold(text), {}

    def factors(self, at: int, divided: bool, most: int = MOST_FACTORS) -> dict[tuple[int, tuple], float]:
        """(end, factors) -> cost of all cuts of at most ``most`` factors that begin at ``at``; only the cheapest for each is kept."""
        key = (at, divided, most)
        if key in self.memo:
            return self.memo[key]
        heads = [(at, 0.0, 0)] + [(end, 0.25 + case, power) for end, case, (power,) in _walk(_PREFIX_TRIE, self.text, self.folded, at)]
        found: dict[tuple[int, tuple], float] = {}

        def keep(end: int, cut: tuple, cost: float) -> None:
            if cost < found.get((end, cut), 1e9):
                found[end, cut] = cost

        for start, head_cost, power in heads:
            for end, case, (root, extra) in _walk(_ROOT_TRIE, self.text, self.folded, start):
                if power and root in ("mole", "bohr", "angstrom"):
                    continue
                cost = 1.0 + head_cost + case + extra
                tails = [(end, 1, 0.0)] + [(e, x, 0.1) for e, _, (x,) in _walk(_EXPONENT_TRIE, self.text, self.folded, end)]
                for tail, exponent, tail_cost in tails:
                    sign = -exponent if divided else exponent
                    factor = (root, sign, power)
                    keep(tail, (factor,), cost + tail_cost)
                    for nxt, _, (slash,) in _walk(_SEPARATOR_TRIE, self.text, self.folded, tail) if most > 1 else ():
                        for (stop, rest), more in self.factors(nxt, slash, most - 1).items():
                            keep(stop, (factor, *rest), cost + tail_cost + more + 0.05)
        self.memo[key] = found
        return found


def _meaning(cut: tuple) -> tuple[tuple[int, int], str, float] | None:
    """Dimension, canonical name and cost of a cut; None if it is no unit of the three fields."""
    energy = length = mole = 0
    size_e = size_l = 1.0
    molar = None
    for root, exponent, power in cut:
        e, l, m, kind, size = _ROOT_SIZE[root]
        energy, length, mole = energy + e * exponent, length + l * exponent, mole + m * exponent
        if e:
            size_e *= (size * 10.0**power) ** exponent
            molar = kind
        elif l:
            size_l *= (size * 10.0**power) ** abs(exponent)
    if (energy, length) not in FIELD_DIMENSION.values():
        return None
    cost = 0.0
    if energy:
        if molar == "molar" and mole == 0:
            cost += 0.5  # "kcal" for kcal/mol
        elif (molar == "molar") != (mole == -1) or mole not in (0, -1):
            return None
    elif mole:
        return None

    def name(units: dict[str, float], size: float) -> str | None:
        return next((u for u, s in units.items() if abs(s / size - 1.0) < 1e-6), None)

    parts = [p for p in (name(ENERGY_UNITS, size_e) if energy else "", name(LENGTH_UNITS, size_l) if length else "")]
    if None in parts:
        return None
    return (energy, length), "/".join(p for p in parts if p), cost


def _clean(text: str) -> str:
    out = []
    for ch in text:
        if ch in "−‐‑‒–":
            ch = "-"
        elif ch == "Å":
            ch = "Å"
        elif ch.isspace():
            ch = " "
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=65536)
def read_label(text: str | None, field: str) -> str | None:
    """Unit named by a label cell for ``field`` ('e', 'r' or 'f'); None if it names none.

    Null, blank, 'n/a' and words outside the grammar give None. Ambiguous
    spellings ('au', 'a.u.', 'm') are settled by the field's dimension.
    """
    if text is None:
        return None
    text = re.sub(r" +", " ", _clean(text)).strip()
    best: tuple[float, str] | None = None
    for trial in dict.fromkeys((text, text.strip(" .;:,"), text.strip(" .;:,()[]"))):
        if not trial or best:
            continue
        for (end, cut), cost in _Parse(trial).factors(0, False).items():
            if end == len(trial) and (m := _meaning(cut)) and m[0] == FIELD_DIMENSION[field] and (best is None or cost + m[2] < best[0]):
                best = (cost + m[2], m[1])
    return best[1] if best else None


_CLAUSE = re.compile(r"(?<=[.;!?])\s+|\n|;\s*")
_NUMBER_BEFORE = re.compile(r"\d(?:[.,]\d+)?(?:[eE][-+]?\d+)?\s*$")
_WORD = re.compile(r"[^\W\d_]+")
#: Words by which a clause speaks of a field, and of none of the three.
_SUBJECT = {
    "e": {"e", "energy", "energies"},
    "r": {"r", "coordinates", "coordinate", "positions", "position", "lengths", "geometry", "geometries", "xyz"},
    "f": {"f", "force", "forces", "gradient", "gradients"},
}
_ANY_FIELD = {"value", "values", "all", "this", "converted", "rescaled", "row", "column"}
_OTHER = {
    "paper", "tables", "loss", "box", "edge", "cutoff", "threshold", "tolerance", "gap", "optimiser", "optimizer", "scf", "thermostat",
    "elsewhere", "plot", "figure", "restraint", "barrier", "width", "shift", "error", "errors", "rmse", "mae",
}


def _spans(clause: str) -> list[tuple[int, int, tuple[int, int], str]]:
    """Longest unit phrases of a clause: (start, end, dimension, name)."""
    parse, at, found = _Parse(clause), 0, []
    while at < len(clause):
        if at and (clause[at - 1].isalnum() or clause[at - 1] == "_") or not clause[at].isalpha():
            at += 1
            continue
        best = None
        for (end, cut), cost in parse.factors(at, False).items():
            if end < len(clause) and (clause[end].isalnum() or clause[end] == "_") or end - at < 2:
                continue
            if (m := _meaning(cut)) and (best is None or (-end, cost + m[2]) < best[0]):
                best = ((-end, cost + m[2]), end, m[0], m[1])
        if best:
            found.append((at, best[1], best[2], best[3]))
            at = best[1]
        else:
            at += 1
    return found


@lru_cache(maxsize=65536)
def scan_text(text: str | None) -> dict[str, str]:
    """Units that prose gives for the fields, e.g. {'e': 'hartree', 'f': 'ev/bohr'}.

    A phrase right after a number is a quantity and says nothing; a clause whose
    subject is something else (a paper's tables, the box edge) says nothing. Of
    several energy phrases in one clause ("was eV, now hartree", "eV -> hartree")
    the last holds. The first clause that names a field's unit wins.
    """
    if text is None:
        return {}
    out: dict[str, str] = {}
    for clause in _CLAUSE.split(_clean(text)):
        if not clause or not clause.strip():
            continue
        spans = _spans(clause)
        if not spans:
            continue
        outside, last = "", 0
        for start, end, _, _ in spans:
            outside += clause[last:start] + " "
            last = end
        words = {w.casefold() for w in _WORD.findall(outside + clause[last:])}
        named = {f for f, subject in _SUBJECT.items() if words & subject}
        stated: dict[str, str] = {}
        for start, _, dimension, name in spans:
            if _NUMBER_BEFORE.search(clause[:start]):
                continue
            field = next(f for f, d in FIELD_DIMENSION.items() if d == dimension)
            if words & _OTHER and not words & _SUBJECT[field]:
                continue
            if field in named or not named and (words & _ANY_FIELD or "->" in clause):
                stated[field] = name
        for field, name in stated.items():
            out.setdefault(field, name)
    return out
