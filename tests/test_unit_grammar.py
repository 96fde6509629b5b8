from hypothesis import given
from hypothesis import strategies as st

from moltide.functions.unit_grammar import ENERGY_UNITS, LENGTH_UNITS, read_label, scan_text

SPELLINGS = {
    "e": {
        "kcal/mol": ["kcal/mol", "KCAL/MOL", " kcal/mol ", "kcal mol^-1", "kcal mol⁻¹", "kcal.mol-1", "kcal per mole", "kilocalories per mole", "kcal"],
        "kj/mol": ["kJ/mol", "KJ/MOL", "kJ mol-1", "kilojoules per mole"],
        "hartree": ["Eh", "E_h", "Ha", "a.u.", "au", "Hartrees", "atomic units (hartree)"],
        "ev": ["eV", "electron volts", "electronvolt"], "mev": ["meV", "milli-eV", "millielectronvolt"], "mhartree": ["mEh", "mHa", "millihartree"],
    },
    "r": {"angstrom": ["Å", "A", "ang", "Ångström", "ANGSTROMS"], "bohr": ["a0", "a_0", "au", "a.u.", "Bohr"], "nm": ["nm", "NM", "nanometres"], "pm": ["pm", "picometre"]},
    "f": {"ev/angstrom": ["eV/Å", "eV per angstrom"], "hartree/bohr": ["Eh/a0", "atomic units (hartree) / atomic units of length"], "kj/mol/nm": ["kJ mol-1 per nm", "kJ/mol/nm"]},
}


def test_labels():
    for field, units in SPELLINGS.items():
        for unit, spellings in units.items():
            for s in spellings:
                assert read_label(s, field) == unit, (s, field)


def test_what_names_no_unit():
    for s in (None, "", "  ", "n/a", "unknown", "furlong", "kcal/eV", "x" * 500, "5"):
        assert read_label(s, "e") is None
    assert read_label("bohr", "e") is None and read_label("eV", "r") is None  # the field's dimension decides


@given(st.text(max_size=60))
def test_any_text_is_read(s):
    assert read_label(s, "e") in {None, *ENERGY_UNITS}
    assert read_label(s, "r") in {None, *LENGTH_UNITS}
    scan_text(s)


def test_prose():
    assert scan_text("Energies in kJ mol-1. xyz block uses a0;") == {"e": "kj/mol", "r": "bohr"}
    assert scan_text("E was eV, now atomic units (hartree)") == {"e": "hartree"}
    assert scan_text("kJ/mol -> kcal per mole before upload") == {"e": "kcal/mol"}
    assert scan_text("E[eV]") == {"e": "ev"}
    assert scan_text("force block straight from the program: kcal/mol / a0.") == {"f": "kcal/mol/bohr"}
    for decoy in ("Box edge 27 angstrom.", "SCF stopped at 1e-8 hartree.", "Paper tables use kJ/mol.", "Loss reported in kcal/mol.", "gap 3.4 eV", "checked", None, ""):
        assert scan_text(decoy) == {}
