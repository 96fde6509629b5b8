from conftest import at, dataset, structure

from moltide.operators import units
from moltide.sources.tables import table

BOHR = 0.529177210903
R = [0.0, 0.0, 0.0, 0.96, 0.0, 0.0, -0.24, 0.93, 0.0]


def found(spark, d):
    u = units.dataset_units(table(spark, d, "structures"), table(spark, d, "datasets"))
    return {tuple(x) for x in units.values_not_in_common_units(table(spark, d, "structures"), u).collect()}


def test_labels_notes_rows_and_numbers(spark, tables):
    d = tables(
        extra=True,
        datasets=[
            dataset(1), dataset(2, e_unit="E_h", r_unit="au"), dataset(3, e_unit=None, r_unit=None, notes="E column is eV. lengths are nm. Forces in kJ/mol per Å."),
            dataset(4, e_unit="kcal/mol", r_unit="angstrom"), dataset(5, loaded_at=None, z=None, comp_ids=None, e_unit="eV"),
            dataset(1, e_unit="kJ/mol", loaded_at=at(2024)),  # a later delivery doesn't count
        ],
        structures=[
            structure(1), structure(1, loaded_at=at(2024)), structure(2, e=float("nan")), structure(3, e=None, r=None, f=None), structure(4, row_note="this one still hartree", e=-76.3),
            *[structure(20 + i, dset_id=2, e=-76.3 - i / 100, r=[x / BOHR for x in R]) for i in range(3)],
            *[structure(30 + i, dset_id=3, e=-2077.0 - i, r=[x / 10 for x in R]) for i in range(3)],
            *[structure(40 + i, dset_id=4, e=-76.3, r=[x / BOHR for x in R]) for i in range(3)],  # contradicts its labels
            structure(50, dset_id=5, r=[0.0, None, float("nan")]), structure(51, dset_id=None),
        ],
    )
    got = found(spark, d)
    assert {x for x in got if x[0] < 20} == {(4, "e", "hartree")}
    assert {x for x in got if x[0] == 20} == {(20, "e", "hartree"), (20, "r", "bohr"), (20, "f", "hartree/bohr")}
    assert {x for x in got if x[0] == 30} == {(30, "e", "ev"), (30, "r", "nm"), (30, "f", "kj/mol/angstrom")}
    assert {x for x in got if x[0] == 40} == {(40, "e", "hartree"), (40, "r", "bohr"), (40, "f", "hartree/bohr")}
    u = units.dataset_units(table(spark, d, "structures"), table(spark, d, "datasets"))
    rows = {x.struct_id: x for x in units.to_common_units(table(spark, d, "structures"), u).collect()}
    assert abs(rows[20].r[3] - 0.96) < 1e-9 and abs(rows[20].e + 47878.97) < 0.1 and abs(rows[20].f[0] - 0.1 * 627.5094740631 / BOHR) < 1e-6
    assert rows[3].e is None and rows[3].r is None


def test_empty_tables(spark, tables):
    assert found(spark, tables()) == set()
    assert found(spark, tables(datasets=[dataset(1)])) == set()


def test_a_label_holds_where_the_numbers_allow_it(spark, tables):
    """A shortest distance of 1.3 may be angstrom or bohr: the label decides, the numbers only where there is none; all atoms count, not the first."""
    far = [0.0, 0.0, 0.0, 1.35, 0.0, 0.0, 0.0, 1.35, 0.0]
    ring = [9.0, 9.0, 9.0, 0.0, 0.0, 0.0, 0.96, 0.0, 0.0]  # atom 0 is far from both others
    d = tables(
        datasets=[dataset(1, r_unit="Angstrom"), dataset(2, r_unit="a0"), dataset(3, r_unit=None), dataset(4, r_unit=None), dataset(5, r_unit="  ".join(["not a unit"] * 40))],
        structures=[structure(i, dset_id=i, r=far, e=None, f=None) for i in (1, 2, 3)] + [structure(i, dset_id=i, r=ring, e=None, f=None) for i in (4, 5)],
    )
    assert found(spark, d) == {(2, "r", "bohr")}
    far2 = [x * 1.15 for x in far]  # 1.55: nearer to a bond as bohr
    d = tables(datasets=[dataset(1, r_unit="Angstrom"), dataset(2, r_unit="bohr"), dataset(3, r_unit=None)], structures=[structure(i, dset_id=i, r=far2, e=None, f=None) for i in (1, 2, 3)])
    assert found(spark, d) == {(2, "r", "bohr"), (3, "r", "bohr")}
