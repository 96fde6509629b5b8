from conftest import at, dataset, structure

from moltide.operators import references
from moltide.sources.tables import table

A, B, C, D = "a" * 32, "b" * 32, "c" * 32, "d" * 32


def found(spark, d):
    return {tuple(x) for x in references.unresolved(*(table(spark, d, t) for t in ("datasets", "structures", "predictsets", "rsets", "models"))).collect()}


def test_states(spark, tables):
    d = tables(
        extra=True,
        rsets=[(A.upper(), "a", 10, 5, at(2020), None), (f" md5:{B}\n", "b", 10, 5, at(2024), None), (C, "c", 10, 5, at(2020), at(2023)), (C, "c", 10, 5, at(2025), at(2023)), (None, "n", None, None, None, None)],
        models=[(A, "gdml", None, 1, None, None, at(2025), at(2020))],
        datasets=[
            dataset(1, dset_md5=A, r_prov_ids={0: f"\tMD5:{A}\n", 1: B, 2: C, 3: D, 4: None, 5: " \n", 6: "n/a"}, mb_dsets_md5=[A, D, D, None, ""]),
            dataset(1, dset_md5=A, r_prov_ids={0: f"\tMD5:{A}\n", 1: B, 2: C, 3: D, 4: None, 5: " \n", 6: "n/a"}, mb_dsets_md5=[A, D, D, None, ""], loaded_at=at(2024)),
            dataset(2, dset_md5=None, created_at=None, r_prov_ids=None, mb_dsets_md5=None),
        ],
        predictsets=[(7, "p", 1, None, [A, A, None], at(2023, 2), at(2023)), (7, "p", 1, None, [A], at(2023, 2), at(2024)), (8, "q", 1, None, None, at(2023), at(2023))],
        structures=[structure(1, r_prov_specs=[0, 9, 4]), structure(2, r_prov_specs=[0, 10, 4]), structure(3, r_prov_specs=[0, 1, 5]), structure(3, r_prov_specs=[0, 1, 5]), structure(4, r_prov_specs=[9, 0]), structure(5, r_prov_specs=[]), structure(6), structure(7, r_prov_specs=[3, 99, 99])],
    )
    month = "2023-05"
    assert found(spark, d) == {
        ("datasets", "r_prov_ids", 1, B, "late", month), ("datasets", "r_prov_ids", 1, C, "deleted", month), ("datasets", "r_prov_ids", 1, D, "missing", month),
        ("datasets", "mb_dsets_md5", 1, A, "late", month), ("datasets", "mb_dsets_md5", 1, D, "missing", month), ("predictsets", "models_md5", 7, A, "late", "2023-02"),
        ("structures", "r_prov_specs", 2, "0,10,4", "missing", "2023-07"), ("structures", "r_prov_specs", 3, "0,1,5", "missing", "2023-07"), ("structures", "r_prov_specs", 4, "9,0", "missing", "2023-07"),
    }


def test_empty_tables(spark, tables):
    assert found(spark, tables()) == set()
    d = tables(datasets=[dataset(1, r_prov_ids={0: A})])
    assert found(spark, d) == {("datasets", "r_prov_ids", 1, A, "missing", "2023-05")}


def test_missing_without_a_date(spark, tables):
    """A missing target stays missing where its owner has no creation time; a hash with a line end is the same hash."""
    d = tables(rsets=[(f"{A}\n", "a", 10, 5, at(2020), None)], datasets=[dataset(1, created_at=None, r_prov_ids={0: A, 1: B})])
    assert found(spark, d) == {("datasets", "r_prov_ids", 1, B, "missing", None)}


def test_hot_source_and_negative_places(spark, tables):
    """Records of one source: only those outside it come out, negative places included; a source that isn't known has any place."""
    d = tables(
        rsets=[(A, "a", 10, 5, at(2020), None)],
        datasets=[dataset(1, r_prov_ids={0: A, 1: B})],
        structures=[structure(i, r_prov_specs=[0, i % 10, 1]) for i in range(40)] + [structure(50, r_prov_specs=[0, -1, 1]), structure(51, r_prov_specs=[0, 1, -1]), structure(52, r_prov_specs=[1, 999, 999]), structure(53, r_prov_specs=[0, 3])],
    )
    assert {x[2] for x in found(spark, d) if x[0] == "structures"} == {50, 51}
