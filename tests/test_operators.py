import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from moltide.functions import chemistry, mixtures, symmetry
from moltide.operators import fragments as fr
from moltide.operators import geometry as g
from moltide.operators import kernel, losses, sampling

RNG = np.random.default_rng(3)


def test_pair_orders_and_center(spark):
    r = RNG.normal(size=(4, 3)) * 3
    df = spark.createDataFrame([(r.ravel().tolist(), [8, 1, 1, 6], [0, 0, 0, 1])], "r array<double>, z array<int>, ids array<int>")
    row = df.select(
        g.pair_distances(F.col("r")).alias("low"), g.upper_pair_distances(F.col("r")).alias("up"), g.center_of_mass(F.col("r"), F.col("z")).alias("c"),
        g.scatter_to_atoms(F.col("r"), F.array(*[F.lit(float(k)) for k in range(6)])).alias("f"), g.com_distance_sum(F.col("r"), F.col("z"), F.col("ids")).alias("l"),
        g.descriptor_jacobian(F.col("r")).alias("j"), g.centered(F.col("r"), F.col("z")).alias("rc"),
    ).first()
    low = [np.linalg.norm(r[i] - r[j]) for i in range(4) for j in range(i)]
    up = [np.linalg.norm(r[i] - r[j]) for i, j in itertools.combinations(range(4), 2)]
    assert np.allclose(row.low, low) and np.allclose(row.up, up)
    m = np.array([chemistry.ELEMENTS[k][1] for k in (8, 1, 1, 6)])
    c = (m[:, None] * r).sum(0) / m.sum()
    assert np.allclose([row.c.x, row.c.y, row.c.z], c) and np.allclose(np.reshape(row.rc, (4, 3)), r - c)
    part = (m[:3, None] * r[:3]).sum(0) / m[:3].sum()
    assert np.isclose(row.l, np.linalg.norm(part - c) + np.linalg.norm(r[3] - c))
    want = np.zeros((4, 3))
    for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i)):
        jac = (r[i] - r[j]) / np.linalg.norm(r[i] - r[j]) ** 3
        assert np.allclose(row.j[k], jac)
        want[j] += k * jac
        want[i] -= k * jac
    assert np.allclose(np.reshape(row.f, (4, 3)), want)


def test_one_atom_and_none(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [8]), ([], []), (None, None)], "r array<double>, z array<int>")
    assert [x.p for x in df.select(g.pair_distances(F.col("r")).alias("p")).collect()] in ([[], [], None], [[], None, None])


def test_cutoffs_are_strict(spark):
    df = spark.createDataFrame([(5.0,), (4.999,), (5.001,)], "v double")
    got = [tuple(x) for x in df.select(g.accepted(F.col("v"), 5.0), g.accepted(F.col("v"), 5.0, "lower"), g.accepted(F.col("v"), (6.0, 5.0)), g.accepted(F.col("v"), None)).collect()]
    assert got == [(False, False, False, True), (True, False, False, True), (False, True, True, True)]
    with pytest.raises(ValueError):
        g.accepted(F.col("v"), 5.0, "sideways")


def test_minimum_image_rounds_half_even(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 6.0, 9.0, -15.0],)], "r array<double>")
    d = df.select(g.pair_distances(F.col("r"), (12.0, 12.0, 12.0))[0]).first()[0]
    assert np.isclose(d, np.sqrt(36 + 9 + 9))


def test_units_switching_and_voigt(spark):
    df = spark.createDataFrame([(1.0, [float(i) for i in range(9)])], "x double, w array<double>")
    e, f, v = df.select(chemistry.convert_energy(F.col("x"), "hartree", "kcal/mol"), chemistry.convert_force(F.col("x"), ("hartree", "bohr"), ("kcal/mol", "angstrom")), chemistry.voigt(F.col("w"))).first()
    assert np.isclose(e, 627.5094740631) and np.isclose(f, 627.5094740631 / 0.529177210903) and v == [0.0, 4.0, 8.0, 3.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        chemistry.convert_energy(F.col("x"), "furlong", "ev")
    assert df.select(chemistry.switched(F.col("x"), F.lit(0.25))).first()[0] == 0.25
    with pytest.raises(Exception, match="between 0 and 1"):
        df.select(chemistry.switched(F.col("x"), F.lit(1.5))).collect()


def test_water_box(spark):
    df = spark.createDataFrame([(1.0, 18.01528, 997.0)], "w double, m double, rho double")
    assert df.select(mixtures.molecules_in(F.col("w"), F.col("rho"), F.col("m"), 10.0)).first()[0] == 33
    with pytest.raises(ValueError):
        mixtures.volume("cone", 1.0)


def test_combinations(spark):
    from moltide.plans import nbody

    df = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],)], "comp_ids array<string>")
    rows = lambda *a, **k: [tuple(map(tuple, x[0])) for x in df.select(fr.labelled_combinations(F.col("comp_ids"), *a, **k)).collect()]
    assert rows(["a", "a"]) == [((0, 2),), (), ()]
    assert rows(["a", "b"]) == [((0, 1),), (), ()]  # (2, 1) falls, as it doesn't rise
    assert rows(["a", "b"], ascending=False) == [((0, 1), (2, 1)), (), ()]
    assert rows([None, None, None]) == [((0, 1, 2),), (), ()] and rows([None])[1] == ((0,),)
    for labels in (["a", "a"], ["a", "b"], [None, None], [None, "a"]):
        assert rows(labels)[0] == tuple(nbody.combinations(["a", "b", "a"], tuple(labels)))
    df = spark.createDataFrame([([7, 3, 9, 5],), ([1],), ([],)], "v array<bigint>")
    got = [x[0] for x in df.select(fr.combinations_of(F.col("v"), 2)).collect()]
    assert got == [[list(c) for c in itertools.combinations([7, 3, 9, 5], 2)], [], []]


def test_many_body(spark):
    schema = "struct_id bigint, source string, frame bigint, fragments array<bigint>, theory string, e double, f array<double>, entity_ids array<int>"
    atoms = lambda *ids: [float(i) for i in ids for _ in range(3)]
    # fragments 1, 2, 3 of one, two and one atoms; the second one's atoms are not next to each other
    p = spark.createDataFrame([(1, "s", 0, [1, 2, 3], "t", -10.0, atoms(10, 20, 30, 40), [1, 0, 1, 2]), (2, "s", 1, [1, 2, 3], "t", -5.0, None, [0, 1, 1, 2])], schema)
    low = spark.createDataFrame(
        [
            (9, "s", 0, [1, 2], "t", -1.0, atoms(9, 9, 9), [0, 1, 1]), (8, "s", 0, [1, 2], "t", -2.0, atoms(1, 2, 3), [0, 1, 1]), (7, "s", 0, [2, 3], "t", -3.0, atoms(5, 6, 7), [0, 0, 1]),
            (6, "x", 0, [1, 3], "t", -4.0, None, [0, 1]), (5, "s", 0, [1, 3], "t", None, None, [0, 1]),
        ],
        schema,
    )
    found = fr.contributions(p, low, 2)
    got = {r.struct_id: r for r in fr.many_body(p, found, "remove").collect()}
    assert {i: (r.found, r.e_new) for i, r in got.items()} == {1: (2, -5.0), 2: (0, -5.0)}  # of two records with one key the smaller id
    # atom 0 and 2 are fragment 2's: (2, 3) of the first record and (5, 6) of the second; atom 1 is fragment 1's, atom 3 fragment 3's
    assert got[1].f_new == atoms(10 - 2 - 5, 20 - 1, 30 - 3 - 6, 40 - 7) and got[2].f_new is None
    back = fr.many_body(spark.createDataFrame([(1, got[1].e_new, got[1].f_new)], "struct_id bigint, e double, f array<double>"), found, "add").first()
    assert back.e_new == -10.0 and back.f_new == atoms(10, 20, 30, 40)
    with pytest.raises(ValueError):
        fr.many_body(p, p, "divide")


def test_skewed_cells():
    from moltide.operators.cells import Cell

    rng = np.random.default_rng(2)
    v = np.array([[8.0, 0, 0], [3.5, 7.0, 0], [1.0, -2.0, 9.0]])
    cell, d = Cell(tuple(map(tuple, v))), rng.normal(size=(200, 3)) * 20
    images = np.stack(np.meshgrid(*[np.arange(-9, 10)] * 3, indexing="ij"), -1).reshape(-1, 3) @ v
    best = np.sqrt(((d[:, None] + images[None]) ** 2).sum(2).min(1))
    assert np.allclose(np.linalg.norm(cell.shortest(d), axis=1), best)
    assert cell.limit == pytest.approx(np.linalg.norm(v, axis=1).min() / 2) and cell.volume == pytest.approx(8 * 7 * 9)
    box = Cell(((10.0, 0, 0), (0, 12.0, 0), (0, 0, 14.0)))
    r, whole = box.unwrapped(np.array([[[0.5, 0, 0], [9.8, 0, 0]], [[0, 0, 0], [4.9, 1.2, 0]]]))
    assert np.allclose(r[0, 1], [-0.7, 0, 0]) and whole.tolist() == [True, False]  # 5.04 is not under half the shortest side
    with pytest.raises(ValueError):
        Cell(((1.0, 0, 0), (2.0, 0, 0), (0, 0, 1.0)))


def test_nbody_prediction(spark):
    """Orders, forces, cells and cutoffs against loops; rejected and missing combinations are null and add nothing."""

    class Springs:  # half the square of the distance; made here, so that it travels to the workers with its code
        z = (1, 1)

        def evaluate(self, r):
            d = r[:, 0] - r[:, 1]
            return 0.5 * (d * d).sum(1), np.stack([-d, d], 1)

    from moltide.operators.cells import Cell
    from moltide.plans import nbody

    rng = np.random.default_rng(1)
    r = rng.uniform(0, 6, (3, 4, 3))
    schema = "struct_id bigint, r array<double>, z array<int>, entity_ids array<int>, comp_ids array<string>"
    rows = [(i, x.ravel().tolist(), [1] * 4, [0, 1, 2, 3], ["a", "a", "b", "a"]) for i, x in enumerate(r)]
    df = spark.createDataFrame([*rows, (7, None, [1], [0], ["a"]), (8, [0.0] * 3, [1], [0], ["a"]), (9, [0.0] * 5, [1, 1], [0, 1], ["a", "a"])], schema)
    cell = Cell(((6.0, 0, 0), (0, 6.0, 0), (0, 0, 6.0)), 2.9)
    for c in (None, cell):
        model = nbody.NBodyModel(Springs(), ("a", "a"), 3.5)
        parts = {(x.struct_id, tuple(x.comb)): x for x in nbody.decomposed(df, [model], c).collect()}
        told = {x.struct_id: x for x in nbody.total(df, [model, nbody.NBodyModel(Springs(), ("a", "b"))], c).collect()}
        assert set(parts) == {(i, p) for i in range(3) for p in ((0, 1), (0, 3), (1, 3))} and set(told) == {0, 1, 2, 8}
        assert told[8].e == 0.0 and told[8].combs == 0
        for i in range(3):
            e, f = 0.0, np.zeros((4, 3))
            for a, b, cut in ((0, 1, 3.5), (0, 3, 3.5), (1, 3, 3.5), (0, 2, np.inf), (1, 2, np.inf)):
                d = r[i, b] - r[i, a]
                d = d if c is None else c.shortest(d)
                far = np.linalg.norm(d)
                ok = far < cut and (c is None or far < 2.9)
                if (i, (a, b)) in parts:
                    x = parts[i, (a, b)]
                    assert x.accepted == ok and (x.e is None) == (not ok) and np.isclose(x.spread, far) and (not ok or np.isclose(x.e, 0.5 * far**2))
                if ok:
                    e, f[a], f[b] = e + 0.5 * far**2, f[a] + d, f[b] - d
            assert np.isclose(told[i].e, e) and np.allclose(np.reshape(told[i].f, (4, 3)), f) and told[i].combs == 5
    half = nbody.total(df, [model], None, [(0, 2, 0.5)]).filter("struct_id = 0").first()
    whole = nbody.decomposed(df, [model]).filter("struct_id = 0")
    want = sum((0.5 if 0 in x.comb else 1.0) * (x.e or 0.0) for x in whole.collect())
    assert np.isclose(half.e, want)
    stored = nbody.decomposed(df, [model])
    sums = {x.struct_id: x.e for x in nbody.summed(stored, [2]).collect()}
    direct = {x.struct_id: x for x in nbody.total(df, [model]).collect()}
    assert all(np.isclose(sums[i], direct[i].e) for i in range(3)) and nbody.summed(stored, [3]).count() == 0
    forces = {(x.struct_id, x.atom_idx): (x.fx, x.fy, x.fz) for x in nbody.summed_forces(df, stored).collect()}
    assert all(np.allclose(v, np.reshape(direct[i].f, (4, 3))[a]) for (i, a), v in forces.items())


def test_records_come_once(spark):
    """The first delivery stays; without a time it is the last; equal times leave one row."""
    import datetime as dt

    from moltide.operators.records import once

    t = lambda day: dt.datetime(2024, 1, day)
    rows = [(1, "a", t(2)), (1, "b", t(1)), (2, "c", None), (2, "d", t(5)), (3, "e", t(1)), (3, "e", t(1)), (4, "f", None), (4, "f", None), (5, "g", t(9)), (None, "h", t(1))]
    got = sorted((x.struct_id, x.v) for x in once(spark.createDataFrame(rows, "struct_id bigint, v string, loaded_at timestamp_ntz")).filter("struct_id is not null").collect())
    assert got == [(1, "b"), (2, "d"), (3, "e"), (4, "f"), (5, "g")]


def test_alchemy(spark):
    df = spark.createDataFrame([([0, 1], 2, 8.0), ([1, 2], 2, 8.0), ([0, 1, 2], 3, 8.0)], "comb array<int>, k int, e double")
    assert [x[0] for x in df.select(fr.alchemical(F.col("e"), F.col("comb"), F.col("k"), [(0, 2, 0.5), (1, 2, 0.5)])).collect()] == [2.0, 4.0, 8.0]


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2), (-2.0, 1.0, 2), (None, None, 2)], "x double, y double, n int")
    row = df.agg(losses.mae(F.col("x")), losses.mse(F.col("x")), losses.rmse(F.col("x")), losses.sse(F.col("x")), losses.weighted(F.col("x"), F.col("y"), 0.5, F.col("n"))).first()
    assert np.allclose(list(row), [1.5, 2.5, 2.5**0.5, 5.0, 0.5 * 2.5 + 5.0 / 2])


def test_quotas_meet_the_size(spark):
    rows = spark.createDataFrame([("a", i, float(i * i)) for i in range(50)] + [("b", 100, 1.0)], "k string, id bigint, v double")
    s = sampling.stratified_sample(rows, ["k"], "v", "id", 10)
    assert {r.k: r["count"] for r in s.groupBy("k").count().collect()} == {"a": 10, "b": 1}
    assert sampling.split(rows, s, "id").count() == 40


def test_cluster_quota_and_bound(spark):
    c = spark.createDataFrame([("a", 10.0, 100), ("b", 1.0, 10), ("c", 0.1, 1)], "cluster string, loss double, population bigint")
    q = {r.cluster: r.quota for r in sampling.cluster_quotas(c, 20).collect()}
    assert sum(q.values()) == 20 and q["b"] >= 1 and q["c"] <= 1
    assert {r.cluster for r in sampling.problem_clusters(c, 105).collect()} == {"a", "b"}
    assert {r.cluster for r in sampling.problem_clusters(c, 10_000).collect()} == {"a", "b", "c"}


def _training(n=12):
    base = np.array([[0, 0, 0], [0.96, 0, 0], [-0.24, 0.93, 0]])
    r = base + RNG.normal(size=(n, 3, 3)) * 0.08
    ij = [(0, 1), (0, 2), (1, 2)]
    rest = [0.96, 0.96, 1.52]

    def energy(x):
        return sum(30 * (np.linalg.norm(x[i] - x[j]) - d) ** 2 for (i, j), d in zip(ij, rest, strict=True))

    def force(x):
        out = np.zeros((3, 3))
        for (i, j), d in zip(ij, rest, strict=True):
            v = x[i] - x[j]
            length = np.linalg.norm(v)
            out[i] -= 60 * (length - d) * v / length
            out[j] += 60 * (length - d) * v / length
        return out

    return r, np.array([force(x) for x in r]), np.array([energy(x) for x in r])


def test_kernel_model_learns_and_its_forces_are_slopes(spark):
    r, f, e = _training(30)
    perms = symmetry.group(symmetry.swaps_of_equal_atoms([8, 1, 1], [0, 0, 0]))
    assert perms.tolist() == [[0, 1, 2], [0, 2, 1]]
    k = kernel.assemble(spark, r[:4], 2.0, perms)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-8
    model = kernel.train(spark, r[:20], f[:20], e[:20], (8, 1, 1), 2.0, 1e-10, perms)
    told_e, told_f = kernel.predict_raw(model, r[20:])
    rms = lambda x: np.sqrt((x**2).mean())
    assert rms(told_f - f[20:]) < 0.05 * rms(f[20:]) and rms(told_e - e[20:]) < 0.05 * rms(e[20:])
    x, h = r[25].copy(), 1e-5
    for a in range(3):
        for c in range(3):
            up, down = x.copy(), x.copy()
            up[a, c] += h
            down[a, c] -= h
            slope = (kernel.predict_raw(model, up[None])[0][0] - kernel.predict_raw(model, down[None])[0][0]) / (2 * h)
            assert np.isclose(-slope, kernel.predict_raw(model, x[None])[1][0, a, c], atol=1e-3)
    swapped = r[25][[0, 2, 1]]
    assert np.isclose(kernel.predict_raw(model, swapped[None])[0][0], kernel.predict_raw(model, r[25:26])[0][0])


def test_conjugate_gradients_agree(spark):
    r, f, e = _training(6)
    direct = kernel.train(spark, r, f, e, (8, 1, 1), 1.0, 1e-3)
    rows = spark.createDataFrame([(i, r[i].ravel().tolist(), f[i].ravel().tolist(), float(e[i])) for i in range(6)], "point bigint, r array<double>, f array<double>, e double")
    steps = kernel.train_iteratively(rows, (8, 1, 1), 1.0, 1e-3, 60, 1e-6)
    assert np.allclose(kernel.predict_raw(direct, r)[1], kernel.predict_raw(steps, r)[1], atol=1e-2)
    with pytest.raises(ValueError):
        kernel.assemble(spark, np.zeros((kernel.MAX_POINTS + 1, 2, 3)), 1.0, np.array([[0, 1]]))


def test_grid_stops_when_the_loss_rises():
    loss = {1.0: 3.0, 2.0: 1.0, 3.0: 2.0, 4.0: 0.1}
    best, log = kernel.grid_search(list(loss), lambda s: (s, loss[s]))
    assert best == 2.0 and [s for s, _ in log] == [1.0, 2.0, 3.0]
    assert kernel.memory_estimate(9, 1000) == pytest.approx(5832)


def test_permutation_group():
    p = np.array([[1, 2, 0, 3], [1, 0, 2, 3]])
    g6 = symmetry.group(p)
    assert len(g6) == 6
    with pytest.raises(ValueError):
        symmetry.group(p, 5)
    assert {tuple(symmetry.inverse(x)) for x in g6} == {tuple(x) for x in g6}
    assert symmetry.cycles(np.array([1, 2, 0, 3])) == [[0, 1, 2]]


def test_strained_copies_give_the_virial(spark):
    from moltide.plans import nbody

    r, f, e = _training(8)
    model = kernel.train(spark, r, f, e, (8, 1, 1), 1.0, 1e-6)
    rows = spark.createDataFrame([(i, r[i].ravel().tolist()) for i in range(8)], "struct_id bigint, r array<double>")
    forces = kernel.predict_raw(model, r)[1]
    for x in nbody.strained_virial(rows, model).collect():
        assert np.allclose(np.reshape(x.w, (3, 3)), np.einsum("na,nb->ab", forces[x.struct_id], r[x.struct_id]), atol=1e-3)


def test_descriptor_moves_with_the_atoms(spark):
    r, v = RNG.normal(size=(3, 3)) * 2, RNG.normal(size=(3, 3))
    h = 1e-6
    slope = [(1 / np.linalg.norm(r[i] - r[j] + h * (v[i] - v[j])) - 1 / np.linalg.norm(r[i] - r[j])) / h for i in range(3) for j in range(i)]
    df = spark.createDataFrame([(r.ravel().tolist(), v.ravel().tolist())], "r array<double>, v array<double>")
    assert np.allclose(df.select(g.jacobian_times(F.col("r"), F.col("v"))).first()[0], slope, atol=1e-4)


def test_weighted_draw(spark):
    rows = spark.createDataFrame([(i, 1.0 if i % 2 else 9.0) for i in range(400)] + [(1000, 0.0), (1001, None)], "id bigint, w double").withColumn("k", F.lit(0))
    got = [x.id for x in sampling.weighted_sample(rows, ["k"], "w", "id", 100).collect()]
    assert len(set(got)) == 100 and max(got) < 1000 and sum(i % 2 == 0 for i in got) > 70


def test_models_are_kept(spark, tmp_path):
    from moltide.plans import nbody
    from moltide.sources import models as kept

    r, f, e = _training(8)
    model = nbody.NBodyModel(kernel.train(spark, r, f, e, (8, 1, 1), 1.0, 1e-6), ("wat",), None)
    kept.save_models(spark, [model], str(tmp_path))
    (back,) = kept.load_models(spark, str(tmp_path))
    assert back.labels == ("wat",) and np.array_equal(back.model.x, model.model.x) and np.allclose(kernel.predict_raw(back.model, r)[0], kernel.predict_raw(model.model, r)[0])
    with pytest.raises(ValueError):
        kept.load_models(spark, str(tmp_path), ["0" * 32])
