"""Gradient-domain kernel regression: Matern-5/2 in inverse distances, trained on forces.

With x the inverse pair distances, J = dx/dr, n = sqrt(5) |x - x'| and
k = (1 + n/s + n^2/(3 s^2)) exp(-n/s), forces of two geometries have the covariance
J^T H J' with H = 5/(3 s^2) exp(-n/s) ((1 + n/s) I - 5/s^2 d d^T), d = x - x'. A model
is the training points' x and A = J alpha, where alpha solves (K + lambda I) alpha = forces / sd.

A model is a bounded object: at most MAX_POINTS points. Assembly and prediction run as
Spark jobs (blocks of training points, Arrow batches of queries); only the solve of
the bounded system is done on the driver, or, iteratively, only vectors of its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Training points of a model, at most; its system has 3 * atoms * points unknowns.
MAX_POINTS = 500


@dataclass(frozen=True)
class Model:
    """Points (after permutations) by descriptor, weights, and the constants that turn raw values into energies."""

    z: tuple[int, ...]
    sigma: float
    x: np.ndarray  # (points, pairs)
    weights: np.ndarray  # (points, pairs)
    sd: float = 1.0
    constant: float = 0.0


def pairs(n_atoms: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the lower triangle, row-major."""
    return np.tril_indices(n_atoms, -1)


def describe(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, atoms, 3) -> inverse distances (n, pairs) and their derivatives (n, pairs, 3 * atoms)."""
    n, atoms, _ = r.shape
    i, j = pairs(atoms)
    d = r[:, i] - r[:, j]
    x = 1.0 / np.sqrt((d * d).sum(2))
    slope = -d * x[..., None] ** 3  # d(1/|d|)/dr_i
    full = np.zeros((n, len(i), atoms, 3))
    at = np.arange(len(i))
    full[:, at, i], full[:, at, j] = slope, -slope
    return x, full.reshape(n, len(i), 3 * atoms)


def pair_permutation(order: np.ndarray) -> np.ndarray:
    """Where each pair of the permuted atoms lies among the unpermuted ones."""
    i, j = pairs(len(order))
    a, b = np.maximum(order[i], order[j]), np.minimum(order[i], order[j])
    return a * (a - 1) // 2 + b


def _hessian_times(x: np.ndarray, points: np.ndarray, sigma: float, right: np.ndarray) -> np.ndarray:
    """H(x, point) @ right for one x and many points; right (points, pairs, m) -> the same shape."""
    d = x - points
    n = np.sqrt(5.0 * (d * d).sum(1))
    scale = 5.0 / (3.0 * sigma**2) * np.exp(-n / sigma)
    along = np.matmul(d[:, None], right)[:, 0]
    return scale[:, None, None] * ((1.0 + n / sigma)[:, None, None] * right - 5.0 / sigma**2 * d[:, :, None] * along[:, None, :])


def predict_raw(model: Model, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Energies (n,) and forces (n, atoms, 3) in the model's units."""
    x, jac = describe(r)
    e, g = np.empty(len(r)), np.empty_like(x)
    s = model.sigma
    at_once = max(1, 2_000_000 // max(1, model.x.size))  # bounded work arrays: rows x points x pairs
    for a in range(0, len(r), at_once):
        # differences first: products of x and point apart would lose the digits that large weights need
        d = x[a : a + at_once, None] - model.x[None]
        n = np.sqrt(5.0 * np.einsum("qpd,qpd->qp", d, d))
        decay = 5.0 / (3.0 * s**2) * np.exp(-n / s)
        along = np.einsum("qpd,pd->qp", d, model.weights)
        phi = decay * (1.0 + n / s)
        e[a : a + at_once] = -(phi * along).sum(1)
        g[a : a + at_once] = -(phi @ model.weights) + 5.0 / s**2 * np.matmul((decay * along)[:, None], d)[:, 0]
    force = -np.matmul(g[:, None], jac)[:, 0]
    return model.sd * e + model.constant, model.sd * force.reshape(len(r), -1, 3)


def evaluate(model, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Energies and forces by a kernel model, or by any object with ``z`` and ``evaluate(r)``: the hook for other potentials."""
    return predict_raw(model, r) if isinstance(model, Model) else model.evaluate(r)


def predict(records: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` with e_pred and f_pred; records: r (angstrom, complete, the model's atoms)."""
    fields = records.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 3 * len(model.z)
        for batch in batches:
            r = batch.column(batch.schema.get_field_index("r")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, 3)
            e, f = evaluate(model, r) if batch.num_rows else (np.empty(0), np.empty((0, width)))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(e), pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))], [*keep, "e_pred", "f_pred"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields.fields, T.StructField("e_pred", T.DoubleType()), T.StructField("f_pred", T.ArrayType(T.DoubleType()))])
    return records.select(*keep, "r").mapInArrow(run, schema)


def assemble(spark: SparkSession, r: np.ndarray, sigma: float, perms: np.ndarray) -> np.ndarray:
    """The force covariance matrix of the training points: one task a block row, upper blocks only, mirrored on arrival."""
    m, dim = len(r), 3 * r.shape[1]
    if m > MAX_POINTS:
        raise ValueError(f"{m} training points; a model holds at most {MAX_POINTS}")
    x, jac = describe(r)
    turned = [pair_permutation(p) for p in perms]
    atoms = [np.repeat(p * 3, 3) + np.tile(np.arange(3), len(p)) for p in perms]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sorted(i for batch in batches for i in batch.column("i").to_pylist())  # some m / 16 of the block rows
        if not mine:
            return
        low, blocks = mine[0], {i: np.zeros((m - i, dim, dim)) for i in mine}
        for t, at in zip(turned, atoms, strict=True):
            # the points with their atoms permuted: descriptors in the new order, derivatives back to the old atoms
            px, pj = x[low:][:, t], np.zeros((m - low, len(t), dim))
            pj[:, :, at] = describe(r[low:][:, _order(at)])[1]
            for i in mine:
                blocks[i] += np.matmul(jac[i].T[None], _hessian_times(x[i], px[i - low :], sigma, pj[i - low :]))
        for i in mine:
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([blocks[i].tobytes()], pa.binary())], ["i", "b"])

    k = np.zeros((m * dim, m * dim))
    jobs = spark.range(m).select(F.col("id").alias("i")).repartition(max(1, min(m, 16)))
    for i, b in jobs.mapInArrow(rows, "i bigint, b binary").toLocalIterator():
        block = np.frombuffer(b).reshape(m - i, dim, dim)
        for step in range(m - i):
            j = i + step
            k[i * dim : (i + 1) * dim, j * dim : (j + 1) * dim] = block[step]
            k[j * dim : (j + 1) * dim, i * dim : (i + 1) * dim] = block[step].T
    return k


def _order(at: np.ndarray) -> np.ndarray:
    return at[::3] // 3


def _weights(r: np.ndarray, alpha: np.ndarray, perms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of a model, the permutations unrolled."""
    x, jac = describe(r)
    a = np.einsum("pdk,pk->pd", jac, alpha.reshape(len(r), -1))
    turned = [pair_permutation(p) for p in perms]
    return np.concatenate([x[:, t] for t in turned]), np.concatenate([a[:, t] for t in turned])


def train(spark: SparkSession, r: np.ndarray, f: np.ndarray, e: np.ndarray, z: tuple[int, ...], sigma: float, ridge: float = 1e-10, perms: np.ndarray | None = None) -> Model:
    """A model from bounded training arrays: r, f (points, atoms, 3) and e (points)."""
    perms = np.arange(len(z))[None] if perms is None else perms
    sd = float(f.std()) or 1.0
    y = (f / sd).ravel()
    k = assemble(spark, r, sigma, perms)
    k[np.diag_indices_from(k)] += ridge
    try:
        np.linalg.cholesky(k)  # fails unless the matrix is positive definite
        alpha = np.linalg.solve(k, y)
    except np.linalg.LinAlgError:
        alpha = np.linalg.lstsq(k, y, rcond=None)[0]
    points, weights = _weights(r, alpha, perms)
    model = Model(z, sigma, points, weights, sd)
    return Model(z, sigma, points, weights, sd, float(np.mean(e - predict_raw(model, r)[0])))


def train_iteratively(records: DataFrame, z: tuple[int, ...], sigma: float, ridge: float = 1e-6, rounds: int = 200, tolerance: float = 1e-6) -> Model:
    """The same by conjugate gradients: each product with the matrix is one prediction job over the training table.

    records: point (0, 1, ...), r, f, e. The matrix never exists; the driver holds vectors of its length.
    """
    rows = records.orderBy("point").select("point", "r", "f", "e").toPandas()
    if len(rows) > MAX_POINTS:
        raise ValueError(f"{len(rows)} training points; a model holds at most {MAX_POINTS}")
    r = np.stack([np.asarray(x, float) for x in rows.r]).reshape(len(rows), -1, 3)
    f = np.stack([np.asarray(x, float) for x in rows.f])
    sd = float(f.std()) or 1.0
    y = (f / sd).ravel()
    identity = np.arange(len(z))[None]

    def times(v: np.ndarray) -> np.ndarray:
        model = Model(z, sigma, *_weights(r, v, identity))
        got = {p: x for p, x in predict(records, model, "point").select("point", "f_pred").collect()}
        return np.concatenate([np.asarray(got[p]) for p in rows.point]) + ridge * v

    a, residual = np.zeros_like(y), y.copy()
    direction, size = residual.copy(), float(residual @ residual)
    for _ in range(rounds):
        image = times(direction)
        step = size / float(direction @ image)
        a += step * direction
        residual -= step * image
        new = float(residual @ residual)
        if new <= tolerance**2 * float(y @ y):
            break
        direction, size = residual + new / size * direction, new
    points, weights = _weights(r, a, identity)
    raw = Model(z, sigma, points, weights, sd)
    return Model(z, sigma, points, weights, sd, float(np.mean(rows.e.to_numpy() - predict_raw(raw, r)[0])))


def digest(model: Model) -> str:
    """md5 of a model's contents: atoms, constants, points and weights."""
    h = hashlib.md5(repr((model.z, model.sigma, model.sd, model.constant)).encode())
    for a in (model.x, model.weights):
        h.update(np.ascontiguousarray(a, dtype=np.float64).tobytes())
    return h.hexdigest()


def memory_estimate(n_atoms: int, n_train: int) -> float:
    """Megabytes of the full matrix: 8 bytes times (3 atoms points)^2."""
    return 8.0 * (3 * n_atoms * n_train) ** 2 * 1e-6


def grid_search(sigmas: list[float], trial: Callable[[float], tuple[Model, float]]) -> tuple[Model, list[tuple[float, float]]]:
    """Trials by rising sigma until the loss rises; the best model and all (sigma, loss)."""
    best, log = None, []
    for sigma in sorted(sigmas):
        model, loss = trial(sigma)
        log.append((sigma, loss))
        if best is None or loss < best[1]:
            best = (model, loss)
        elif loss > log[-2][1]:
            break
    if best is None:
        raise ValueError("no sigmas")
    return best[0], log
