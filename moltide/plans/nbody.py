"""Prediction plans: n-body models over all combinations of fragments.

One Arrow pass over the records does it all: combinations are made once for each kind of
record (atoms, fragments, labels), not by joins; their coordinates are taken out for many
records at once, brought to the shortest images of a cell, cut off, and given to the models.
Only sums leave the pass for totals, so nothing is shuffled at all.

Defined results: a combination that a cutoff or the cell rejects has null energy and forces
and adds nothing; a record without combinations has an energy of 0; records with null
``r`` or another number of coordinates than atoms are left out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltide.functions.chemistry import ELEMENTS
from moltide.operators import kernel
from moltide.operators.cells import Cell

#: Combinations that are worked on at once in a task.
AT_ONCE = 8_192


@dataclass(frozen=True)
class NBodyModel:
    """A model for combinations with these labels, accepted if their spread is below the cutoff (None: all). Without a model only the spread is told."""

    model: object | None
    labels: tuple[str, ...]
    cutoff: float | None = None

    @property
    def order(self) -> int:
        return len(self.labels)


def combinations(comp_ids: list[str], labels: tuple[str | None, ...]) -> list[tuple[int, ...]]:
    """Ascending fragment ids whose labels are ``labels`` in that order; None stands for any label."""
    grown: list[tuple[int, ...]] = [()]
    for label in labels:
        grown = [(*c, i) for c in grown for i in range(c[-1] + 1 if c else 0, len(comp_ids)) if label is None or comp_ids[i] == label]
    return grown


def spreads(r: np.ndarray, z: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sum over fragments of the distance of their center of mass to the whole's; r (n, atoms, 3)."""
    m = np.array([ELEMENTS[int(a)][1] for a in z])
    centre = lambda at: (r[:, at] * m[at, None]).sum(1) / m[at].sum()
    whole = centre(np.arange(len(z)))
    return sum(np.sqrt(((centre(np.flatnonzero(ids == i)) - whole) ** 2).sum(1)) for i in dict.fromkeys(ids.tolist()))


def _kinds(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(z, entity_ids, comp_ids), row numbers and coordinates of the usable records of a batch, kind by kind."""
    r = batch.column(batch.schema.get_field_index("r"))
    counts = r.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    kinds: dict[tuple, list[int]] = {}
    for row, key in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("z", "entity_ids", "comp_ids")), strict=True)):
        if all(k is not None for k in key) and len(key[0]) == len(key[1]) and counts[row] == 3 * len(key[0]):
            kinds.setdefault(tuple(map(tuple, key)), []).append(row)
    for kind, rows in kinds.items():
        x = r.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        yield kind, np.array(rows), x.reshape(len(rows), -1, 3)


def _told(kind: tuple, r: np.ndarray, m: NBodyModel, cell: Cell | None):
    """Per slice of a kind's records: (rows of the slice, combinations, atoms of each, spread, accepted, e, f), the last four by (row, combination)."""
    z, ids, comps = np.array(kind[0]), np.array(kind[1]), list(kind[2])
    combs = combinations(comps, m.labels)
    by_size: dict[tuple, list] = {}
    for c in combs:
        at = np.concatenate([np.flatnonzero(ids == i) for i in c])
        if m.model is None or tuple(z[at]) == tuple(m.model.z):
            by_size.setdefault(tuple(z[at]), []).append((c, at))
    for kind_z, found in by_size.items():
        atoms = np.stack([at for _, at in found])
        each = max(1, AT_ONCE // len(found))
        # very many combinations of one record: they are cut too
        for start in range(0, len(r), each):
            for first in range(0, len(found), AT_ONCE):
                part, at = found[first : first + AT_ONCE], atoms[first : first + AT_ONCE]
                x = r[start : start + each][:, at].reshape(-1, at.shape[1], 3)
                ok = np.isfinite(x).all((1, 2))
                if cell is not None:
                    x, whole = cell.unwrapped(x)
                    ok &= whole
                spread = np.empty(len(x))
                local = np.tile(np.arange(len(part)), len(x) // len(part))
                # fragments lie in one order in all combinations of a kind, so their ids differ but not where they change
                sizes = [ids[a] for a in at]
                groups: dict[tuple, list[int]] = {}
                for k, own in enumerate(sizes):
                    groups.setdefault(tuple(np.cumsum(np.append(0, np.diff(own) != 0))), []).append(k)
                for pattern, members in groups.items():
                    rows = np.flatnonzero(np.isin(local, members))
                    spread[rows] = spreads(x[rows], np.array(kind_z), np.array(pattern))
                if m.cutoff is not None:
                    ok &= spread < m.cutoff
                e, f = np.full(len(x), np.nan), np.zeros(x.shape)
                if m.model is not None and ok.any():
                    e[ok], f[ok] = kernel.evaluate(m.model, x[ok])
                yield np.arange(start, min(start + each, len(r))), part, at, spread, ok, e, f, x


def _factors(part: list, order: int, alchemy: list[tuple[int, int, float]]) -> np.ndarray:
    """Product of the factors of every (entity, order, factor) whose entity is in the combination."""
    out = np.ones(len(part))
    for entity, of_order, factor in alchemy:
        if not 0.0 <= factor <= 1.0:
            raise ValueError("a factor lies between 0 and 1")
        if of_order == order:
            out *= [factor if entity in c else 1.0 for c, _ in part]
    return out


_PARTS = "nbody_order int, model int, comb array<int>, spread double, accepted boolean, e double, f array<double>"


def decomposed(records: DataFrame, models: list[NBodyModel], cell: Cell | None = None, *keep: str) -> DataFrame:
    """struct_id, ``keep``, nbody_order, model (its place in the list), comb, spread, accepted, e, f: one row a combination and model; e and f are null if it was rejected.

    records: struct_id, r, z, entity_ids, comp_ids.
    """
    if not models:
        raise ValueError("no models")
    kept = ["struct_id", *[c for c in keep if c != "struct_id"]]
    schema = T.StructType([*records.select(*kept).schema.fields, *T.StructType.fromDDL(_PARTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, rows, r in _kinds(batch):
                for number, m in enumerate(models):
                    for at, part, atoms, spread, ok, e, f, _ in _told(kind, r, m, cell):
                        n, width = len(spread), 3 * atoms.shape[1]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(f.ravel()))
                        told = pa.array(ok if m.model is not None else np.zeros(n, bool))
                        combs = pa.array([list(c) for c, _ in part], pa.list_(pa.int32())).take(pa.array(np.tile(np.arange(len(part)), len(at))))
                        none, take = pa.nulls(n), pa.array(np.repeat(rows[at], len(part)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(batch.column(batch.schema.get_field_index(c)).take(take) for c in kept), pa.array(np.full(n, m.order, np.int32)), pa.array(np.full(n, number, np.int32)), combs, pa.array(spread), pa.array(ok),
                                pc.if_else(told, pa.array(e), none.cast(pa.float64())), pc.if_else(told, lists, none.cast(lists.type)),
                            ],
                            [*kept, "nbody_order", "model", "comb", "spread", "accepted", "e", "f"],
                        )

    return records.select(*dict.fromkeys([*kept, "r", "z", "entity_ids", "comp_ids"])).mapInArrow(run, schema)


def total(records: DataFrame, models: list[NBodyModel], cell: Cell | None = None, alchemy: list[tuple[int, int, float]] | None = None, *keep: str) -> DataFrame:
    """``keep``, struct_id, e, f (3 numbers an atom), virial (row-major 3 x 3), combs, accepted: summed over all models and combinations inside the pass."""
    kept = [c for c in keep if c != "struct_id"]
    fields = records.select("struct_id", *kept).schema
    schema = T.StructType([*fields.fields, *T.StructType.fromDDL("e double, f array<double>, virial array<double>, combs bigint, accepted bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, rows, r in _kinds(batch):
                e, f, w = np.zeros(len(r)), np.zeros(r.shape), np.zeros((len(r), 3, 3))
                combs, taken = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
                for m in models:
                    for at, part, atoms, _, ok, e_part, f_part, x in _told(kind, r, m, cell):
                        shape = (len(at), len(part))
                        scale = _factors(part, m.order, alchemy or []) * ok.reshape(shape)
                        e_part, f_part = np.nan_to_num(e_part).reshape(shape) * scale, f_part.reshape(*shape, -1, 3) * scale[:, :, None, None]
                        np.add.at(e, at, e_part.sum(1))
                        np.add.at(f, (at[:, None, None], atoms[None]), f_part)
                        np.add.at(w, at, np.einsum("rcna,rcnb->rab", np.nan_to_num(x).reshape(f_part.shape), f_part))
                        np.add.at(combs, at, len(part))
                        np.add.at(taken, at, ok.reshape(shape).sum(1))
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * (a.size // len(a))), pa.array(a.ravel()))
                columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in ("struct_id", *kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(e), lists(f), lists(w), pa.array(combs), pa.array(taken)], ["struct_id", *kept, "e", "f", "virial", "combs", "accepted"])

    return records.select("struct_id", *dict.fromkeys([*kept, "r", "z", "entity_ids", "comp_ids"])).mapInArrow(run, schema)


def summed(parts: DataFrame, orders: list[int] | None = None) -> DataFrame:
    """struct_id, e, combs, accepted from stored ``decomposed`` rows, of the given orders only (None: all); rejected ones count as zero."""
    rows = parts if orders is None else parts.filter(F.col("nbody_order").isin(orders))
    return rows.groupBy("struct_id").agg(F.sum(F.coalesce("e", F.lit(0.0))).alias("e"), F.count(F.lit(1)).alias("combs"), F.count("e").alias("accepted"))


def summed_forces(records: DataFrame, parts: DataFrame, orders: list[int] | None = None) -> DataFrame:
    """struct_id, atom_idx, fx, fy, fz from stored ``decomposed`` rows: forces of all combinations on the record's atoms."""
    from moltide.operators.fragments import atoms_of

    rows = parts if orders is None else parts.filter(F.col("nbody_order").isin(orders))
    rows = rows.filter("f is not null").select("struct_id", "comb", "f").join(records.select("struct_id", "entity_ids"), "struct_id")
    rows = rows.select("struct_id", "f", F.posexplode(atoms_of(F.col("comb"), F.col("entity_ids"))).alias("k", "atom_idx"))
    return rows.groupBy("struct_id", "atom_idx").agg(*[F.sum(F.get("f", F.col("k") * 3 + c)).alias(n) for c, n in enumerate(("fx", "fy", "fz"))])


def strained_virial(records: DataFrame, model: kernel.Model, step: float = 1e-4) -> DataFrame:
    """struct_id, w (row-major 3 x 3): -dE/dstrain by central differences, 18 strained copies of each record in one prediction job.

    The copies are made by exploding 18 small numbers inside each row, no join; the 18 energies of a record meet again in one shuffle.
    """
    sign = F.explode(F.array(F.lit(-1.0), F.lit(1.0)))
    rows = records.select("struct_id", "r", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("struct_id", "r", "k", sign.alias("sign"))
    a, b = F.floor(F.col("k") / 3), F.col("k") % 3
    moved = F.transform("r", lambda x, i: x + F.when(i % 3 == a, F.col("sign") * step / 2 * F.get("r", i - i % 3 + b)).otherwise(0.0))
    told = kernel.predict(rows.withColumn("r", moved), model, "struct_id", "k", "sign")
    slopes = told.groupBy("struct_id", "k").agg((-F.sum(F.col("sign") * F.col("e_pred")) / step).alias("w"))
    return slopes.groupBy("struct_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("w"))
