"""Quantities recorded in different units, converted to kcal/mol, angstrom and kcal/mol/angstrom.

Evidence for a data set's unit, in this order:

1. the label cell (``e_unit``, ``r_unit``), read by the unit grammar;
2. the prose of ``notes``, read by the same grammar;
3. the numbers of all its records and atoms: covalent bonds are about 1 angstrom long, total
   energies follow from the atomic numbers (semiclassical atom: -0.7687 Z^7/3 + Z^2/2 -
   0.2699 Z^5/3 hartree), n-body energies and forces have the sizes that the data sets
   with a stated unit show.

A stated unit holds unless the numbers rule it out; then, and where none is stated, the numbers decide.
``row_note`` may give a unit for E of its row only. Forces follow the data set's
real units unless ``notes`` names theirs.

Null or unreadable cells state nothing. Null values, and NaN energies, have no
unit. Data sets without numbers keep what is stated, else the common unit. Extra
columns pass through. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltide.functions.unit_grammar import ENERGY_UNITS, LENGTH_UNITS, read_label, scan_text
from moltide.sources.tables import first_delivery, join_dimension, materialise

COMMON = {"e": "kcal/mol", "r": "angstrom", "f": "kcal/mol/angstrom"}
#: Log10 of how far a total energy may be from the semiclassical estimate.
TOTAL_ENERGY_TOLERANCE = 0.1
#: Log10 of how far the shortest distance may be from a bond's length (1 angstrom with hydrogen, else 1.45) before a stated unit is ruled out; bohr and angstrom are 0.276 apart.
BOND_TOLERANCE = 0.2
#: Histogram of log10 sizes: bins of 0.05 from -20 to 20.
_BIN, _LOW, _BINS = 0.05, -20.0, 800
#: A stated unit is ruled out if the best one is so much likelier (natural log).
_MARGIN = 5.0


def _units_of(texts: pd.Series, read) -> pd.Series:
    known = {t: read(t) for t in texts.dropna().unique()}
    return texts.map(known).astype(object).where(texts.notna(), None)


@F.pandas_udf(T.StringType())
def _label_e(texts: pd.Series) -> pd.Series:
    return _units_of(texts, lambda t: read_label(t, "e"))


@F.pandas_udf(T.StringType())
def _label_r(texts: pd.Series) -> pd.Series:
    return _units_of(texts, lambda t: read_label(t, "r"))


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in ("e", "r", "f")]))
def _prose(texts: pd.Series) -> pd.DataFrame:
    known = {t: scan_text(t) for t in texts.dropna().unique()}
    found = [known.get(t, {}) for t in texts]
    return pd.DataFrame({k: pd.Series([x.get(k) for x in found], dtype=object) for k in ("e", "r", "f")})


@F.pandas_udf(T.StringType())
def _prose_e(texts: pd.Series) -> pd.Series:
    return _units_of(texts, lambda t: scan_text(t).get("e"))


def row_energy_unit(note: Column) -> Column:
    """Unit that a row's comment gives for its own E, else null."""
    return _prose_e(F.when(note.rlike("[A-Za-z]"), note))


def unit_factor(unit: Column, sizes: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[unit]


def shortest_distances(r: np.ndarray) -> np.ndarray:
    """(n, atoms, 3) -> the least distance of two atoms of each record, in the stored unit; missing coordinates are passed over, NaN if nothing is left."""
    best = np.full(len(r), np.nan)
    for i in range(r.shape[1] - 1):  # rows x atoms numbers at a time, however large the records are
        gap = r[:, i + 1 :] - r[:, i : i + 1]
        d2 = np.einsum("njc,njc->nj", gap, gap)
        best = np.fmin(best, np.fmin.reduce(d2, axis=1))
    return np.sqrt(best)


def mean_forces(f: np.ndarray) -> np.ndarray:
    """(n, atoms, 3) -> mean length of the forces on the atoms whose force is known."""
    size = np.sqrt(np.einsum("njc,njc->nj", f, f))
    known = np.isfinite(size)
    return np.where(known, size, 0.0).sum(1) / np.where(known.any(1), known.sum(1), np.nan)


def _by_length(column: pa.Array, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` applied to a list column of packed triples, rows of one length at a time; NaN where there are fewer than ``3`` numbers or none at all."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full(len(column), np.nan)
    for n in np.unique(counts[counts >= 3]):
        at = np.flatnonzero(counts == n)
        for start in range(0, len(at), 4096):
            rows = at[start : start + 4096]
            x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            out[rows] = of(x.reshape(len(rows), n)[:, : n - n % 3].reshape(len(rows), -1, 3))
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 of a record's shortest distance, |E| (rows without their own unit) and mean force; null where there is none."""
    own: dict[str, bool] = {}
    for batch in batches:
        r, f, notes = (batch.column(batch.schema.get_field_index(c)) for c in ("r", "f", "row_note"))
        e = np.abs(batch.column(batch.schema.get_field_index("e")).to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
        for note in notes.unique().to_pylist():
            if note is not None and note not in own:
                own[note] = "e" in scan_text(note)
        if any(own.values()):
            e = np.where([own.get(x, False) for x in notes.to_pylist()], np.nan, e)
        logs = []
        for x in (_by_length(r, shortest_distances), e, _by_length(f, mean_forces)):
            usable = (x > 0) & (x < 1e300)
            logs.append(pa.array(np.log10(np.where(usable, x, 1.0)), mask=~usable))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("dset_id")), *logs], ["dset_id", "_r", "_e", "_f"])


def _log10(x: Column) -> Column:
    return F.when((x > 0) & (x < 1e300), F.log10(x))


def _median(x: Column) -> Column:
    return F.percentile_approx(x, 0.5, 200)


def size_of_numbers(structures: DataFrame) -> DataFrame:
    """Per data set: medians over its records of the log10 of the shortest distance of all atoms, |E| (rows without their own unit) and the mean force of all atoms."""
    rows = structures.select("dset_id", "e", "r", "f", "row_note").mapInArrow(_sizes, "dset_id bigint, _r double, _e double, _f double")
    return rows.groupBy("dset_id").agg(_median(F.col("_r")).alias("log_r"), _median(F.col("_e")).alias("log_e"), _median(F.col("_f")).alias("log_f"))


def _expected_total(z: Column) -> Column:
    """Log10 of the total energy in kcal/mol that the semiclassical formula gives for the atoms."""
    atom = lambda a: F.lit(0.768745) * F.pow(a, F.lit(7 / 3)) - a * a * 0.5 + F.lit(0.2699) * F.pow(a, F.lit(5 / 3))
    hartree = F.aggregate(F.transform(z, lambda a: atom(a.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return _log10(hartree * ENERGY_UNITS["hartree"])


def _bin(size: Column) -> Column:
    """Bin of a log10 size; what lies outside the histogram counts in its first or last bin."""
    return F.least(F.greatest(F.floor((size - _LOW) / _BIN).cast("int"), F.lit(0)), F.lit(_BINS - 1))


def _likelihood(sizes: DataFrame, column: str) -> Column | None:
    """A function of log10 sizes: log density of the sizes seen in sets with a stated unit, relative to its peak.

    The histogram has at most _BINS rows however many sets there are; only it comes to the driver.
    """
    seen = sizes.filter(F.col(column).isNotNull()).groupBy(_bin(F.col(column)).alias("b")).count().collect()
    if not seen:
        return None
    h = np.zeros(_BINS)
    for b, n in seen:
        h[b] = n
    x = np.arange(-8, 9) * _BIN
    h = np.convolve(h, np.exp(-0.5 * (x / 0.08) ** 2), mode="same")
    return F.lit([float(v) for v in np.log(h / h.max() + 1e-4)])


def _look_up(density: Column | None, size: Column) -> Column:
    if density is None:
        return F.lit(0.0)
    return F.coalesce(F.get(density, _bin(size)), F.lit(0.0))


def dataset_units(structures: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row per data set (first delivery): real units and the factors to the common ones.

    Columns: dset_id, z, comp_ids, mb, e_unit_real, r_unit_real, f_unit_real, e_factor,
    r_factor, f_factor. The result is a materialised table, as it is read more than once.
    """
    sets = first_delivery(datasets.select("dset_id", "z", "comp_ids", "mb", "e_unit", "r_unit", "notes", "loaded_at"), "dset_id")
    sets = sets.withColumns({"_le": _label_e("e_unit"), "_lr": _label_r("r_unit"), "_prose": _prose("notes")})
    sets = sets.join(size_of_numbers(structures), "dset_id", "left")
    log = math.log10

    # lengths: what is stated holds if the shortest distance can be a bond then; else the unit that makes it most like one
    bond = F.when(F.array_contains("z", 1), log(1.0)).otherwise(log(1.45))
    off = lambda size: F.abs(F.col("log_r") + log(size) - bond)
    by_bond = F.array_min(F.array(*[F.struct(off(size).alias("off"), F.lit(u).alias("unit")) for u, size in LENGTH_UNITS.items()]))
    stated_r = F.coalesce("_lr", "_prose.r")
    off_stated = F.abs(F.col("log_r") + F.log10(unit_factor(stated_r, LENGTH_UNITS)) - bond)
    can_be = F.col("log_r").isNull() | (off_stated <= BOND_TOLERANCE)
    r_unit = F.when(stated_r.isNotNull() & can_be, stated_r).otherwise(F.when(F.col("log_r").isNotNull(), by_bond["unit"]))
    sets = sets.withColumn("r_unit_real", F.coalesce(r_unit, F.lit("angstrom"))).withColumn("_stated", F.coalesce("_le", "_prose.e"))
    sets = sets.withColumns({"_expected": _expected_total(F.col("z")), "_log_a": F.log10(unit_factor(F.col("r_unit_real"), LENGTH_UNITS))})
    sets = materialise(sets, "sets")

    # energies: candidates with their distance from what the numbers allow
    stated_log = F.log10(unit_factor(F.col("_stated"), ENERGY_UNITS))
    nbody = sets.filter(F.col("mb").isNotNull() & F.col("_stated").isNotNull())
    sizes = nbody.select((F.col("log_e") + stated_log).alias("se"), F.when(F.col("_prose.f").isNull(), F.col("log_f") + stated_log - F.col("_log_a")).alias("sf"))
    density_e, density_f = _likelihood(sizes, "se"), _likelihood(sizes, "sf")

    def nbody_score(size: float) -> Column:
        force = F.when(F.col("_prose.f").isNull(), F.col("log_f") + log(size) - F.col("_log_a"))
        return _look_up(density_e, F.col("log_e") + log(size)) + _look_up(density_f, force)

    def total_score(size: float) -> Column:
        off = F.abs(F.col("log_e") + log(size) - F.col("_expected"))
        return F.when(off.isNull(), 0.0).otherwise(-off * _MARGIN / TOTAL_ENERGY_TOLERANCE)

    score = {u: F.when(F.col("mb").isNull(), total_score(size)).otherwise(nbody_score(size)) for u, size in ENERGY_UNITS.items()}
    # a first pick settles ties (no numbers at all) in favour of the common unit, the first in the table
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("k"), F.lit(u).alias("unit")) for k, (u, s) in enumerate(score.items())]))
    of_stated = F.coalesce(*[F.when(F.col("_stated") == u, s) for u, s in score.items()])
    sets = sets.withColumns({"_best": best, "_of_stated": of_stated})
    holds = F.col("_stated").isNotNull() & (F.col("_of_stated") >= F.col("_best.score") - _MARGIN)
    e_unit = F.when(holds, F.col("_stated")).otherwise(F.col("_best.unit"))
    sets = sets.withColumn("e_unit_real", e_unit)
    sets = sets.withColumn("f_unit_real", F.coalesce("_prose.f", F.concat_ws("/", "e_unit_real", "r_unit_real")))
    force_sizes = {f"{e}/{r}": se / sr for e, se in ENERGY_UNITS.items() for r, sr in LENGTH_UNITS.items()}
    return materialise(
        sets.select(
            "dset_id", "z", "comp_ids", "mb", "e_unit_real", "r_unit_real", "f_unit_real",
            unit_factor(F.col("e_unit_real"), ENERGY_UNITS).alias("e_factor"),
            unit_factor(F.col("r_unit_real"), LENGTH_UNITS).alias("r_factor"),
            unit_factor(F.col("f_unit_real"), force_sizes).alias("f_factor"),
        ),
        "dataset-units",
    )


def _with_row_unit(structures: DataFrame, units: DataFrame) -> DataFrame:
    joined = join_dimension(structures, units, "dset_id")
    row = F.coalesce(row_energy_unit(F.col("row_note")), F.col("e_unit_real"))
    return joined.withColumn("e_unit_real", row)


def values_not_in_common_units(structures: DataFrame, units: DataFrame) -> DataFrame:
    """(struct_id, field_name, unit_name): one row for each stored value whose unit is another than the common one.

    Repeated deliveries of a struct_id give one row. Only flags of r and f leave the scan, not the arrays.
    """
    flags = structures.select(
        "struct_id", "dset_id", "row_note",
        (F.col("e").isNotNull() & ~F.isnan("e")).alias("has_e"), F.col("r").isNotNull().alias("has_r"), F.col("f").isNotNull().alias("has_f"),
    )
    rows = _with_row_unit(flags, units.select("dset_id", "e_unit_real", "r_unit_real", "f_unit_real"))
    cells = F.array(*[F.when(F.col(f"has_{k}") & (F.col(f"{k}_unit_real") != common), F.struct(F.lit(k).alias("field_name"), F.col(f"{k}_unit_real").alias("unit_name"))) for k, common in COMMON.items()])
    rows = rows.select("struct_id", F.inline(F.filter(cells, lambda c: c.isNotNull())))
    return rows.distinct()


def to_common_units(structures: DataFrame, units: DataFrame, *keep: str) -> DataFrame:
    """Records with e, r, f in kcal/mol, angstrom and kcal/mol/angstrom, z and comp_ids of their data set, and the columns of ``keep``.

    Null stays null and NaN stays NaN; repeated deliveries are not removed.
    """
    rows = structures.select("struct_id", "dset_id", "e", "r", "f", "row_note", *keep)
    rows = _with_row_unit(rows, units.select("dset_id", "z", "comp_ids", "mb", "e_unit_real", "r_factor", "f_factor"))
    e = F.col("e") * unit_factor(F.col("e_unit_real"), ENERGY_UNITS)
    scaled = lambda x, by: F.transform(x, lambda v: v * F.col(by))
    return rows.select("struct_id", "dset_id", "z", "comp_ids", "mb", e.alias("e"), scaled(F.col("r"), "r_factor").alias("r"), scaled(F.col("f"), "f_factor").alias("f"), *keep)
