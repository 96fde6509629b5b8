"""File formats of structure sets as Spark data sources: multi-frame XYZ and npz.

``register(spark)`` once, then ``spark.read.format("xyz").load(folder)``,
``df.write.format("xyz").save(folder)``, and the same with ``"npz"``. Files are the unit of
work: a task reads one file frame by frame, or writes one file, so a set spreads over as many
files as it has tasks. Bad frames (a count that isn't a number, too few lines, words for
numbers) fail the read with the file and line.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

XYZ_SCHEMA = "file string, frame int, comment string, symbols array<string>, r array<double>"
NPZ_SCHEMA = "struct_id bigint, z array<int>, r array<double>, e double, f array<double>"


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _files(options: dict, suffix: str) -> list[str]:
    path = _local(options.get("path", ""))
    if not path:
        raise ValueError("give a path")
    if os.path.isfile(path):
        return [path]
    deep = options.get("recursivefilelookup", options.get("recursiveFileLookup", "false")).lower() == "true"
    found = glob.glob(os.path.join(path, "**" if deep else "", f"*{suffix}"), recursive=deep)
    return sorted(f for f in found if options.get("contains", "") in os.path.basename(f))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Done(WriterCommitMessage):
    pass


def parse_xyz(path: str) -> Iterator[tuple[int, str, list[str], list[float]]]:
    """(frame, comment, symbols, coordinates) of each frame; blank lines between frames are passed over."""
    with open(path, encoding="utf-8") as f:
        frame, number = 0, 0
        while line := f.readline():
            number += 1
            if not line.strip():
                continue
            try:
                n = int(line)
            except ValueError as bad:
                raise ValueError(f"{path}, line {number}: no atom count: {line.strip()[:40]!r}") from bad
            comment, symbols, r = f.readline().rstrip("\n"), [], []
            number += 1
            for _ in range(n):
                number += 1
                part = f.readline().split()
                if len(part) < 4:
                    raise ValueError(f"{path}, line {number}: an atom needs a symbol and three numbers")
                symbols.append(part[0])
                r.extend(map(float, part[1:4]))
            yield frame, comment, symbols, r
            frame += 1


class XyzReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_File(f) for f in _files(self.options, ".xyz")]

    def read(self, partition):
        for frame, comment, symbols, r in parse_xyz(partition.path):
            yield os.path.splitext(os.path.basename(partition.path))[0], frame, comment, symbols, r


class XyzWriter(DataSourceWriter):
    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows):
        folder, digits = _local(self.options["path"]), int(self.options.get("precision", "10"))
        os.makedirs(folder, exist_ok=True)
        name, path = f"part-{uuid.uuid4().hex}", None
        for row in rows:
            if path is None:
                path = open(os.path.join(folder, f".{name}.tmp"), "w", encoding="utf-8")  # noqa: SIM115
            n = len(row.symbols)
            path.write(f"{n}\n{(row.comment or '').replace(chr(10), ' ')}\n")
            for a in range(n):
                path.write(f"{row.symbols[a]:<2} " + " ".join(f"{x: .{digits}f}" for x in row.r[3 * a : 3 * a + 3]) + "\n")
        if path is not None:
            path.close()
            os.rename(os.path.join(folder, f".{name}.tmp"), os.path.join(folder, f"{name}.xyz"))
        return _Done()


class XyzSource(DataSource):
    @classmethod
    def name(cls):
        return "xyz"

    def schema(self):
        return XYZ_SCHEMA

    def reader(self, schema):
        return XyzReader(self.options)

    def writer(self, schema, overwrite):
        return XyzWriter(self.options)


class NpzReader(DataSourceReader):
    """Keys may be renamed by the options z_key, r_key, e_key, f_key; e and f may be missing. A type tag other than 'd' is refused."""

    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_File(f) for f in _files(self.options, ".npz")]

    def read(self, partition):
        key = {k: self.options.get(f"{k}_key", default) for k, default in (("z", "z"), ("r", "R"), ("e", "E"), ("f", "F"))}
        with np.load(partition.path, allow_pickle=False) as data:
            if "type" in data and str(data["type"]) != "d":
                raise ValueError(f"{partition.path} isn't a data set")
            r = np.asarray(data[key["r"]], float)
            r = r[None] if r.ndim == 2 else r
            z = np.asarray(data[key["z"]]).tolist()
            e = np.atleast_1d(np.asarray(data[key["e"]], float)) if key["e"] in data else None
            f = np.asarray(data[key["f"]], float).reshape(len(r), -1) if key["f"] in data else None
            ids = data["struct_id"].tolist() if "struct_id" in data else range(len(r))
            for i, struct_id in enumerate(ids):
                yield int(struct_id), z, r[i].ravel().tolist(), None if e is None else float(e[i]), None if f is None else f[i].tolist()


class NpzWriter(DataSourceWriter):
    """One file per task and composition, at most BLOCK records each, as a set shares its z."""

    BLOCK = 10_000

    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows):
        folder = _local(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        held: dict[tuple, list] = {}
        for row in rows:
            kept = held.setdefault((tuple(row.z), row.f is None), [])
            kept.append((row.struct_id, row.r, row.e, row.f))
            if len(kept) == self.BLOCK:
                self._save(folder, row.z, held.pop((tuple(row.z), row.f is None)))
        for (z, _), kept in held.items():
            self._save(folder, z, kept)
        return _Done()

    def _save(self, folder, z, kept):
        ids, r, e, f = zip(*kept, strict=True)
        arrays = {"type": "d", "struct_id": np.array(ids), "z": np.array(z), "R": np.array(r, float).reshape(len(ids), -1, 3), "E": np.array([np.nan if x is None else x for x in e], float)}
        if f[0] is not None:
            arrays["F"] = np.array(f, float).reshape(len(ids), -1, 3)
        np.savez(os.path.join(folder, f"part-{uuid.uuid4().hex}.npz"), **arrays)


class NpzSource(DataSource):
    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return NPZ_SCHEMA

    def reader(self, schema):
        return NpzReader(self.options)

    def writer(self, schema, overwrite):
        return NpzWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XyzSource)
    spark.dataSource.register(NpzSource)


def xyz_block(symbols: Column, r: Column, comment: Column, digits: int = 10) -> Column:
    """One XYZ block as a string, without Python: for ``df.select(...).write.text(...)``."""
    row = lambda s, i: F.format_string(f"%s % .{digits}f % .{digits}f % .{digits}f", s, F.get(r, i * 3), F.get(r, i * 3 + 1), F.get(r, i * 3 + 2))
    return F.concat_ws("\n", F.size(symbols).cast("string"), F.coalesce(comment, F.lit("")), F.array_join(F.transform(symbols, row), "\n"))


def save_trials(trials: DataFrame, path: str) -> None:
    """Trials (a few rows) as one CSV file with a header, by sigma."""
    trials.orderBy("sigma").coalesce(1).write.mode("overwrite").csv(path, header=True)


def box_input(lengths: tuple[float, float, float], molecules: list[tuple[str, int]], output: str, tolerance: float = 2.0, shift: float = 0.0) -> str:
    """Input of a packing program: each molecule file with its count inside one box; ``shift`` shrinks a periodic box on every side."""
    box = " ".join(f"{x:g}" for x in (*[shift] * 3, *[v - shift for v in lengths]))
    blocks = [f"structure {path}\n  number {n}\n  inside box {box}\nend structure\n" for path, n in molecules]
    return "\n".join([f"tolerance {tolerance:g}\nfiletype xyz\noutput {output}\n", *blocks])
