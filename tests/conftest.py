"""One session for all tests, and small tables in the shape of the real ones."""

from __future__ import annotations

import datetime as dt
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

DATASETS = (
    "dset_id bigint, dset_name string, release_no int, dset_md5 string, theory string, mb int, z array<int>, entity_ids array<int>, comp_ids array<string>, r_unit string, e_unit string, "
    "centered boolean, r_prov_ids map<int,string>, mb_dsets_md5 array<string>, notes string, created_at timestamp_ntz, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
)
STRUCTURES = "struct_id bigint, dset_id bigint, dset_name string, r_prov_specs array<bigint>, r array<double>, e double, f array<double>, row_note string, created_at timestamp_ntz, loaded_at timestamp_ntz"
RSETS = "rset_md5 string, rset_name string, n_structs bigint, n_entities int, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
MODELS = "model_md5 string, model_type string, comp_ids array<string>, nbody_order int, sig double, lam double, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
PREDICTSETS = "pset_id bigint, pset_name string, dset_id bigint, nbody_orders array<int>, models_md5 array<string>, created_at timestamp_ntz, loaded_at timestamp_ntz"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, votes int"
LABELS = "doc_id bigint, reviewer_id int, is_harmful int, reviewed_at timestamp_ntz"
SCHEMAS = {
    "datasets": DATASETS, "structures": STRUCTURES, "rsets": RSETS, "models": MODELS, "predictsets": PREDICTSETS, "documents": DOCUMENTS, "review_labels": LABELS,
    "subset_requests": "request_id int, n_atoms int, comp_ids array<string>, subset_size int",
    "pack_capacities": "pack_id int, capacity_tokens int",
    "mix_targets": "mix_id int, source string, target_share double, max_repeats int",
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def at(year: int, month: int = 1, day: int = 1) -> dt.datetime:
    return dt.datetime(year, month, day)


def dataset(i: int, **over) -> tuple:
    row = dict(
        dset_id=i, dset_name=f"d{i}", release_no=1, dset_md5=f"{i:032x}", theory="MP2", mb=None, z=[8, 1, 1], entity_ids=[0, 0, 0], comp_ids=["wat"], r_unit="Angstrom", e_unit="kcal/mol",
        centered=True, r_prov_ids={}, mb_dsets_md5=None, notes=None, created_at=at(2023, 5), loaded_at=at(2023, 6), deleted_at=None,
    ) | over
    return tuple(row.values())


def structure(i: int, **over) -> tuple:
    row = dict(struct_id=i, dset_id=1, dset_name="d1", r_prov_specs=None, r=[0.0, 0.0, 0.0, 0.96, 0.0, 0.0, -0.24, 0.93, 0.0], e=-47900.0, f=[0.1] * 9, row_note=None, created_at=at(2023, 7), loaded_at=at(2023, 8)) | over
    return tuple(row.values())


@pytest.fixture
def tables(spark, tmp_path):
    """write(name=[rows], ...) -> folder holding these tables and the other ones empty; extra=True adds columns with clashing names."""
    from pyspark.sql import functions as F

    def write(extra: bool = False, **rows) -> str:
        folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(rows.get(name, []), schema)
            if extra:
                df = df.withColumns({c: F.lit("x") for c in ("group_key", "cell", "chunk", "_nth", "n_tokens", "score", "label", "key", "anchor", "n", "p", "unit", "size", "count")})
            df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
