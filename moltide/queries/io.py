"""Queries that write records derived from the tables in a format, read them back and compare; and the streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltide.functions.chemistry import symbol
from moltide.queries.common import RECS, records
from moltide.queries.statistics import BINS, HIGH, LOW
from moltide.sources import formats
from moltide.sources.tables import shared_folder
from moltide.streaming import monitors


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def xyz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every complete record written as an XYZ frame and read back: frames, atoms and a checksum per composition."""
    formats.register(spark)
    rows = records(spark, d).select(F.col("struct_id").cast("string").alias("comment"), F.transform("z", symbol).alias("symbols"), "r")
    folder = _folder(spark, "xyz")
    rows.write.format("xyz").mode("append").save(folder)
    back = spark.read.format("xyz").load(folder)
    x = F.aggregate("r", F.lit(0.0), lambda s, v: s + v * v)
    return back.groupBy(F.array_join("symbols", "").alias("formula")).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("symbols")).alias("atoms"), F.sum(F.col("comment").cast("bigint")).alias("id_sum"), F.round(F.avg(x), 3).alias("mean_square"))


def npz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every complete record with forces written to npz files and read back."""
    formats.register(spark)
    rows = records(spark, d).filter("size(f) = 3 * size(z)").select("struct_id", "z", "r", "e", "f")
    folder = _folder(spark, "npz")
    rows.write.format("npz").mode("append").save(folder)
    back = spark.read.format("npz").load(folder)
    x = F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v)
    return back.groupBy(F.size("z").alias("n_atoms"), F.element_at("z", 1).alias("first_atom")).agg(F.count(F.lit(1)).alias("records"), F.sum("struct_id").alias("id_sum"), F.round(F.avg(x), 2).alias("mean_square"), F.sum(F.when(F.isnan("e"), 1).otherwise(0)).alias("without_energy"))


def json_export(spark: SparkSession, d: str) -> DataFrame:
    """Data-set descriptions exported as JSON lines and read back."""
    base = records(spark, d).groupBy("dset_id").agg(F.count(F.lit(1)).alias("n_r"), F.first("z").alias("z"), F.first("comp_ids").alias("comp_ids"))
    folder = _folder(spark, "json")
    base.write.json(folder)
    back = spark.read.schema("dset_id bigint, n_r bigint, z array<int>, comp_ids array<string>").json(folder)
    return back.select("dset_id", "n_r", F.size("z").alias("n_z"), F.array_join("comp_ids", ",").alias("comps"))


def xyz_text(spark: SparkSession, d: str) -> DataFrame:
    """XYZ blocks as strings, without Python: the size and lines of each record's block."""
    block = formats.xyz_block(F.transform("z", symbol), F.col("r"), F.col("struct_id").cast("string"), 6)
    return records(spark, d).select("struct_id", F.size(F.split(block, "\n")).alias("lines"), F.substring_index(F.split(block, "\n")[2], " ", 1).alias("first_symbol"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Identity of each data set by its records' ids, atoms and array lengths, as its SQL defines it; ``content_identity`` reads the numbers too."""
    row = F.md5(F.concat_ws("|", "struct_id", F.array_join("z", ","), F.size("r"), F.coalesce(F.size("f"), F.lit(-1))))
    rows = records(spark, d).select("dset_id", "struct_id", row.alias("h"))
    # hashes of a data set are summed as numbers, so none of its rows are gathered in one place
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    return rows.groupBy("dset_id").agg(F.md5(F.concat_ws("|", F.count(F.lit(1)), F.sum(part))).alias("content_md5"), F.count(F.lit(1)).alias("n_r"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r, f = (batch.column(c).view(pa.list_(pa.int64())) for c in "rf")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dset_id", "struct_id", "z")), r, batch.column("e").view(pa.int64()), f], ["dset_id", "struct_id", "z", "r", "e", "f"])


def content_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity of each data set by content: the records' md5 over struct_id, z and every bit of r, e and f, summed in four parts of 32 bits, so in any order."""
    bits = records(spark, d).select("dset_id", "struct_id", "z", "r", "e", "f").mapInArrow(_bits, "dset_id bigint, struct_id bigint, z array<int>, r array<bigint>, e bigint, f array<bigint>")
    text = lambda c: F.coalesce(F.array_join(c, ",", "null"), F.lit("null"))
    rows = bits.select("dset_id", F.md5(F.concat_ws("|", "struct_id", text("z"), text("r"), F.coalesce(F.col("e").cast("string"), F.lit("null")), text("f"))).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("bigint")) for at in (1, 9, 17, 25)]
    return rows.groupBy("dset_id").agg(F.md5(F.concat_ws("|", F.count(F.lit(1)), *parts)).alias("content_md5"), F.count(F.lit(1)).alias("n_r"))


def stream_rdf(spark: SparkSession, d: str) -> DataFrame:
    """RDF counts kept by a stream over the record files."""
    return monitors.run_once(monitors.rdf_counts(spark, d, LOW, HIGH, BINS), "rdf")


def stream_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries per month kept by a stream, late ones apart."""
    return monitors.run_once(monitors.arrivals(spark, d), "arrivals")


QUERIES = {q.__name__: q for q in (xyz_round_trip, npz_round_trip, json_export, xyz_text, content_hash, content_identity, stream_rdf, stream_arrivals)}

_SYMBOLS = "case x when 1 then 'H' when 6 then 'C' when 7 then 'N' when 8 then 'O' end"
_JOINED = "coalesce(array_to_string(list_transform({0}, lambda x: coalesce(({1})::varchar, 'null')), ','), 'null')"
ORACLE = {
    "xyz_round_trip": RECS + f"""select array_to_string(list_transform(z, lambda x: {_SYMBOLS}), '') as formula, count(*) as frames, sum(len(z))::bigint as atoms, sum(struct_id)::bigint as id_sum,
        round(avg(list_sum(list_transform(r, lambda v: v * v))), 3) as mean_square from recs group by 1""",
    "npz_round_trip": RECS + """select len(z) as n_atoms, z[1] as first_atom, count(*) as records, sum(struct_id)::bigint as id_sum, round(avg(list_sum(list_transform(f, lambda v: v * v))), 2) as mean_square,
        sum((e is null)::int)::bigint as without_energy from recs where len(f) = 3 * len(z) group by 1, 2""",
    "json_export": RECS + "select dset_id, count(*) as n_r, any_value(len(z)) as n_z, any_value(array_to_string(comp_ids, ',')) as comps from recs group by 1",
    "xyz_text": RECS + f"select struct_id, len(z) + 2 as lines, list_transform(z, lambda x: {_SYMBOLS})[1] as first_symbol from recs",
    "content_hash": RECS + """, h as (select dset_id, md5(concat_ws('|', struct_id, array_to_string(z, ','), len(r), coalesce(len(f), -1))) as h from recs)
        select dset_id, md5(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 8))::bigint))) as content_md5, count(*) as n_r from h group by 1""",
    "content_identity": RECS + f""", h as (select dset_id, md5(concat_ws('|', struct_id, {_JOINED.format('z', 'x')}, {_JOINED.format('r', 'x::bit::bigint')}, coalesce(e::bit::bigint::varchar, 'null'), {_JOINED.format('f', 'x::bit::bigint')})) as h from recs)
        select dset_id, md5(concat_ws('|', count(*), {', '.join(f"sum(('0x' || substr(h, {at}, 8))::bigint)" for at in (1, 9, 17, 25))})) as content_md5, count(*) as n_r from h group by 1""",
    "stream_rdf": f"""with d as (select * from datasets qualify row_number() over (partition by dset_id order by loaded_at) = 1),
        recs as (select row_number() over () as k, s.r, d.z, d.entity_ids from structures s join d using (dset_id) where len(s.r) = 3 * len(d.z) and len(list_filter(s.r, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        o as (select k, len(z) as n_atoms, z, r, entity_ids, unnest(range(len(z))) as a from recs), ox as (select k, n_atoms, a, entity_ids[a + 1] as e, r[3 * a + 1] as x, r[3 * a + 2] as y, r[3 * a + 3] as w from o where z[a + 1] = 8),
        p as (select p.n_atoms, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.w - q.w) ** 2) as v from ox p join ox q on p.k = q.k and p.a > q.a and p.e <> q.e)
        select n_atoms, least(floor((v - {LOW}) / {(HIGH - LOW) / BINS}), {BINS - 1})::int as bin, count(*) as n from p where v between {LOW} and {HIGH} group by 1, 2""",
    "stream_arrivals": """select strftime(created_at, '%Y-%m') as month, count(*) as rows, sum((loaded_at > created_at + interval 30 day)::int)::bigint as late_rows, sum((e is null or isnan(e))::int)::bigint as without_energy from structures group by 1""",
}
