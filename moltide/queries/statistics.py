"""Queries over many records: statistics, losses, RDF, strata, splits, clusters by data set, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltide.operators import losses, rdf, sampling
from moltide.queries.common import ATOMS, RECS, records
from moltide.sources.tables import table

LOW, HIGH, BINS, VOLUME = 0.0, 8.0, 160, 4096.0
N_TRAIN, N_SELECT, N_PROBLEM = 8, 50, 150


def energy_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Least, largest, mean and population variance of each data set's energies."""
    rows = records(spark, d).filter("e is not null")
    return rows.groupBy("dset_id").agg(F.count("e").alias("n"), F.round(F.min("e"), 6).alias("e_min"), F.round(F.max("e"), 6).alias("e_max"), F.round(F.avg("e"), 4).alias("e_mean"), F.round(F.stddev_pop("e"), 3).alias("e_sd"))


def force_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The same over all force components."""
    x = records(spark, d).filter("f is not null").select("dset_id", F.explode("f").alias("x"))
    return x.groupBy("dset_id").agg(F.count("x").alias("n"), F.round(F.min("x"), 6).alias("f_min"), F.round(F.max("x"), 6).alias("f_max"), F.round(F.avg("x"), 5).alias("f_mean"), F.round(F.stddev_pop("x"), 4).alias("f_sd"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the plainest model, every data set's mean: energies against it, forces against zero."""
    rows = records(spark, d).filter("e is not null and size(f) = 3 * size(z)").select("struct_id", "dset_id", "e", "f", "z", "theory", "mb")
    mean = rows.groupBy("dset_id").agg(F.avg("e").alias("_m"))
    return rows.join(mean, "dset_id").withColumn("e_error", F.col("_m") - F.col("e")).withColumn("f_loss", losses.mean_square(F.col("f")))


def losses_by_theory(spark: SparkSession, d: str) -> DataFrame:
    """MAE, MSE, RMSE and SSE of force components per level of theory."""
    rows = _errors(spark, d).select("theory", F.explode("f").alias("x"))
    out = losses.by_group(rows, ["theory"], F.col("x"))
    return out.select("theory", "n", *[F.round(c, 3 if c == "sse" else 5).alias(c) for c in ("mae", "mse", "rmse")], F.round(F.col("sse") / F.col("n"), 5).alias("sse_per_value"))


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """rho * energy MSE + force MSE / atoms per data set."""
    rows = _errors(spark, d).withColumn("f_error", F.sqrt("f_loss"))  # a record's own RMS, so its square is the mean over the record
    loss = losses.weighted(F.col("e_error"), F.col("f_error"), 0.1, F.size("z"))
    return rows.groupBy("dset_id").agg(F.round(loss, 3).alias("loss"), F.round(losses.rmse(F.col("e_error")), 4).alias("e_rmse"), F.round(losses.rmse(F.col("f_error")), 5).alias("f_rmse"))


def rdf_oxygen(spark: SparkSession, d: str) -> DataFrame:
    """g(r) of oxygen pairs of different fragments, per number of atoms, over all records."""
    base = records(spark, d).withColumn("n_atoms", F.size("z"))
    counts = rdf.histogram(base, rdf.distances_between(F.col("r"), F.col("z"), F.col("entity_ids"), 8, 8), ["n_atoms"], LOW, HIGH, BINS)
    frames = base.groupBy("n_atoms").agg(F.count(F.lit(1)).alias("n_frames"), F.avg(rdf.pair_count(F.col("z"), 8, 8)).alias("n_pairs"))
    out = rdf.normalised(counts, frames, ["n_atoms"], LOW, HIGH, BINS, VOLUME)
    return out.select("n_atoms", "bin", F.round("r", 6).alias("r"), "n", F.round("g", 6).alias("g"))


def _energies(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter("e is not null").select("struct_id", "dset_id", F.round("e", 6).alias("e"))


def strata_counts(spark: SparkSession, d: str) -> DataFrame:
    """Energy bins of every data set and how many of N_TRAIN draws each is due."""
    binned = sampling.strata(_energies(spark, d), ["dset_id"], "e", N_TRAIN)
    return sampling.quotas(binned.groupBy("dset_id", "bin").count(), ["dset_id"], N_TRAIN).select("dset_id", "bin", "count", "quota")


def training_sample(spark: SparkSession, d: str) -> DataFrame:
    """The stratified draw itself, with the records held out for tests counted."""
    rows = _energies(spark, d)
    train = sampling.stratified_sample(rows, ["dset_id"], "e", "struct_id", N_TRAIN)
    test = sampling.split(rows, train, "struct_id").groupBy("dset_id").agg(F.count(F.lit(1)).alias("held_out"))
    return train.select("dset_id", "struct_id", "bin").join(test, "dset_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(0)))


def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    """N_TRAIN records of every data set, drawn with chances by their force loss."""
    rows = _errors(spark, d).select("dset_id", "struct_id", F.round("f_loss", 6).alias("w"))
    return sampling.weighted_sample(rows, ["dset_id"], "w", "struct_id", N_TRAIN)


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records by kind (atoms, theory, order of the energies), a bounded set of clusters, with their force loss."""
    kind = F.concat_ws("|", F.size("z"), F.coalesce("theory", F.lit("")), F.coalesce("mb", F.lit(0)))
    rows = _errors(spark, d).select(kind.alias("cluster"), F.col("struct_id").alias("row_id"), "f_loss")
    clusters = rows.groupBy("cluster").agg(F.round(F.avg("f_loss"), 5).alias("loss"), F.count(F.lit(1)).alias("population"))
    return rows.select("cluster", "row_id", F.round("f_loss", 6).alias("loss")), clusters


def cluster_losses(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[1]


def problem_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of high loss that together hold N_PROBLEM records, with the bound."""
    return sampling.problem_clusters(_clusters(spark, d)[1], N_PROBLEM).select("cluster", "loss", "population", F.round("bound", 5).alias("bound"))


def problem_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cluster_quotas(_clusters(spark, d)[1], N_SELECT).select("cluster", "loss", "population", "quota")


def problem_records(spark: SparkSession, d: str) -> DataFrame:
    """The N_SELECT records of highest loss, shared out over the clusters."""
    rows, clusters = _clusters(spark, d)
    return sampling.top_of_clusters(rows, sampling.cluster_quotas(clusters, N_SELECT), N_SELECT).select("cluster", "row_id", "loss", "place")


def rising_losses(spark: SparkSession, d: str) -> DataFrame:
    """Releases of a data set in order: whether the energy spread rose against the one before, and the best so far."""
    spread = _energies(spark, d).groupBy("dset_id").agg(F.round(F.stddev_pop("e"), 3).alias("loss"))
    names = table(spark, d, "datasets").filter("dset_name is not null").groupBy("dset_id").agg(F.min_by("dset_name", "loaded_at").alias("dset_name"), F.min_by("release_no", "loaded_at").alias("release_no"))
    w = Window.partitionBy("dset_name").orderBy("release_no", "dset_id")
    rows = names.join(spread, "dset_id")
    return rows.select("dset_name", "release_no", "dset_id", "loss", F.coalesce(F.col("loss") > F.lag("loss").over(w), F.lit(False)).alias("rising"), F.min("loss").over(w).alias("best"))


def train_labels(spark: SparkSession, d: str) -> DataFrame:
    """Force labels over their population standard deviation per data set: the spread, how many, and the scaled labels' mean size and mean square."""
    x = records(spark, d).filter("size(f) = 3 * size(z)").select("dset_id", F.explode("f").alias("v"))
    sd = x.groupBy("dset_id").agg(F.stddev_pop("v").alias("sd"), F.count("v").alias("n_labels")).filter("sd > 0")
    scaled = x.join(sd, "dset_id").withColumn("y", F.col("v") / F.col("sd"))
    return scaled.groupBy("dset_id", "n_labels", F.round("sd", 5).alias("sd")).agg(F.round(F.avg(F.abs("y")), 5).alias("mean_size"), F.round(F.avg(F.col("y") * F.col("y")), 5).alias("mean_square"))


def integration_constant(spark: SparkSession, d: str) -> DataFrame:
    """Mean offset, sign of the slope and correlation of energies against a one-number prediction (minus the mean force square) per data set, and whether the constant is refused: too few records, a slope under 0, or hardly any correlation."""
    rows = _errors(spark, d).select("dset_id", F.col("e").alias("y"), (-F.col("f_loss")).alias("x"))
    out = rows.groupBy("dset_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.col("x")).alias("c"), F.signum(F.regr_slope("y", "x")).alias("slope_sign"), F.round(F.corr("y", "x"), 4).alias("corr"))
    refused = (F.col("n") < 3) | F.coalesce((F.col("slope_sign") < 0) | (F.col("corr") < 0.95), F.lit(True))
    return out.filter("n >= 3").select("dset_id", "n", F.round("c", 3).alias("c"), "slope_sign", "corr", refused.alias("refused"))


def composition_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Mole and mass fractions of each fragment kind per data set, and how many molecules fill a 10 angstrom box at the mixture's density."""
    from moltide.functions.mixtures import molecules_in, mass_fraction, mixture_density

    parts = table(spark, d, "datasets").select("dset_id", "comp_ids").dropDuplicates(["dset_id"]).select("dset_id", F.explode("comp_ids").alias("comp_id")).groupBy("dset_id", "comp_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.create_map(*[F.lit(x) for k, (m, _) in MOLECULES.items() for x in (k, m)])
    dense = F.create_map(*[F.lit(x) for k, (_, rho) in MOLECULES.items() for x in (k, rho)])
    rows = parts.withColumns({"m": kinds[F.col("comp_id")], "rho": dense[F.col("comp_id")]}).filter("m is not null")
    rows = rows.withColumn("w", mass_fraction(F.col("n"), F.col("m"), "dset_id"))
    rows = rows.withColumn("density", mixture_density(F.col("w"), F.col("rho"), "dset_id"))
    return rows.select("dset_id", "comp_id", "n", F.round("w", 6).alias("mass_fraction"), F.round("density", 4).alias("density"), molecules_in(F.col("w"), F.col("density"), F.col("m"), 10.0).alias("molecules"))


# Molar mass (g/mol) and density (kg/m3) at room temperature of water, liquid ammonia and methanol.
MOLECULES = {"wat": (18.015, 997.0), "amm": (17.031, 682.0), "mtl": (32.042, 792.0)}

QUERIES = {q.__name__: q for q in (
    energy_statistics, force_statistics, losses_by_theory, weighted_loss, rdf_oxygen, strata_counts, training_sample, weighted_draw, cluster_losses,
    problem_clusters, problem_quotas, problem_records, rising_losses, train_labels, integration_constant, composition_fractions,
)}

_ERR = RECS + """, base as (select * from recs where e is not null and len(f) = 3 * len(z)),
err as (select struct_id, dset_id, theory, mb, e, z, f, avg(e) over (partition by dset_id) - e as e_error, list_sum(list_transform(f, lambda x: x * x)) / len(f) as f_loss from base)"""
_EN = RECS + ", en as (select struct_id, dset_id, round(e, 6) as e from recs where e is not null)"
_STRATA = _EN + f""", sp as (select dset_id, quantile_cont(e, 0.25) as q1, quantile_cont(e, 0.75) as q3, min(e) as lo, max(e) as hi from en group by 1),
wd as (select *, 2.0 * (q3 - q1) / pow({N_TRAIN}.0, 1.0 / 3.0) as w from sp), nb as (select *, case when w > 0 then greatest(least(ceil((hi - lo) / w), {max(N_TRAIN // 2, 1)}), 1) else 1 end as n_bins from wd),
bn as (select struct_id, en.dset_id, case when hi > lo then least(floor((e - lo) / ((hi - lo) / n_bins)), n_bins - 1) else 0 end::int as bin from en join nb using (dset_id)),
ct as (select dset_id, bin, count(*) as count from bn group by 1, 2),
sh as (select *, sum(count) over (partition by dset_id) as al from ct), s2 as (select *, round(count * least({N_TRAIN}, al) / al, 9) as share from sh),
s3 as (select *, floor(share)::bigint as q from s2), s4 as (select *, least({N_TRAIN}, al) - sum(q) over (partition by dset_id) as rest, row_number() over (partition by dset_id order by q - share, bin) as rk from s3),
st as (select dset_id, bin, count, least(q + case when rk <= rest then 1 else 0 end, count) as quota from s4)"""
_CL = _ERR + ", rx as (select concat_ws('|', len(z), coalesce(theory, ''), coalesce(mb, 0)) as cluster, struct_id as row_id, f_loss from err), rw as (select cluster, row_id, round(f_loss, 6) as loss from rx), cl as (select cluster, round(avg(f_loss), 5) as loss, count(*) as population from rx group by 1)"
_QUOTA = _CL + f""", w1 as (select *, (loss / sum(loss) over ()) * (population / sum(population) over ()) as w from cl), w2 as (select *, least(floor(round(w / sum(w) over () * {N_SELECT}, 9)), population) as q0 from w1),
w3 as (select *, {N_SELECT} - sum(q0) over () as d0, row_number() over (partition by q0 = 0 order by loss desc, cluster) as p0 from w2),
w4 as (select *, q0 + case when q0 = 0 and population > 0 and p0 <= d0 then 1 else 0 end as q1 from w3),
w5 as (select *, {N_SELECT} - sum(q1) over () as d1, row_number() over (partition by q1 < population order by loss desc, cluster) as p1 from w4),
qt as (select cluster, loss, population, (q1 + case when q1 < population and p1 <= d1 then 1 else 0 end)::bigint as quota from w5)"""
ORACLE = {
    "energy_statistics": RECS + "select dset_id, count(e) as n, round(min(e), 6) as e_min, round(max(e), 6) as e_max, round(avg(e), 4) as e_mean, round(stddev_pop(e), 3) as e_sd from recs where e is not null group by 1",
    "force_statistics": RECS + ", x as (select dset_id, unnest(f) as v from recs) select dset_id, count(v) as n, round(min(v), 6) as f_min, round(max(v), 6) as f_max, round(avg(v), 5) as f_mean, round(stddev_pop(v), 4) as f_sd from x group by 1",
    "losses_by_theory": _ERR + ", x as (select theory, unnest(f) as v from err) select theory, count(v) as n, round(avg(abs(v)), 5) as mae, round(avg(v * v), 5) as mse, round(sqrt(avg(v * v)), 5) as rmse, round(sum(v * v) / count(v), 5) as sse_per_value from x group by 1",
    "weighted_loss": _ERR + "select dset_id, round(0.1 * avg(e_error * e_error) + avg(f_loss) / max(len(z)), 3) as loss, round(sqrt(avg(e_error * e_error)), 4) as e_rmse, round(sqrt(avg(f_loss)), 5) as f_rmse from err group by 1",
    "rdf_oxygen": ATOMS + f""", fr as (select len(z) as n_atoms, count(*) as n_frames, avg(len(list_filter(z, lambda x: x = 8)) * (len(list_filter(z, lambda x: x = 8)) - 1) / 2) as n_pairs from recs group by 1),
        sized as (select struct_id, len(z) as n_atoms from recs),
        hb as (select n_atoms, case when dist = {HIGH} then {BINS - 1} else least(floor((dist - {LOW}) / {(HIGH - LOW) / BINS}), {BINS - 1}) end::int as bin, count(*) as n from pairs join sized using (struct_id)
          where ni = 8 and nj = 8 and ei <> ej and dist between {LOW} and {HIGH} group by 1, 2),
        sp as (select n_atoms, n_frames, n_pairs, unnest(range({BINS}))::int as bin from fr)
        select sp.n_atoms, sp.bin, round({LOW} + sp.bin * {(HIGH - LOW) / BINS} + {(HIGH - LOW) / BINS / 2}, 6) as r, coalesce(n, 0) as n,
          case when n_pairs > 0 then round(coalesce(n, 0) / (n_frames * (4.0 / 3.0 * pi() * (pow({LOW} + (sp.bin + 1) * {(HIGH - LOW) / BINS}, 3) - pow({LOW} + sp.bin * {(HIGH - LOW) / BINS}, 3))) * n_pairs / {VOLUME}), 6) else 0 end as g
        from sp left join hb on sp.n_atoms = hb.n_atoms and sp.bin = hb.bin""",
    "strata_counts": _STRATA + " select dset_id, bin, count, quota from st",
    "training_sample": _STRATA + """, rk2 as (select dset_id, struct_id, bin, row_number() over (partition by dset_id, bin order by md5(struct_id::varchar), struct_id) as r from bn),
        tr as (select dset_id, struct_id, bin from rk2 join st using (dset_id, bin) where r <= quota), ho as (select dset_id, count(*) as held_out from bn where struct_id not in (select struct_id from tr) group by 1)
        select dset_id, struct_id, bin, coalesce(held_out, 0) as held_out from tr left join ho using (dset_id)""",
    "weighted_draw": _ERR + f""", w as (select dset_id, struct_id, round(f_loss, 6) as w from err), u as (select *, ln((('0x' || substr(md5(struct_id::varchar), 1, 8))::bigint + 0.5) / {float(1 << 32)}) / w as lot from w where w > 0)
        select dset_id, struct_id, w from u qualify row_number() over (partition by dset_id order by lot desc, struct_id) <= {N_TRAIN}""",
    "cluster_losses": _CL + " select * from cl",
    "problem_clusters": _CL + f""", h as (select *, sum(population) over (order by loss desc, cluster rows unbounded preceding) as held, avg(loss) over () as m from cl),
        c as (select *, coalesce(max(case when held >= {N_PROBLEM} then loss end) over (), min(loss) over ()) as cs from h), b as (select *, m * (1 + (1 - greatest(0, ceil(round(1 + 500 * (1 - cs / m), 9)))) / 500) as bound from c)
        select cluster, loss, population, round(bound, 5) as bound from b where loss >= bound - 1e-12""",
    "problem_quotas": _QUOTA + " select * from qt",
    "problem_records": _QUOTA + ", p as (select *, row_number() over (partition by cluster order by loss desc, row_id) as place from rw) select p.cluster, row_id, p.loss, place from p join qt on p.cluster = qt.cluster where place <= quota",
    "rising_losses": _EN + """, sd as (select dset_id, round(stddev_pop(e), 3) as loss from en group by 1), nm as (select dset_id, arg_min(dset_name, loaded_at) as dset_name, arg_min(release_no, loaded_at) as release_no from datasets where dset_name is not null group by 1)
        select dset_name, release_no, dset_id, loss, coalesce(loss > lag(loss) over w, false) as rising, min(loss) over w as best from nm join sd using (dset_id) window w as (partition by dset_name order by release_no, dset_id)""",
    "train_labels": RECS + """, v as (select dset_id, unnest(f) as v from recs where len(f) = 3 * len(z)), s2 as (select dset_id, stddev_pop(v) as sd, count(v) as n_labels from v group by 1)
        select dset_id, n_labels, round(sd, 5) as sd, round(avg(abs(v / sd)), 5) as mean_size, round(avg((v / sd) ** 2), 5) as mean_square from v join s2 using (dset_id) where sd > 0 group by dset_id, n_labels, sd""",
    "integration_constant": _ERR + """, g as (select dset_id, count(*) as n, round(avg(e + f_loss), 3) as c, sign(regr_slope(e, -f_loss))::double as slope_sign, round(corr(e, -f_loss), 4) as corr from err group by 1 having count(*) >= 3)
        select *, coalesce(slope_sign < 0 or corr < 0.95, true) as refused from g""",
    "composition_fractions": """with p as (select dset_id, comp_ids from (select * from datasets qualify row_number() over (partition by dset_id order by loaded_at) = 1)), u as (select dset_id, unnest(comp_ids) as comp_id from p),
        c as (select dset_id, comp_id, count(*) as n from u group by 1, 2), k as (select *, case comp_id """ + " ".join(f"when '{k}' then {m}" for k, (m, _) in MOLECULES.items()) + " end as m, case comp_id " + " ".join(f"when '{k}' then {rho}" for k, (_, rho) in MOLECULES.items()) + """ end as rho from c),
        w as (select *, n * m / sum(n * m) over (partition by dset_id) as w from k where m is not null), q as (select *, sum(w * rho) over (partition by dset_id) as density from w)
        select dset_id, comp_id, n, round(w, 6) as mass_fraction, round(density, 4) as density, floor(w * 1e-27 * density * 1000 / m * 6.02214076e23 + 1e-9)::bigint as molecules from q""",
}
