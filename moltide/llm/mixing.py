"""Mixing sources to target weights, with soft membership.

1. *Labelled table.* Documents whose source (trimmed, lower case) is a target's, and the
   counts of their words' hashes per source, over all of them: a naive Bayes classifier.
2. *Posteriors.* A document with a source belongs to it; one without gets the
   classifier's posterior over the mix's sources.
3. *Rates.* Each document has a nonnegative rate up to its cap (max_repeats). Projected
   gradient on 1/2 sum_s (tokens_s - target_s)^2 / (tokens there are of s), where tokens_s is the sum of
   rate x size x posterior, from one rate for all documents; each step is one
   aggregate over all documents and all mixes, and the steps so far (a few numbers each) are
   replayed inside the next aggregate.
4. *Copies.* floor(rate + a document's own uniform number); for documents with a source
   also plus its shift. The shifts are set so that the whole copies, those of documents
   without a source counted by their posterior, meet the targets, again from aggregates.

The size of a mix is SLACK times the largest that the caps allow. Documents of other
sources get no copies. One without a source is drawn at most as often as its posterior's
mean of the caps, and its likeliest source's cap, allow.

Defined results: null texts have no tokens and no copies; a source without documents is
reported with a share of 0; targets that are null or not positive are left out;
empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltide.llm.tokens import token_counts
from moltide.sources.tables import materialise

BINS = 1 << 14
STEPS = 30
#: The steps end once every source's expected tokens are so near to their target, relatively.
NEAR = 1e-4
#: Rounds of setting shifts: over all documents, then over ever shorter ones.
FILLS = 3
#: Trial shifts a round, each a GRID-th of the range that the round before left.
GRID = 40
SLACK = 0.95
#: Targets come to the driver and the model of their sources (MAX_TARGETS x BINS numbers, 66 MB at most) to the tasks; more rows are refused.
MAX_TARGETS = 1_000


def clean_source(x: Column) -> Column:
    s = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def word_bins(text: Column) -> Column:
    """Hash bins of the words of a text, repeated ones too."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BINS)).cast("int"))


def fit_sources(documents: DataFrame, sources: list[str]) -> np.ndarray:
    """Log probabilities (source, BINS + 1): of each word bin, and in the last column of the source itself; over all labelled documents."""
    index = {s: i for i, s in enumerate(sources)}
    labelled = documents.filter(F.col("source").isin(sources)).select("source", F.explode(F.concat(F.coalesce(word_bins(F.col("text")), F.array().cast("array<int>")), F.array(F.lit(BINS)))).alias("b"))
    counts = labelled.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most sources x (BINS + 1) rows
    n = np.ones((len(sources), BINS + 1))
    n[[index[s] for s in counts["source"].to_pylist()], counts["b"].to_numpy()] += counts["n"].to_numpy()
    return np.hstack([np.log(n[:, :BINS] / n[:, :BINS].sum(1, keepdims=True)), np.log(n[:, BINS:] / n[:, BINS:].sum())]).astype(np.float32)


def posteriors(documents: DataFrame, sources: list[str]) -> DataFrame:
    """doc_id, source, n_tokens, p (array over ``sources``): one-hot for a known source, the classifier's posterior for none, zeros for others."""
    documents = documents.select("doc_id", "text", clean_source(F.col("source")).alias("source"))
    log_p = fit_sources(documents, sources)
    index = {s: i for i, s in enumerate(sources)}
    # only documents without a source need their words
    documents = documents.withColumn("bins", F.when(F.col("source").isNull(), word_bins(F.col("text"))))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, len(sources)))
            for row, (source, bins) in enumerate(zip(batch.column("source").to_pylist(), batch.column("bins"), strict=True)):
                if source is not None:
                    if source in index:
                        p[row, index[source]] = 1.0
                    continue
                bins = bins.values.to_numpy() if bins.is_valid else np.empty(0, int)
                score = log_p[:, BINS] + (log_p[:, bins].sum(1, dtype=float) / np.sqrt(len(bins)) if len(bins) else 0.0)  # words of a text aren't independent
                q = np.exp(score - score.max())
                p[row] = q / q.sum()
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(sources))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "n_tokens")), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], ["doc_id", "source", "n_tokens", "p"])

    return token_counts(documents, "source", "bins").mapInArrow(predict, "doc_id bigint, source string, n_tokens bigint, p array<double>")


@dataclass
class Mix:
    """One mix: its sources in order of name, where they lie in the posterior, shares, caps, and what is fitted."""

    mix_id: int
    names: list[str]
    where: np.ndarray
    share: np.ndarray
    cap: np.ndarray
    start: float = 0.0  # the rate that all documents start from
    target: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def rates(self, post: np.ndarray) -> np.ndarray:
        return replay(post, self.start, self.steps, self.cap)


def replay(post: np.ndarray, start: float, steps: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates after the projected steps, from each document's posterior (rows of zeros: other sources, no rate)."""
    most = np.minimum(post @ cap, cap[post.argmax(1)])
    rate = np.minimum(start, most)
    for g in steps:
        rate = np.clip(rate - post @ g, 0.0, most)
    return rate


def _posterior(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sums over all rows of the ``size`` numbers that ``of`` gives for a batch: one aggregate, ``size`` rows to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["i", "t"])

    out = np.zeros(size)
    for i, t in rows.mapInArrow(part, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect():
        out[i] = t
    return out


def fit_rates(docs: DataFrame, mixes: list[Mix]) -> int:
    """Sets start, target and gradient steps of every mix; the number of steps taken. docs: source, n_tokens, p."""
    ends = np.cumsum([0, *(len(m.names) for m in mixes)])
    narrow = docs.select("source", "n_tokens", "p")

    def held(batch: pa.RecordBatch) -> np.ndarray:
        weighted = _posterior(batch) * batch.column("n_tokens").to_numpy()[:, None]
        known = batch.column("source").is_valid().to_numpy(zero_copy_only=False)
        return np.concatenate([f(weighted[:, m.where]) for m in mixes for f in (lambda w: w.sum(0), lambda w: w[known].sum(0))])

    sums = _sums(narrow, held, 2 * int(ends[-1]))
    active, weights = {}, {}
    for m, a in zip(mixes, ends, strict=False):
        have, labelled = np.split(sums[2 * a : 2 * (a + len(m.names))], 2)
        held_ = labelled > 0  # what a classifier gives to a source without documents is no ground to draw for it
        m.steps = np.zeros((0, len(m.names)))
        if not held_.any():
            m.target = np.zeros(len(m.names))
            continue
        total = SLACK * float(np.min(m.cap[held_] * have[held_] / m.share[held_]))
        m.target, m.start = m.share * total, total / float(have.sum())
        active[m.mix_id], weights[m.mix_id] = held_, 1.0 / np.maximum(have, 1.0)

    def reached(batch: pa.RecordBatch) -> np.ndarray:
        post, n = _posterior(batch), batch.column("n_tokens").to_numpy()
        return np.concatenate([(m.rates(post[:, m.where]) * n) @ post[:, m.where] for m in mixes])

    worst = 0.0
    for step in range(STEPS if active else 0):
        got, worst = _sums(narrow, reached, int(ends[-1])), 0.0
        for m, a in zip(mixes, ends, strict=False):
            if m.mix_id in active:
                residual = np.where(active[m.mix_id], got[a : a + len(m.names)] - m.target, 0.0)
                worst = max(worst, float(np.abs(residual / np.maximum(m.target, 1.0)).max()))
                # the gradient over a document's size; posteriors sum to at most 1, so its Lipschitz constant with these weights is at most 1
                m.steps = np.vstack([m.steps, weights[m.mix_id] * residual])
        if worst < NEAR:
            return step
    if worst > 0.01:
        warnings.warn(f"expected tokens are still {worst:.3f} of a target away after {STEPS} steps; the shifts of copies follow", stacklevel=2)
    return STEPS if active else 0


def _set_shifts(rates: DataFrame, mixes: list[Mix]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(longest size, shift) per mix and source and fill, so that whole copies meet the targets from below: ever finer grids, one aggregate each.

    A long document may overshoot, so what is missing then is filled up by shifts of the shorter ones alone.
    """
    keys = [(m.mix_id, s) for m in mixes for s in m.names]
    known = rates.filter("source is not null").select("slot", "n_tokens", "rate", "u", "cap")
    # documents without a source are rounded by their own number alone; what they hold of each source is no longer wanted from the others
    first = {m.mix_id: keys.index((m.mix_id, m.names[0])) for m in mixes}

    def open_ones(batch: pa.RecordBatch) -> np.ndarray:
        n = _copies(batch, []) * batch.column("n_tokens").to_numpy()
        out = np.zeros(len(keys))
        for row, (mix_id, member) in enumerate(zip(batch.column("mix_id").to_pylist(), batch.column("membership"), strict=True)):
            member = member.values.to_numpy()
            out[first[mix_id] : first[mix_id] + len(member)] += n[row] * member
        return out

    want = np.maximum(np.concatenate([m.target for m in mixes]) - _sums(rates.filter("source is null"), open_ones, len(keys)), 0.0)
    fills: list[tuple[np.ndarray, np.ndarray]] = []
    limit = np.full(len(keys), np.inf)
    for fill in range(FILLS):
        low, width, held = np.full(len(keys), 0.0 if fill else -1.0), 2.0, want
        for _ in range(3):
            trials = low[:, None] + np.arange(GRID + 1) * width / GRID

            def tokens(batch: pa.RecordBatch, trials=trials, limit=limit) -> np.ndarray:
                slot, n = batch.column("slot").to_numpy(), batch.column("n_tokens").to_numpy()
                out = np.empty((len(keys), GRID + 1))
                for i in range(GRID + 1):
                    out[:, i] = np.bincount(slot, n * _copies(batch, [*fills, (limit, trials[:, i])]), minlength=len(keys))
                return out.ravel()

            t = _sums(known, tokens, len(keys) * (GRID + 1)).reshape(len(keys), -1)
            k = np.clip([np.searchsorted(row, w, side="right") - 1 for row, w in zip(t, want, strict=True)], 0, GRID)
            held = t[np.arange(len(keys)), k]
            low = low + k * width / GRID
            width /= GRID
        fills.append((limit, low))
        limit = np.maximum(want - held, 0.0) / 10.0
    return fills


def _copies(batch: pa.RecordBatch, fills: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whole copies of documents: floor(rate + own number + shifts), at least 0 and at most the cap. ``fills`` as of ``_set_shifts``; none for documents without a source."""
    slot, n = batch.column("slot").to_numpy(), batch.column("n_tokens").to_numpy()
    x = batch.column("rate").to_numpy() + batch.column("u").to_numpy()
    for limit, shift in fills:
        x = x + np.where(n <= limit[slot], shift[slot], 0.0)
    return np.clip(np.floor(x), 0, batch.column("cap").to_numpy())


_RATED = "mix_id int, doc_id bigint, source string, drawn_as string, n_tokens bigint, rate double, membership array<double>, cap int, slot int"
_DRAWN = "mix_id int, doc_id bigint, source string, drawn_as string, n_tokens bigint, rate double, membership array<double>, copies int"


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, doc_id, source (null if unknown), drawn_as (its likeliest source), n_tokens, rate, membership (its share of each of the mix's sources, in order of name), copies (0 left out)."""
    asked = targets.filter("target_share > 0").select("mix_id", clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().limit(MAX_TARGETS + 1).collect()
    if len(asked) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    if not asked:
        return documents.sparkSession.createDataFrame([], _DRAWN)
    sources = sorted({r.source for r in asked})
    docs = materialise(posteriors(documents, sources), "posteriors")
    mixes = []
    for mix_id in sorted({r.mix_id for r in asked}):
        mine = {r.source: r for r in asked if r.mix_id == mix_id}
        names = sorted(mine)
        share = np.array([mine[s].target_share for s in names], float)
        mixes.append(Mix(mix_id, names, np.array([sources.index(s) for s in names]), share / share.sum(), np.array([mine[s].max_repeats for s in names], float)))
    fit_rates(docs, mixes)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post_, slot = _posterior(batch), 0
            for m in mixes:
                post = post_[:, m.where]
                r, top = m.rates(post), post.argmax(1)
                at = np.flatnonzero((r > 0) & (batch.column("n_tokens").to_numpy() > 0))
                take, offsets = pa.array(at), pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(m.names))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), m.mix_id, np.int32)), batch.column("doc_id").take(take), batch.column("source").take(take), pa.array(m.names).take(pa.array(top[at])), batch.column("n_tokens").take(take),
                        pa.array(r[at]), pa.ListArray.from_arrays(offsets, pa.array(post[at].ravel())), pa.array(m.cap[top[at]].astype(np.int32)), pa.array((slot + top[at]).astype(np.int32)),
                    ],
                    ["mix_id", "doc_id", "source", "drawn_as", "n_tokens", "rate", "membership", "cap", "slot"],
                )
                slot += len(m.names)

    uniform = F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    rates = materialise(docs.mapInArrow(rate, _RATED).withColumn("u", uniform), "rates")
    fills = _set_shifts(rates, mixes)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("source").is_valid().to_numpy(zero_copy_only=False)
            copies = np.where(known, _copies(batch, fills), _copies(batch, []))
            at = pa.array(np.flatnonzero(copies > 0))
            columns = ["mix_id", "doc_id", "source", "drawn_as", "n_tokens", "rate", "membership"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in columns), pa.array(copies.astype(np.int32)).take(at)], [*columns, "copies"])

    return rates.mapInArrow(draw, _DRAWN)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target share of the tokens, the share reached by likeliest source and the one expected by membership, documents, tokens, and the most copies of one document."""
    mixed = mixed.withColumn("t", F.col("copies") * F.col("n_tokens"))
    whole = mixed.groupBy("mix_id").agg(F.sum("t").alias("all_tokens"))
    held = mixed.withColumn("source", F.col("drawn_as")).groupBy("mix_id", "source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    wanted = targets.select("mix_id", clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null")
    names = wanted.filter("target_share > 0").dropna().groupBy("mix_id").agg(F.array_sort(F.collect_set("source")).alias("names"))
    parts = mixed.join(F.broadcast(names), "mix_id").select("mix_id", "t", F.explode(F.arrays_zip("names", "membership")).alias("m"))
    parts = parts.groupBy("mix_id", F.col("m.names").alias("source")).agg(F.sum(F.col("t") * F.col("m.membership")).alias("expected"))
    all_parts = parts.groupBy("mix_id").agg(F.sum("expected").alias("all_expected"))
    rows = wanted.join(held, ["mix_id", "source"], "full").join(whole, "mix_id", "left").join(parts, ["mix_id", "source"], "left").join(all_parts, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    reached = F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0))
    return rows.select("mix_id", "source", "target_share", "max_repeats", reached.alias("reached_share"), F.coalesce(F.round(F.col("expected") / F.col("all_expected"), 6), F.lit(0.0)).alias("expected_share"), zero("tokens"), zero("documents"), zero("most_copies"))
