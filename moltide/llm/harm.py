"""Scores for abusive, hateful or sexual language, by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in hashed
features of its normalised words; a document's is their noisy-or, 1 - prod(1 - p). The
weights are trained from document labels alone (the mean over reviewers as a soft
label), by full-batch Adam on a bounded sample of at most MAX_LABELLED labelled documents,
so the model learns which sentences offend and can point at them. The features of the labelled documents are
made once and kept in blocks; every step sums the blocks' gradients. Every document is
scored over its whole text; the model (2^18 numbers) goes to the tasks with the closure.

Normalising undoes disguise: compatibility forms, look-alike letters of other
alphabets, invisible characters, digits for letters, letters spaced or dotted apart, stretched letters;
a word with blanked letters keeps its frame.

Defined results: a null or empty text has score 0 and no sentence; without labels
(or with labels of one kind) every score is 0; null labels are left out; a label for a document that does
not exist is ignored; repeated sentences of a text count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltide.llm.mixing import clean_source
from moltide.sources.tables import materialise

BINS = 1 << 18
MAX_LABELLED = 20_000
#: Documents whose features are made together.
BLOCK_DOCS = 1_000
#: Steps of the training, one Spark job each, and their size.
STEPS, RATE = 40, 0.3
RIDGE = 5e-5
#: A document is reported as harmful from this score on.
THRESHOLD = 0.4

# Letters of other alphabets that look like Latin ones, and signs written for letters.
_LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝмнктвгαεορνικτυ", "aeopcyxijshdqwmhktbraeopvikty")
_SIGNS = str.maketrans("430157@$!|€", "aeoistasiie")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\r\n]+")
_APART = re.compile(r"(?<![\w])(?:[^\W\d_][ .\-_*·]{1,2}){2,}[^\W\d_](?![\w])")
_LONE = re.compile(r"(?:\b[^\W\d_]\b[ .\-_*·]{1,2}){2}|[^\W\d_]_[^\W\d_]_")
_TOKEN = re.compile(r"[^\W_]+(?:[*#@$!|€\-'’][^\W_]*)*[*#$]*|[?!]")
_RUN = re.compile(r"(.)\1+")


def plain(text: str) -> str:
    """Lower case without accents, invisible characters and look-alikes."""
    if text.isascii():
        return text.casefold()
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf", "Cc") or c in "\n\t")
    return text.casefold().translate(_LOOKALIKES)


def tokens(sentence: str) -> list[str]:
    """Tokens of a plain sentence, letters that stand apart put together."""
    if _LONE.search(sentence):
        sentence = _APART.sub(lambda m: re.sub(r"[^\w]", "", m.group()), sentence)
    return _TOKEN.findall(sentence)


def words(sentence: str) -> list[str]:
    """Normalised words of a plain sentence."""
    return [w for token in tokens(sentence) for w in _normal(token)]


@lru_cache(maxsize=50_000)
def _normal(token: str) -> tuple[str, ...]:
    """The normalised words of one token."""
    token = token.strip("-'’")
    if not token:
        return ()
    letters = sum(c.isalpha() for c in token)
    if letters == 0:
        return ("#" if token[0].isdigit() else token,)
    if "*" in token or re.search(r"\w#+\w|\w\$+$|\w#+$", token):
        return "<blanked>", _RUN.sub(r"\1", re.sub(r"[*#$\-]+", "*", token))
    if letters < len(token) and letters >= 2 and not re.fullmatch(r"[^\W\d_]+[\-'’][^\W\d_\-]+.*|[^\W\d_]+\d+", token):
        token = token.translate(_SIGNS)
    return tuple(w for w in re.split(r"[\-'’@!|€]+", _RUN.sub(r"\1", token)) if w)


def sentences(text: str) -> list[str]:
    """The text's distinct sentences in order; a run of single letters over line ends is no concern here."""
    return list(dict.fromkeys(s.strip() for s in _SENTENCE.split(text) if s and s.strip()))


_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 18)  # leaves BINS values


class Vocabulary:
    """Words met so far by number: a 64-bit hash each, and the bins of the 4-grams of those of five letters or more."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.of_token: dict[str, tuple[int, ...]] = {}
        self.hashes: list[int] = []
        self.grams: list[list[int]] = []
        self.start, self.end = self.word("<s>"), self.word("</s>")

    def word(self, word: str) -> int:
        import xxhash

        if (n := self.number.get(word)) is None:
            n = self.number[word] = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word))
            self.grams.append([xxhash.xxh32_intdigest("^" + word[i : i + 4]) % BINS for i in range(len(word) - 3)] if len(word) >= 5 else [])
        return n

    def words(self, sentence: str) -> list[int]:
        """Numbers of the normalised words of a sentence."""
        out: list[int] = []
        for token in tokens(plain(sentence)):
            if (found := self.of_token.get(token)) is None:
                found = self.of_token[token] = tuple(self.word(w) for w in _normal(token))
            out.extend(found)
        return out

    def features(self, flat: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentence and bin of all distinct features: words, pairs, triples, pairs one apart, and 4-grams. ``flat``: word numbers, sentences one after the other."""
        h = np.array(self.hashes, np.uint64)[flat]
        one, two, three = h * _MIX[0], h * _MIX[1], h * _MIX[2]
        near, far = sentence[:-1] == sentence[1:], sentence[:-2] == sentence[2:]
        joined = np.concatenate([one, (one[:-1] + two[1:])[near], (one[:-2] + two[1:-1] + three[2:])[far], (one[:-2] + three[2:])[far]]) >> _SHIFT
        counts = np.array([len(g) for g in self.grams])
        at = np.concatenate([[0], np.cumsum(counts)])
        held = np.fromiter((b for g in self.grams for b in g), np.int64, int(at[-1]))
        n = counts[flat]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        grams = held[np.repeat(at[flat], n) + inside]
        owner = np.concatenate([sentence, sentence[:-1][near], sentence[:-2][far], sentence[:-2][far], np.repeat(sentence, n)])
        keys = np.sort(owner * BINS + np.concatenate([joined.astype(np.int64), grams]))
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        return keys // BINS, keys % BINS


class Bags:
    """Documents as bags of their distinct sentences of feature bins, flattened."""

    def __init__(self, texts: list[str | None]):
        vocabulary, flat, length, doc_of, self.lines = Vocabulary(), [], [], [], []
        for d, text in enumerate(texts):
            for s in sentences(text or ""):
                w = vocabulary.words(s)
                if w:
                    flat += [vocabulary.start, *w, vocabulary.end]
                    length.append(len(w) + 2)
                    doc_of.append(d)
                    self.lines.append(s)
        self.n_docs, self.doc_of = len(texts), np.array(doc_of, np.int64)
        owner, bins = vocabulary.features(np.array(flat, np.int64), np.repeat(np.arange(len(length)), length)) if flat else (np.empty(0, np.int64), np.empty(0, np.int64))
        # sentences of a document with the same features count once: the first
        mark = np.bincount(owner, np.sin(bins + 1.0), minlength=len(length)) if len(length) else np.empty(0)
        first = np.zeros(len(length), bool)
        first[np.unique(np.stack([self.doc_of, mark.round(9)]), axis=1, return_index=True)[1] if len(length) else []] = True
        renumbered = np.cumsum(first) - 1
        keep = first[owner]
        self.sentence_of, self.bins, self.n = renumbered[owner[keep]], bins[keep], int(first.sum())
        self.doc_of, self.lines = self.doc_of[first], [s for s, f in zip(self.lines, first, strict=True) if f]
        self.scale = 1.0 / np.sqrt(np.maximum(np.bincount(self.sentence_of, minlength=self.n), 1)) if self.n else np.empty(0)

    def logits(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.sentence_of, w[self.bins], minlength=self.n) * self.scale + bias

    def noisy_or(self, z: np.ndarray) -> np.ndarray:
        keep = np.bincount(self.doc_of, -np.logaddexp(0.0, z), minlength=self.n_docs)  # sum of log(1 - p)
        return 1.0 - np.exp(keep)

    def worst(self, z: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """Per document its likeliest sentence (of equals the first) and that one's probability."""
        lines, top = [None] * self.n_docs, np.zeros(self.n_docs)
        order = np.lexsort((-np.arange(self.n), z, self.doc_of))
        last = order[np.flatnonzero(np.append(np.diff(self.doc_of[order]) != 0, True))] if self.n else []
        for i in last:
            lines[self.doc_of[i]], top[self.doc_of[i]] = self.lines[i], 1.0 / (1.0 + np.exp(-z[i]))
        return lines, top


_BLOCKS = "y array<double>, doc_of array<int>, sentence_of array<int>, bins array<int>"


def _to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents of a batch as one row of flattened bags, so their features are made once."""
    for batch in batches:
        bags = Bags(batch.column("text").to_pylist())
        columns = [batch.column("y").to_numpy(), *(x.astype(np.int32) for x in (bags.doc_of, bags.sentence_of, bags.bins))]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in columns], ["y", "doc_of", "sentence_of", "bins"])


def gradient(y: np.ndarray, doc_of: np.ndarray, sentence_of: np.ndarray, bins: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """Sum over documents of the slope of -y log p - (1 - y) log(1 - p) by weight; the last number by the bias. p is the noisy-or of the sentences."""
    n = len(doc_of)
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(sentence_of, minlength=n), 1))
    z = np.bincount(sentence_of, w[bins], minlength=n) * scale + bias
    doc = np.clip(1.0 - np.exp(np.bincount(doc_of, -np.logaddexp(0.0, z), minlength=len(y))), 1e-6, 1 - 1e-9)
    by_sentence = ((1.0 - y) - y * (1.0 - doc) / doc)[doc_of] / (1.0 + np.exp(-z))
    return np.append(np.bincount(bins, (by_sentence * scale)[sentence_of], minlength=BINS), by_sentence.sum())


def train(documents: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled documents (doc_id, text, y in 0 ... 1), by full-batch Adam: every step sums the gradients of all blocks in a Spark job.

    The driver holds the model and, a step, one vector of its size for each block of BLOCK_DOCS documents, at most MAX_LABELLED / BLOCK_DOCS.
    """
    w, bias = np.zeros(BINS, np.float32), -3.0
    n, most, least = documents.agg(F.count(F.lit(1)), F.max("y"), F.min("y")).first()
    if not n or most < 0.5 or least >= 0.5:
        return w, -30.0
    parts = -(-n // BLOCK_DOCS)
    blocks = materialise(documents.repartition(parts, "doc_id").mapInArrow(_to_block, _BLOCKS), "bags")

    def slopes(batches: Iterator[pa.RecordBatch], w: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                y, *index = (batch.column(c)[i].values.to_numpy() for c in ("y", "doc_of", "sentence_of", "bins"))
                # reviewers err: a label never counts as certain
                total += gradient(0.02 + 0.96 * y, *index, w, bias)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["g"])

    m, s = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for step in range(1, STEPS + 1):
        found = blocks.coalesce(parts).mapInArrow(lambda b, w=w, bias=bias: slopes(b, w, bias), "g binary").collect()
        g = sum(np.frombuffer(r.g, np.float32).astype(float) for r in found) / n
        g[:-1] += RIDGE * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        w, bias = (w - move[:-1]).astype(np.float32), bias - float(move[-1])
    return w, bias


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y (mean label) of at most MAX_LABELLED reviewed documents, those of the lowest hash."""
    mean = labels.filter("is_harmful is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("is_harmful").alias("y"))
    chosen = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")  # at most MAX_LABELLED rows of two numbers
    return materialise(rows.select("doc_id", "text", "y"), "labelled")


def scores(documents: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep``, score (noisy-or over all sentences), worst (the likeliest sentence) and its probability."""
    w, bias = train(labelled(documents, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(start, BLOCK_DOCS)
                bags = Bags(batch.column("text").to_pylist())
                z = bags.logits(w, bias)
                lines, top = bags.worst(z)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(bags.noisy_or(z)), pa.array(lines, pa.string()), pa.array(top)],
                    ["doc_id", *keep, "score", "worst", "worst_score"],
                )

    fields = documents.select("doc_id", *keep).schema
    schema = T.StructType([*fields.fields, T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType()), T.StructField("worst_score", T.DoubleType())])
    return documents.select("doc_id", *keep, "text").mapInArrow(score, schema)


def harmful(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def by_source(scored: DataFrame) -> DataFrame:
    """Per source (trimmed, lower case; null for none): documents, harmful ones, their rate and the mean score."""
    rows = scored.select(clean_source(F.col("source")).alias("source"), "score")
    hit = F.sum(F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), hit.alias("harmful"), F.round(hit / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
