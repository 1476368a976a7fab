"""A quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. A line's features are its own (shares of kinds of characters, length, word length,
repetition in the document) and those of the lines before and after it; transition weights tie neighbours. Forward-backward gives
each line's probability of being good, and a document's quality is their mean weighted by length, put on the scale of
document labels by a logistic curve.

Training lines take their document's label. Labelled documents are read for training only where
``crc32(doc_id as text) % 5`` is not 0, and of those at most ``MAX_TRAIN`` (the first by a seeded hash of the id), without the ones
whose lines would bring their number over ``MAX_LINES``; the bounds keep training on the driver small, whatever the corpus. Labels, language, source and id are no features.

Defined results: null and empty texts are one empty line; a null id is not held out and never trains; a null label is no
label; several labels of a document count as their least; with no labels of one kind, every score is the share of
good labels (1 without any label); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

MAX_TRAIN, MAX_LINES, FOLDS, SEED, STEPS, CHUNK = 4000, 200_000, 5, 11, 250, 1 << 20

SPACE, LOWER, UPPER, DIGIT, SYMBOL, BANG, PUNCT, OTHER, NONASCII, NEWLINE = range(10)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[128:] = NONASCII
for kind, chars in ((SPACE, " \t\x0b\x0c\r"), (LOWER, "abcdefghijklmnopqrstuvwxyz"), (UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, "0123456789"), (SYMBOL, "#*$%&|<>=@^~{}[]\\_"), (BANG, "!?"), (PUNCT, ".,;:'\"()-/"), (NEWLINE, "\n")):
    for c in chars:
        _KIND[ord(c)] = kind
NEAR = 10  # so many of a line's first features are also given of its neighbours


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of ``texts`` (n, k); lengths of the lines; number of lines of each text."""
    joined = b"\n".join(texts) + b"\n"
    kinds = _KIND[np.frombuffer(joined, np.uint8)]
    ends = np.flatnonzero(kinds == NEWLINE) + 1
    starts = np.concatenate([[0], ends[:-1]])
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    count = {k: np.add.reduceat((kinds == k).view(np.int8), starts, dtype=np.int64) for k in (SPACE, LOWER, UPPER, DIGIT, SYMBOL, BANG, PUNCT, NONASCII)}
    gap = (kinds == SPACE) | (kinds == NEWLINE)
    begins = ~gap
    begins[1:] &= gap[:-1]
    n_words = np.add.reduceat(begins.view(np.int8), starts, dtype=np.int64)
    lengths = ends - starts - 1
    n = np.maximum(lengths, 1)
    solid = np.maximum(lengths - count[SPACE], 1)
    lines = joined.split(b"\n")[:-1]
    seen_before, at = np.zeros(len(lines)), 0
    stutter, variety = np.zeros(len(lines)), np.ones(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        if len(w) > 1:
            stutter[i] = sum(map(eq, w, w[1:])) / (len(w) - 1)
            variety[i] = len(set(w)) / len(w)
    for m in per_text:
        own: set[bytes] = set()
        for i in range(at, at + m):
            if lines[i] in own:
                seen_before[i] = 1
            own.add(lines[i])
        at += m
    share = {k: count[k] / solid for k in count}
    letters = np.maximum(count[LOWER] + count[UPPER], 1)
    length_of_word = solid / np.maximum(n_words, 1)
    own = [share[SYMBOL], share[UPPER], share[BANG], stutter, variety, share[DIGIT], share[PUNCT], seen_before, np.minimum(length_of_word, 40) / 10, np.log1p(n) / 5]
    own += [share[SYMBOL] > 0.02, share[SYMBOL] > 0.1, count[UPPER] / letters > 0.3, count[UPPER] / letters > 0.7, share[BANG] > 0.05, share[BANG] > 0.15, stutter > 0.15, stutter > 0.4, variety < 0.5, share[DIGIT] > 0.2, count[SPACE] / n, lengths == 0, n_words < 3, length_of_word > 12, share[NONASCII]]
    x = np.stack([np.asarray(f, np.float64) for f in own], axis=1)
    last = np.cumsum(per_text) - 1
    first = last - per_text + 1
    before, after = np.roll(x[:, :NEAR], 1, axis=0), np.roll(x[:, :NEAR], -1, axis=0)
    before[first], after[last] = 0, 0
    edge = np.zeros((len(x), 2))
    edge[first, 0], edge[last, 1] = 1, 1
    return np.concatenate([np.ones((len(x), 1)), x, before, after, edge], axis=1), lengths, per_text


def marginals(scores: np.ndarray, per_text: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of every line, the probability of good; the expected transitions (2, 2); the log-partition in all.

    ``scores``: a line's weight for good (bad weighs 0). Texts run side by side, the longest first.
    """
    order = np.argsort(-per_text, kind="stable")
    sizes = per_text[order]
    begin = (np.cumsum(per_text) - per_text)[order]
    t_of = np.exp(transitions)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    emit = np.exp(np.stack([np.zeros_like(scores), np.clip(scores, -30, 30)], axis=1))
    forward, backward, scale = np.zeros((len(scores), 2)), np.ones((len(scores), 2)), np.ones(len(scores))
    for s in range(steps):
        rows = begin[: active[s]] + s
        a = emit[rows] if not s else emit[rows] * (forward[rows - 1] @ t_of)
        scale[rows] = a.sum(axis=1)
        forward[rows] = a / scale[rows][:, None]
    pairs = np.zeros((2, 2))
    for s in range(steps - 1, 0, -1):
        rows = begin[: active[s]] + s
        e = emit[rows] * backward[rows]
        b = e @ t_of.T
        pairs += np.einsum("ni,ij,nj->ij", forward[rows - 1], t_of, e / scale[rows][:, None])
        backward[rows - 1] = b / scale[rows][:, None]
    return (forward * backward)[:, 1], pairs, float(np.log(scale).sum())


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def mean_marginal(self, x: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean, over each text's lines, of the probability of good. Every line weighs one byte more than its length."""
        p, _, _ = marginals(((x - self.mean) / self.spread) @ self.weights, per_text, self.transitions)
        first = np.cumsum(per_text) - per_text
        return np.add.reduceat(p * (lengths + 1), first) / np.add.reduceat(lengths + 1, first)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), 1.0 if self.constant is None else self.constant)
        m = np.clip(self.mean_marginal(*line_features(texts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(m / (1 - m)) + self.shift)))


def train(features: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> Model:
    """Maximum likelihood of the line labels by Adam, then the logistic curve on the documents.

    ``features``: of each document, the features and lengths of its lines.
    """
    if len(set(quality.tolist())) < 2:
        return Model(*[np.zeros(1)] * 4, constant=float(quality.mean()) if len(quality) else 1.0)
    x, lengths = (np.concatenate(part) for part in zip(*features, strict=True))
    per_text = np.array([len(f) for f, _ in features])
    y = np.repeat(quality.astype(float), per_text)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], spread[0] = 0, 1
    z = (x - mean) / spread
    seen = np.zeros((2, 2))
    for q in (0, 1):
        seen[q, q] = (per_text[quality == q] - 1).sum()
    w, t = np.zeros(z.shape[1]), np.zeros((2, 2))
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, t)]
    for step in range(1, steps + 1):
        p, pairs, _ = marginals(z @ w, per_text, t)
        for v, g, (m1, m2) in ((w, z.T @ (y - p) / len(y) - decay * w, state[0]), (t, (seen - pairs) / len(y) - decay * t, state[1])):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, spread, w, t)
    m = np.clip(model.mean_marginal(x, lengths, per_text), 1e-6, 1 - 1e-6)
    u, a, b = np.log(m / (1 - m)), 1.0, 0.0
    for _ in range(50):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-(a * u + b)))
        h = p * (1 - p) + 1e-9
        g = np.array([((quality - p) * u).sum() - 1e-2 * a, (quality - p).sum()])
        a, b = np.array([a, b]) + np.linalg.solve([[(h * u * u).sum() + 1e-2, (h * u).sum()], [(h * u).sum(), h.sum()]], g)
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> Model:
    """A model from the labelled documents outside fold 0. Features are made on the executors."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(fold(F.col("doc_id")) != 0)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    present = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("n")).join(known, "doc_id")
    present = present.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("n").alias("n"))
    quality_of, n_lines = {}, 0
    for r in present.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_train).collect():
        if n_lines + r["n"] <= max_lines:
            quality_of[r["doc_id"]] = int(r["quality"])
            n_lines += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                x, lengths, _ = line_features([t])
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([x.tobytes()]), pa.array([lengths.astype(np.int64).tobytes()])], ["doc_id", "x", "lengths"])

    ids = docs.sparkSession.createDataFrame([(k,) for k in quality_of], "doc_id long")
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x binary, lengths binary")
    rows = sorted(sample.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    features = [(np.frombuffer(r["x"], np.float64).reshape(len(r["lengths"]) // 8, -1), np.frombuffer(r["lengths"], np.int64)) for r in rows]
    return train(features, np.array([quality_of[r["doc_id"]] for r in rows]))


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t)
        if size > CHUNK:
            yield now
            now, size = [], 0
    yield now


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs``, all columns, with the score; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8(b.column(b.schema.get_field_index(text)))
            found = np.concatenate([model.score(c) for c in _chunks(texts)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, name])

    return docs.select([f.name for f in kept]).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, doc_id, text)
    scored = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
