"""Toxicity scores from averaged subword embeddings and a linear softmax.

A word is the bag of its own vector and those of its affixes and byte n-grams, all hashed into
one table of embeddings; a text is the mean over its distinct words, and ``NEUTRAL`` words of
zeros, of the means of their bags.  A linear softmax reads the mean.  The neutral words keep a
text of a few words from being judged by chance.  Table and softmax are trained together in numpy, so a misspelling that
the training never saw shares most vectors with the word it bends.  A mean over many words thins
out what a few of them say, so the log odds are stretched and shifted (Platt's scaling) by learnt
rows that the vectors were not trained on: ``PARTS`` models are each trained without one part of the
rows and scaled on it, and their log odds are averaged.

Training takes at most ``SAMPLE`` labelled rows (in the order of a hash of the key, each text at
most ``SAMPLE_BYTES`` long) and runs in ``PARTS`` tasks, a model each; the driver gets what the
features add to the log odds, and no text.  Everything is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm import ragged, subwords
from formline.llm.registry import query, table
from formline.llm.samples import hash_limit

SAMPLE, SAMPLE_BYTES = 8000, 40_000
BITS, WIDTH, BATCH, RATE, DECAY = 18, 4, 128, 1.0, 3e-6
#: Passes over the sample; a small sample is passed so often that this many batches are seen.
EPOCHS, LEAST_BATCHES = 8, 300
PARTS = 3
NEUTRAL = 60
AFFIXES, GRAMS = (3, 4, 5), (4,)
#: Rows with this remainder of crc32(key as text) by 4 are never learnt from.
HELD_OUT = 2
THRESHOLD = 0.3


@dataclass
class Model:
    """Embeddings (feature, width), softmax weights (width, 2) and its bias."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self, factor: float = 1.0, offset: float = 0.0) -> Scorer:
        """Log odds of the label 1, times ``factor`` plus ``offset``."""
        one = self.weights[:, 1] - self.weights[:, 0]
        return Scorer(factor * (self.vectors.astype(float) @ one),
                      factor * float(self.bias[1] - self.bias[0]) + offset)


@dataclass
class Scorer:
    """What a feature adds to the log odds of the label 1, and the log odds without words.

    The mean of embeddings and the softmax are linear, so this is all that scoring needs of them."""

    odds: np.ndarray
    blank: float

    def log_odds(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Log odds of the label 1 of every text of a chunk."""
        rows, words, place, owner, number, size = _bags(offsets, data)
        means = np.bincount(owner, self.odds[number], size) / np.maximum(
            np.bincount(owner, minlength=size), 1)
        pairs = np.unique(words * size + place) if size else np.zeros(0, np.int64)
        text, kind = pairs // max(size, 1), pairs % max(size, 1)
        return self.blank + np.bincount(text, means[kind], rows) / (
            np.bincount(text, minlength=rows) + NEUTRAL)

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Probability of the label 1 of every text of a chunk."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(offsets, data), -30, 30)))


def _bags(offsets: np.ndarray, data: np.ndarray):
    """(texts, text of each word, type of each word, type and feature pairs, types)."""
    low = subwords.lower(data)
    spans, row, place, starts, ends = subwords.distinct_words(low, offsets)
    owner, number = subwords.features(spans, starts, ends, BITS, AFFIXES, GRAMS)
    return len(offsets) - 1, row, place, owner, number, len(starts)


def _training_bags(texts: list[str] | pa.Array):
    """(text, type) pairs in the order of the texts, features of all types, features per type."""
    docs, kinds, numbers, sizes = [], [], [], []
    known, order = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes, sorted; their types
    for first, offsets, data in ragged.text_chunks(pa.array(texts, pa.string())):
        low = subwords.lower(data)
        spans, row, place, starts, ends = subwords.distinct_words(low, offsets)
        hashes = spans.hashes(starts, ends)
        new = np.flatnonzero(~np.isin(hashes, known))
        owner, number = subwords.features(spans, starts[new], ends[new], BITS, AFFIXES, GRAMS)
        numbers.append(number[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(new)))
        known = np.concatenate([known, hashes[new]])
        order = np.concatenate([order, np.arange(len(order), len(known), dtype=np.int32)])
        by = np.argsort(known)
        known, order = known[by], order[by]
        pairs = np.unique(row * max(len(starts), 1) + place)
        docs.append((pairs // max(len(starts), 1) + first).astype(np.int32))
        kinds.append(order[np.searchsorted(known, hashes[pairs % max(len(starts), 1)])])
    return tuple(map(np.concatenate, (docs, kinds, numbers, sizes)))


def _places(numbers: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, place of each number among them); ``mark`` is zero before and after."""
    mark[numbers] = 1
    distinct = np.flatnonzero(mark)
    mark[distinct] = np.arange(len(distinct))
    places = mark[numbers]
    mark[distinct] = 0
    return distinct, places


def train(texts: list[str] | pa.Array, y: np.ndarray, *, epochs: int = EPOCHS, batch: int = BATCH,
          rate: float = RATE, seed: int = 7) -> Model:
    """Embeddings and softmax by stochastic gradients with per-weight step sizes.

    A batch's words are embedded once each, however many of its texts hold them.  Without rows of
    both labels the model is the share of the label 1 alone.
    """
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(np.zeros((1 << BITS, WIDTH), dtype=np.float32),
                  rng.normal(0, 0.5, (WIDTH, 2)), np.log([1 - share, share]))
    if not 0 < y.sum() < len(y):
        model.weights[:] = 0
        return model
    rows = len(texts)
    doc, kind, number, bag = _training_bags(texts)
    head = np.cumsum(bag) - bag
    begin = np.searchsorted(doc, np.arange(rows + 1))
    speed = [np.full(model.vectors.shape, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)]
    marks = np.zeros(len(bag), np.int64), np.zeros(1 << BITS, np.int64)
    for _ in range(max(epochs, -(-LEAST_BATCHES * batch // rows))):
        shuffled = rng.permutation(rows)
        for at in range(0, rows, batch):
            docs = shuffled[at:at + batch]
            count = begin[docs + 1] - begin[docs]
            own = np.repeat(np.arange(len(docs)), count)
            weight = (1.0 / (count + NEUTRAL))[own]
            kinds, word = _places(kind[ragged.ranges(begin[docs], count)], marks[0])
            size = bag[kinds]
            used, feature = _places(number[ragged.ranges(head[kinds], size)], marks[1])
            owner, table = np.repeat(np.arange(len(kinds)), size), model.vectors[used]
            words = subwords.sums(owner, table[feature], len(kinds)) / size[:, None]
            hidden = subwords.sums(own, words[word] * weight[:, None], len(docs))
            z = hidden @ model.weights + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (np.stack([1 - y[docs], y[docs]], axis=1) - p) / len(docs)
            back = subwords.sums(word, (error @ model.weights.T)[own] * weight[:, None],
                                 len(kinds)) / size[:, None]
            step = subwords.sums(feature, back[owner], len(used)) - DECAY * table
            speed[0][used] += step * step
            model.vectors[used] += (rate * step / np.sqrt(speed[0][used])).astype(np.float32)
            for value, step, total in zip((model.weights, model.bias), (
                    hidden.T @ error, error.sum(axis=0)), speed[1:], strict=True):
                total += step * step
                value += rate * step / np.sqrt(total)
    return model


def scaling(z: np.ndarray, y: np.ndarray, blank: float, steps: int = 100) -> tuple[float, float]:
    """Factor and offset of log odds ``z`` by Platt's scaling: logistic regression whose targets
    are drawn a little towards each other.

    ``blank``, the log odds of a text without words, gets no more than the share of the label 1.
    A factor is never negative.
    """
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, found = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (target - p))
        found += step * min(1.0, 2 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    base = np.log(ones / (len(y) - ones))
    factor = max(0.0, float(found[0]))
    return factor, float(min(found[1] if factor else base, base - factor * blank))


def part_scorer(texts: Callable[[np.ndarray], pa.Array], y: np.ndarray, k: int, **options
                ) -> Scorer | None:
    """Model ``k`` of ``PARTS``, trained without that part of the rows and scaled on it.

    ``texts`` gives those of row numbers, so that no more than one side is held beside the rows.
    Without rows of both labels inside and outside of every part, the first is one model of all
    rows as it is, and there are no others.
    """
    part = np.arange(len(y)) % PARTS
    sides = [y[side] for j in range(PARTS) for side in (part == j, part != j)]
    if not all(0 < side.sum() < len(side) for side in sides):
        return None if k else train(texts(np.arange(len(y))), y, **options).scorer()
    model = train(texts(np.flatnonzero(part != k)), y[part != k], **options)
    plain = model.scorer()
    z = [plain.log_odds(offsets, data) for _, offsets, data in ragged.text_chunks(
        texts(np.flatnonzero(part == k)))]
    return model.scorer(*scaling(np.concatenate(z), y[part == k], plain.blank))


def averaged(models: list[Scorer]) -> Scorer:
    return Scorer(np.mean([s.odds for s in models], axis=0),
                  float(np.mean([s.blank for s in models])))


def fit(texts: list[str], labels: list[int], **options) -> Scorer:
    """Mean of the models of all parts, learnt here."""
    rows, y = pa.array(texts, pa.string()), np.asarray(labels, dtype=float)
    found = [part_scorer(rows.take, y, k, **options) for k in range(PARTS)]
    return averaged([s for s in found if s is not None])


def held_out(key: str, remainder: int = HELD_OUT, folds: int = 4):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")),
                  F.lit(folds)) == remainder


def drawn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
          text: str = "text", rows: int = SAMPLE) -> DataFrame:
    """(_h, _y, _text) of at most ``rows`` labelled rows to learn from, in any order.

    Rows whose hash lies below the wished share are taken, so each task sends its share only; of
    equal hashes, however many, none sends more than ``rows``.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.col(label).cast("int")).alias("_y"))
    usable = docs.where(F.col(text).isNotNull() & F.coalesce(~held_out(key), F.lit(False)) & (
        F.octet_length(text) <= SAMPLE_BYTES)).select(
        F.col(key), F.xxhash64(F.col(key), F.lit("sample")).alias("_h"),
        F.col(text).alias("_text")).join(known, key)
    low = hash_limit(rows, usable.count())
    return usable.where(F.col("_h") <= F.lit(low)).select("_h", "_y", "_text").orderBy(
        "_h", "_y", "_text").limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
           text: str = "text", rows: int = SAMPLE) -> list:
    """At most ``rows`` labelled rows to learn from, as (text, label), for use without Spark."""
    found = sorted((r["_h"], r["_y"], r["_text"]) for r in drawn(
        docs, labels, label, key, text, rows).toLocalIterator())
    return [(t, y) for _, y, t in found]


def with_toxicity(docs: DataFrame, model: Scorer, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted as last columns (of their names, the old are replaced).

    NULL, empty and wordless texts get at most the share of the label 1.  Repeated rows are
    scored alike; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text_"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            found = [shared.value.scores(offsets, data) for _, offsets, data in
                     ragged.text_chunks(batch.column(batch.num_columns - 1))]
            z = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(z), pa.array((z >= threshold).astype(np.int32))],
                [*kept, "score", "predicted"])
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias("score"),
                         F.lit(0).alias("predicted")).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(score, schema)


def fitted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Scorer:
    """The model of at most ``size`` rows; every part's is learnt in a group of its own."""
    def learn(group: pa.Table) -> pa.Table:
        k = group["part"][0].as_py()
        order = pc.sort_indices(group, [(c, "ascending") for c in ("_h", "_y", "_text")]).to_numpy()
        found = part_scorer(lambda at: group["_text"].take(order[at]).combine_chunks(),
                            group["_y"].to_numpy()[order].astype(float), k)
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks
        out = [] if found is None else [{"part": k, "odds": found.odds.tobytes(),
                                         "blank": found.blank}]
        return pa.Table.from_pylist(out, pa.schema([
            ("part", pa.int32()), ("odds", pa.binary()), ("blank", pa.float64())]))
    parts = drawn(docs, labels, rows=size).withColumn(
        "part", F.explode(F.array(*map(F.lit, range(PARTS))))).repartition("part")
    found = parts.groupBy("part").applyInArrow(
        learn, "part int, odds binary, blank double").collect()
    models = [Scorer(np.frombuffer(r["odds"]), r["blank"])
              for r in sorted(found, key=lambda r: r["part"])]
    return averaged(models) if models else fit([], [])


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
