"""Language of texts, also code-switched ones, by a linear-chain conditional random field.

Every word is labelled with a language from its affixes, its byte n-grams and the word itself (a
learned lexicon), and from learned transitions between the languages of neighbouring words.
Forward-backward gives the probability of every language at every word; a text's probabilities
are the means over its words.

The field learns from at most ``SAMPLE`` rows per language (rows of the smallest hashes of the key,
texts up to ``SAMPLE_BYTES``); every word of a row counts as one of the row's language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm import chain, ragged, subwords
from formline.llm.registry import query, table
from formline.llm.samples import hash_limit

SAMPLE, SAMPLE_BYTES = 250, 30_000
#: Beyond ``SAMPLE_ALL / SAMPLE`` languages each gets fewer rows, but at least ``SAMPLE_LEAST``.
SAMPLE_ALL, SAMPLE_LEAST = 25_000, 20
BITS, AFFIXES, GRAMS = 16, (1, 2, 3), (2, 3)
STEPS, RATE, SHRINK = 25, 0.1, 1e-2
#: Rows with this remainder of crc32(key as text) by 3 are never learnt from.
HELD_OUT = 1
UNKNOWN = "und"


@dataclass
class Field:
    """Languages, feature weights (feature, language), moves and starts."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def probabilities(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """(word, language) of the words of a chunk, and the text of every word."""
        scores, row, begins = self._scored(*_words(offsets, data))
        return chain.forward_backward(scores, begins, self.moves, self.start), row

    def _scored(self, row, place, owner, number, types):
        each = subwords.sums(owner, self.weights[number], types)
        begins = np.ones(len(row), dtype=bool)
        begins[1:] = row[1:] != row[:-1]
        return each[place], row, begins

    def texts(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of every text and its number of words."""
        rows = len(offsets) - 1
        p, row = self.probabilities(offsets, data)
        count = np.bincount(row, minlength=rows)
        return subwords.sums(row, p, rows) / np.maximum(count, 1)[:, None], count


def _words(offsets: np.ndarray, data: np.ndarray):
    low = subwords.lower(data)
    spans, row, place, starts, ends = subwords.distinct_words(low, offsets)
    owner, number = subwords.features(spans, starts, ends, BITS, AFFIXES, GRAMS)
    return row, place, owner, number, len(starts)


def fit(texts: list[str], languages: list[str]) -> Field:
    """The field of the given rows; without rows it knows no language."""
    names = sorted(set(languages))
    size = len(names)
    field = Field(names, np.zeros((1 << BITS, size)), np.zeros((size, size)), np.zeros(size))
    if size < 2:
        return field
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    row, place, owner, number, types = _words(offsets, data)
    y = np.array([names.index(x) for x in languages])[row]
    begins = np.ones(len(row), dtype=bool)
    begins[1:] = row[1:] != row[:-1]
    gold = np.eye(size)[y]
    same = np.flatnonzero(~begins)
    gold_moves = np.zeros((size, size))
    np.add.at(gold_moves, (y[same - 1], y[same]), 1)
    gold_start = gold[begins].sum(axis=0)

    def gradient():
        scores = subwords.sums(owner, field.weights[number], types)[place]
        p, moved = chain.forward_backward(scores, begins, field.moves, field.start, pairs=True)
        error = subwords.sums(place, gold - p, types)
        return {"weights": subwords.sums(number, error[owner], 1 << BITS)
                - SHRINK * field.weights, "moves": gold_moves - moved - SHRINK * field.moves,
                "start": gold_start - p[begins].sum(axis=0) - SHRINK * field.start}
    chain.adam({"weights": field.weights, "moves": field.moves, "start": field.start}, gradient,
               STEPS, RATE)
    return field


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")),
                  F.lit(3)) == HELD_OUT


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang",
           rows: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, language) of about ``rows`` and at most twice as many rows of each language.

    Every language is learnt, however rare, and is thinned by its own share of hashes.  The rows
    a language fall with the number of languages (``SAMPLE_ALL``); the weights grow with it.
    """
    usable = docs.where(
        F.col(f"`{text}`").isNotNull() & F.col(f"`{language}`").isNotNull()
        & F.coalesce(~held_out(key), F.lit(False))
        & (F.octet_length(F.col(f"`{text}`")) <= SAMPLE_BYTES)).select(
        F.xxhash64(F.col(f"`{key}`"), F.lit("language")).alias("h"),
        F.col(f"`{language}`").alias("y"), F.col(f"`{text}`").alias("t"))
    counts = usable.groupBy("y").agg(F.count("*").alias("n")).collect()  # a row per language
    if not counts:
        return []
    rows = min(rows, max(SAMPLE_LEAST, SAMPLE_ALL // len(counts)))
    limits = docs.sparkSession.createDataFrame(
        [(str(r["y"]), hash_limit(rows, r["n"])) for r in counts], "y string, least bigint")
    wanted = usable.withColumn("y", F.col("y").cast("string")).join(
        F.broadcast(limits), "y").where("h <= least").select("h", "y", "t")
    found = sorted((r["h"], r["y"], r["t"]) for r in wanted.toLocalIterator())
    taken: dict[str, int] = {}
    out = []
    for _, y, t in found:
        taken[y] = taken.get(y, 0) + 1
        if taken[y] <= 2 * rows:
            out.append((t, y))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text holds a letter of any script."""
    total = np.zeros(len(data) + 1, dtype=np.int64)
    low = ragged.LOWER[data]
    np.cumsum((low >= 97) & (low <= 122), out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for r in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        text = data[offsets[r]:offsets[r + 1]].tobytes().decode()
        out[r] = any(c.isalpha() for c in text)
    return out


def with_language(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score as last columns (old ones of these names go).

    Texts that are NULL, empty or without a letter get ``und`` and 0; so does every text if
    nothing was learnt.  Ties go to the language first in the alphabet.  Repeated rows are
    treated alike, an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text_"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def label(batches):
        names = np.array([*shared.value.languages, UNKNOWN], dtype=object)
        for batch in batches:
            found, sure = [], []
            for _, offsets, data in ragged.text_chunks(batch.column(batch.num_columns - 1)):
                known = has_letter(data, offsets)
                if len(names) > 1:
                    p, _ = shared.value.texts(offsets, data)
                    best = np.where(known, p.argmax(axis=1), -1)
                    sure.append(np.where(known, p.max(axis=1), 0.0))
                else:
                    best = np.full(len(known), -1)
                    sure.append(np.zeros(len(known)))
                found += names[best].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()),
                 pa.array(np.clip(np.concatenate(sure), 0, 1) if sure else [], pa.float64())],
                [*kept, "lang_pred", "score"])
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("lang_pred"),
                         F.lit(0.0).alias("score")).schema
    for item in schema:
        item.nullable = True
    return rows.mapInArrow(label, schema)


def fitted(docs: DataFrame) -> Field:
    rows = sample(docs)
    return fit([t for t, _ in rows], [y for _, y in rows])


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return with_language(docs.select("doc_id", "text"), fitted(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
