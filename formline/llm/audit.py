"""How five document filters act on each other, in every order, by a sparse document-term matrix.

The words of all texts are dictionary-encoded: tasks cut their documents into shards, compressed
sparse rows over the shard's own words.  A word's number is its 63-bit hash.  All words meet once,
as number and check sum, to find numbers that two words share; those words get numbers of their
own (negative ones).  With the numbers the columns of a shard are global, and no row or cell of
the matrix is ever shuffled.  Row sums are numbers of words, nonzero counts numbers of distinct
words.

A document's failures are five bits.  Counts per part and set of failures say everything about all
orders: what is kept after any filters is the number of documents that fail none of them.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm import ragged
from formline.llm.registry import query, table
from formline.session import own_folder, park

# The conditions under which a document fails.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SIGNS = "#$%&*|"
FILTERS = "ABCDE"
#: Text bytes of a shard (or one longer text), bytes that a reader of shards holds at once.
SHARD_BYTES, ROW_GROUP = 1 << 20, 16 << 20
#: Bits of a word's number.
BITS = 63

_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(SIGNS.encode())] = True
_CHECK = ragged.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _one(values: pa.Array) -> pa.Array:
    """All values as a single list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def sparse_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(indptr, indices, data, words): compressed sparse rows of the texts over their own words.

    Words are what ASCII white space parts.
    """
    lists = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(words, "").as_py() if len(words) else -1
    if blank >= 0:  # before the first or after the last word of a text
        real = index != blank
        owner, index = owner[real], index[real]
        index -= index > blank
        words = pc.filter(words, pc.not_equal(words, ""))
    cells, data = np.unique(owner * max(len(words), 1) + index, return_counts=True)
    row = cells // max(len(words), 1)
    indptr = np.searchsorted(row, np.arange(len(lists) + 1))
    return indptr, cells % max(len(words), 1), data, words


def _packed(values: np.ndarray) -> pa.Array:
    """Whole numbers as bytes of the smallest fitting size."""
    kind = next(k for k in ("<u2", "<u4", "<i8") if not len(values)
                or values.max() <= np.iinfo(k).max)
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _unpacked(data: bytes, count: int) -> np.ndarray:
    kind = {0: "<u2", 2: "<u2", 4: "<u4", 8: "<i8"}[len(data) // max(count, 1)]
    return np.frombuffer(data, kind).astype(np.int64)


def _cut(batches):
    """One row per shard of the documents (id, part, digest, text) of a task."""
    for batch in batches:
        for first, offsets, data in ragged.text_chunks(batch.column(3), SHARD_BYTES):
            part = batch.slice(first, len(offsets) - 1)
            indptr, indices, counts, words = sparse_rows(part.column(3))
            capitals = _per_row((data >= 65) & (data <= 90), offsets)
            points = _per_row((data & 0xC0) != 0x80, offsets)
            yield pa.RecordBatch.from_arrays(
                [*(_one(part.column(k)) for k in range(3)),
                 _one(pa.array(100 * capitals > MOST_CAPITALS * points)),
                 _one(pa.array(_per_row(_SIGN[data], offsets) > 0)),
                 _one(pa.array(indptr.astype(np.int64))), _packed(indices), _packed(counts),
                 pc.binary_join(_one(words), " ")],
                ["ids", "parts", "digests", "c", "d", "indptr", "indices", "data", "words"])


def local_shards(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Shards over their own words, written once; indices and data are packed whole numbers."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), whole.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(_cut, f"""ids array<{kind}>, parts array<string>,
        digests array<binary>, c array<boolean>, d array<boolean>, indptr array<long>,
        indices binary, data binary, words string""")
    folder = own_folder(spark, "shards")
    cut.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    return spark.read.schema(cut.schema).parquet(folder)


def numbers_of(words: bytes, bits: int = BITS
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, check sum, start, end) of words that single spaces part."""
    data = np.frombuffer(words, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), *np.zeros((2, 0), np.int64)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    number = ragged.Spans(data).hashes(starts, ends) >> np.uint64(64 - bits)
    other = ragged.Spans(data, _CHECK).hashes(starts, ends)
    return number.view(np.int64), (other >> np.uint64(32)).astype(np.uint32).view(
        np.int32), starts, ends


def shared_numbers(shards: DataFrame, bits: int = BITS) -> dict[bytes, int]:
    """New numbers of the words whose hash another word has, too.

    There are hardly any: about half a pair among four billion words.
    """
    def pairs(batches):
        for batch in batches:
            for words in batch.column(0):
                number, check, *_ = numbers_of(words.as_buffer().to_pybytes(), bits)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(check)],
                                                 ["number", "check"])
    twice = {r["number"] for r in shards.select("words").mapInArrow(
        pairs, "number long, check int").groupBy("number").agg(
        F.min("check").alias("low"), F.max("check").alias("high")).where(
        "low <> high").select("number").toLocalIterator()}
    if not twice:
        return {}
    known = np.array(sorted(twice))

    def sharing(batches):
        for batch in batches:
            for words in batch.column(0):
                text = words.as_buffer().to_pybytes()
                number, _, starts, ends = numbers_of(text, bits)
                yield pa.RecordBatch.from_arrays([pa.array(
                    [text[starts[i]:ends[i]] for i in np.flatnonzero(np.isin(number, known))],
                    pa.binary())], ["word"])
    words = shards.select("words").mapInArrow(sharing, "word binary").distinct()
    return {bytes(r["word"]): -1 - k for k, r in enumerate(words.orderBy("word").collect())}


def _columns(words: bytes, shared: dict[bytes, int], bits: int = BITS) -> np.ndarray:
    """Global number of each of a shard's words."""
    number, _, starts, ends = numbers_of(words, bits)
    if shared:
        known = np.isin(number, [int(numbers_of(w, bits)[0][0]) for w in shared])
        for i in np.flatnonzero(known):
            number[i] = shared[words[starts[i]:ends[i]]]
    return number


def _cells(shard: pa.RecordBatch, at: int, shared: dict[bytes, int], bits: int = BITS
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the column, occurrences) of a shard's cells in this order, and the columns."""
    def blob(name):
        return shard.column(name)[at].as_buffer().to_pybytes()

    ptr = shard.column("indptr")[at].values.to_numpy()
    index, data = _unpacked(blob("indices"), ptr[-1]), _unpacked(blob("data"), ptr[-1])
    columns, place = np.unique(_columns(blob("words"), shared, bits), return_inverse=True)
    cell = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)) * max(len(columns), 1)
    if len(index):
        cell += place[index]
    by = np.argsort(cell)
    return cell[by] // max(len(columns), 1), cell[by] % max(len(columns), 1), data[by], columns


def term_matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
                ) -> DataFrame:
    """Document-term matrix as compressed sparse row shards: ids (of its rows), indptr, columns
    (numbers of words, the same in all shards) and data (occurrences)."""
    shards = local_shards(docs, key, text, part)
    shared = shared_numbers(shards)

    def matrix(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                _, place, data, columns = _cells(batch, at, shared)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids").slice(at, 1), batch.column("indptr").slice(at, 1),
                     _one(pa.array(columns[place])), _one(pa.array(data))],
                    ["ids", "indptr", "columns", "data"])
    kind = shards.schema["ids"].dataType.simpleString()
    return shards.mapInArrow(matrix, f"ids {kind}, indptr array<long>, columns array<long>, "
                                     "data array<long>")


def row_figures(shards: DataFrame, bits: int = BITS) -> DataFrame:
    """Row sums and nonzero counts of the matrix, a row per document."""
    shared = shared_numbers(shards, bits)

    def figures(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row, place, data, _ = _cells(batch, at, shared, bits)
                ids = batch.column("ids")[at].values
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                total = np.bincount(row, data, len(ids)).astype(np.int64)  # far below 2**53
                distinct = np.bincount(row[new], minlength=len(ids))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(batch.column(n)[at].values for n in ("parts", "digests")),
                     pa.array(total), pa.array(distinct),
                     *(batch.column(n)[at].values for n in ("c", "d"))],
                    ["id", "part", "digest", "n_words", "n_distinct", "c", "d"])
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    return shards.mapInArrow(figures, f"""id {kind}, part string, digest binary, n_words long,
        n_distinct long, c boolean, d boolean""")


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """id, part, n_words, n_distinct, mask (bit k: fails the k-th filter), good, toxic of each row.

    NULL texts count as empty, NULL parts as the empty part.  Rows without key never repeat a
    smaller one and have no label; rows that share a key repeat only keys smaller than theirs.  A
    key with several label rows is good (toxic) if any says 1.  Other columns play no role.
    """
    rows = park(row_figures(local_shards(docs, key, text, part)), "figures")
    kind = rows.schema["id"].dataType.simpleString()
    # The least key of every text; joined by key, so the rows of one text do not meet.
    first = rows.where(F.col("id").isNotNull()).groupBy("digest").agg(
        F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(
        F.col(f"`{key}`").cast(kind).alias("id")).agg(
        *[F.coalesce(F.max(F.col(f"`{c}`") == 1), F.lit(False)).alias(n)
          for n, c in (("good", quality), ("toxic", toxic))])
    known = rows.where(F.col("id").isNotNull()).join(first, ["id", "digest"], "left").join(
        marks, "id", "left")
    nameless = rows.where(F.col("id").isNull()).withColumns(
        {"first": F.lit(True), "good": F.lit(False), "toxic": F.lit(False)})
    fails = [F.col("n_words") < LEAST_WORDS,
             100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
             F.col("c"), F.col("d"), F.col("first").isNull()]
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return known.unionByName(nameless).select(
        "id", "part", "n_words", "n_distinct", mask.alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interactions(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from the ``mask`` of every row.

    Counts of a part and mask are summed before any shuffle; an order needs no further pass.
    """
    n, sets = len(filters), 1 << len(filters)
    cells = failed.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"),
        F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic"))
                                      .alias("cells"))

    def passing(name: str) -> Column:
        """Rows that fail no filter of a set, for all sets."""
        return F.transform(F.sequence(F.lit(0), F.lit(sets - 1)), lambda s: F.aggregate(
            "cells", F.lit(0).cast("long"), lambda total, cell: total + F.when(
                cell["mask"].bitwiseAND(s) == 0, cell[name]).otherwise(0)))

    steps = [{"filter_order": "".join(filters[k] for k in order), "step": i + 1, "k": order[i],
              "before": sum(1 << k for k in order[:i])}
             for order in itertools.permutations(range(n)) for i in range(n)]
    plan = F.from_json(F.lit(json.dumps(steps)),
                       "array<struct<filter_order string, step int, k int, before int>>")
    wide = parts.select("part", *[passing(c).alias(c) for c in ("n", "good", "toxic")],
                        F.explode(plan).alias("s"))
    k, before = F.col("s.k"), F.col("s.before")
    bit = F.call_function("shiftleft", F.lit(1), k)
    after = before.bitwiseOR(bit)

    def at(name, which):
        return F.element_at(name, which + 1)

    removed = at("n", before) - at("n", after)
    # Orders in which exactly the filters of a set come before this one.
    orders = [math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) if
              s.bit_count() < n else 0 for s in range(sets)]
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(sets - 1)), F.lit(0).cast("long"), lambda total, s: total
        + F.when(s.bitwiseAND(bit) == 0, F.element_at(F.lit(orders), s + 1).cast("long") * (
            at("n", s) - at("n", s.bitwiseOR(bit)))).otherwise(0))
    return wide.select(
        "part", "s.filter_order", "s.step", at("n", after).alias("kept"), removed.alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - removed).alias("redundant"),
        (at("n", F.lit(sets - 1) - bit) - at("n", F.lit(sets - 1))).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"),
        (at("toxic", before) - at("toxic", after)).alias("toxic_lost"), shapley.alias("shapley"))


#: The same by evaluating every order over all documents.
SQL = rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text
 FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
 l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false)
 AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 [len(words) < {LEAST_WORDS},
 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words),
 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text),
 regexp_matches(text, '[{SIGNS}]'),
 doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM w LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
 k AS (SELECT unnest(range(1, 6)) AS k),
 o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e
 WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
 s AS (SELECT o, k AS step, list_aggregate(list_transform(o, lambda x: substr('{FILTERS}',
 CAST(x AS INT), 1)), 'string_agg', '') AS filter_order FROM o, k),
 r AS (SELECT part, filter_order, step, o[step] AS this, g.n, good, toxic, fails[o[step]] AS fails,
 len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone,
 len(list_filter(fails, lambda x: x)) = 1 AS alone FROM g, s),
 c AS (SELECT part, filter_order, step, this, sum(n) FILTER (NOT gone AND NOT fails) AS kept,
 sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
 sum(n) FILTER (fails AND alone) AS unique_fails,
 sum(n) FILTER (NOT gone AND fails AND good) AS good_lost,
 sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost FROM r GROUP BY ALL)
 SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(
    f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}" for n in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, this) AS BIGINT) AS shapley FROM c"""


@query("op13_filter_interactions", SQL)
def op13_filter_interactions(spark, sf_dir):
    failed = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(failed)
