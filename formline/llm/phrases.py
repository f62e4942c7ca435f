"""Benchmark decontamination with a distributed positional inverted index.

A term is the 64-bit hash of a word (digits, a-z after lower-casing A-Z, and everything beyond
ASCII).  Every window of an item (``window`` consecutive words; a shorter item is one window)
is represented by its rarest terms in the corpus.  The index holds, per term and document,
the ascending positions of the term; it is stored for the terms that represent a window.  The
posting list of a window's rarest term, shifted by the term's place in the window, gives
candidate alignments; the shifted lists of its next terms are intersected with them one after
the other.  What is left is compared word by word with the document, so results are exact.

The executors know which terms to count and to index by a bitmap of fixed size.  Two terms
may share a bit: that lets more postings through, which the joins drop again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm import ragged
from formline.llm.registry import query, table
from formline.session import park

WINDOW = 10
#: Posting lists intersected per window, rarest first.
TERMS = 3
#: Slots of the bitmap that travels to the executors, whatever the benchmark's size.
SLOTS = 1 << 22


def _bitmap(terms: DataFrame) -> np.ndarray:
    """One flag per slot of the terms' hashes; at most ``SLOTS`` numbers reach the driver."""
    slots = terms.select(F.col("term").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("s")
                         ).distinct().collect()
    flags = np.zeros(SLOTS, dtype=bool)
    flags[[r.s for r in slots]] = True
    return flags


def item_words(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words array<long>) of the items that have words and an id."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, data in ragged.text_chunks(batch.column(1)):
                hashes, row, _, _ = ragged.words(offsets, data)
                count = np.bincount(row, minlength=len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(count)),
                     ragged.list_array(ragged.as_long(hashes), count)], ["item", "words"])
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(parse, "item string, words array<long>").where(
        F.col("item").isNotNull() & (F.size("words") > 0)).distinct()


def term_counts(docs: DataFrame, flags, text: str = "text") -> DataFrame:
    """(term, n): occurrences in the whole corpus of the terms whose bit is set."""
    def count(batches):
        for batch in batches:
            for _, offsets, data in ragged.text_chunks(batch.column(0), 2 * ragged.CHUNK_BYTES):
                hashes = ragged.words(offsets, data)[0]
                hashes = hashes[flags.value[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]]
                terms, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([ragged.as_long(terms), ragged.as_long(n)],
                                                 ["term", "n"])
    return docs.select(F.col(text).alias("text")).mapInArrow(
        count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def window_terms(words: DataFrame, counts: DataFrame, window: int = WINDOW,
                 terms: int = TERMS) -> DataFrame:
    """(item, at, rare): per window of an item its rarest terms.

    ``rare`` is an array of (n, place, term), rarest first, ``place`` the position in the item.
    Windows with a word that the corpus lacks cannot occur and are left out.
    """
    placed = words.select("item", F.size("words").alias("m"),
                          F.posexplode("words").alias("place", "term"))
    known = placed.join(counts, "term", "left")
    frame = Window.partitionBy("item").orderBy("place").rowsBetween(0, window - 1)
    inside = known.select(
        "item", F.col("place").alias("at"), "m",
        F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term")
                       ).over(frame).alias("w"))
    whole = inside.where((F.col("at") == 0) | (F.col("at") + window <= F.col("m")))
    rare = F.array_sort("w")
    return whole.withColumn("w", rare).where(F.col("w")[0]["n"] > 0).select(
        "item", "at", F.slice("w", 1, terms).alias("rare"))


def postings(docs: DataFrame, flags, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, positions array<int>) of the indexed terms, one row per term and document."""
    def index(batches):
        for batch in batches:
            for first, offsets, data in ragged.text_chunks(batch.column(1)):
                hashes, row, _, _ = ragged.words(offsets, data)
                begin = np.searchsorted(row, np.arange(len(offsets) - 1))
                place = np.arange(len(row)) - begin[row]
                kept = np.flatnonzero(
                    flags.value[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)])
                kept = kept[np.lexsort((hashes[kept], row[kept]))]
                h, r = hashes[kept], row[kept]
                new = np.ones(len(kept), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                head = np.flatnonzero(new)
                sizes = np.diff(np.append(head, len(kept)))
                yield pa.RecordBatch.from_arrays(
                    [ragged.as_long(h[head]), batch.column(0).take(pa.array(first + r[head])),
                     ragged.list_array(pa.array(place[kept].astype(np.int32)), sizes)],
                    ["term", "doc", "positions"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(
        index, f"term long, doc {kind}, positions array<int>")


def aligned(windows: DataFrame, index: DataFrame, terms: int = TERMS, slop: int = 0
            ) -> DataFrame:
    """(doc, item, at, shift): places where the rarest terms of a window stand as in the item.

    ``shift`` is the document position of the item's first word.  With ``slop`` the terms after
    the rarest one may be off their place by so many words (a proximity match).
    """
    lists = index.select("term", "doc", F.explode("positions").alias("position"))
    first = F.col("rare")[0]
    found = windows.withColumn("term", first["term"]).join(lists, "term").select(
        "doc", "item", "at", "rare", (F.col("position") - first["place"]).alias("shift")
    ).where(F.col("shift") + F.col("at") >= 0)
    off = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    for k in range(1, terms):
        here = F.get("rare", F.lit(k))
        tested = found.where(here.isNotNull())
        if slop:
            tested = tested.select("*", off.alias("off"))
        else:
            tested = tested.withColumn("off", F.lit(0))
        tested = tested.withColumn("term", here["term"]).withColumn(
            "position", F.col("shift") + here["place"] + F.col("off"))
        passed = tested.join(lists, ["term", "doc", "position"], "left_semi").select(found.columns)
        found = found.where(here.isNull()).unionByName(passed.distinct() if slop else passed)
    return found.select("doc", "item", "at", "shift")


def hits(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc, n_words, n_hit (words inside an occurring window), items.

    ``items`` lists the ids (as text, sorted, each once) of items with an occurring window.
    NULL and empty texts have no words; rows with a NULL key are kept and get no hits.  Repeated
    rows are kept; rows that share a key are compared each for itself.  Items without words or
    id never occur; items that share an id count as one.  Empty tables give no rows or no
    hits.  Other columns are not read.
    """
    spark = docs.sparkSession
    words = park(item_words(items, item, item_text), "items")
    flags = spark.sparkContext.broadcast(
        _bitmap(words.select(F.explode("words").alias("term"))))
    counts = park(term_counts(docs, flags, text), "term-counts")
    windows = park(window_terms(words, counts, window), "windows")
    chosen = spark.sparkContext.broadcast(
        _bitmap(windows.select(F.explode("rare.term").alias("term"))))
    index = park(postings(docs, chosen, key, text), "postings")
    candidates = aligned(windows, index).select("doc", "item", "shift").distinct().join(
        words, "item").groupBy("doc").agg(
        F.collect_list(F.struct("item", "shift", "words")).alias("places"))
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(
        candidates, "doc", "left")
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _verified(batches, window),
                           f"doc {kind}, n_words long, n_hit long, items array<string>")


def _verified(batches, window):
    """Candidate places compared word by word."""
    for batch in batches:
        if not batch.num_rows:
            continue
        places = batch.column(2)
        for first, offsets, data in ragged.text_chunks(batch.column(1)):
            hashes, row, _, _ = ragged.words(offsets, data)
            count = len(offsets) - 1
            n_words = np.bincount(row, minlength=count)
            begin = np.cumsum(n_words) - n_words
            n_hit, found = np.zeros(count, np.int64), [[] for _ in range(count)]
            for r in range(count):
                cell = places[first + r]
                if not cell.is_valid:
                    continue
                cell = cell.values
                body = hashes[begin[r]:begin[r] + n_words[r]].view(np.int64)
                hit, names = np.zeros(len(body) + 1, np.int64), set()
                lists = cell.field("words")
                edge, flat = np.asarray(lists.offsets), lists.values.to_numpy()
                for k, (name, shift) in enumerate(zip(
                        cell.field("item").to_pylist(), cell.field("shift").to_pylist(),
                        strict=True)):
                    own = flat[edge[k]:edge[k + 1]]
                    lo, hi = max(0, -shift), min(len(own), len(body) - shift)
                    need = min(window, len(own))
                    if hi - lo < need:
                        continue
                    same = np.zeros(hi - lo + 2, dtype=np.int8)
                    same[1:-1] = own[lo:hi] == body[lo + shift:hi + shift]
                    step = np.diff(same)
                    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    for s, e in zip(starts, ends, strict=True):
                        if e - s >= need:
                            hit[lo + shift + s] += 1
                            hit[lo + shift + e] -= 1
                            names.add(name)
                n_hit[r] = int((np.cumsum(hit)[:-1] > 0).sum())
                found[r] = sorted(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, count), ragged.as_long(n_words),
                 pa.array(n_hit), pa.array(found, pa.list_(pa.string()))],
                ["doc", "n_words", "n_hit", "items"])


def with_contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The digest of ``hits``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, items, **options).select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 2, *, key: str = "doc_id",
                      text: str = "text", item: str = "item_id", item_text: str = "text",
                      window: int = WINDOW, terms: int = TERMS) -> DataFrame:
    """(doc, item): the rarest terms of some window stand within ``slop`` words of their place."""
    spark = docs.sparkSession
    words = park(item_words(items, item, item_text), "items")
    flags = spark.sparkContext.broadcast(
        _bitmap(words.select(F.explode("words").alias("term"))))
    counts = park(term_counts(docs, flags, text), "term-counts")
    windows = park(window_terms(words, counts, window, terms), "windows")
    chosen = spark.sparkContext.broadcast(
        _bitmap(windows.select(F.explode("rare.term").alias("term"))))
    index = park(postings(docs, chosen, key, text), "postings")
    return aligned(windows, index, terms, slop).select("doc", "item").distinct()


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """The same by comparing every position; for tests on small inputs."""
    import re
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    wanted = {i: split(t) for i, t in items.items()}
    out = {}
    for d, t in texts.items():
        body = split(t)
        at = {}
        for p, w in enumerate(body):
            at.setdefault(w, []).append(p)
        hit, names = set(), set()
        for i, own in wanted.items():
            need = min(window, len(own))
            for s in range(len(own) - need + 1) if own else ():
                for p in at.get(own[s], ()):
                    if body[p:p + need] == own[s:s + need]:
                        hit.update(range(p, p + need))
                        names.add(str(i))
        out[d] = (len(body), len(hit), sorted(names))
    return out


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir):
    return with_contamination(table(spark, sf_dir, "documents"),
                              table(spark, sf_dir, "benchmark"))
