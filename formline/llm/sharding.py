"""Shards of nearly equal bytes: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form an atomic group; groups are ordered by the 64-bit hash of their
text.  The smallest capacity for which a greedy left-to-right filling needs no more than the
wished number of shards is found by binary search, and the order is cut there.  As the order
is that of a hash, a shard is a range of hashes: rows are assigned without a shuffle.

The order is summarised in segments of equal hash prefixes, at most ``SEGMENTS`` at first.
Filling with segments that may be cut anywhere gives a lower bound of the capacity, filling
with segments that may not be cut gives an upper bound; only segments in which a cut may
fall between these bounds are refined by further hash bits, until both bounds agree.  The
driver holds the segment totals only, never rows or all groups.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.registry import query, table
from formline.session import park

SEGMENTS = 1 << 14
REFINE_BITS = 8
SLOT_ROWS = 50_000


@dataclass
class Segment:
    start: int  # smallest hash, as an unsigned number
    bits: int   # length of the shared prefix
    size: int
    atomic: bool


def text_order(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def _totals(df: DataFrame, bits: int) -> list[tuple[int, int, bool]]:
    """(prefix, bytes, one hash only) of the prefixes of ``bits`` bits."""
    prefix = F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
    rows = df.groupBy(prefix.alias("p")).agg(
        F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
    return [((r.p % (1 << 64)), int(r.s), r.lo == r.hi, r.lo % (1 << 64)) for r in rows]


def _fill(segments: list[Segment], sums: list[int], capacity: int, shards: int,
          divisible: bool) -> list[int] | None:
    """Ends of the shards in cumulated bytes, or None if they do not suffice."""
    ends, at, total = [], 0, sums[-1]
    for _ in range(shards):
        if at >= total:
            break
        k = bisect_right(sums, at + capacity) - 1
        reach = sums[k]
        if divisible and reach < total and not segments[k].atomic:
            reach = min(at + capacity, total)
        if reach <= at:
            return None
        at = reach
        ends.append(at)
    return ends if at >= total else None


def _least(segments: list[Segment], sums: list[int], shards: int, divisible: bool) -> int:
    low, high = 0, max(sums[-1], 1)
    while high - low > 1:
        middle = (low + high) // 2
        if _fill(segments, sums, middle, shards, divisible) is None:
            low = middle
        else:
            high = middle
    return high


def minimax_cuts(df: DataFrame, shards: int, *, segments: int = SEGMENTS,
                 refine_bits: int = REFINE_BITS) -> tuple[list[int], int]:
    """(first hashes of the shards after the first, capacity) for rows of ``h``, ``size``.

    The capacity is the least possible for this order; cuts are unsigned 64-bit numbers.
    """
    bits = max(1, segments.bit_length() - 1)
    parts = [Segment(lo if one else p << (64 - bits), bits, s, one)
             for p, s, one, lo in _totals(df, bits)]
    while True:
        parts.sort(key=lambda x: x.start)
        if not parts:
            return [], 0
        sums = [0, *accumulate(x.size for x in parts)]
        low = _least(parts, sums, shards, divisible=True)
        high = _least(parts, sums, shards, divisible=False)
        first = _greedy(parts, sums, low, shards)
        last = _fill(parts, sums, high, shards, divisible=True)
        open_parts = set()
        for a, b in zip(_padded(first, shards, sums[-1]), _padded(last, shards, sums[-1]),
                        strict=True):
            lo, hi = bisect_right(sums, min(a, b)) - 1, bisect_right(sums, max(a, b)) - 1
            open_parts.update(k for k in range(max(lo - 1, 0), min(hi + 2, len(parts)))
                              if not parts[k].atomic)
        if not open_parts:  # every cut between the bounds falls between whole groups
            ends = _fill(parts, sums, high, shards, divisible=False)
            starts = {s: x.start for s, x in zip(sums, parts, strict=False)}
            return [starts[e] for e in ends if e < sums[-1]], high
        parts = _refined(df, parts, open_parts, refine_bits)


def _greedy(parts: list[Segment], sums: list[int], capacity: int, shards: int) -> list[int]:
    """Ends reached with whole segments, as far as they go."""
    ends, at = [], 0
    for _ in range(shards):
        k = bisect_right(sums, at + capacity) - 1
        at = max(at, sums[k])
        ends.append(at)
    return ends


def _padded(ends: list[int], shards: int, total: int) -> list[int]:
    return [*ends, *[total] * (shards - len(ends))]


def _refined(df: DataFrame, parts: list[Segment], chosen: set[int], step: int) -> list[Segment]:
    """The chosen segments cut by ``step`` further hash bits, the others as they are."""
    spark = df.sparkSession
    out = [x for k, x in enumerate(parts) if k not in chosen]
    for bits in sorted({parts[k].bits for k in chosen}):
        prefixes = [(parts[k].start >> (64 - bits),) for k in chosen if parts[k].bits == bits]
        keys = spark.createDataFrame(prefixes, "q long")
        inner = df.withColumn("q", F.shiftrightunsigned("h", 64 - bits)).join(
            F.broadcast(keys), "q", "left_semi")
        finer = min(64, bits + step)
        out += [Segment(lo if one else p << (64 - finer), finer, s, one)
                for p, s, one, lo in _totals(inner, finer)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard_of(h: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the hash, both as unsigned numbers."""
    lifted = h.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as signed order
    return sum((F.when(lifted >= F.lit(_signed(c ^ (1 << 63))), 1).otherwise(0)
                for c in cuts), F.lit(0)).cast("int")


def sharded(df: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text",
            slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size`` is the UTF-8 length of the text plus 8.  Equal texts share a shard, NULL counts as
    empty; the largest shard is as small as the order of the groups allows.  ``slot`` numbers
    the rows of a shard from 0, by pieces of a hash of the key: a shard is never sorted in one
    task.  Repeated rows and NULL keys get slots of their own.  An empty table gives no rows.
    Other columns are not read.
    """
    narrow = park(df.select(
        F.col(key).alias("k"), text_order(text).alias("h"), row_size(text).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("crc")), "sizes")
    cuts, _ = minimax_cuts(narrow, shards)
    pieces = max(1, -(-narrow.count() // slot_rows))
    # Rows without a key are spread by their text, others by their key.
    placed = narrow.select(
        "k", "size", "crc", shard_of(F.col("h"), cuts).alias("shard"),
        F.pmod(F.xxhash64(F.col("k"), F.when(F.col("k").isNull(), F.col("h"))),
               F.lit(pieces)).alias("piece"))
    before = placed.groupBy("shard", "piece").agg(F.count("*").alias("n")).select(
        "shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece"))
                           - F.col("n")).alias("offset"))
    order = Window.partitionBy("shard", "piece").orderBy("k", "size", "crc")
    return placed.withColumn("rn", F.row_number().over(order)).join(
        before, ["shard", "piece"]).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"))
