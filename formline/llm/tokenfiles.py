"""Token ids in files compressed by a Re-Pair grammar, with random access.

Texts are encoded by a public tokenizer, an end id is appended to each, and the ids are cut into
blocks of whole documents in ascending order of the key.  Within a block the most frequent pairs
of neighbouring ids are replaced by new ids (nonterminals), again and again; a block holds the
remaining sequence, the rules (left and right id of every nonterminal), the expansion length of
every nonterminal, and where each document starts in the sequence.  Pairs do not reach over a
document's end.  A range of ids is decoded from the symbols that cover it alone.

One row of the Parquet files is one block.  Blocks are numbered by range of the key and place in
the range, so ``start`` needs a running sum over block totals only.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.llm import ragged
from formline.llm.registry import query, table
from formline.llm.units import Cache
from formline.session import scratch_folder

END = 2
BLOCK_IDS = 1 << 19
#: A pair is replaced if it occurs so often in its block; rounds of replacement per block.
LEAST, ROUNDS = 24, 5
SLOTS_BITS = 18
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Cache, int]:
    """Unit cache over the tokenizer in ``path``, and its number of ids; one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in tokenizer.encode_batch_fast([u.decode() for u in units],
                                                          add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.int32, int(sizes.sum())), sizes
    return Cache(encode), tokenizer.get_vocab_size()


def compressed(ids: np.ndarray, ends: np.ndarray, first: int, rounds: int = ROUNDS,
               least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, left, right, ends): nonterminal ``first + k`` stands for left[k], right[k].

    ``ends`` are the documents' ends, before in ids and after in symbols.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    made, now = first, ids.astype(_U)
    for _ in range(rounds):
        if len(now) < 2 * least:
            break
        pair = (now[:-1] << _U(32)) | now[1:]
        slot = ((pair * _ODD) >> _U(64 - SLOTS_BITS)).view(np.int64)
        cut = ends[(ends > 0) & (ends <= len(pair))] - 1
        owner = np.zeros(1 << SLOTS_BITS, _U)
        owner[slot] = pair  # one of the pairs of a slot
        same = owner[slot] == pair
        same[cut] = False
        times = np.bincount(slot[same], minlength=1 << SLOTS_BITS)
        room = (1 << 16) - made if made < 1 << 16 else (1 << 31) - made
        frequent = np.flatnonzero(times >= least)
        frequent = frequent[np.argsort(-times[frequent], kind="stable")][:room]
        if not len(frequent):
            break
        # Of two overlapping pairs the more frequent one wins; of equal ones the first.
        strong = np.zeros(1 << SLOTS_BITS, np.int32)
        strong[frequent] = np.arange(len(frequent), 0, -1)
        here = np.zeros(len(pair) + 2, np.int32)
        here[1:-1] = strong[slot]
        here[1:-1][~same] = 0
        middle = here[1:-1]
        wins = (middle > here[:-2]) & (middle >= here[2:])
        again = (middle == here[:-2]) & (middle > 0)
        if again.any():  # in a run of one id every other pair is taken
            begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(middle))))
            even = (np.arange(len(middle)) - begin) % 2 == 0
            wins |= again & even & (middle > here[begin]) & (middle >= here[2:])
        taken = np.flatnonzero(wins)
        left.append((owner[frequent] >> _U(32)).astype(np.int64))
        right.append((owner[frequent] & _U(0xFFFFFFFF)).astype(np.int64))
        now[taken] = (made + len(frequent) - middle[taken]).astype(_U)
        kept = np.ones(len(now), dtype=bool)
        kept[taken + 1] = False
        gone = np.searchsorted(taken, ends - 1, "left")  # removals before each end
        ends = ends - gone
        now = now[kept]
        made += len(frequent)
        if len(taken) < len(now) // 50:
            break
    now = now.astype(np.int64)
    return now, np.concatenate(left), np.concatenate(right), ends


def lengths(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal expands to; rules only use earlier ones."""
    out = np.zeros(len(left), np.int64)
    done = 0
    while done < len(left):
        # All rules up to the first that needs one not yet known.
        need = np.maximum(left[done:], right[done:]) - first
        stop = np.flatnonzero(need >= done)
        until = done + int(stop[0]) if len(stop) else len(left)
        part = slice(done, until)
        out[part] = sum(np.where(x >= first, out[np.maximum(x - first, 0)], 1)
                        for x in (left[part], right[part]))
        done = until
    return out


def expanded(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    now = symbols.astype(np.int64)
    while len(now) and (open_ := now >= first).any():
        size = 1 + open_
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[at] = np.where(open_, left[np.where(open_, now - first, 0)] if len(left) else 0, now)
        out[at[open_] + 1] = right[now[open_] - first]
        now = out
    return now


def decoded_range(block: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, from the symbols that cover them."""
    symbols, left, right, first = _block(block)
    size = np.frombuffer(block["lengths"], np.uint32).astype(np.int64)
    each = np.where(symbols >= first, size[np.maximum(symbols - first, 0)] if len(size) else 1, 1)
    edge = np.concatenate([[0], np.cumsum(each)])
    stop = min(stop, int(edge[-1]))
    if stop <= start:
        return np.zeros(0, np.int64)
    lo = int(np.searchsorted(edge, start, "right")) - 1
    hi = int(np.searchsorted(edge, stop, "left"))
    return expanded(symbols[lo:hi], left, right, first)[start - edge[lo]:stop - edge[lo]]


def _block(block: dict):
    kind = np.uint16 if block["width"] == 2 else np.uint32
    return (*(np.frombuffer(block[c], kind).astype(np.int64)
              for c in ("sequence", "left", "right")), block["first"])


BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()),
                   ("keys", pa.list_(pa.int64())), ("width", pa.int32()), ("first", pa.int32()),
                   ("sequence", pa.binary()), ("left", pa.binary()), ("right", pa.binary()),
                   ("lengths", pa.binary()), ("sizes", pa.binary())])
_DDL = ("shard int, block int, n_ids long, keys array<long>, width int, first int, "
        "sequence binary, left binary, right binary, lengths binary, sizes binary")


def _row(shard: int, block: int, keys: list, ids: np.ndarray, sizes: np.ndarray, first: int
         ) -> pa.RecordBatch:
    sequence, left, right, _ = compressed(ids, np.cumsum(sizes), first)
    wide = first + len(left) > 1 << 16
    kind = np.uint32 if wide else np.uint16
    cells = [shard, block, len(ids), keys, 4 if wide else 2, first,
             *(x.astype(kind).tobytes() for x in (sequence, left, right)),
             lengths(left, right, first).astype(np.uint32).tobytes(),
             sizes.astype(np.uint32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(
        cells, BLOCK, strict=True)], schema=BLOCK)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, block_ids: int
            ) -> Iterator[pa.RecordBatch]:
    cache, first = encoder(path)
    shard, number = TaskContext.get().partitionId(), 0
    keys, parts, sizes, held = [], [], [], 0
    for batch in batches:
        for row, offsets, data in ragged.text_chunks(batch.column(1)):
            ids, count = cache.texts(offsets, data)
            # The end id goes behind the ids of each text.
            whole = np.full(len(ids) + len(count), end, np.int32)
            inner = np.ones(len(whole), dtype=bool)
            inner[np.cumsum(count + 1) - 1] = False
            whole[inner] = ids
            keys += batch.column(0).slice(row, len(count)).to_pylist()
            parts.append(whole)
            sizes.append(count + 1)
            held += len(whole)
            if held >= block_ids:
                yield _row(shard, number, keys, np.concatenate(parts), np.concatenate(sizes),
                           first)
                number += 1
                keys, parts, sizes, held = [], [], [], 0
    if held:
        yield _row(shard, number, keys, np.concatenate(parts), np.concatenate(sizes), first)


def write_ids(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text",
              vocabulary: str | None = None, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts below ``folder``, in ascending order of the key.

    NULL and empty texts have the end id alone; NULL keys come first; repeated rows are all
    written; an empty table writes no block.  ``vocabulary`` must be a file every executor has.
    """
    path = vocabulary or vocabulary_file()
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    # Many rows of one key are spread by their text.
    rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions(
        "k", F.xxhash64("t")).mapInArrow(
        lambda batches: _encode(batches, path, end, block_ids), _DDL).write.parquet(folder)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in range(batch.num_rows):
            block = {n: batch.column(n)[b].as_py() for n in batch.schema.names if n != "keys"}
            ids = expanded(*_block(block)).astype("<u4")
            sizes = np.frombuffer(block["sizes"], np.uint32).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("keys")[b].values, pa.array(block["before"] + edge[:-1]),
                 ragged.list_array(pa.array(ids.view(np.int32)), sizes)], ["k", "start", "ids"])


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The written blocks, with the number of ids ``before`` each."""
    blocks = spark.read.schema(_DDL).parquet(folder)
    narrow = blocks.select("shard", "block", "n_ids")
    # One row per range of the key, then one per block of a range.
    shards = narrow.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard").orderBy("block")
    places = narrow.withColumn("inner", F.sum("n_ids").over(within) - F.col("n_ids")).join(
        shards, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("before"))
    return blocks.join(places, ["shard", "block"])


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids array<int>) of every written document."""
    return read_blocks(spark, folder).mapInArrow(
        _decode, "k long, start long, ids array<int>").withColumnRenamed("k", key)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        edge = np.asarray(ids.offsets)
        flat = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
        edge = 4 * (edge - edge[0])
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(edge) // 4, pa.int64()),
             pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids as little-endian 32-bit numbers, of every
    document in the files; the ids stay in the task that decodes them."""
    return read_blocks(spark, folder).mapInArrow(
        lambda batches: _digest(_decode(batches)),
        "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    folder = f"{scratch_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder)
    return digests(spark, folder)
