"""Vectors as short codes of codebook entries (product quantisation), fitted in whole numbers.

A component x counts as floor(4096 * x).  Vectors are cut into equal parts; each part position has
a codebook, fitted by rounds of nearest entries and floored means.  Squared distances are exact
64-bit integers, so results do not depend on how rows are dealt.

Most scans are spared by norm-of-sum bounds.  A part keeps an upper bound of the distance to its
entry and a lower bound of the distance to all others, each with the round it was measured in.
All codebooks of the past are kept; in a later round a bound is moved by the net displacement of
the entries since its own round, |c(now) - c(then)|, which is never more than the sum of the moves
in between.  Where the moved bounds cannot tell, the distance to the own entry is measured, and
only if that cannot tell either are all entries scanned.

Each round is one pass that reads the rows with their bounds and writes them anew, so a lost
executor repeats parts of one round only.  The driver sees codebooks and their sums, whose size
does not depend on the rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.registry import query, table
from formline.session import discard, own_folder, park
from formline.skew import BROADCAST_ROWS, HOT_ROWS

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
CHUNK = 2048
#: Relative slack of bounds, far above the rounding of a double and below that of a float.
SLACK = 1e-9
#: Per part and row: entry, round of the upper and of the lower bound, both bounds.
STATE = np.dtype([("entry", "u1"), ("at_u", "u1"), ("at_l", "u1"), ("u", "<f4"), ("l", "<f4")])


@dataclass
class Codebooks:
    """Entries of every round, oldest first: (parts, entries, width) whole numbers each.

    ``scans`` counts the parts whose entries were all scanned in each pass."""

    rounds: list[np.ndarray]
    scans: list[int] = field(default_factory=list)

    @property
    def entries(self) -> np.ndarray:
        return self.rounds[-1]

    def sha256(self) -> str:
        """Of the components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()
                              ).hexdigest()


def largest(width: int) -> int:
    """Components below this size cannot overflow the squared distance of whole vectors."""
    return math.isqrt((1 << 61) // max(width, 1))


def whole_numbers(values: np.ndarray, width: int) -> np.ndarray:
    """Components of vectors, one after the other, as rows of whole numbers."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= largest(width):
        raise ValueError(f"components of {largest(width) // SCALE} or more in size: their squared "
                         "distances do not fit 64 bits")
    return scaled.astype(np.int64).reshape(-1, width)


def _up(x):
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x):
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """What is known of the entries of one part position before a pass."""

    def __init__(self, history: list[np.ndarray]):
        past = np.stack(history).astype(np.float64)  # (rounds, entries, width)
        now = past[-1]
        self.entries, self.round = history[-1], len(history) - 1
        moved = np.sqrt(((now - past) ** 2).sum(-1)) * (1 + SLACK)
        self.moved = moved
        alone = np.eye(len(now), dtype=bool)
        self.others = np.where(alone, 0.0, moved[:, None, :]).max(-1)  # the most, without own
        apart = np.sqrt(((now[:, None] - now[None]) ** 2).sum(-1))
        self.half = np.where(alone, np.inf, apart).min(-1) / 2 * (1 - SLACK)

    def assign(self, rows: np.ndarray, state: np.ndarray, first: bool) -> int:
        """Sets entry, bounds and their rounds in ``state``; number of rows scanned in full."""
        todo = np.arange(len(rows))
        if not first:
            own, now = state["entry"], self.round
            upper = state["u"] + self.moved[state["at_u"], own]
            lower = np.maximum(state["l"] - self.others[state["at_l"], own], self.half[own])
            todo = np.flatnonzero(~(upper < lower))
            exact = ((rows[todo] - self.entries[own[todo]]) ** 2).sum(-1)
            state["u"][todo], state["at_u"][todo] = _up(np.sqrt(exact.astype(np.float64))), now
            todo = todo[~(state["u"][todo] < lower[todo])]
        if len(todo):
            near = ((rows[todo, None] - self.entries[None]) ** 2).sum(-1)
            entry = near.argmin(-1)  # the first of equals
            at = np.arange(len(todo))
            least = near[at, entry]
            near[at, entry] = np.iinfo(np.int64).max
            rest = near.min(-1).astype(np.float64) if near.shape[1] > 1 else np.full(
                len(todo), np.inf)
            state["entry"][todo] = entry
            state["u"][todo] = _up(np.sqrt(least.astype(np.float64)))
            state["l"][todo] = _down(np.sqrt(rest))
            state["at_u"][todo] = state["at_l"][todo] = self.round
        return len(todo)


def _sums(rows: np.ndarray, entry: np.ndarray, count: int) -> np.ndarray:
    """(entries, width + 1): sums of the rows of each entry and their number; exact, for a chunk's
    sums are far below 2**53."""
    out = [np.bincount(entry, rows[:, k], count) for k in range(rows.shape[1])]
    return np.stack([*out, np.bincount(entry, minlength=count)], axis=1).astype(np.int64)


def _pass(rounds: list[np.ndarray], first: bool, last: bool):
    """Function of Arrow batches (id, label, vector or numbers, state) for one pass.

    It gives rows with new bounds (the last pass: code and error) and, per task, one row of the
    changes of all sums followed by the number of scans."""
    parts, count, size = rounds[0].shape
    width = parts * size

    def run(batches):
        bounds = [Bounds([r[p] for r in rounds]) for p in range(parts)]
        change, scans, kinds = np.zeros((parts, count, size + 1), np.int64), 0, ()
        for batch in batches:
            kinds = batch.schema.types[:2]
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                n = part.num_rows
                if first:
                    rows = whole_numbers(part.column(2).flatten().to_numpy(
                        zero_copy_only=False), width)
                    state = np.zeros((n, parts), STATE)
                else:
                    rows, state = (np.frombuffer(b"".join(part.column(k).to_pylist()), kind)
                                   for k, kind in ((2, "<i4"), (3, STATE)))
                    rows = rows.astype(np.int64).reshape(n, width)
                    state = state.reshape(n, parts).copy()
                cut = rows.reshape(n, parts, size)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    before = state["entry"][:, p].copy()
                    own = np.ascontiguousarray(state[:, p])
                    scans += bounds[p].assign(cut[:, p], own, first)
                    state[:, p] = own
                    entry = own["entry"]
                    if last:
                        error += ((cut[:, p] - bounds[p].entries[entry]) ** 2).sum(-1)
                        continue
                    new = np.arange(n) if first else np.flatnonzero(before != entry)
                    change[p] += _sums(cut[new, p], entry[new], count)
                    if not first:
                        change[p] -= _sums(cut[new, p], before[new], count)
                if last:
                    codes = [bytes(r).hex() for r in state["entry"]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(codes, pa.string()),
                         pa.array(error), pa.nulls(n, pa.list_(pa.int64()))],
                        ["_id", "_label", "code", "error", "_sums"])
                else:
                    numbers = rows.astype("<i4").tobytes()
                    kept = state.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1),
                         *(pa.array([data[i:i + one] for i in range(0, n * one, one)], pa.binary())
                           for data, one in ((numbers, 4 * width), (kept, STATE.itemsize * parts))),
                         pa.nulls(n, pa.list_(pa.int64()))],
                        ["_id", "_label", "_numbers", "_state", "_sums"])
        if not kinds:
            return  # a task without rows
        tail = pa.array([[*change.ravel().tolist(), scans]], pa.list_(pa.int64()))
        empty = [pa.nulls(1, pa.string() if last else pa.binary()),
                 pa.nulls(1, pa.int64() if last else pa.binary())]
        names = ["code", "error"] if last else ["_numbers", "_state"]
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(1, kind) for kind in kinds), *empty, tail],
            ["_id", "_label", *names, "_sums"])
    return run


def _totals(written: DataFrame) -> np.ndarray:
    """Sums over all tasks of their rows of sums, position by position."""
    found = written.where(F.col("_sums").isNotNull()).select(F.posexplode("_sums")).groupBy(
        "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    out = np.zeros(len(found), object)
    for r in found:
        out[r["pos"]] = int(r["s"])
    return out


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
               label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
               rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(rows of ``key``, ``label``, code and error, the codebooks).

    Rows whose vector is NULL, empty, or holds NULL or non-finite components are dropped, and so
    are vectors of another length than that of the first kept key.  Start entries are the rows of
    the smallest keys, repeated keys by their vectors, NULL keys last; a table of fewer rows has
    fewer entries.  Repeated rows count as often as they are there.  Without rows there are no
    codebooks and the result is empty.  Other columns play no role, whatever their names.
    Lengths that ``parts`` does not divide, and components too large for 64-bit distances
    (``largest``), raise an error.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good).select(
        F.col(f"`{key}`").alias("_id"), F.col(f"`{label}`").alias("_label"), v.alias("_vector"))
    order = [F.col("_id").asc_nulls_last(), "_vector"]
    head = rows.orderBy(*order).limit(1).collect()
    kinds = rows.select("_id", "_label").schema
    if not head:
        return rows.select(F.col("_id").alias(key), F.col("_label").alias(label),
                           F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = len(head[0]["_vector"])
    if width % parts:
        raise ValueError(f"vectors of length {width} cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("_vector") == width)
    start = whole_numbers(np.array([r["_vector"] for r in rows.orderBy(*order).limit(
        entries).collect()], float).ravel(), width)
    books = Codebooks([np.ascontiguousarray(
        start.reshape(len(start), parts, width // parts).swapaxes(0, 1))])
    id_kind, label_kind = (f.dataType for f in kinds)

    def done(run, source, last):
        named = "code string, error long" if last else "_numbers binary, _state binary"
        schema = f"_id {id_kind.simpleString()}, _label {label_kind.simpleString()}, {named}, " \
                 "_sums array<long>"
        return source.mapInArrow(run, schema)

    total = np.zeros(books.entries.shape[:2] + (width // parts + 1,), object)
    now, folder = rows, None
    for step in range(rounds):
        made = own_folder(spark, "codes")
        found = done(_pass(books.rounds, step == 0, False), now, False)
        found.write.parquet(made)
        written = spark.read.schema(found.schema).parquet(made)
        if folder:
            discard(spark, folder)
        now, folder = written.where(F.col("_sums").isNull()).select(
            "_id", "_label", "_numbers", "_state"), made
        change = _totals(written)
        books.scans.append(change[-1])
        total = total + change[:-1].reshape(total.shape)
        count = total[..., -1:]
        mean = total[..., :-1] // np.maximum(count, 1)
        new = np.where(count > 0, mean, books.entries).astype(np.int64)
        same = np.array_equal(new, books.entries)
        books.rounds.append(new)
        if same:
            break  # no later round can change anything
    coded = park(done(_pass(books.rounds, not folder, True), now, True), "codes")
    if folder:
        discard(spark, folder)
    books.scans.append(_totals(coded)[-1])
    return coded.where(F.col("_sums").isNull()).select(
        F.col("_id").alias(key), F.col("_label").alias(label), "code", "error"), books


def with_label_errors(coded: DataFrame, label: str = "label", error: str = "error",
                      hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS
                      ) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over the rows of an equal label, NULLs together.

    The sums of a counted, small number of labels are broadcast.  Beyond that only the labels of
    many rows are, of which there are few; the rows of all others are shuffled by label.
    """
    sums = park(coded.groupBy(F.col(label).alias("_l")).agg(
        F.sum(error).alias("label_error"), F.count("*").alias("_n")), "label-errors")
    match = F.col(label).eqNullSafe(F.col("_l"))
    columns = [*coded.columns, "label_error"]
    if sums.count() <= broadcast_rows:
        return coded.join(F.broadcast(sums), match).select(columns)
    often = F.broadcast(sums.where(F.col("_n") > hot_rows))
    cold = coded.join(often, match, "left_anti").join(
        sums.where(F.col("_n") <= hot_rows), match)
    return coded.join(often, match).select(columns).unionByName(cold.select(columns))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by plain scans of all entries in every round."""
    def scan(k):
        return f"""d{k} AS MATERIALIZED (SELECT id, x.p, min(d) % {entries} AS e, min(d) // {entries}
 AS d FROM (SELECT id, x.p, e, sum((x - c) * (x - c)) * {entries} + e AS d FROM x JOIN c{k} USING
 (p, i) GROUP BY id, x.p, e) x GROUP BY id, x.p)"""

    def update(k):
        return f"""c{k + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(m, c) AS c FROM c{k} LEFT JOIN
 (SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM x JOIN d{k} USING (id, p)
 GROUP BY p, e, i) USING (p, e, i))"""
    steps = [s for k in range(rounds) for s in (scan(k), update(k))]
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id,
 embedding) AS id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE))
 AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding,
 lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 w AS (SELECT len(v) // {parts} AS w FROM kept WHERE id = 1),
 x AS MATERIALIZED (SELECT id, k // w AS p, k % w AS i, v[k + 1] AS x FROM (SELECT id, v,
 unnest(range(len(v))) AS k FROM kept), w),
 c0 AS MATERIALIZED (SELECT p, id - 1 AS e, i, x AS c FROM x WHERE id <= {entries}),
 {", ".join(steps)}, {scan(rounds)},
 h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM c{rounds}),
 r AS (SELECT id, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code,
 CAST(sum(d) AS BIGINT) AS error FROM d{rounds} GROUP BY id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 h AS codebooks_sha256 FROM kept JOIN r USING (id), h"""


@query("op12_vector_codes", _sql())
def op12_vector_codes(spark, sf_dir):
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error",
        F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
