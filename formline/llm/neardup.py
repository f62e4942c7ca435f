"""Near-duplicate documents by DartMinHash signatures, bands and exact verification.

A document is the multiset of its shingles of ``SHINGLE`` consecutive words (a shorter document
is one shingle); a shingle's weight is its number of occurrences.  Two documents are linked if
their weighted Jaccard similarity, sum of minima by sum of maxima, is at least 0.8.  A class is
a connected component of links.

*Darts.*  Every element owns a strip (weight, rank).  The weights are cut into regions that
double in width, and every region into cells of area one, whose darts are drawn from a hash of
(element, region, cell): a Poisson number of them, each with a place and a coordinate 0..K-1.
A dart counts for a document if it hits below the element's weight; of those of a coordinate
the one of the smallest rank is kept.  Only ranks below a bound of about K ln K darts per
document are looked at; a document with an empty coordinate is drawn again with twice the bound.

*Bands.*  ``BANDS`` bands of ``ROWS`` coordinates: two documents of similarity 0.8 share a band
with probability above 0.9998.

*Links.*  Documents with equal word sequences are one text.  A band's bucket links its members
to its hub, the member with the fullest buckets.  Where members of a bucket are then still in
different classes, they are compared with each other across the classes, each pair in the first
small bucket it shares.  Pairs of hubs and of small buckets whose signatures, cut to a byte a
coordinate, agree so little that a similarity of 0.8 has odds below 1 : 10**6 are dropped; all
others are verified on the whole texts.

*Crowds.*  In a bucket of more than ``SMALL`` members all that are outside its most frequent class
meet all members, block by block: matrix products over the shingles give the exact similarity of
every pair, and a block pair sends on, per member, its smallest relative in the block pair, never
the links themselves.  The work grows with the members times those outside that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm import ragged
from formline.llm.components import components
from formline.llm.registry import query, table
from formline.session import park

SHINGLE = 5
BANDS, ROWS = 28, 6
K = BANDS * ROWS
#: Least share of equal signature bytes; at similarity 0.8 it is missed by 4.8 deviations.
AGREE = 0.65
#: Buckets up to this size compare their members by a join, larger ones by blocks.
SMALL = 64
#: Members and shingles of a block, and columns of one dense product.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1000, 1 << 18, 2048
_U = np.uint64
_ODD = ragged.mix(np.arange(11, 11 + SHINGLE, dtype=_U)) | _U(1)
_POISSON = np.cumsum([1 / np.e / np.prod(range(1, n + 1), initial=1.0) for n in range(20)])


def shingles(offsets: np.ndarray, data: np.ndarray):
    """(row, shingle, occurrences) without repeats, words per row, and two row digests."""
    hashes, row, _, _ = ragged.words(offsets, data)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    begin = np.cumsum(n) - n
    place = np.arange(len(row)) - begin[row]
    digest = [_row_sums(ragged.mix(hashes + ragged.mix(place.astype(_U) + _U(salt))), begin, n)
              for salt in (3, 1 << 40)]
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    at = ragged.ranges(begin, count)
    owner = np.repeat(np.arange(rows), count)
    value = np.zeros(len(at), dtype=_U)
    for k in range(SHINGLE):
        inside = k < n[owner]
        value += np.where(inside, hashes[np.minimum(at + k, len(hashes) - 1)] * _ODD[k], _U(k))
    value = ragged.mix(value)
    _, first, times = np.unique(value ^ ragged.mix(owner.astype(_U)), return_index=True,
                                return_counts=True)
    return owner[first], value[first], times, n, digest


def _row_sums(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values, out=total[1:])
    return ragged.mix(total[begin + n] - total[begin])


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int,
               k: int = K) -> np.ndarray:
    """(rows, k) smallest ranks; infinite for rows without elements."""
    out = np.full(rows * k, np.inf)
    total = np.bincount(owner, weight, rows)
    todo = np.flatnonzero(total > 0)
    bound = np.zeros(rows)
    bound[todo] = k * (np.log(k) + 4) / total[todo]
    while len(todo):
        chosen = np.zeros(rows, dtype=bool)
        chosen[todo] = True
        own = np.flatnonzero(chosen[owner])
        region = 0
        while len(own):
            _throw(out, owner[own], element[own], weight[own], bound, region, k)
            region += 1
            own = own[weight[own] > 2 ** region - 1]
        empty = np.isinf(out.reshape(rows, k)).any(axis=1)
        todo = todo[empty[todo]]
        bound[todo] *= 2
    return out.reshape(rows, k)


def _throw(out, owner, element, weight, bound, region, k):
    """Darts of one weight region, [2^r - 1, 2^(r+1) - 1), into the smallest ranks ``out``."""
    height = 2.0 ** -region
    cells = np.ceil(bound[owner] / height).astype(np.int64)
    for part in np.array_split(np.arange(len(owner)), max(1, int(cells.sum()) >> 20)):
        own = np.repeat(part, cells[part])
        cell = np.arange(len(own)) - np.repeat(np.cumsum(cells[part]) - cells[part], cells[part])
        seed = ragged.mix(element[own] + ragged.mix(cell.astype(_U) * _U(64) + _U(region)))
        darts = np.searchsorted(_POISSON, _uniform(seed), "right")
        hit = np.repeat(np.arange(len(own)), darts)
        order = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
        seed = ragged.mix(seed[hit] + (order.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        rank = (cell[hit] + _uniform(seed)) * height
        source = own[hit]
        keep = rank < bound[owner[source]]
        seed = ragged.mix(seed + _U(7))
        if region:
            depth = 2.0 ** region * (1 + _uniform(seed)) - 1
            keep &= depth < weight[source]
        seed = ragged.mix(seed[keep] + _U(13))
        coordinate = ((seed >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
        np.minimum.at(out, owner[source[keep]] * k + coordinate, rank[keep])


def band_keys(ranks: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(rows, bands) hash of the coordinates of every band."""
    bits = ranks.view(_U).reshape(len(ranks), bands, -1)
    key = np.zeros(bits.shape[:2], dtype=_U)
    for j in range(bits.shape[2]):
        key = ragged.mix(key + bits[:, :, j])
    return key


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n shingles, d1, d2 digest of the word sequence, bands array<long>, mini binary).

    ``mini`` is the signature with a byte of every coordinate.
    """
    def sketch(batches):
        for batch in batches:
            for first, offsets, data in ragged.text_chunks(batch.column(1)):
                rows = len(offsets) - 1
                owner, element, weight, n, digest = shingles(offsets, data)
                ranks = signatures(owner, element, weight, rows)
                keys = band_keys(ranks)
                small = ragged.mix(ranks.view(_U)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows),
                     ragged.as_long(np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)),
                     *map(ragged.as_long, digest),
                     ragged.list_array(ragged.as_long(keys.reshape(-1)), np.full(rows, BANDS)),
                     pa.array([x.tobytes() for x in small], pa.binary())],
                    ["id", "n", "d1", "d2", "bands", "mini"])
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"),
                       F.col(f"`{text}`").alias("text")).mapInArrow(
        sketch, "id long, n long, d1 long, d2 long, bands array<long>, mini binary")


def _similar(batches):
    """Pairs (a, b, text of a, text of b) of similarity 0.8 or more, in whole numbers."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        at = 0
        while at < batch.num_rows:
            # As many pairs at once as fit into a chunk.
            size, stop = 0, at
            while stop < batch.num_rows and (stop == at or size < ragged.CHUNK_BYTES):
                size += len(left[stop].as_buffer()) + len(right[stop].as_buffer())
                stop += 1
            both = pa.concat_arrays([left.slice(at, stop - at), right.slice(at, stop - at)])
            (_, offsets, data), = ragged.text_chunks(both, 1 << 62)
            owner, element, weight, n, _ = shingles(offsets, data)
            pairs = stop - at
            value = element ^ ragged.mix((owner % pairs).astype(_U))
            order = np.argsort(value, kind="stable")
            same = np.flatnonzero(value[order[1:]] == value[order[:-1]])
            one, two = order[same], order[same + 1]
            common = np.bincount(owner[one] % pairs, np.minimum(weight[one], weight[two]), pairs)
            total = np.bincount(owner % pairs, weight, pairs)
            good = pa.array(9 * common >= 4 * total)
            yield pa.RecordBatch.from_arrays(
                [c.slice(at, pairs).filter(good) for c in batch.columns[:2]], ["a", "b"])
            at = stop


def _agreeing(batches):
    """Pairs (a, b, ma, mb) whose signature bytes agree often enough."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, K)
                        for c in batch.columns[2:])
            good = pa.array((one == two).mean(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]],
                                             ["a", "b"])


def plausible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out; ``texts`` has id and mini."""
    one = texts.select(F.col("id").alias("a"), F.col("mini").alias("ma"))
    two = texts.select(F.col("id").alias("b"), F.col("mini").alias("mb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ma", "mb").mapInArrow(
        _agreeing, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar; ``texts`` has id and text.

    Only texts of some pair are moved on from the first join; neither side is ever broadcast.
    """
    pairs = park(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(
        pairs.select(F.col("b").alias("id"))).distinct()
    texts = park(texts.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]),
                 "pair-texts")
    with_both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a"
                           ).join(texts.select(F.col("id").alias("b"),
                                               F.col("text").alias("tb")), "b")
    return with_both.select("a", "b", "ta", "tb").mapInArrow(_similar, "a long, b long")


def _fits(a: str, b: str):
    """Sizes that allow a similarity of 0.8: 9 min(n) >= 4 (n + n')."""
    return 9 * F.least(a, b) >= 4 * (F.col(a) + F.col(b))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id) of every row; the class id is the smallest id of the class.

    Documents without words (NULL, empty, punctuation) are in no class but their own; a NULL
    id gets the class of its copies, or NULL.  Repeated rows stay and share a class.  Empty
    tables give no rows.  Other columns are not read.
    """
    sketch = park(sketches(docs, key, text), "sketches")
    texts = sketch.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("d1", "d2").agg(
        F.min(F.struct("id", "n", "bands", "mini")).alias("s")).select("d1", "d2", "s.*")
    texts = park(texts, "texts")
    rows = texts.select("id", "n", F.posexplode("bands").alias("band", "value"))
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = rows.join(sizes, ["band", "value"])
    fullness = members.groupBy("id").agg(F.sum("size").alias("full"))
    members = park(members.join(fullness, "id"), "members")
    hubs = members.groupBy("band", "value").agg(
        F.max(F.struct("full", (-F.col("id")).alias("minus"), "n")).alias("h")).select(
        "band", "value", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    body = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    body = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    wanted = members.join(hubs, ["band", "value"]).where(
        (F.col("id") != F.col("hub")) & _fits("n", "hub_n")).select(
        F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    first = park(verified(plausible(wanted, texts), body), "links-hub")
    near = park(components(first), "near")
    second = park(verified(plausible(_across(members, near, texts), texts), body), "links-across")
    crowded = park(_crowd_links(members, near, body), "links-crowds")
    near = components(second.unionByName(crowded).unionByName(
        near.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    found = texts.select("d1", "d2", "id").join(near, "id", "left").select(
        "d1", "d2", F.coalesce("component", "id").alias("component"))
    return sketch.withColumn("d1", F.when(F.col("n") > 0, F.col("d1"))).join(
        found, ["d1", "d2"], "left").select(
        "id", F.coalesce("component", "id").alias("class_id"))


def _unsettled(members: DataFrame, near: DataFrame) -> DataFrame:
    """Members, with class and bucket size, of the buckets that hold several classes so far."""
    placed = members.select("id", "n", "band", "value").join(near, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    mixed = placed.groupBy("band", "value").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.count("*").alias("size")).where("lo < hi")
    return placed.join(mixed.select("band", "value", "size"), ["band", "value"])


def _across(members: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of one small bucket that are in different classes so far, each pair once."""
    small = _unsettled(members, near).where(F.col("size") <= SMALL)
    # A pair meets in the first of the bands whose bucket is a small one; the others are NULL.
    open_bands = small.groupBy("id").agg(F.collect_set("band").alias("open"))
    all_bands = texts.join(open_bands, "id").select("id", F.transform(
        "bands", lambda x, k: F.when(F.array_contains("open", k), F.shiftright(x, 32).cast("int"))
    ).alias("all"))
    small = park(small.join(all_bands, "id"), "open")
    other = small.select("band", "value", F.col("id").alias("b"), F.col("n").alias("m"),
                         F.col("component").alias("c"), F.col("all").alias("all2"))
    shared = F.array_position(F.zip_with("all", "all2", lambda x, y: x == y), True)
    different = (F.col("component") != F.col("c")) & _fits("n", "m")
    return small.join(other, ["band", "value"]).where(
        (F.col("id") < F.col("b")) & different & (shared == F.col("band") + 1)).select(
        F.col("id").alias("a"), "b").distinct()


def _crowd_links(members: DataFrame, near: DataFrame, body: DataFrame) -> DataFrame:
    """(a, b) that joins what is linked across the classes of the buckets that are not small.

    Residents are the members outside a bucket's most frequent class, visitors all members;
    every block of residents meets every block of visitors.  ``body`` has id and text.
    """
    where = ["band", "value"]
    large = park(_unsettled(members, near).where(F.col("size") > SMALL), "crowds")
    crowds = large.groupBy(*where, "component").agg(
        F.count("*").alias("c"), F.sum("n").alias("s")).groupBy(*where).agg(
        F.max(F.struct("c", "component", "s")).alias("most"), F.sum("c").alias("c"),
        F.sum("s").alias("s"))

    def blocks(rows, size):
        return F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_SHINGLES)).cast("int")
    crowds = crowds.select(
        *where, F.col("most.component").alias("main"),
        blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("n_res"),
        blocks(F.col("c"), F.col("s")).alias("n_vis"))
    texts = park(body.join(large.select("id").distinct().hint("merge"), "id", "left_semi"
                           ).dropDuplicates(["id"]), "crowd-texts")
    rows = large.join(crowds, where)

    def spread(side, own, other, mine, theirs):
        """Every row goes to its block and meets all blocks of the other side."""
        return side.withColumn(own, F.pmod(F.xxhash64("id", F.lit(5)), F.col(mine)).cast("int")
                               ).withColumn(other, F.explode(F.sequence(
                                   F.lit(0), F.col(theirs) - 1)))
    names = ["id", "component", *where, "i", "j"]
    both = spread(rows.where("component != main"), "i", "j", "n_res", "n_vis").select(
        *names, F.lit(True).alias("resident")).unionByName(
        spread(rows, "j", "i", "n_vis", "n_res").select(
            *names, F.lit(False).alias("resident")))
    return both.join(texts, "id").groupBy(*where, "i", "j").applyInArrow(
        _meet, "a long, b long")


def _common(a, b, rows_a: int, rows_b: int) -> np.ndarray:
    """Sums of minima of the (owner, element, weight) of two sides, (rows_a, rows_b)."""
    shared = np.intersect1d(a[1], b[1])
    sides, most = [], []
    for owner, element, weight in (a, b):
        at = np.minimum(np.searchsorted(shared, element), max(len(shared) - 1, 0))
        kept = np.flatnonzero(shared[at] == element) if len(shared) else np.zeros(0, np.int64)
        sides.append((owner[kept], at[kept], weight[kept]))
        top = np.zeros(len(shared), np.int64)
        np.maximum.at(top, at[kept], weight[kept])
        most.append(top)
    # An element of weight w is a one in each of its first w columns.
    width = np.minimum(*most)
    begin = np.cumsum(width) - width
    ones = []
    for owner, at, weight in sides:
        times = np.minimum(weight, width[at])
        column = ragged.ranges(begin[at], times)
        order = np.argsort(column, kind="stable")
        ones.append((np.repeat(owner, times)[order], column[order]))
    out = np.zeros((rows_a, rows_b))
    for lo in range(0, int(width.sum()), COLUMNS):
        dense = []
        for rows, (owner, column) in zip((rows_a, rows_b), ones, strict=True):
            part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
            dense.append(np.zeros((rows, COLUMNS), np.float32))
            dense[-1][owner[part], column[part] - lo] = 1
        out += dense[0] @ dense[1].T
    return out


def _meet(group: pa.Table) -> pa.Table:
    """Links across classes between the residents and the visitors of one block pair."""
    flag = group["resident"].to_numpy()
    if flag.all() or not flag.any():
        return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
    ids, component = (group[c].to_numpy() for c in ("id", "component"))
    sides, totals, names, classes_ = [], [], [], []
    for own in (np.flatnonzero(flag), np.flatnonzero(~flag)):
        text = group["text"].take(pa.array(own)).combine_chunks()
        parts = []
        for first, offsets, data in ragged.text_chunks(text):
            owner, element, weight, _, _ = shingles(offsets, data)
            parts.append((owner + first, element, weight))
        sides.append([np.concatenate(x) for x in zip(*parts, strict=True)])
        totals.append(np.bincount(sides[-1][0], sides[-1][2], len(own)))
        names.append(ids[own])
        classes_.append(component[own])
    common = _common(*sides, *map(len, totals))
    linked = 9 * common >= 4 * (totals[0][:, None] + totals[1])
    linked &= classes_[0][:, None] != classes_[1]
    some = linked.any(axis=1), linked.any(axis=0)
    linked = linked[some[0]][:, some[1]]
    names = [x[s] for x, s in zip(names, some, strict=True)]
    # Roots are kept per side; a member of both sides is joined by its id later.
    root = [x.copy() for x in names]
    none = np.iinfo(np.int64).max
    while linked.size:
        up = np.minimum(root[0], np.where(linked, root[1], none).min(axis=1))
        down = np.minimum(root[1], np.where(linked, up[:, None], none).min(axis=0))
        if (up == root[0]).all() and (down == root[1]).all():
            break
        root = [up, down]
    return pa.table([pa.array(np.concatenate(x)) for x in (names, root)], ["a", "b"])


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark, sf_dir):
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id",
                        (F.col("id") == F.col("class_id")).alias("kept"))
