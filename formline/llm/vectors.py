"""Near-duplicate embeddings: spherical k-means cells, blocked cosines, one kept per group.

Vectors of one label link if their cosine is at least 0.93.  Equal vectors of a label are one
class with a multiplicity.  Spherical k-means (fitted on at most ``SAMPLE`` vectors) gives every
class a home cell, the one of the nearest centre; a class also visits every cell whose border
with its home is so near that a linked class may lie behind it.  Of two linked classes at a
distance of at most d = sqrt(2 - 2 * 0.93) with homes p and q, one lies within d / 2 of the plane
between the centres of p and q, so it visits the other's home: no link is lost.

Within a cell and label, blocks of residents meet blocks of visitors in dense products.  A block
pair sends on, per class, the number of its links and its smallest relative in the block pair,
never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.components import components
from formline.llm.registry import query, table
from formline.llm.samples import hash_limit
from formline.session import park

LEAST = 0.93
SAMPLE, CELL_ROWS, MOST_CELLS, LOOPS = 20_000, 2000, 1024, 8
BLOCK_ROWS = 1000


def usable(vector: str = "embedding", label: str = "label"):
    """Whether a vector can link at all: label, components and length are there and finite."""
    v = F.col(f"`{vector}`")
    return (F.col(f"`{label}`").isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
            & F.exists(v, lambda x: x != 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so nothing over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, count: int, loops: int = LOOPS, seed: int = 5) -> np.ndarray:
    """Centres of length one by spherical k-means."""
    rng = np.random.default_rng(seed)
    rows = unit(sample)
    centres = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)]
    for _ in range(loops):
        near = np.concatenate([(part @ centres.T).argmax(axis=1)
                               for part in np.array_split(rows, -(-len(rows) // 4096))])
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        size = np.linalg.norm(total, axis=1)
        full = size > 1e-12
        centres[full] = total[full] / size[full, None]
    return np.unique(centres, axis=0)


def visits(rows: np.ndarray, centres: np.ndarray, least: float = LEAST
           ) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, row by cell flags of the cells to visit, the home among them)."""
    near = rows @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    gap = near[np.arange(len(rows)), home][:, None] - near
    half = np.sqrt(2 - 2 * least) / 2 + 1e-9
    return home, gap <= half * apart[home] + 1e-9


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
            label: str = "label") -> DataFrame:
    """(id, label, v, m): distinct usable vectors of a label, smallest id and number of ids."""
    # Negative zero is zero.
    good = vectors.where(usable(vector, label) & F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
        F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + 0.0).alias("v"))
    return good.groupBy("label", "v", "id").agg(F.lit(1).alias("one")).groupBy(
        "label", "v").agg(F.min("id").alias("id"), F.count("*").alias("m"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _centres(found: DataFrame) -> np.ndarray | None:
    """Centres for the vectors of the most frequent length."""
    sizes = found.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "d").first()
    if sizes is None:
        return None
    low = hash_limit(SAMPLE, sizes["n"])
    rows = found.where((F.size("v") == sizes["d"]) & (F.xxhash64("id") <= F.lit(low))).select(
        "id", "v").toLocalIterator()
    sample = np.array([r["v"] for r in sorted(rows, key=lambda r: r["id"])[:2 * SAMPLE]])
    count = max(1, min(MOST_CELLS, sizes["n"] // CELL_ROWS))
    return fit_centres(sample, count) if len(sample) else None


def _assigned(found: DataFrame, centres) -> DataFrame:
    """``found`` with home (int) and cells (array of the cells to visit)."""
    def assign(batches):
        c = centres.value
        for batch in batches:
            v = batch.column(2)
            size = np.diff(np.asarray(v.offsets))
            fits = size == (c.shape[1] if c is not None else -1)
            home = np.zeros(len(v), np.int32)
            lists = [[0]] * len(v)
            rows = np.flatnonzero(fits)
            for part in np.array_split(rows, max(1, -(-len(rows) // 2048))):
                if not len(part):
                    continue
                home[part], flags = visits(unit(_matrix(v.take(pa.array(part)))), c)
                for r, f in zip(part.tolist(), flags, strict=True):
                    lists[r] = np.flatnonzero(f).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home), pa.array(lists, pa.list_(pa.int32()))],
                [*batch.schema.names, "home", "cells"])
    schema = found.select("id", "label", "v", "m", F.lit(0).alias("home"),
                          F.array(F.lit(0)).alias("cells")).schema
    for item in schema:
        item.nullable = True
    return found.select("id", "label", "v", "m").mapInArrow(assign, schema)


def _meet(group: pa.Table) -> pa.Table:
    """Links between the residents and the visitors of one block pair."""
    flag = group["resident"].to_numpy()
    v = unit(_matrix(group["v"]))
    ids, m, home = (group[c].to_numpy() for c in ("id", "m", "home"))
    a, b = np.flatnonzero(flag), np.flatnonzero(~flag)
    cell = group["cell"][0].as_py()
    linked = (v[a] @ v[b].T >= LEAST) & (ids[a][:, None] != ids[b][None])
    if not linked.any():
        return OUT.empty_table()
    total = np.zeros(len(ids), np.int64)
    total[a] += linked @ m[b]
    # A visitor counts here what it will not count at home: residents that never go there.
    foreign = home[b] != cell
    if foreign.any():
        cells = group["cells"].combine_chunks().take(pa.array(a))
        size = np.diff(np.asarray(cells.offsets))
        goes = np.zeros((len(a), int(max(home.max(), cells.flatten().to_numpy().max())) + 1),
                        dtype=bool)
        goes[np.repeat(np.arange(len(a)), size), cells.flatten().to_numpy()] = True
        only_here = linked & ~goes[:, home[b]] & foreign[None]
        total[b] += m[a] @ only_here
    root = ids.copy()
    while True:
        up = np.where(linked, root[b][None], np.iinfo(np.int64).max).min(axis=1)
        new_a = np.minimum(root[a], up)
        down = np.where(linked, new_a[:, None], np.iinfo(np.int64).max).min(axis=0)
        new_b = np.minimum(root[b], down)
        if (new_a == root[a]).all() and (new_b == root[b]).all():
            break
        root[a], root[b] = new_a, new_b
    some = np.flatnonzero((total > 0) | (root != ids))
    return pa.table([pa.array(ids[some]), pa.array(total[some]), pa.array(root[some])],
                    schema=OUT)


OUT = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _block_links(placed: DataFrame, block_rows: int) -> DataFrame:
    """(id, links, root) parts from all block pairs."""
    dim = F.size("v").alias("dim")
    residents = placed.select("*", dim, F.col("home").alias("cell"))
    visitors = placed.select("*", dim, F.explode("cells").alias("cell"))
    where = ["label", "dim", "cell"]

    def blocks(rows, name):
        return rows.groupBy(*where).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    counts = blocks(residents, "n_res").join(blocks(visitors, "n_vis"), where)

    def spread(rows, own, other, mine, theirs):
        """Every row goes to its block and meets all blocks of the other side."""
        return rows.join(counts, where).withColumn(
            own, F.pmod(F.xxhash64("id", F.lit(3)), F.col(mine)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
    names = ["id", "v", "m", "home", "cells", *where, "i", "j"]
    both = spread(residents, "i", "j", "n_res", "n_vis").select(
        *names, F.lit(True).alias("resident")).unionByName(
        spread(visitors, "j", "i", "n_vis", "n_res").select(
            *names, F.lit(False).alias("resident")))
    return both.groupBy(*where, "i", "j").applyInArrow(_meet, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors that are NULL, zero, or hold NULL or non-finite components, and rows without label
    or id, link with nothing.  Vectors of different lengths never link.  Repeated rows of one id
    are one vector, and all rows stay.  An empty table gives no rows.  Other columns are not
    read.
    """
    spark = vectors.sparkSession
    found = park(classes(vectors, key, vector, label), "vector-classes")
    centres = spark.sparkContext.broadcast(_centres(found))
    placed = park(_assigned(found, centres), "vector-cells")
    parts = park(_block_links(placed, block_rows), "vector-links")
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = found.join(links, "id", "left").join(groups, "id", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    good = usable(vector, label) & F.col(f"`{key}`").isNotNull()
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.when(good, F.col(f"`{label}`")).alias("label"),
        F.when(good, F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + 0.0)
               ).alias("v"))
    return rows.join(of_class, ["label", "v"], "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
