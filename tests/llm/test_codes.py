"""Vector codes against plain scans of all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _id string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes by exact scans in Python's whole numbers."""
    kept = sorted((r for r in rows if r[1] and all(
        x is not None and math.isfinite(x) for x in r[1])),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    w = len(whole[0]) // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e)
                   for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True))
                        if e in groups else c for e, c in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()
                         ).hexdigest()
    out = [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f))
           for r, f in zip(kept, found, strict=True)]
    label = {}
    for r, o in zip(kept, out, strict=True):
        label[r[2]] = label.get(r[2], 0) + o[2]
    return sorted((*o, label[r[2]]) for r, o in zip(kept, out, strict=True)), sha


def result(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    coded, books = codes.compressed(df)
    full = codes.with_label_errors(coded, **options)
    return sorted((r.vec_id, r.code, r.error, r.label_error) for r in full.collect()), books


def clustered(n, seed, width=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (20, width))
    return [(i, (centre[rng.integers(20)] + rng.normal(0, 0.1, width)).astype(np.float32)
             .tolist(), int(rng.integers(4)) if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0, "hot_rows": 50}])
def test_codes_equal_plain_scans(spark, options):
    rows = clustered(400, 3)
    found, books = result(spark, rows, **options)
    expected, sha = plain(rows)
    assert found == expected and books.sha256() == sha
    # Bounds spare scans: all parts in the first pass, fewer in all later ones.
    assert books.scans[0] == 400 * 8 and max(books.scans[1:]) < 400 * 8 // 2


def test_ties_repeated_rows_and_odd_vectors(spark):
    rng = random.Random(4)
    # Few values, so distances tie everywhere; many rows are equal.
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(8)], rng.choice([None, 1, 2]))
            for i in range(120)]
    rows += rows[:30]
    rows += [(0, [9.0] * 8, 1), (500, None, 1), (501, [], 1), (502, [1.0, None] * 4, 1),
             (503, [float("nan")] * 8, 1), (504, [float("inf")] + [0.0] * 7, 2),
             (505, [1.0] * 16, 1), (506, [-0.00001] * 8, 2)]
    found, books = result(spark, rows)
    expected, sha = plain(rows)
    assert found == expected and books.sha256() == sha


def test_few_rows_and_none(spark):
    rows = clustered(5, 8)
    found, books = result(spark, rows)
    expected, sha = plain(rows)
    assert found == expected and books.sha256() == sha and books.entries.shape[1] == 5
    found, books = result(spark, [(1, None, 1)])
    assert found == [] and books is None


def test_null_keys_come_last(spark):
    rows = clustered(40, 9)
    coded, books = codes.compressed(spark.createDataFrame(
        [(*r, "x", "y") for r in [*rows, (None, rows[0][1], 1)]], SCHEMA))
    expected, sha = plain([*rows, (999, rows[0][1], 1)])
    assert books.sha256() == sha
    assert coded.where(F.col("vec_id").isNull()).count() == 1 and len(expected) == 41


def test_what_cannot_be_cut_or_counted_is_refused(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 9, 1, "", "")], SCHEMA))
    with pytest.raises(Exception, match="64 bits"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 1, "", "")], SCHEMA))
