import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from formline.llm import neardup, ragged


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return collections.Counter(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else {}


def brute(rows):
    have = {i: shingles(t) for i, t in rows}
    root = {i: i for i in have}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(have)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            one, two = have[a], have[b]
            total = sum(one.values()) + sum(two.values()) if one and two else 0
            if total and 9 * sum(min(x, two.get(s, 0)) for s, x in one.items()) >= 4 * total:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def sample(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 300]))]
        rows.append(text)
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, len(copy) // 40, len(copy) // 15])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    rows += [["again"] * 50, ["again"] * 50 + ["end"], ["again"] * 20]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_classes_against_brute_force(documents):
    rows = sample()
    found = {r.id: r.class_id for r in neardup.classes(documents(rows)).collect()}
    assert found == brute(rows)


def test_signatures_estimate_weighted_similarity():
    a = "x y z p q " * 20 + " ".join(f"w{k}" for k in range(100))
    b = "x y z p q " * 14 + " ".join(f"w{k}" for k in range(5, 110))
    (_, offsets, data), = ragged.text_chunks(pa.array([a, b]))
    owner, element, weight, _, _ = neardup.shingles(offsets, data)
    ranks = neardup.signatures(owner, element, weight, 2, 3000)
    one, two = shingles(a), shingles(b)
    common = sum(min(x, two.get(s, 0)) for s, x in one.items())
    exact = common / (sum(one.values()) + sum(two.values()) - common)
    assert abs((ranks[0] == ranks[1]).mean() - exact) < 0.04
    assert np.isfinite(ranks).all()


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "ONE, two!"), (5, "one two"),
            (None, "one two"), (None, None), (6, "word " * 30_000), (7, "word " * 30_000 + "end")]
    df = documents(rows, class_id=F.lit("x"), n=F.lit(3), text2=F.lit(1))
    found = sorted(map(tuple, neardup.classes(df).collect()), key=str)
    assert found == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (None, 4),
                            (None, None), (6, 6), (7, 6)], key=str)
    assert neardup.classes(documents([])).count() == 0


def test_crowded_buckets_use_hubs(documents, monkeypatch):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(neardup, "SMALL", 4)
    assert {r.class_id for r in neardup.classes(documents(rows)).collect()} == {0}


def test_pairs_meet_in_a_small_bucket_after_a_crowded_one(spark, monkeypatch):
    # 1 and 2 share band 0 with 66 others, and band 9 only with each other.
    monkeypatch.setattr(neardup, "SMALL", 4)
    bands = {i: [100 * k + i << 32 for k in range(neardup.BANDS)] for i in range(1, 68)}
    for i in bands:
        bands[i][0] = 7 << 32
    bands[1][9] = bands[2][9] = 5 << 32
    # The fullest members, thus the hubs, are others.
    members = [(i, 50, 0, 7 << 32, 0 if i < 3 else i) for i in bands]
    members += [(i, 50, 9, 5 << 32, 0) for i in (1, 2)]
    texts = spark.createDataFrame([(i, b, bytes([i]) * neardup.K) for i, b in bands.items()],
                                  "id long, bands array<long>, mini binary")
    found = neardup._across(
        spark.createDataFrame(members, "id long, n long, band int, value long, full long"),
        spark.createDataFrame([], "id long, component long"), texts)
    assert (1, 2) in {(r.a, r.b) for r in found.select("a", "b").collect()}


def test_crowd_without_a_central_text_against_brute_force(documents, monkeypatch):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(200)]

    def changed(text, places, name):
        copy = list(text)
        for k in rng.sample(range(200), places):
            copy[k] = f"{name}x{k}"
        return copy
    rows = []
    for i in range(200):  # unlike each other, but for one near relative each
        one = changed(base, 4, f"n{i}")
        rows += [one, changed(one, 4, f"m{i}")]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 50, raising=False)
    found = {r.id: r.class_id for r in neardup.classes(documents(rows)).collect()}
    assert found == brute(rows)


def test_common_shingles_of_two_sides_are_sums_of_minima():
    texts = ["a b c d e " * 9 + "x y z", "a b c d e " * 4 + "q r s t u v", "k l m n o", "...",
             "a b c d e " * 700]
    (_, offsets, data), = ragged.text_chunks(pa.array(texts))
    owner, element, weight, _, _ = neardup.shingles(offsets, data)
    side = owner, element, weight
    found = neardup._common(side, side, len(texts), len(texts))
    have = [shingles(t) for t in texts]
    assert found.tolist() == [[sum(min(x, b.get(s, 0)) for s, x in a.items()) if b else 0
                               for b in have] for a in have]
