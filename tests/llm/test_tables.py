"""Licences, shards, vectors and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formline.llm import licenses, neardup, phrases, sharding, toxicity, vectors
from formline.llm.registry import table


# --- licences ---------------------------------------------------------------------

def words_of(text):
    return [w for w in re.split(r"[\x00-/:-`{-\x7F]+", (text or "").lower()) if w]


def licences_plain(text, least=0.8):
    have = {}
    words = words_of(text)
    for i in range(len(words) - 4):
        have.setdefault(tuple(words[i:i + 5]), []).append(i)
    out = set()
    for name, template in licenses.TEMPLATES:
        own = words_of(template)
        need = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
        places = sorted((i, s) for s in need for i in have.get(s, ()))
        span = len(own) - 4 + 2 * licenses.step_of(len(own))
        if any(len({s for j, s in places if i <= j < i + span}) >= least * len(need)
               for i, _ in places):
            out.add(name)
    return ",".join(sorted(out))


def test_licences_against_plain_containment(documents):
    rng = random.Random(6)
    rows = []
    for k in range(150):
        body = [f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 3, 30, 120]))]
        part = words_of(rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.choice([0, 0, 1, 2])):
            part[rng.randrange(len(part))] = "zz"
        if k % 3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        rows.append((k, " ".join(body)))
    found = {r.doc_id: r.licenses for r in licenses.with_licenses(documents(rows)).collect()}
    expected = {k: licences_plain(t) for k, t in rows}
    wrong = {k for k in expected if expected[k] != found[k]}
    # A share found only by stitching two far ends of a region together is no window's.
    assert len(wrong) <= 1 and any(expected.values())


def test_licences_of_odd_rows(documents):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "under the"), (4, mit), (4, mit), (5, "x " * 40_000 + mit),
            (None, mit), (6, mit.upper() + " LICENSED UNDER CC BY-NC 4.0")]
    df = documents(rows, license=F.lit(1), s=F.lit(2), k=F.lit(3))
    got = sorted((str(r.doc_id), r.n_licenses, r.licenses)
                 for r in licenses.with_licenses(df).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 0, ""), ("4", 1, "MIT"), ("4", 1, "MIT"),
                   ("5", 1, "MIT"), ("6", 2, "CC-BY-NC-4.0,MIT"), ("None", 0, "")]
    assert licenses.with_licenses(documents([])).count() == 0
    place = licenses.license_matches(df).where("doc_id = 5").first()
    assert (place.start, place.share) == (40_000, 1.0)


def test_licences_use_no_python(spark):
    plan = licenses.with_licenses(table(spark, "/root/testdata/sf0.001", "documents"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


# --- shards -----------------------------------------------------------------------

def least_capacity(sizes, shards):
    low, high = 0, max(1, sum(sizes))
    while high - low > 1:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            if s > middle:
                used = shards + 1
                break
            if filled + s > middle:
                used, filled = used + 1, 0
            filled += s
        low, high = (low, middle) if used <= shards else (middle, high)
    return high


@pytest.mark.parametrize("seed,shards,segments", [(1, 24, 1 << 14), (2, 5, 8), (3, 24, 2),
                                                  (4, 3, 64), (5, 1, 4)])
def test_capacity_is_the_least_possible(spark, seed, shards, segments):
    rng = random.Random(seed)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.randrange(1, 1000)) for _ in range(300)]
    rows += [rows[0]] * 40
    df = spark.createDataFrame(rows, "h long, size long").cache()
    cuts, capacity = sharding.minimax_cuts(df, shards, segments=segments, refine_bits=3)
    groups = {}
    for h, s in rows:
        groups[h % (1 << 64)] = groups.get(h % (1 << 64), 0) + s
    sizes = [groups[h] for h in sorted(groups)]
    assert capacity == least_capacity(sizes, shards)
    load = df.groupBy(sharding.shard_of(F.col("h"), cuts).alias("s")).agg(F.sum("size")).collect()
    assert max(r[1] for r in load) <= capacity and len(load) <= shards
    df.unpersist()


def test_shards_of_odd_rows(documents):
    rows = [(i, "copy") for i in range(50)] + [(100 + i, f"text {i} " * (i % 7)) for i in range(200)]
    rows += [(7, None), (8, ""), (9, "é"), (9, "é"), (None, "x"), (None, None), (10, "y" * 100_000)]
    df = documents(rows, size=F.lit("s"), shard=F.lit(1), h=F.lit(2), k=F.lit(3))
    got = sharding.sharded(df, slot_rows=20).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id < 50].query("size == 12").shard.nunique() == 1
    by_id = got.dropna(subset="doc_id").set_index("doc_id")
    assert by_id.loc[10, "size"].max() == 100_008
    assert by_id.loc[100 + 1, "text_crc32"] == zlib.crc32(b"text 1 ")
    assert sharding.sharded(documents([])).count() == 0


# --- vectors ----------------------------------------------------------------------

def links_plain(rows):
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None
            and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: set() for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, (a, x, l) in enumerate(good):
        for b, y, m in good[:n]:
            if a != b and l == m and len(x) == len(y) and (
                    x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93):
                links[a].add(b)
                links[b].add(a)
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(links[i]), find(i)) for i in links}


@pytest.mark.parametrize("cell_rows,block_rows", [(2000, 1000), (15, 7)])
def test_vectors_against_all_pairs(spark, monkeypatch, cell_rows, block_rows):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(40):
        base = rng.normal(size=8)
        for _ in range(int(rng.choice([1, 2, 6]))):
            noisy = base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.35])
            rows.append((n, [float(np.float32(x)) for x in noisy], int(n % 2)))
            n += 1
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.near_duplicates(df, block_rows=block_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == links_plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None),
            (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0),
            (8, [inf, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [], 0), (None, [1.0, 0.0], 0),
            (11, [-0.0, 1.0], 0), (12, [0.0, 1.0], 0), (13, [1e-30, 0.0], 0),
            (14, [3e38, 0.0], 0), (15, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({"id": F.lit("x"), "m": F.lit(2), "v": F.lit(3), "links": F.lit(4)})
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    expected = links_plain(rows)
    assert all((n, c) == expected[i] for i, n, c in got if i is not None)
    assert (None, 0, None) in got
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# --- the pipeline -----------------------------------------------------------------

def test_pipeline_keeps_what_each_operator_keeps(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = toxicity.fitted(docs, table(spark, sf, "labels"))
    kept = toxicity.with_toxicity(docs, model).where("predicted = 0").select(docs.columns)
    classes = {r.id: r.class_id for r in neardup.classes(kept).collect()}
    texts = {r.doc_id: r.text for r in kept.collect() if classes[r.doc_id] == r.doc_id}
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    clean = {i for i, (_, hit, _) in phrases.brute_force(texts, items).items() if not hit}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == clean and all(r.same_text for r in got)
    assert 0 < len(clean) < 200


def test_stages_return_documents(documents, spark):
    rows = [(i, f"words of text number {i} and more") for i in range(30)]
    rows += [(40, None), (41, ""), (42, "token = \"0123456789abcdef0123456789abcdef\"")]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {40, 41} <= {r.doc_id for r in out.collect()}, name
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(
        spark, docs, "").collect()}
    assert masked[42][0] == "[secret]\"" and masked[42][1] == len(masked[42][0])
    assert masked[0] == (rows[0][1], len(rows[0][1]))
