import hashlib
import random

from pyspark.sql import functions as F

from formline.llm import phrases


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def check(spark, documents, texts, items):
    found = phrases.hits(documents(texts), items_of(spark, items)).collect()
    expected = phrases.brute_force(dict(texts), dict(items))
    assert {r.doc: (r.n_words, r.n_hit, list(r["items"])) for r in found} == expected
    return expected


def test_against_brute_force(spark, documents):
    rng = random.Random(2)
    words = [f"t{k}" for k in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 25]))))
             for i in range(12)]
    texts = []
    for d in range(40):
        body = [rng.choice(words) for _ in range(rng.choice([0, 5, 50, 200]))]
        if d % 2:
            part = rng.choice(items)[1].split()
            cut = part[:rng.randrange(len(part)) + 1]
            at = rng.randrange(len(body) + 1)
            body[at:at] = cut
        texts.append((d, ", ".join(body)))
    expected = check(spark, documents, texts, items)
    assert any(x[1] for x in expected.values()) and not all(x[1] for x in expected.values())


def test_overlapping_windows_and_repeated_words(spark, documents):
    texts = [(1, "a " * 15), (2, "a " * 9), (3, "b " + "a " * 10), (4, "a b " * 12)]
    check(spark, documents, texts, [(1, "a " * 10), (2, "a b " * 6), (3, "zz")])


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two three"), (None, "one two"),
            (4, "ONE... Two")]
    df = documents(rows, items=F.lit(1), term=F.lit("x"))
    items = items_of(spark, [(7, "one two"), (7, "one two"), (None, "one two"), (8, None), (9, "-")])
    found = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated)
                   for r in phrases.with_contamination(df, items).collect())
    assert found == [("1", 0, 0, 0, False), ("2", 0, 0, 0, False), ("3", 2, 2, 1, True),
                     ("3", 3, 2, 1, True), ("4", 2, 2, 1, True), ("None", 2, 0, 0, False)]
    sha = {r.items_sha256 for r in phrases.with_contamination(df, items).collect()
           if r.contaminated}
    assert sha == {hashlib.sha256(b"7").hexdigest()}
    assert phrases.with_contamination(documents([]), items).count() == 0
    none = phrases.with_contamination(df, items.limit(0)).collect()
    assert len(none) == 6 and not any(r.contaminated for r in none)


def test_proximity(spark, documents):
    rows = [(1, "red x green blue"), (2, "red green blue"), (3, "red x x x x x green blue")]
    items = items_of(spark, [(5, "red green blue")])
    exact = phrases.hits(documents(rows), items).where("n_hit > 0").select("doc").collect()
    near = phrases.proximity_matches(documents(rows), items, slop=1).select("doc").collect()
    assert {r.doc for r in exact} == {2} and {r.doc for r in near} == {1, 2}
