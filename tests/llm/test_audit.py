"""Filter interactions against a plain evaluation of every order."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import types as T

from formline.llm import audit

LABELS = "doc_id long, quality int, toxic int, source string, mask string"


def fails_plain(rows):
    """Set of failed filters of each row."""
    out = []
    for key, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = [k for k, t, _ in rows if (t or "") == text and k is not None
                   and key is not None and k < key]
        flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 bool(re.search(r"[#$%&*|]", text)), bool(smaller)]
        out.append({f for f, bad in zip("ABCDE", flags, strict=True) if bad})
    return out


def plain(rows, labels):
    fails = fails_plain(rows)
    marks = {}
    for key, quality, toxic in labels:
        if key is not None:
            good, bad = marks.get(key, (False, False))
            marks[key] = (good or quality == 1, bad or toxic == 1)
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        here = [(f, *marks.get(r[0], (False, False))) for r, f in zip(rows, fails, strict=True)
                if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                failing = [x for x in here if name in x[0]]
                left = [x for x in left if name not in x[0]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone),
                    sum(x[0] == {name} for x in here), sum(x[1] for x in gone),
                    sum(x[2] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    rows = audit.interactions(audit.failures(
        docs, spark.createDataFrame([(*x, "l", "m") for x in labels], LABELS))).collect()
    return {(r.part, r.filter_order, r.step): (
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in rows}


def sample(seed=2, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.randrange(8)
        words = [rng.choice(["w", "Ü", "X", "über", "a b", "日本"]) + str(rng.randrange(
            rng.choice([20, 2000]))) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        text = rng.choice([" ", "\n", " \t\v\f\r "]).join(words)
        if kind == 0:
            text = None if rng.random() < 0.3 else text + " # "
        elif kind == 1:
            text = "  " + text.upper()
        elif kind == 2 and rows:
            text = rng.choice(rows)[1]
        rows.append((k, text, rng.choice(["s1", "s1", "s1", "s2", None, ""])))
    rows += rows[5:8] + [(None, rows[3][1], "s1"), (None, rows[3][1], "s3"), (7, "other", "s2")]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, n, 2)]
    return rows, labels + labels[:4] + [(labels[0][0], 1, 0), (None, 1, 1)]


def frame(spark, rows):
    schema = T.StructType([T.StructField(n, k()) for n, k in (
        ("doc_id", T.LongType), ("text", T.StringType), ("source", T.StringType),
        ("part", T.StringType), ("id", T.IntegerType), ("mask", T.StringType))])
    return spark.createDataFrame([(*r, "p", 1, "m") for r in rows], schema).repartition(3)


def test_all_orders_against_plain_evaluation(spark):
    rows, labels = sample()
    assert found(spark, frame(spark, rows), labels) == plain(rows, labels)


def test_empty_tables_and_one_long_text(spark):
    assert found(spark, frame(spark, []), []) == {}
    long = " ".join(f"w{i % 40_000}" for i in range(900_000))  # longer than a shard
    rows = [(1, long, "s"), (2, long, "s"), (3, "x" * 70_000, None)]
    assert found(spark, frame(spark, rows), []) == plain(rows, [])


def matrix_rows(docs):
    """(key, words of a row as numbers with their counts) of every document."""
    out = []
    for r in audit.term_matrix(docs).collect():
        for i, key in enumerate(r.ids):
            low, high = r.indptr[i], r.indptr[i + 1]
            assert r.columns[low:high] == sorted(set(r.columns[low:high]))
            out.append((key, dict(zip(r.columns[low:high], r.data[low:high], strict=True))))
    return out


def test_matrix_holds_the_words(spark):
    rows, _ = sample(3, 60)
    rows = [r for r in rows if r[0] is not None]
    number = {}

    def of(word):
        if word not in number:
            number[word] = int(audit.numbers_of(word.encode())[0][0])
        return number[word]
    expected = [(k, {of(w): n for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")
                                                  ).items()}) for k, t, _ in rows]
    assert len(set(number.values())) == len(number)
    order = lambda x: (x[0], sorted(x[1].items()))
    assert sorted(matrix_rows(frame(spark, rows)), key=order) == sorted(expected, key=order)


def test_words_of_one_hash_get_numbers_of_their_own(spark):
    rows, _ = sample(5, 60)
    shards = audit.local_shards(frame(spark, rows), "doc_id", "text", "source")
    words = {w for _, t, _ in rows for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    shared = audit.shared_numbers(shards, 8)
    # Eight bits hold 256 numbers, so nearly all words share theirs.
    assert len(shared) > len(words) // 2 and len(set(shared.values())) == len(shared)
    figures = sorted((r.n_words, r.n_distinct) for r in audit.row_figures(shards, 8).collect())
    assert figures == sorted((len(w), len(set(w))) for _, t, _ in rows
                             for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert audit.shared_numbers(shards) == {}
