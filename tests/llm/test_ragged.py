"""Ragged helpers, chains and components against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest

from formline.llm import chain, ragged, subwords, units
from formline.llm.components import components

TEXTS = ["", "a", "Hello, world 42!", "é è\nÀ-b", None, " ", "x" * 40 + " y", "日本 語"]


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_chunks_hold_all_rows(limit):
    column = pa.array(["skip", *TEXTS]).slice(1)
    seen = []
    for first, offsets, data in ragged.text_chunks(column, limit):
        assert first == len(seen)
        raw = data.tobytes()
        seen += [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert seen == [t or "" for t in TEXTS]
    assert list(ragged.text_chunks(pa.array([], pa.string()))) == []


def test_words():
    (_, offsets, data), = ragged.text_chunks(pa.array(TEXTS))
    hashes, row, start, end = ragged.words(offsets, data)
    found = {}
    for h, r, a, b in zip(hashes, row, start, end, strict=True):
        word = ragged.LOWER[data][a:b].tobytes().decode()
        assert found.setdefault(word, h) == h
    for k, t in enumerate(TEXTS):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert (row == k).sum() == len(plain)
    assert len(set(found.values())) == len(found)


def test_lower_case_of_accents():
    data = np.frombuffer("ÀÉßÜ×A".encode(), np.uint8)
    assert subwords.lower(data).tobytes().decode() == "àéßü×a"


def test_units_are_the_texts():
    (_, offsets, data), = ragged.text_chunks(pa.array(["a b  c", " d", "e ", "", "f  g h"]))
    row, start, end = units.cut(offsets, data)
    raw = data.tobytes()
    got = [(int(r), raw[a:b].decode()) for r, a, b in zip(row, start, end, strict=True)]
    assert got == [(0, "a"), (0, " b  c"), (1, " d"), (2, "e "), (4, "f  g"), (4, " h")]


def _plain(scores, begins, moves, start):
    n, labels = scores.shape
    alpha, beta, best = np.zeros((n, labels)), np.zeros((n, labels)), np.zeros((n, labels))
    back = np.zeros((n, labels), int)
    for i in range(n):
        if begins[i]:
            alpha[i] = start + scores[i]
            best[i] = start + scores[i] + (best[i - 1].max() if i else 0)
            back[i] = best[i - 1].argmax() if i else 0
        else:
            alpha[i] = np.logaddexp.reduce(alpha[i - 1][:, None] + moves, axis=0) + scores[i]
            options = best[i - 1][:, None] + moves
            best[i], back[i] = options.max(axis=0) + scores[i], options.argmax(axis=0)
    for i in range(n - 2, -1, -1):
        if not begins[i + 1]:
            beta[i] = np.logaddexp.reduce(moves + scores[i + 1] + beta[i + 1], axis=1)
    p = np.exp(alpha + beta - (alpha + beta).max(axis=1, keepdims=True))
    path = [int(best[-1].argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return p / p.sum(axis=1, keepdims=True), path[::-1]


@pytest.mark.parametrize("n", [1, 7, 256, 900])
def test_chain_against_plain_recursions(n):
    rng = np.random.default_rng(n)
    scores, begins = rng.normal(size=(n, 3)) * 2, rng.random(n) < 0.05
    begins[0] = True
    moves, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    p, path = _plain(scores, begins, moves, start)
    found, moved = chain.forward_backward(scores, begins, moves, start, pairs=True)
    assert np.allclose(p, found, atol=1e-9)
    assert moved.sum() == pytest.approx(n - begins.sum())
    assert chain.viterbi(scores, begins, moves, start).tolist() == path


def test_chain_without_positions():
    none = np.zeros((0, 2))
    assert chain.forward_backward(none, np.zeros(0, bool), np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)
    assert not len(chain.viterbi(none, np.zeros(0, bool), np.zeros((2, 2)), np.zeros(2)))


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1), (20, 10), (30, 20), (30, 40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10, 40: 10}
    assert components(df.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    df = spark.range(300).selectExpr("id + 1 AS a", "id AS b")
    assert {r.component for r in components(df).collect()} == {0}
