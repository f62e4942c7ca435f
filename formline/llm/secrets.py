"""Secret spans: fixed patterns, and a linear-chain conditional random field that adds others.

Tokens are runs of letters, digits and the signs + / _ . = - and the bytes beyond ASCII.  Each
is tagged as begin of a secret, inside one, or outside, from

* its shape: character classes, length, share of digits, mix of cases, only hex digits,
* its neighbours: the token before and after, and the signs between them,
* the file: share of digits, length and number of pattern matches per token, in steps.

The field is trained on what the patterns find in at most ``SAMPLE`` rows (in the order of a hash of
the key, texts up to ``SAMPLE_BYTES``), and on copies of those texts in which no pattern fits any more:
the key word is bent by one sign or another word stands in its place, and the value has other signs
(``bent``).  So shape and neighbours must carry the tag, not what the patterns see.  Copies with
compounds of a text's own words, dates and numbers (``compounds``) teach which long tokens are none.
The training runs in a task; the driver gets the weights, and no text.
Every whole text is decoded by Viterbi.  Spans of adjacent tokens tagged B I I ... that no
pattern span touches are added with the kind ``crf``.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm import chain, ragged
from formline.llm.registry import query, table
from formline.llm.samples import hash_limit

SAMPLE, SAMPLE_BYTES = 2000, 40_000
BITS, STEPS, RATE, SHRINK = 15, 60, 0.1, 2e-3
KINDS = ("assign", "access", "hex", "crf")
#: At least so many copies of a sampled text that holds a secret, and of all of them together; every
#: how many-th text gets compounds; so many tokens on each side of a long one are learnt from.
BENT, ALL_BENT, COMPOUNDS, NEAR = 2, 3000, 4, 6
#: Longest chain that is learnt from, in tokens; longer stretches are cut.
CHAIN = 32
#: A span the field adds is at least so long; shorter tokens carry no usable secret.
LEAST = 12

# The patterns, and the least length of group 2 or of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
HINTS = ("passw", "secret", "token", "api")  # each match of ASSIGN holds one of them

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.=-"),
        *range(128, 256)]] = True
_DIGIT, _UPPER, _SMALL, _HEX = (np.zeros(256, dtype=np.int64) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _SMALL[97:123] = _SMALL[128:] = 1
_HEX[48:58] = _HEX[97:103] = 1
_CLASS = np.zeros(256, dtype=np.uint64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 4
_HEXRUN = _HEX.astype(bool)
_U = np.uint64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns, in code points."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text)
                if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)
                if len(m[0]) >= LEAST_ACCESS]
    return out


@dataclass
class Tokens:
    """Tokens of a chunk with the numbers of their features."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begins: np.ndarray
    features: np.ndarray  # (token, feature)


def tokens(offsets: np.ndarray, data: np.ndarray, found: np.ndarray) -> Tokens:
    """``found`` is the number of pattern matches of every text."""
    start, end = ragged.runs(_TOKEN[data], offsets)
    row = ragged.owner(offsets, start)
    size = end - start
    begins = np.ones(len(row), dtype=bool)
    begins[1:] = row[1:] != row[:-1]

    def count(values):
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(values[data], out=total[1:])
        return total[end] - total[start], total
    digits, total_digits = count(_DIGIT)
    upper, small, hexes = (count(x)[0] for x in (_UPPER, _SMALL, _HEX))
    low = ragged.LOWER[data]
    word = ragged.Spans(low).hashes(start, end)
    kind = _CLASS[data]
    change = np.zeros(len(data) + 1, dtype=np.int64)
    change[1:len(data)] = np.cumsum(kind[1:] != kind[:-1])
    change[len(data)] = change[len(data) - 1] if len(data) else 0
    turns = change[np.maximum(end - 1, 0)] - change[start]
    step = np.minimum(np.log2(size + 1).astype(_U), _U(12))
    share = (8 * digits // np.maximum(size, 1)).astype(_U)
    mixed = ((digits > 0) * 1 + (upper > 0) * 2 + (small > 0) * 4
             + (digits + upper + small < size) * 8).astype(_U)
    shape = mixed * _U(16) + step
    before, after = np.roll(word, 1), np.roll(word, -1)
    last = np.roll(begins, -1)
    before[begins] = 1
    after[last] = 1
    gap = _gaps(data, start, end, begins)
    texts = np.diff(offsets)
    per_row = np.bincount(row, minlength=len(texts))
    file_digits = (16 * (total_digits[offsets[1:]] - total_digits[offsets[:-1]])
                   // np.maximum(texts, 1)).astype(_U)
    file_size = np.log2(per_row + 1).astype(_U)
    density = np.minimum(np.ceil(8 * np.log2(1 + 100 * found / np.maximum(per_row, 1))), 40
                         ).astype(_U)
    same = (hexes == size).astype(_U)
    columns = [shape, share * _U(64) + step, same * _U(64) + step + _U(32) * (digits > 0),
               np.minimum(turns, 31).astype(_U) * _U(16) + step,
               (kind[start] * _U(8) + kind[end - 1]) if len(start) else shape,
               np.where(size <= 12, word, _U(0)), before, after,
               before ^ (gap << _U(1)) ^ shape, gap * _U(16) + step, np.roll(gap, -1),
               file_digits[row] * _U(16) + step, file_size[row] * _U(16) + step,
               density[row] * _U(16) + step]
    numbers = np.stack([ragged.mix(c + _U(k * 0xA24BAED4963EE407 % 2**64)) >> _U(64 - BITS)
                        for k, c in enumerate(columns)], axis=1)
    return Tokens(row, start, end, begins, numbers.astype(np.int32))


def _gaps(data, start, end, begins):
    """Which signs stand between a token and the one before: bits for space, line, = or :, quote."""
    signs = np.zeros((256,), dtype=np.int64)
    out = np.zeros(len(start), dtype=_U)
    for bit, chars in enumerate((" \t", "\n\r", ":", "\"'`", "()[]{}<>", ",;|")):
        signs[:] = 0
        signs[[ord(c) for c in chars]] = 1
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(signs[data], out=total[1:])
        left = np.where(begins, start, np.roll(end, 1))
        out |= ((total[start] - total[left]) > 0).astype(_U) << _U(bit)
    return out


@dataclass
class Field:
    """Feature weights (feature, label) and label moves; labels are outside, begin, inside."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.row), 3))
        for k in range(t.features.shape[1]):
            out += self.weights[t.features[:, k]]
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        return chain.viterbi(self.scores(t), t.begins, self.moves, self.start)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before every byte."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def chunk_spans(offsets: np.ndarray, data: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Pattern spans of every text of a chunk."""
    raw = data.tobytes()
    out = [base_spans(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    starts, ends = ragged.runs(_HEXRUN[data], offsets)
    long = ends - starts >= LEAST_HEX
    if long.any():
        points = _points(data)
        for a, b, r in zip(starts[long], ends[long], ragged.owner(offsets, starts[long]),
                           strict=True):
            zero = points[offsets[r]]
            out[r].append((int(points[a] - zero), int(points[b] - zero), 2))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def _overlap(points, offsets, t: Tokens, spans) -> np.ndarray:
    """Number of the pattern span (of its text, from 1) that a token lies in; 0 for none."""
    inside = np.zeros(len(t.row), dtype=np.int64)
    edge = np.searchsorted(t.row, np.arange(len(spans) + 1))
    for r, own in enumerate(spans):
        if not own:
            continue
        a = points[t.start[edge[r]:edge[r + 1]]] - points[offsets[r]]
        b = points[t.end[edge[r]:edge[r + 1]]] - points[offsets[r]]
        for k, (s, e, _) in enumerate(own, 1):
            lo, hi = np.searchsorted(b, s, "right"), np.searchsorted(a, e, "left")
            inside[edge[r] + lo:edge[r] + hi] = k
    return inside


SIGNS = string.ascii_letters + string.digits
_SIMPLE = re.compile(r"[^\W\d_]{2,12}")


def _secret_parts(text: str) -> list[tuple[int, int, int]]:
    """(start of the match, start and end of its value), left to right, none touching another."""
    found = [(m.start(), m.start(2), m.end()) for m in ASSIGN.finditer(text)
             if len(m[2]) >= LEAST_ASSIGN]
    for pattern, least in ((ACCESS, LEAST_ACCESS), (HEX, LEAST_HEX)):
        found += [(m.start(), m.start(), m.end()) for m in pattern.finditer(text)
                  if len(m[0]) >= least]
    out: list[tuple[int, int, int]] = []
    for part in sorted(found):
        if not out or part[0] >= out[-1][2]:
            out.append(part)
    return out


def bent(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A copy of ``text`` whose secrets the patterns mostly miss, and the spans of their values."""
    words = _SIMPLE.findall(text) or ["value"]
    out, at, size, spans = [], 0, 0, []

    def put(piece):
        nonlocal size
        out.append(piece)
        size += len(piece)

    for start, value, end in _secret_parts(text):
        put(text[at:start])
        key = text[start:value]
        letters = [i for i, c in enumerate(key) if c.isalpha()]
        if letters and rng.random() < 0.5:
            i = rng.choice(letters)
            put(key[:i] + rng.choice(("", key[i] * 2, rng.choice(string.ascii_lowercase)))
                + key[i + 1:])
        elif letters:
            put(rng.choice(words) + rng.choice((" = ", ": ", "=", " ", ' "')))
        secret, how = text[value:end], rng.randrange(3)
        if how == 0:
            secret = secret.upper() if rng.random() < 0.3 and not secret.isdigit() else "".join(
                rng.choices("0123456789ABCDEF", k=rng.randrange(LEAST + 4, 65)))
        elif how == 1:
            signs = SIGNS + rng.choice(("", "+/", "-_"))
            head = "".join(rng.choices(string.ascii_lowercase, k=3)) + "_"
            secret = rng.choice(("", "", head)) + "".join(rng.choices(
                signs, k=rng.randrange(LEAST + 4, 49))) + rng.choice(("", "", "=", "=="))
        else:  # no run of hex digits is long enough
            secret = "".join(c if i % 9 else rng.choice(SIGNS[6:26]) for i, c in enumerate(secret))
        spans.append((size, size + len(secret), 3))
        put(secret)
        at = end
    put(text[at:])
    return "".join(out), spans


def compounds(text: str, rng: random.Random) -> str:
    """A copy of ``text`` with long tokens that are no secrets: joined words, dates, versions."""
    words = text.split(" ")
    simple = _SIMPLE.findall(text) or ["value"]
    for _ in range(4):
        sign = rng.choice("-_./")
        some = [rng.choice(simple) for _ in range(rng.randrange(2, 5))]
        number = str(rng.randrange(10 ** rng.randrange(1, 12)))
        date = f"{rng.randrange(1950, 2050)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        token = rng.choice((sign.join(some), sign.join([*some, number]), "".join(
            w.capitalize() for w in some), date + "T" + number, sign.join([date, *some]),
            number + "." + str(rng.randrange(1000)), "".join(some) + number))
        words.insert(rng.randrange(len(words) + 1), token)
    return " ".join(words)


def examples(texts: list[str]) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """The texts and their copies, with the spans of secrets that no pattern finds."""
    rng = random.Random(11)
    holders = [t for t in texts if _secret_parts(t)]
    copies = [bent(t, rng) for t in holders
              for _ in range(max(BENT, -(-ALL_BENT // len(holders))))]
    out = [*texts, *(t for t, _ in copies), *(compounds(t, rng) for t in texts[::COMPOUNDS])]
    extra = [[] for _ in texts] + [spans for _, spans in copies]
    return out, extra + [[] for _ in out[len(extra):]]


def _stretches(t: Tokens, teach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens within ``NEAR`` of one that teaches, and which of them begin a chain: the first of a
    stretch and of a text, and every ``CHAIN``-th."""
    near = np.zeros(len(teach) + 1, dtype=np.int64)
    at = np.flatnonzero(teach)
    np.add.at(near, np.maximum(0, at - NEAR), 1)
    np.add.at(near, np.minimum(len(teach), at + NEAR + 1), -1)
    keep = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    begins = t.begins[keep].copy()
    begins[1:] |= (np.diff(keep) > 1) | (np.diff(t.row[keep]) > 0)
    begins[:1] = True
    number = np.arange(len(keep))
    begins |= (number - np.maximum.accumulate(np.where(begins, number, 0))) % CHAIN == 0
    return keep, begins


def fit(texts: list[str]) -> Field:
    """The field whose tags are the secrets in the patterns' matches and in bent copies of them;
    without rows all outside."""
    texts, extra = examples(texts)
    copied = np.array([bool(e) for e in extra], dtype=bool)
    parts = []
    for row, offsets, data in ragged.text_chunks(pa.array(texts, pa.string())):
        found = chunk_spans(offsets, data)
        spans = [own + extra[row + i] for i, own in enumerate(found)]
        points = _points(data)
        t = tokens(offsets, data, np.array([len(s) for s in found]))
        inside = _overlap(points, offsets, t, spans)
        # Of "name = value" only the long value is the secret.
        long = t.end - t.start >= LEAST
        secret = (inside > 0) & long
        joined = np.zeros(len(inside), dtype=bool)
        joined[1:] = secret[1:] & secret[:-1] & (inside[1:] == inside[:-1]) & ~t.begins[1:]
        # What a copy shares with its text is learnt from the text.
        keep, begins = _stretches(t, secret | long & ~copied[row + t.row])
        tags = np.where(secret, np.where(joined, 2, 1), 0)[keep]
        parts.append((np.where(begins & (tags == 2), 1, tags), begins, t.features[keep]))
    field = Field(np.zeros((1 << BITS, 3)), np.zeros((3, 3)), np.zeros(3))
    field.moves[0, 2] = field.start[2] = -8.0  # nothing continues what has not begun
    if not sum(len(y) for y, _, _ in parts):
        field.weights[:, 0] = 1.0
        return field
    y, begins, numbers = map(np.concatenate, zip(*parts, strict=True))
    whole = Tokens(np.zeros(len(y)), np.zeros(0), np.zeros(0), begins, numbers)
    gold = np.eye(3)[y]
    same = np.flatnonzero(~begins)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (y[same - 1], y[same]), 1)
    gold_start = gold[begins].sum(axis=0)

    def gradient():
        p, moved = chain.forward_backward(field.scores(whole), begins, field.moves, field.start,
                                          pairs=True)
        error = gold - p
        g = np.zeros_like(field.weights)
        for label in range(3):
            g[:, label] = np.bincount(
                numbers.reshape(-1), np.repeat(error[:, label], numbers.shape[1]), 1 << BITS)
        return {"weights": g - SHRINK * field.weights, "moves": gold_moves - moved
                - SHRINK * field.moves, "start": gold_start - p[begins].sum(axis=0)
                - SHRINK * field.start}
    chain.adam({"weights": field.weights, "moves": field.moves, "start": field.start}, gradient,
               STEPS, RATE)
    return field


def all_spans(offsets: np.ndarray, data: np.ndarray, field: Field
              ) -> list[list[tuple[int, int, int]]]:
    """Pattern spans and those the field adds, of every text of a chunk."""
    spans = chunk_spans(offsets, data)
    t = tokens(offsets, data, np.array([len(s) for s in spans]))
    tag = field.decode(t)
    if not tag.any():
        return spans
    points = _points(data)
    known = np.zeros(len(tag) + 1, dtype=np.int64)  # tokens before that a pattern span touches
    np.cumsum(_overlap(points, offsets, t, spans) > 0, out=known[1:])
    secret = np.flatnonzero(tag > 0)
    new = np.ones(len(secret), dtype=bool)
    new[1:] = (tag[secret[1:]] == 1) | (np.diff(secret) > 1) | t.begins[secret[1:]]
    first = secret[new]
    final = secret[np.append(np.flatnonzero(new)[1:] - 1, len(secret) - 1)]
    row = t.row[first]
    low = points[t.start[first]] - points[offsets[row]]
    high = points[t.end[final]] - points[offsets[row]]
    added = (high - low >= LEAST) & (known[final + 1] == known[first])
    for r, lo, hi in zip(row[added], low[added], high[added], strict=True):
        spans[r].append((int(lo), int(hi), 3))
    for r in np.unique(row[added]):
        spans[r].sort(key=lambda s: (s[0], s[2]))
    return spans


def drawn(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE
          ) -> DataFrame:
    """(h, t) of at most ``rows`` texts to learn from: those whose hash lies below the wished
    share, and of equal hashes (NULL keys, repeated ones) no more than ``rows`` from any task."""
    usable = docs.where(F.col(f"`{text}`").isNotNull() & (
        F.octet_length(F.col(f"`{text}`")) <= SAMPLE_BYTES)).select(
        F.xxhash64(F.col(f"`{key}`"), F.lit("secrets")).alias("h"), F.col(f"`{text}`").alias("t"))
    low = hash_limit(rows, usable.count())
    return usable.where(F.col("h") <= F.lit(low)).orderBy("h", "t").limit(rows)


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SAMPLE) -> Field:
    """The field of at most ``size`` texts, learnt in one task."""
    names = ["weights", "moves", "start"]

    def learn(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("h", "ascending"), ("t", "ascending")])
        field = fit(rows["t"].to_pylist())
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks
        return pa.table([pa.array([getattr(field, c).tobytes()], pa.binary()) for c in names],
                        names)
    found = drawn(docs, key, text, size).groupBy().applyInArrow(
        learn, ", ".join(f"{c} binary" for c in names)).collect()
    if not found:
        return fit([])
    weights, moves, start = (np.frombuffer(found[0][c]) for c in names)
    return Field(weights.reshape(-1, 3), moves.reshape(3, 3), start)


SPANS = "array<struct<start:int,end:int,kind:string>>"


def with_secrets(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` as last column (an old one of this name is replaced).

    Spans are in code points, by start and kind; NULL and empty texts have none.  Repeated rows
    are treated alike, an empty table stays empty.
    """
    kept = [c for c in docs.columns if c != "spans"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text_"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    cell = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def scan(batches):
        for batch in batches:
            found = []
            for _, offsets, data in ragged.text_chunks(batch.column(batch.num_columns - 1)):
                found += [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in own]
                          for own in all_spans(offsets, data, shared.value)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(cell))], [*kept, "spans"])
    schema = docs.select(*[F.col(f"`{c}`") for c in kept],
                         F.lit(None).cast(SPANS).alias("spans")).schema
    for item in schema:
        item.nullable = True
    return rows.mapInArrow(scan, schema)


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Texts with every span (column ``spans``) replaced by ``mask``; overlaps become one."""
    c = F.col(f"`{text}`")
    merged = F.aggregate(
        F.filter("spans", lambda s: s["end"] > s["start"]),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("masked")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(
                a["out"], F.substring(c, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))
                   ).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"), F.lit(0).alias("masked")),
        lambda a: F.concat(a["out"], F.substring(c, a["at"] + 1, F.lit(2147483647))))
    return docs.withColumn(text, F.when(F.size("spans") > 0, merged).otherwise(c))


def _joined(kinds=None):
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_secrets(docs, fitted(docs)).drop("text")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"),
        _joined().alias("spans"))
