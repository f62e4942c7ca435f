"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (a space becomes the mark
U+2581, and one mark is put before the text), the pieces (one arc per piece from a position to
the one behind it, weighted by the negative score), and the byte fallback (a character without a
piece passes as its UTF-8 bytes).  For a merge-trained vocabulary the piece transducer is
restricted by an acceptor over neighbouring pieces: two pieces may follow each other only if no
merge across their border would come before, or between, the merges that build them.  The
composition with an input then has one accepting path, the one of the shortest distance in the
tropical semiring, and it is the segmentation the merges give.

Distinct space-led units are composed once per chunk and side by side; relaxation goes from
position to position over all units together.  Runs of marks, whose pieces share one score and
are merged from the left, are a transducer of their own.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm import ragged
from formline.llm.registry import query, table
from formline.llm.units import Cache

MARK = "▁"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_RUN = 0x200000  # code of a run of marks: this plus its length
_SEVERAL = re.compile(" {2,}")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _code_hash(text: str) -> int:
    out = 0
    for k, c in enumerate(text):
        out += (int(_SALT(np.array([ord(c)], dtype=_U))[0]) * pow(_BASE, k, 2**64))
    return out % 2**64


def _SALT(codes: np.ndarray) -> np.ndarray:
    return ragged.mix(codes.astype(_U) + _U(0x51ED27))


class Transducer:
    """Normaliser, pieces, neighbour acceptor and byte fallback of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" Ａ  b") != f"{MARK * 2}Ａ{MARK * 2}b":
            raise ValueError("only models that keep characters and put a mark first are compiled")
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                      or model.is_unused(i)) for i in range(size)]
        self.silent = [model.is_control(i) for i in range(size)]
        self.byte = np.zeros(256, np.int32)
        self.value = np.full(size, -1, np.int32)
        for i in range(size):
            if model.is_byte(i):
                b = int(self.names[i][3:5], 16)
                self.byte[b], self.value[i] = i, b
        self.ids = {p: i for i, p in enumerate(self.names) if plain[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(re.search(f"[^{MARK}]{MARK}|{MARK}{MARK}[^{MARK}]", p) for p in self.ids):
            raise ValueError("a piece reaches over a word boundary")
        self.mark = self.ids[MARK]
        self.longest = max(map(len, self.ids))
        self._compile(size)
        self.runs: dict[int, list[int]] = {}
        self._known = np.full(1 << 21, -1, np.int64)
        self._valid = np.zeros(1 << 21, dtype=bool)
        self.cache = Cache(self._encode_units, bits=21)
        text = [n.encode() if n in self.ids else b"" for n in self.names]
        for i in range(size):
            if self.value[i] >= 0:
                text[i] = bytes([self.value[i]])
            elif not plain[i] and not self.silent[i]:
                text[i] = " ⁇ ".encode()
            else:
                text[i] = text[i].replace(MARK.encode(), b" ")
        self._bytes = np.frombuffer(b"".join(text), np.uint8)
        self._size = np.array([len(t) for t in text], np.int64)
        self._start = np.cumsum(self._size) - self._size

    def _compile(self, size: int) -> None:
        """Piece table by hash, order of the merges, and last merge of each piece."""
        several = {p for p in self.ids if len(p) > 1 and p.strip(MARK)}
        ranked = sorted(several, key=lambda p: -self.score[p])
        # Order of a piece: -1 for characters, else the place of its merge.
        self.order = np.full(size, -1, np.int64)
        self.order[[self.ids[p] for p in ranked]] = np.arange(len(ranked))
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for p in ranked:
            self.left[self.ids[p]], self.right[self.ids[p]] = self._last_merge(p)
        usable = [p for p in self.ids if len(p) == 1 or p in several]
        hashes = np.array([_code_hash(p) for p in usable], dtype=_U)
        by = np.argsort(hashes)
        self._hashes, self._ids = hashes[by], np.array([self.ids[p] for p in usable])[by]
        self._flag = np.zeros(1 << 20, dtype=bool)
        self._flag[(hashes >> _U(44)).astype(np.int64)] = True
        self.hash = np.zeros(size, dtype=_U)
        self.hash[self._ids] = self._hashes
        self.length = np.array([len(p) for p in self.names], np.int64)
        self._up = np.multiply.accumulate(np.array([1] + [_BASE] * 64, dtype=_U))

    def _last_merge(self, piece: str) -> tuple[int, int]:
        parts = list(piece)
        while len(parts) > 2:
            best = max(range(len(parts) - 1), key=lambda k: (
                self.score.get(parts[k] + parts[k + 1], -np.inf), -k))
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) != 2 or any(x not in self.ids for x in parts):
            return -1, -1
        return self.ids[parts[0]], self.ids[parts[1]]

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of a hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self._flag[(hashes >> _U(44)).astype(np.int64)])
        found = hashes[maybe]
        at = np.minimum(np.searchsorted(self._hashes, found), len(self._hashes) - 1)
        good = self._hashes[at] == found
        out[maybe[good]] = self._ids[at[good]]
        return out

    def neighbours(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the merges leave piece ``two`` behind piece ``one``, both whole."""
        key = one * len(self.names) + two
        slot = (ragged.mix(key.view(_U)) >> _U(43)).astype(np.int64)
        miss = np.flatnonzero(self._known[slot] != key)
        if not len(miss):
            return self._valid[slot]
        fresh = self._merge_test(one[miss], two[miss])
        out = self._valid[slot]
        out[miss] = fresh
        self._known[slot[miss]] = -1
        self._valid[slot[miss]] = fresh
        # Of several keys of one slot the last stays; its value must be its own.
        self._known[slot[miss]] = key[miss]
        return out

    def _merge_test(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Undo the later of the two newest merges again and again; at every state ask whether
        a merge across the border would have come before the merge undone last."""
        ok = np.ones(len(one), dtype=bool)
        at = np.arange(len(one))
        x, y = one.copy(), two.copy()
        limit = np.full(len(one), np.iinfo(np.int64).max)
        while len(at):
            across = self._lookup(self.hash[x] + self.hash[y] * self._up[self.length[x]])
            bad = (across >= 0) & (2 * self.order[across] < limit)
            ok[at[bad]] = False
            more = ~bad & ((self.order[x] >= 0) | (self.order[y] >= 0))
            at, x, y, limit = at[more], x[more], y[more], limit[more]
            if not len(at):
                break
            ox, oy = self.order[x], self.order[y]
            later = ox > oy  # of equal merges the left one comes first
            limit = np.where(later, 2 * ox, 2 * oy + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return ok

    def run(self, length: int) -> list[int]:
        """Pieces of so many marks: equal scores, merged from the left."""
        if length not in self.runs:
            parts = {k: 1 for k in range(length)}
            after = {k: k + 1 for k in range(length)}
            heap = []
            before = {k: k - 1 for k in range(length)}

            def offer(k):
                n = after.get(k)
                if k in parts and n in parts and MARK * (parts[k] + parts[n]) in self.ids:
                    heapq.heappush(heap, (-self.score[MARK * (parts[k] + parts[n])], k,
                                          parts[k], parts[n]))
            for k in range(length - 1):
                offer(k)
            while heap:
                _, k, a, b = heapq.heappop(heap)
                n = after.get(k)
                if parts.get(k) != a or parts.get(n) != b:
                    continue
                parts[k] = a + b
                after[k] = after[n]
                before[after[n]] = k
                del parts[n]
                offer(k)
                if before[k] in parts:
                    offer(before[k])
            self.runs[length] = [self.ids[MARK * parts[k]] for k in sorted(parts)]
        return self.runs[length]

    def _codes(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised characters of all units, and how many each has."""
        texts = [u.decode() for u in units]
        plain = np.frombuffer("".join(texts).replace(" ", MARK).encode("utf-32-le"), np.uint32
                              ).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        odd = [k for k, t in enumerate(texts) if _SEVERAL.search(t)]
        if not odd:
            return plain, sizes
        begin = np.cumsum(sizes) - sizes
        parts, last = [], 0
        for k in odd:
            parts.append(plain[last:begin[k]])
            own = []
            for m in re.finditer(" {2,}|.", texts[k], re.DOTALL):
                if len(m[0]) == 1:
                    own.append(ord(MARK) if m[0] == " " else ord(m[0]))
                elif m.end() == len(texts[k]):
                    own.append(_RUN + len(m[0]))
                else:
                    own += [_RUN + len(m[0]) - 1, ord(MARK)]
            parts.append(np.array(own, np.int64))
            last, sizes[k] = begin[k] + sizes[k], len(own)
        return np.concatenate([*parts, plain[last:]]), sizes

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of all units: (ids one after the other, ids per unit)."""
        codes, sizes = self._codes(units)
        n, vocabulary = len(codes), len(self.names)
        up, down = ragged._power(n + 1)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(_SALT(codes) * up[:-1], out=total[1:])
        begin = np.cumsum(sizes) - sizes
        first = np.repeat(begin, sizes)
        place = np.arange(n) - first
        # Arcs of the composition: the piece of each length that ends behind a character.
        arcs = np.full((self.longest + 1, n), -1, np.int32)
        for size in range(1, min(self.longest, int(sizes.max(initial=0))) + 1):
            ends = np.flatnonzero(place >= size - 1)
            starts = ends - size + 1
            arcs[size, ends] = self._lookup((total[ends + 1] - total[starts]) * down[starts])
        strange, which = np.unique(codes[arcs[1] < 0], return_inverse=True)
        arcs[1, arcs[1] < 0] = vocabulary + which
        last = np.full(n, -1, np.int64)  # newest piece of the path that ends behind a character
        size_of = np.zeros(n, np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest_first, begin_first = sizes[order], begin[order]
        for t in range(int(sizes.max(initial=0))):
            active = np.searchsorted(-longest_first, -t, "left")
            here = begin_first[:active] + t
            size, word = np.nonzero(arcs[1:min(self.longest, t + 1) + 1, here] >= 0)
            size += 1
            end = here[word]
            piece = arcs[size, end].astype(np.int64)
            start = end - size
            opening = size == t + 1
            previous = np.where(opening, -1, last[start])
            reached = opening | (previous >= 0)
            free = opening | (piece >= vocabulary) | (previous >= vocabulary)
            test = np.flatnonzero(reached & ~free)
            good = reached & free
            good[test] = self.neighbours(previous[test], piece[test])
            last[end[good]] = piece[good]
            size_of[end[good]] = size[good]
        return self._paths(last, size_of, begin, sizes, strange)

    def _paths(self, last, size_of, begin, sizes, strange):
        vocabulary = len(self.names)
        at, unit = begin + sizes - 1, np.arange(len(sizes))
        unit, at = unit[sizes > 0], at[sizes > 0]
        units, tokens = [], []
        while len(unit):
            if (last[at] < 0).any():
                raise ValueError("a text has no path")
            units.append(unit)
            tokens.append(last[at])
            at = at - size_of[at]
            more = at >= begin[unit]
            unit, at = unit[more], at[more]
        if not units:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        step = np.repeat(np.arange(len(units)), [len(u) for u in units])
        units, tokens = np.concatenate(units), np.concatenate(tokens)
        by = np.lexsort((-step, units))
        units, tokens = units[by], tokens[by]
        # A mark left alone behind a run belongs to the run.
        extra = np.zeros(vocabulary + len(strange), np.int64)
        extra[vocabulary:] = strange
        code = extra[tokens]
        run = np.flatnonzero((code[:-1] > _RUN) & (tokens[1:] == self.mark)
                             & (units[:-1] == units[1:]))
        code[run] += 1
        kept = np.ones(len(tokens), dtype=bool)
        kept[run + 1] = False
        units, tokens, code = units[kept], tokens[kept], code[kept]
        kinds, inverse = np.unique(code, return_inverse=True)
        spelled = [[] if not c else self.run(int(c) - _RUN) if c > _RUN else
                   self.byte[list(chr(int(c)).encode())].tolist() for c in kinds]
        flat = np.array([i for s in spelled for i in s] or [0], np.int64)
        count = np.array([len(s) for s in spelled])
        head = np.cumsum(count) - count
        size = np.where(code > 0, count[inverse], 1)
        pool = np.concatenate([flat, np.arange(vocabulary)])
        where = np.where(code > 0, head[inverse], len(flat) + np.minimum(tokens, vocabulary - 1))
        ids = pool[ragged.ranges(where, size)].astype(np.int32)
        return ids, np.bincount(units, size, len(sizes)).astype(np.int64)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text) of a chunk."""
        if MARK.encode() in data.tobytes():  # the normaliser makes no difference to a space
            texts = [data[a:b].tobytes().replace(MARK.encode(), b" ") for a, b in zip(
                offsets[:-1], offsets[1:], strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            data = np.frombuffer(b"".join(texts), np.uint8)
        full = offsets[1:] > offsets[:-1]
        more = np.concatenate([[0], np.cumsum(full)])
        marked = np.full(len(data) + int(more[-1]), 32, np.uint8)
        inner = np.ones(len(marked), dtype=bool)
        inner[(offsets + more)[:-1][full]] = False
        marked[inner] = data
        return self.cache.texts(offsets + more, marked)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids; the mark put first by the normaliser is taken off again."""
        width = self._size[ids]
        data = self._bytes[ragged.ranges(self._start[ids], width)].tobytes()
        row = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(np.bincount(row, width, len(sizes)).astype(np.int64))
        out = []
        first = np.cumsum(sizes) - sizes
        for r, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(),
                                       strict=True)):
            lead = sizes[r] and self.names[ids[first[r]]].startswith(MARK)
            out.append(data[a + bool(lead):b].decode(errors="replace"))
        return out


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker and model."""
    return Transducer(path)


def _with(df: DataFrame, columns: dict[str, str], source, work) -> DataFrame:
    """``df`` with new last columns (name -> type); ``work`` yields them part by part."""
    kept = [c for c in df.columns if c not in columns]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], source.alias("_source_"))

    def step(batches):
        for batch in batches:
            at = 0
            for part in work(batch.column(batch.num_columns - 1)):
                size = len(part[0])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, size) for c in batch.columns[:-1]), *part],
                    [*kept, *columns])
                at += size
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[
        F.lit(None).cast(kind).alias(c) for c, kind in columns.items()]).schema
    for item in schema:
        item.nullable = True
    return rows.mapInArrow(step, schema)


def _encode_parts(column: pa.Array, path: str):
    for _, offsets, data in ragged.text_chunks(column):
        yield transducer(path).encode(offsets, data)


def encoded(docs: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None
            ) -> DataFrame:
    """``docs`` with the piece ids of whole texts in ``ids`` (an old column of this name goes).

    NULL and empty texts have no ids.  Rows are treated one by one, also repeated ones; an empty
    table stays empty.  ``model`` must be a file every executor has.
    """
    path = model or model_file()

    def work(column):
        for values, sizes in _encode_parts(column, path):
            yield [ragged.list_array(pa.array(values), sizes)]
    return _with(docs, {ids: "array<int>"}, F.col(f"`{text}`"), work)


def encoded_and_decoded(docs: DataFrame, text: str = "text", ids: str = "ids",
                        back: str = "back", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of whole texts and the texts decoded from these ids, in one pass.

    Odd rows are treated as by ``encoded`` and ``decoded``.
    """
    path = model or model_file()

    def work(column):
        for values, sizes in _encode_parts(column, path):
            yield [ragged.list_array(pa.array(values), sizes),
                   pa.array(transducer(path).decode(values, sizes), pa.string())]
    return _with(docs, {ids: "array<int>", back: "string"}, F.col(f"`{text}`"), work)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "text", model: str | None = None
            ) -> DataFrame:
    """``rows`` with the text of ``ids`` in ``text`` (an old column of this name goes).

    NULL and empty lists give empty texts, bytes that are no UTF-8 the replacement character.
    """
    path = model or model_file()

    def work(column):
        edge = np.asarray(column.offsets).astype(np.int64)
        flat = column.values.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(column):
            stop = int(np.searchsorted(edge, edge[at] + ragged.CHUNK_BYTES, "right")) - 1
            stop = min(max(stop, at + 1), len(column))
            out = transducer(path).decode(flat[edge[at]:edge[stop]], np.diff(edge[at:stop + 1]))
            yield [pa.array(out, pa.string())]
            at = stop
    return _with(rows, {text: "string"}, F.coalesce(
        F.col(f"`{ids}`"), F.array().cast("array<int>")), work)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, hash of the ids, crc32 of the decoded text, and whether it is the text."""
    both = encoded_and_decoded(docs.select("doc_id", "text"))
    back = F.coalesce("text", F.lit(""))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        F.crc32(F.encode("back", "UTF-8")).alias("text_crc32"),
        (F.col("back") == F.replace(back, F.lit(MARK), F.lit(" "))).alias("same_text"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
