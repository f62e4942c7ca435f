"""Token files and SentencePiece against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formline.llm import pieces, ragged, tokenfiles
from formline.llm.registry import QUERIES, table

ODD = ["", " ", "  a", "a ", "a  b", "a\n b", "x 　y z", "é è à", "it's a  'll\tb",
       "x" * 600 + " y " + "x" * 600, "日本 語 テスト 門 ▁ ▁▁a", "a  b", "a\u0085 b", "\x1c a b",
       "a" + " " * 15 + "b", " " * 40, "x" + " " * 33 + "門", "f() {\n        return   0;\n}",
       "\U0001F600\U0001F600 a\U0001F600", "a" * 33, "hahahahahaha hhhhhhh", "<s> </s> <0x41>"]


def odd_texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("abcdeiou tsnr   \n.,ABé門▁") for _ in range(
        rng.randint(1, 60))) for _ in range(1500)]


def parts(ids, sizes):
    ends = np.cumsum(sizes)
    return [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)]


def library_texts(spark):
    return [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]


def test_units_encode_like_whole_texts(spark):
    texts = odd_texts() + library_texts(spark)
    path = tokenfiles.vocabulary_file()
    cache, _ = tokenfiles.encoder(path)
    got = []
    for _, offsets, data in ragged.text_chunks(pa.array(texts), 50_000):
        got += parts(*cache.texts(offsets, data))
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [x.ids for x in whole]


def test_forgetting_the_cache_changes_nothing():
    path = tokenfiles.vocabulary_file()
    cache, _ = tokenfiles.encoder(path)
    small = tokenfiles.Cache(cache.encode, bits=4)
    for _, offsets, data in ragged.text_chunks(pa.array(odd_texts()), 200):
        assert parts(*small.texts(offsets, data)) == parts(*cache.texts(offsets, data))


@pytest.mark.parametrize("symbols,count", [(3, 5000), (50, 20_000), (40_000, 3000), (2, 1), (5, 0)])
def test_grammar_round_trip(symbols, count):
    rng = np.random.default_rng(symbols)
    ids = rng.zipf(1.5, count).clip(max=symbols - 1) if symbols > 2 else rng.integers(0, 2, count)
    sizes = np.array([count // 2, 0, count - count // 2])
    first = 50_257
    sequence, left, right, ends = tokenfiles.compressed(ids, np.cumsum(sizes), first, least=4)
    assert (tokenfiles.expanded(sequence, left, right, first) == ids).all()
    assert len(sequence) <= count
    size = tokenfiles.lengths(left, right, first)
    each = [len(tokenfiles.expanded(np.array([first + k]), left, right, first))
            for k in range(len(left))]
    assert size.tolist() == each
    row = tokenfiles._row(0, 0, [1, 2, 3], ids, sizes, first).to_pylist()[0]
    for _ in range(50):
        a, b = sorted(rng.integers(0, count + 1, 2))
        assert (tokenfiles.decoded_range(row, a, b) == ids[a:b]).all()
    # Documents end between symbols.
    assert ends.tolist() == [0, 0, 0] if not count else (
        len(tokenfiles.expanded(sequence[:ends[0]], left, right, first)) == count // 2)


def test_repeated_ids_are_compressed():
    ids = np.tile([1, 2, 3, 4], 5000)
    sequence, left, _, _ = tokenfiles.compressed(ids, np.array([len(ids)]), 100)
    assert len(sequence) < len(ids) // 8 and len(left)


def test_files_hold_the_ids(spark):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, sf).collect()}
    encode = Tokenizer.from_file(tokenfiles.vocabulary_file()).encode
    at = 0
    for r in table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = [*encode(r.text, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (found[r.doc_id].start, found[r.doc_id].n_tokens, found[r.doc_id].ids_crc32) == (
            at, len(ids), crc)
        at += len(ids)
    assert len(found) == 200


def test_files_of_odd_rows(spark, documents, tmp_path):
    rows = [(3, "b"), (1, None), (2, ""), (None, "a b"), (3, "b"), (9, "long " * 40_000)]
    df = documents(rows, k=F.lit(1), ids=F.lit("x"), start=F.lit(2))
    tokenfiles.write_ids(df, f"{tmp_path}/ids", block_ids=10)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, len(r.ids))
                  for r in tokenfiles.read_ids(spark, f"{tmp_path}/ids").collect()),
                 key=lambda r: r[2])
    assert [r[1] for r in got] == [0, 1, 2, 3, 3, 9]
    assert [r[2] for r in got] == np.cumsum([0, *[r[3] for r in got][:-1]]).tolist()
    assert [r[3] for r in got][:5] == [3, 1, 1, 2, 2]
    tokenfiles.write_ids(documents([]), f"{tmp_path}/none")
    assert tokenfiles.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_transducer_against_the_library(spark):
    texts = odd_texts() + library_texts(spark)
    path = pieces.model_file()
    own = pieces.transducer(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, sizes = [], []
    for _, offsets, data in ragged.text_chunks(pa.array(texts), 50_000):
        i, s = own.encode(offsets, data)
        ids.append(i)
        sizes.append(s)
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    expected = library.encode(texts)
    assert parts(ids, sizes) == expected
    back = own.decode(ids, sizes)
    assert back == library.decode(expected)
    assert back == [t.replace("▁", " ") for t in texts]


def test_pieces_of_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "門\n"), (4, "long words " * 30_000)]
    df = documents(rows, ids=F.lit(1), _source=F.lit(2))
    both = pieces.decoded(pieces.encoded(df), text="back").collect()
    assert [r.back for r in sorted(both, key=lambda r: str(r.doc_id))] == [
        r[1] or "" for r in sorted(rows, key=lambda r: str(r[0]))]
    assert {len(r.ids) for r in both if r.doc_id in (1, 2)} == {0}
    assert pieces.decoded(pieces.encoded(documents([]))).count() == 0
    one_pass = pieces.encoded_and_decoded(df).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.back) for r in one_pass) == sorted(
        (str(r.doc_id), list(r.ids), r.back) for r in both)


def test_run_of_marks_like_the_library():
    path = pieces.model_file()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.transducer(path)
    for n in range(1, 80):
        assert own.run(n) == library.encode(" " * (n - 1)) or n == 1


def test_vocabulary_path_is_public():
    assert tokenfiles.vocabulary_file() == public_tokenizers.path("byte_bpe_50k.json")
