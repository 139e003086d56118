"""Byte-level BPE against the tiktoken library."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lotline.llm import wordshuffle as W
from lotline.llm.pretokens import Splitter
from lotline.llm.queries import QUERIES, RANKS
from tests.llm.conftest import SF, docs

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def vocabulary():
    return W.Vocabulary.read(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


EDGES = ["", " ", "\n\t \n", "a", "Hello World's end, it'll do", "<|endoftext|> x", "été  naïve x", "😂" * 300,
         "a" * 3000, "ab" * 2000, "   lead and trail   ", "12½ ٣ 4", "\x00\x01​", "'s't 'RE", "word " * 3000,
         "՘a \U00033000b ౜1 \U000125502", "x\r\n\r\n  y", "日本語テキスト"]


def _want(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_words_like_the_library(vocabulary, library):
    rnd = random.Random(5)
    for _ in range(3000):
        letters = rnd.choice(["ab", "a", "etaoinshr", "éüß", "😂日本", "0123456789", " \n\t", "ABCxyz'-_"])
        word = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 5, 20, 200])))
        assert vocabulary.encode(word.encode()) == library._encode_single_piece(word)


def test_split_of_every_code_point(library):
    """The pattern's classes are those of the library, for every code point, between letters and numbers."""
    split = Splitter(public_tokenizers.PATTERN)
    # single bytes as tokens, and one token for any word that the library could take whole
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={bytes([i]): i for i in range(256)})
    for kind, want in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]"), (r"\s", r"\s")):
        one = tiktoken.Encoding("one", pat_str=want, special_tokens={}, mergeable_ranks={bytes([i]): i for i in range(256)})
        text = "".join(points)
        theirs = one.decode_bytes(one.encode_ordinary(text)).decode()
        assert "".join(Splitter(kind).findall(text)) == theirs, kind
    text = "".join("ab" + c + "cd1" for c in points)
    assert "".join(split.findall(text)) == text == plain.decode(plain.encode_ordinary(text))


@pytest.mark.parametrize("block", [1, 200, W.BLOCK])
def test_rows_like_the_library(spark, vocabulary, library, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "BUCKET", 5000)
    rows = list(enumerate(EDGES)) + [(0, "again"), (0, "again"), (None, "no id"), (99, None), (None, None)]
    got = W.encode(docs(spark, rows).repartition(3), vocabulary, ids=True, decoded=True)
    assert _got(got) == _want(library, rows)
    for r in got.collect():
        text = bytes(r.decoded).decode()
        assert list(r.ids) == library.encode_ordinary(text)
    assert W.encode(docs(spark, rows).limit(0), vocabulary).count() == 0
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]


def test_a_word_is_encoded_once(spark, vocabulary, monkeypatch, tmp_path):
    """Of all blocks of a bucket, every distinct word reaches the encoder once."""
    calls = []

    class Counting(W.Vocabulary):
        def encode(self, word):
            calls.append(word)
            return super().encode(word)

    class Box:
        value = Counting(vocabulary.ranks, vocabulary.pattern)
    import pyarrow as pa
    words = [b" the", b" cat", b"x" * 500]
    part = pa.table({"block": [1, 2, 3], "bucket": [0, 0, 0],
                     "words": pa.array([W.pack_words(words), W.pack_words(words[:2]), W.pack_words([])], pa.binary())})
    W._encode_bucket(Box)(part)
    assert sorted(calls) == sorted(words)


def test_decode_joins_the_token_table(spark, vocabulary, library):
    rows = [(i, library.encode_ordinary(t)) for i, t in enumerate(EDGES)] + [(3, []), (None, None), (5, [10 ** 9])]
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "doc_id long, ids array<int>, row string, pos int")
    got = sorted(((r.doc_id, bytes(r.decoded)) for r in W.decode(df, vocabulary).collect()), key=repr)
    want = [(i, t.encode()) for i, t in enumerate(EDGES)] + [(3, b""), (None, b""), (5, b"")]
    assert got == sorted(want, key=repr)


def test_packing():
    for arrays in ([], [np.array([], int)], [np.array([1, 70000, 2 ** 32 - 1]), np.array([0] * 5)],
                   [np.frombuffer(b"bytes \x00\xff", np.uint8), np.arange(3000), np.array([], np.uint8)]):
        back = W.unpack(W.pack(*arrays))
        assert len(back) == len(arrays) and all((a == b).all() for a, b in zip(arrays, back))
    rows = [[], [1], [1, 2], [1, 2, 3], [70000], [1]]
    counts, ids = W.unpack_ids(W.pack_ids(rows))
    assert counts.tolist() == [0, 1, 2, 3, 1, 1] and ids == [i for r in rows for i in r]
    words = [b"", b"a", "é".encode(), b"\x00\n", b"z" * 100000]
    assert W.unpack_words(W.pack_words(words)) == words and W.unpack_words(W.pack_words([])) == []


def test_whole_table(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(QUERIES["op11_byte_bpe"](spark, SF)) == _want(library, rows)
