import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from lotline.llm import bpe
from lotline.llm.queries import VOCABULARY
from tests.llm.conftest import SF, docs

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def both():
    return bpe.load(PATH), Library.from_file(PATH)


def _ids(tok, text):
    return [i for part in tok.encode_pieces(text) for i in part]


EDGES = ["", " ", "\n\t", "a", "HELLO's World", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "ΟΔΟΣ ΑΣ İ ẞ ǅ", "é é",
         "😂" * 3000, "a" * 20000, "ab" * 9000, "the" * 5000, "12 ½ ٣", "\x00\x01​", "'s't 'RE", "word " * 30000]


def test_same_ids_and_text_as_the_library(both):
    tok, lib = both
    rnd = random.Random(3)
    texts = list(EDGES)
    for _ in range(400):
        letters = rnd.choice(["ab", "aeinrsth o", "<|endoftxsar>| ", "éèàçüß ", "😂❤️ a", "'stremvd ", "Σσς İıΩ ", "0123 x½"])
        texts.append("".join(rnd.choice(letters) for _ in range(rnd.choice([1, 5, 30, 300]))))
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        assert _ids(tok, text) == want, text[:40]
        out = "".join(tok.decoder.feed(want[i: i + 7]) for i in range(0, len(want), 7)) + tok.decoder.finish()
        assert out == lib.decode(want, skip_special_tokens=False)


def test_pieces_do_not_change_the_ids(both, monkeypatch):
    tok, _ = both
    text = "Some words, été <|endoftext|> and more " * 50 + "y" * 300
    want = _ids(tok, text)
    for n in (1, 10, 333):
        monkeypatch.setattr(bpe, "PIECE", n)
        assert "".join(bpe.pieces(text)) == text and _ids(tok, text) == want


def test_window_stays_bounded(both):
    """The transducer emits along the way: a long word keeps a window of positions only."""
    tr = both[0].transducer
    sizes = []
    walk = tr._walk
    tr._walk = lambda last, at: sizes.append(len(last)) or walk(last, at)
    try:
        tr._encode_run("ab" * 20000, False)
    finally:
        del tr._walk
    assert len(sizes) > 100 and max(sizes) <= 16 * tr.lookahead


def test_byte_level_decoder_holds_back_unfinished_characters():
    alphabet = bpe.byte_alphabet()
    tokens = {i: alphabet[b] for i, b in enumerate("é😂".encode())}
    d = bpe.Decoder(tokens, byte_level=True)
    assert [d.feed([i]) for i in range(6)] == ["", "é", "", "", "", "😂"]
    assert d.feed([0]) == "" and d.finish() == "�"


def test_query_rows(spark, both):
    lib = both[1]
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(0, "again"), (0, "again"), (None, "no id"), (99, None)]
    got = sorted((tuple(r) for r in bpe.encode(docs(spark, rows), PATH).collect()), key=repr)
    want = []
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(e), sha(b"".join(x.to_bytes(4, "little") for x in e)),
                     sha(lib.decode(e, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=repr)
    full = bpe.encode(docs(spark, rows[4:5]), PATH, ids=True, text_out=True).first()
    assert list(full.ids) == lib.encode(rows[4][1], add_special_tokens=False).ids and full.decoded.startswith("hello</w>")
    assert bpe.encode(docs(spark, rows).limit(0), PATH).count() == 0


def _hashes(lib, text):
    ids = lib.encode(text, add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(),
            hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_whole_table(spark, both):
    from lotline.llm.queries import QUERIES
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe_codec"](spark, SF).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _hashes(both[1], rows.pop(r.doc_id))
    assert not rows


@pytest.mark.parametrize("form", ["ab{}cd1", "{}", "a{}\u0301\u0323", "\u1ea1{}\u0301 x"])
def test_every_code_point(both, form):
    """Between letters and numbers; alone and among combining marks those below U+20000 (no marks are above)."""
    tok, lib = both
    texts = [form.format(chr(c)) for c in range(0x110000 if form == "ab{}cd1" else 0x20000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(texts), 1 << 12):
        text = " ".join(texts[at: at + (1 << 12)])
        if _ids(tok, text) != lib.encode(text, add_special_tokens=False).ids:
            wrong = [t for t in texts[at: at + (1 << 12)] if _ids(tok, t) != lib.encode(t, add_special_tokens=False).ids]
            assert not wrong, [hex(ord(c)) for c in "".join(wrong[:20])]
            raise AssertionError("only together")
