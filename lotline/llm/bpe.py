"""BPE encoding as a streaming transducer, and decoding as a state machine.

Encoding.  The merge list decides which neighbouring tokens may stand side by
side: ``a b`` may exactly if merging the symbols of both together gives ``a b``
back.  The encoding of a text is the one path of pairwise compatible tokens, so
it can be built from left to right: for every symbol position the transducer
keeps the last token of the path that ends there.  No token is longer than the
merge list's longest (``lookahead`` symbols), so only the last ``lookahead``
positions can be continued; what all of their paths share can no longer change
and is emitted.  Memory is a window of positions, however long the text.

Decoding.  ``Decoder`` is fed ids in pieces and gives out text as soon as it is
complete, holding back at most the bytes of one unfinished character.

Texts are read in pieces cut at white space; a null text is empty.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common, pretokens

PIECE = 1 << 16          # characters of a text handled at once
CACHE = 1 << 18          # words a worker remembers (about 60 MB)
PAIRS = 1 << 18          # and pairs of tokens


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Transducer:
    """Encodes one word (a byte string) after the other."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.rank = {tuple(m): r for r, m in enumerate(merges)}
        self.alphabet = byte_alphabet()
        units: dict[str, tuple[str, ...]] = {}      # token -> its single symbols
        for s in self.alphabet:
            for x in {s, s + suffix}:
                if x in vocab:
                    units[x] = (x,)
        for a, b in merges:
            if a in units and b in units and a + b in vocab:
                units[a + b] = units[a] + units[b]
        self.suffix = suffix
        self.known = set(x for x, u in units.items() if len(u) == 1)
        self.lookahead = max(map(len, units.values()), default=1)
        self.token = {vocab[t]: t for t in units}
        self.units = {vocab[t]: u for t, u in units.items()}
        # what a token can end with, inside a word and at its end: id, or -1 for an unfinished token
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t, u in units.items():
            ends = suffix and u[-1] != t[-1:]
            body = t[: -len(suffix)] if ends else t
            into = [self.final] if ends else [self.inner] if suffix else [self.inner, self.final]
            for d in into:
                for k in range(1, len(body)):
                    d.setdefault(body[k:], -1)
                d[body] = vocab[t]
        self._pairs: dict[int, bool] = {}

    def _merge(self, units: list[str]) -> list[str]:
        """Merges of a short run of symbols by rank, leftmost first."""
        rank = self.rank
        while len(units) > 1:
            best, at = None, 0
            for i, pair in enumerate(zip(units, units[1:])):
                r = rank.get(pair)
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            units[at: at + 2] = [units[at] + units[at + 1]]
        return units

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens may stand side by side."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        known = self._pairs[a << 32 | b] = self._merge([*self.units[a], *self.units[b]]) == [self.token[a], self.token[b]]
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word.  Symbols outside the vocabulary give no token, as
        there is no unknown token."""
        alphabet, known = self.alphabet, self.known
        text = "".join([alphabet[b] for b in word])
        if text and text[-1] + self.suffix in known and all(map(known.__contains__, text[:-1])):
            return self._encode_run(text, True)
        out: list[int] = []
        at = 0
        for i, c in enumerate(text):  # an unknown symbol ends a run
            if (c + self.suffix if i == len(text) - 1 else c) not in known:
                out += self._encode_run(text[at:i], False)
                at = i + 1
        return out + self._encode_run(text[at:], True)

    def _encode_run(self, text: str, ends: bool) -> list[int]:
        far, pairs, units = self.lookahead, self._pairs, self.units
        out: list[int] = []
        base, last = 0, [-1]        # last[i]: last token of the path to position base + i
        final = len(text) if ends else -1
        for end in range(1, len(text) + 1):
            table = self.final if end == final else self.inner
            for start in range(end - 1, base - 1, -1):
                t = table.get(text[start:end])
                if t is None:       # no token ends so
                    start = -1
                    break
                if t >= 0:
                    before = last[start - base]
                    if before < 0:
                        if start == 0:
                            break
                        continue
                    ok = pairs.get(before << 32 | t)
                    if ok or ok is None and self.compatible(before, t):
                        break
            else:
                start = -1
            if start < 0:
                raise ValueError("the merge list does not build its own tokens")
            last.append(t)
            if end - base > 8 * far:               # emit what all live paths share
                heads = {end - j for j in range(far)}
                while len(heads) > 1:
                    top = max(heads)
                    heads.discard(top)
                    heads.add(top - len(units[last[top - base]]))
                cut = heads.pop()
                if cut > base:
                    out += self._walk(last, cut - base)
                    last = last[cut - base:]
                    base = cut
        return out + self._walk(last, len(text) - base)

    def _walk(self, last: list[int], at: int) -> list[int]:
        path = []
        while at > 0:
            path.append(last[at])
            at -= len(self.units[last[at]])
        return path[::-1]


class Decoder:
    """Ids to text in pieces.

    Without a decoder in the tokenizer file, tokens are written with a space
    between them; with the byte-level decoder their bytes are joined and read
    as UTF-8, where a character may begin in one token and end in a later one."""

    def __init__(self, tokens: dict[int, str], byte_level: bool = False):
        self.byte_level = byte_level
        if byte_level:
            back = {c: b for b, c in enumerate(byte_alphabet())}
            self.pieces = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
                           for i, t in tokens.items()}
        else:
            self.pieces = {i: t.encode() for i, t in tokens.items()}
        self.reset()

    def reset(self) -> None:
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        self._first = True

    def feed(self, ids) -> str:
        if not len(ids):
            return ""
        if self.byte_level:
            return self._state.decode(b"".join(map(self.pieces.__getitem__, ids)))
        data = b" ".join(map(self.pieces.__getitem__, ids))
        if not self._first:
            data = b" " + data
        self._first = False
        return self._state.decode(data)

    def finish(self) -> str:
        out = self._state.decode(b"", True)
        self.reset()
        return out


class _Words(dict):
    """word -> ids as little-endian bytes; forgets everything when full."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.transducer.encode(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Tokenizer:
    """A tokenizer file with byte-level BPE after a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.lower = self.nfc = False
        norm = spec.get("normalizer") or {}
        for n in norm.get("normalizers", [norm] if norm else []):
            self.lower |= n["type"] == "Lowercase"
            self.nfc |= n["type"] == "NFC"
        pre = spec["pre_tokenizer"]
        split = next(p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split")
        self.pattern = pretokens.Splitter(split["pattern"]["Regex"])
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")"
                                     ) if self.added else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.words = _Words(self.transducer)
        self.decoder = Decoder({**{i: t for t, i in model["vocab"].items()}, **{i: t for t, i in self.added.items()}},
                               (spec.get("decoder") or {}).get("type") == "ByteLevel")

    def _plain(self, text: str) -> bytes:
        if self.nfc:
            text = pretokens.compose(text)
        if self.lower:
            text = pretokens.lower(text)
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode_pieces(self, text: str) -> Iterator[array]:
        """Ids of a text in pieces."""
        for part in pieces(text):
            if self.special is not None and "<" in part:
                found = b""
                for i, x in enumerate(self.special.split(part)):
                    found += array("I", [self.added[x]]).tobytes() if i % 2 else self._plain(x)
            else:
                found = self._plain(part)
            ids = array("I")
            ids.frombytes(found)
            yield ids


def pieces(text: str) -> Iterator[str]:
    """The text cut at spaces and line ends into parts of about ``PIECE`` characters."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            if cut <= at:
                found = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                cut = min(found, default=len(text))
            end = cut
        yield text[at:end]
        at = end


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(df: DataFrame, path: str, ids: bool = False, text_out: bool = False) -> DataFrame:
    """Encode and decode the ``text`` of each row (``doc_id``, ``text``).

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_sha256 (of the decoded text in UTF-8) and, if asked for,
    ``ids`` and ``decoded`` themselves.  Null texts are empty; every row stays,
    repeated rows and null ids too; other columns are not looked at."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>" * ids + ", decoded string" * text_out

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        tok = load(path)
        count, left, right, all_ids, all_text = [], [], [], [], []
        for x in b.column(1).to_pylist():
            n, h, g, own, said = 0, hashlib.sha256(), hashlib.sha256(), array("I"), []
            for part in tok.encode_pieces(x or ""):
                n += len(part)
                h.update(part)
                out = tok.decoder.feed(part)
                g.update(out.encode())
                if ids:
                    own.extend(part)
                if text_out:
                    said.append(out)
            rest = tok.decoder.finish()
            g.update(rest.encode())
            count.append(n)
            left.append(h.hexdigest())
            right.append(g.hexdigest())
            all_ids.append(list(own))
            all_text.append("".join([*said, rest]))
        cols = [b.column(0), pa.array(count, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids:
            cols.append(pa.array(all_ids, pa.list_(pa.int64())))
            names.append("ids")
        if text_out:
            cols.append(pa.array(all_text, pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(cols, names)

    return common.map_batches(df.select(df["doc_id"].cast("long").alias("doc_id"), "text"), run, schema)
