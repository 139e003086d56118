"""Byte-level BPE by a shuffle of distinct words: every distinct pre-token of the
whole table is encoded once, whatever the number of its places.

1. Documents are cut into pre-tokens, in blocks of about ``BLOCK`` bytes.  A block
   keeps its distinct words, dealt to buckets by their hash, and the word at each
   position as a number; both are written, packed.
2. Words are shuffled by bucket.  A bucket holds every occurrence of a word once a
   block, and encodes each distinct word once; the ids go back to the blocks.
3. Blocks take their ids by a shuffle on the block, put them at the words'
   positions, and cut the ids at the documents' ends.

A word that is a third of all text is one entry a block, in one bucket, so no task
gets more than its share; buckets and blocks grow in number with the text, not in
size.  Positions never meet the words again: what is shuffled is each block's
distinct words, their ids, and one or two bytes a position.

Decoding joins ids with the table of tokens' bytes: ``decode`` does so for any table
of ids by a DataFrame join; in step 3, where the ids of a block are in an array, the
same table (as long as the vocabulary) is looked up by id.

Defined cases: a null text is empty; every row stays, repeated rows and null ids
too; an empty table gives no rows; other columns are not looked at.  A document is
never split, so a block holds one document at least, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretokens import Splitter

BLOCK = 16 << 20            # characters of a block
BUCKET = 16 << 20           # bytes of text for each bucket of words
LAYOUT = -1                 # the bucket number of a block's own row


class Vocabulary:
    """Ranks of byte strings and the pattern that cuts a text into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word: while two neighbours have a rank together, those of the
        least rank (the leftmost of them) become one.  Candidates wait in a heap,
        so a word of n bytes takes n log n steps."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        end = list(range(1, n + 1))             # end[i]: where the part that starts at i ends, 0 if none does
        before = list(range(-1, n))             # before[i]: start of the part that ends at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, stop = heapq.heappop(heap)
            middle = end[start]
            if not middle or middle >= n or end[middle] != stop:
                continue                        # one of the two is no longer what it was
            end[start], end[middle], before[stop] = stop, 0, start
            if start and (r := ranks.get(word[before[start]: stop])) is not None:
                heapq.heappush(heap, (r, before[start], stop))
            if stop < n and (r := ranks.get(word[start: end[stop]])) is not None:
                heapq.heappush(heap, (r, start, end[stop]))
        out, at = [], 0
        while at < n:
            out.append(ranks[word[at: end[at]]])
            at = end[at]
        return out

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens by id, joined, and where each begins (and the last ends)."""
        tokens = {r: t for t, r in self.ranks.items()}
        row = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        return np.frombuffer(b"".join(row), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in row], dtype=np.int64)))


def _sizes(a: np.ndarray) -> np.ndarray:
    """Bits after the leading one of a + 1."""
    return (np.frexp(a.astype(np.float64) + 1)[1] - 1).astype(np.uint8)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed: bytes (uint8) as they are, other whole numbers below
    2**32 as their sizes in bits and then, size by size, the bytes that follow from
    them.  Numbers of one size are spread evenly, so this comes near to their entropy."""
    out = [np.array([len(arrays), *(x for a in arrays for x in (a.dtype != np.uint8, len(a)))], dtype="<u4").tobytes()]
    for a in arrays:
        if a.dtype == np.uint8:
            out.append(a.tobytes())
            continue
        sizes = _sizes(a)
        out.append(sizes.tobytes())
        for c in range(1, 33):
            v = a[sizes == c].astype(np.int64) + 1 - (1 << c)
            out += [((v >> j) & 255).astype(np.uint8).tobytes() for j in range(0, c, 8)] if len(v) else []
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    k = int(data[:4].view("<u4")[0])
    head = data[4: 4 + 8 * k].view("<u4").astype(np.int64)
    out, at = [], 4 + 8 * k
    for numbers, n in zip(head[::2].tolist(), head[1::2].tolist()):
        first = data[at: at + n]
        at += n
        if not numbers:
            out.append(first)
            continue
        a = np.zeros(n, dtype=np.int64)
        for c in range(1, 33):
            here = np.flatnonzero(first == c)
            if len(here):
                v = np.full(len(here), (1 << c) - 1, dtype=np.int64)
                for j in range(0, c, 8):
                    v += data[at: at + len(here)].astype(np.int64) << j
                    at += len(here)
                a[here] = v
        out.append(a)
    return out


def front_coded(rows: list) -> tuple[np.ndarray, np.ndarray, list]:
    """For sequences in sorted order: how many first members each has in common
    with the one before, how many follow, and those that follow."""
    common_, more, rest, last = [], [], [], ()
    for row in rows:
        k, most = 0, min(len(row), len(last))
        while k < most and row[k] == last[k]:
            k += 1
        common_.append(k)
        more.append(len(row) - k)
        rest.append(row[k:])
        last = row
    return np.array(common_, dtype=np.int64), np.array(more, dtype=np.int64), rest


def pack_words(words: list[bytes]) -> bytes:
    common_, more, rest = front_coded(words)
    return pack(common_, more, np.frombuffer(b"".join(rest), np.uint8))


def unpack_words(blob: bytes) -> list[bytes]:
    common_, more, data = unpack(blob)
    data, at, last, out = data.tobytes(), 0, b"", []
    for k, n in zip(common_.tolist(), more.tolist()):
        last = last[:k] + data[at: at + n]
        at += n
        out.append(last)
    return out


def pack_ids(rows: list[list[int]]) -> bytes:
    common_, more, rest = front_coded(rows)
    return pack(common_, more, np.array([i for r in rest for i in r], dtype=np.int64))


def unpack_ids(blob: bytes) -> tuple[np.ndarray, list[int]]:
    """(how many ids each word has, all of them)."""
    common_, more, data = unpack(blob)
    data, at, last, out = data.tolist(), 0, [], []
    for k, n in zip(common_.tolist(), more.tolist()):
        last = last[:k] + data[at: at + n]
        at += n
        out += last
    return common_ + more, out


def take_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start: start + size] of every run, one after the other."""
    shift = starts - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else starts
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class _Block:
    """Distinct words of some documents and the word at each position."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str, split: Splitter) -> None:
        index = self.index
        self.codes.append(np.array([index.setdefault(w, len(index)) for w in split.findall(text)], dtype=np.uint32))
        self.doc_ids.append(doc_id)
        self.size += len(text)

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        """(block, bucket, words, doc_ids, layout): one row for each bucket that gets words, and the layout."""
        words = [w.encode() for w in self.index]
        home = np.array([zlib.crc32(w) % buckets for w in words], dtype=np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        order = np.array(order, dtype=np.int64)[np.argsort(home[order], kind="stable")]
        for b in np.unique(home).tolist():
            yield block, b, pack_words([words[i] for i in order[home[order] == b]]), None, None
        codes = np.concatenate([*self.codes, np.empty(0, np.uint32)]).astype(np.int64)
        # Frequent words get small numbers, which take less room.  place: where a number's word is in (bucket,
        # word) order; equally frequent words keep that order, so steps from one to the next are short.
        place = np.argsort(-np.bincount(codes, minlength=len(words))[order], kind="stable")
        number = np.empty(len(words), np.int64)
        number[order[place]] = np.arange(len(words))
        steps = np.diff(place, prepend=0)
        yield block, LAYOUT, None, self.doc_ids, pack(np.array([len(c) for c in self.codes], dtype=np.int64),
                                                      np.where(steps < 0, -2 * steps - 1, 2 * steps), number[codes])


PARTS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()),
                   ("doc_ids", pa.list_(pa.int64())), ("layout", pa.binary())])


def _blocks(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, count = Splitter(pattern), _Block(), 0

        def out() -> pa.RecordBatch:
            rows = block.rows((TaskContext.get().partitionId() << 32) + count, buckets)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PARTS.types)], schema=PARTS)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block.add(doc_id, text or "", split)
                if block.size >= BLOCK:
                    yield out()
                    block, count = _Block(), count + 1
        if block.doc_ids:
            yield out()
    return run


def _encode_bucket(vocabulary: Broadcast):
    def run(part: pa.Table) -> pa.Table:
        encode, known, coded = vocabulary.value.encode, {}, []
        for blob in part.column("words").to_pylist():
            row = []
            for w in unpack_words(blob):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = encode(w)
                row.append(ids)
            coded.append(pack_ids(row))
        return pa.table({"block": part.column("block"), "bucket": part.column("bucket"),
                         "coded": pa.array(coded, pa.binary())})
    return run


def _assemble(vocabulary: Broadcast, ids_out: bool, text_out: bool):
    def run(layout: pa.Table, coded: pa.Table) -> pa.Table:
        flat, begins = vocabulary.value.pieces()
        parts = [unpack_ids(x) for x in coded.sort_by("bucket").column("coded").to_pylist()]
        counts = np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)])
        ids = np.array([i for p in parts for i in p[1]], dtype="<u4")
        starts = np.concatenate(([0], np.cumsum(counts)))
        doc_ids = layout.column("doc_ids").to_pylist()[0]
        n_words, steps, numbers = unpack(layout.column("layout").to_pylist()[0])
        place = np.cumsum(np.where(steps % 2, -(steps + 1) // 2, steps // 2))
        ends = np.cumsum(n_words, dtype=np.int64)
        n_tokens, left, right, own, said = [], [], [], [], []
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            words = place[numbers[a:b]]
            mine = take_runs(ids, starts[words], counts[words])
            text = take_runs(flat, begins[mine], np.diff(begins)[mine]).tobytes()
            n_tokens.append(len(mine))
            left.append(hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest())
            right.append(hashlib.sha256(text).hexdigest())
            own.append(mine.astype(np.int64) if ids_out else None)
            said.append(text if text_out else None)
        out = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()),
               "ids_sha256": pa.array(left, pa.string()), "decoded_sha256": pa.array(right, pa.string())}
        if ids_out:
            out["ids"] = pa.array(own, pa.list_(pa.int64()))
        if text_out:
            out["decoded"] = pa.array(said, pa.binary())
        return pa.table(out)
    return run


def encode(df: DataFrame, vocabulary: Vocabulary, ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encode and decode the ``text`` of each row (``doc_id``, ``text``).

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit
    integers), decoded_sha256 (of the decoded bytes) and, if asked for, ``ids``
    and ``decoded`` (bytes) themselves."""
    spark = df.sparkSession
    common.ship(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    shared = spark.sparkContext.broadcast(vocabulary)
    parts = common.written(docs.mapInArrow(
        _blocks(vocabulary.pattern, buckets),
        "block long, bucket int, words binary, doc_ids array<long>, layout binary"), "blocks")
    coded = (parts.where(F.col("bucket") != LAYOUT).select("block", "bucket", "words")
             .groupBy("bucket").applyInArrow(_encode_bucket(shared), "block long, bucket int, coded binary"))
    layout = parts.where(F.col("bucket") == LAYOUT).select("block", "doc_ids", "layout")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>" * ids + ", decoded binary" * decoded
    return layout.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(shared, ids, decoded), schema)


def token_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(id, bytes) of every token."""
    return spark.createDataFrame([(r, bytearray(t)) for t, r in vocabulary.ranks.items()], "id long, bytes binary")


def decode(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids): the ids are exploded with their
    positions, joined with the token table and put together by position.  Every row
    stays; null ids or none give empty bytes; an id that no token has gives none."""
    rows = common.written(df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                    F.col("ids").cast("array<long>").alias("ids")), "ids")
    tokens = token_table(df.sparkSession, vocabulary).select("id", F.hex("bytes").alias("piece"))
    places = rows.select("row", F.posexplode("ids").alias("pos", "id"))
    joined = common.join_counted(places, tokens, "id", "inner").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("found"))
    return rows.select("row", "doc_id").join(joined, "row", "left").select(
        "doc_id", F.unhex(F.coalesce(F.array_join("found.piece", ""), F.lit(""))).alias("decoded"))
