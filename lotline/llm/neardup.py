"""Near-duplicate documents: MinHash signatures joined by their coordinates.

1. A document's set is its distinct five-word shingles; equal sets are one
   class from here on.  A class has ``COORDINATES`` MinHash values.
2. Every (coordinate, value) is a posting list.  A pair of the similarity asked
   for agrees in ``MATCHES`` coordinates at least (five standard deviations
   below the mean number, 54 of 64), so a class that shares fewer values with
   others has no partner.  A class whose own shingles (those no other candidate
   has) are too large a share of its set has none either; this is exact.
3. Prefix: values are ordered by how many classes have them, rarest first.  Two
   classes that agree in ``MATCHES`` values meet in the first
   ``COORDINATES - MATCHES + 1`` of either, so only those are posted.
4. In each list every class meets the one with the fewest own shingles.
   Collisions of a pair are counted on the two value lists; pairs above the
   threshold are confirmed on the full sets.  Linked classes are merged.
5. Skip: only lists that hold more than one component are left, and in them
   only pairs of different components; they are compared in blocks of bounded
   size, then confirmed as before.

So links inside a merged component are not looked for again, and a large group
of near copies costs no list of all its pairs, while any link between two
components is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import join_counted, map_batches, texts_of, written
from .components import components

COORDINATES = 64
MATCHES = 40
PERCENT = 85        # 100 * intersection >= PERCENT * union
WORDS = 5
BLOCK = 1024        # members of a list compared by one task at a time
BUCKET_ROWS = 20_000

_MULTIPLIERS = T.mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, 32 bits each."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(out, (s[at: at + 4096, None] * _MULTIPLIERS).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, rid, n, k1, k2, sig) of documents (doc_id, text); k1 and k2 name
    the set (null and no signature for the empty set), rid the id and text."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, k1, k2, sig = [], [], [], []
        for w in T.documents_words(texts_of(b.column(1))):
            s = T.shingle_set(w, words)
            n.append(len(s))
            some = len(s) > 0
            k1.append(int(np.add.reduce(T.mix(s)).view(np.int64)) if some else None)
            k2.append(int(np.add.reduce(T.mix(s ^ T._ORDER[0])).view(np.int64)) if some else None)
            sig.append(signature(s).tobytes() if some else None)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
             pa.array(sig, pa.binary())], ["doc_id", "rid", "n", "k1", "k2", "sig"])
    return map_batches(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid")), run,
                       "doc_id long, rid long, n long, k1 long, k2 long, sig binary")


def _values(sig: np.ndarray) -> np.ndarray:
    """The (coordinate, value) pairs of signatures, as one number each."""
    return T.mix(sig.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(40))).view(np.int64)


def _postings(reps: DataFrame) -> DataFrame:
    """(value, v): one row for each coordinate of each class."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        return pa.RecordBatch.from_arrays(
            [pa.array(_values(sig).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), COORDINATES))], ["value", "v"])
    return map_batches(reps.select("v", "sig"), run, "value long, v long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(v, shingles) of documents (v, text)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [T.shingle_set(w, words).view(np.int64) for w in T.documents_words(texts_of(b.column(1)))]
        at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["v", "shingles"])
    return map_batches(docs.select("v", "text"), run, "v long, shingles array<long>")


def _possible(a: str, b: str, percent: int) -> str:
    """What n and own allow: neither can share its own shingles."""
    both = f"least({a}n - {a}own, {b}n - {b}own)"
    return f"100 * {both} >= {percent} * ({a}n + {b}n - {both})"


def _confirmed(pairs: DataFrame, members: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates and whose full sets are similar enough."""
    side = lambda x: members.select(F.col("v").alias(x), F.col("values").alias(f"{x}_values"),
                                    F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.size(F.array_intersect("a_values", "b_values")) >= matches)
    both = both.withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
    return both.where(100 * F.col("common") >= percent * (F.size("a_set") + F.size("b_set") - F.col("common"))
                      ).select("a", "b")


def _across(rows: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs of different components in blocks (bucket, value, low, high, side,
    v, n, own, c, sig, values): side 0 rows are of block ``low``, side 1 of
    ``high``.  A pair belongs to the list of the rarest value it shares."""
    def run(t: pa.Table) -> pa.Table:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        val, lo, hi = (t[c].to_numpy() for c in ("value", "low", "high"))
        side, v, n, own, c = (t[x].to_numpy() for x in ("side", "v", "n", "own", "c"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        held = _values(sig)
        rank = np.full(sig.shape, COORDINATES, dtype=np.int8)     # place of each coordinate in ``values``
        for i, x in enumerate(t["values"].to_pylist()):
            x = np.asarray(x)
            o = np.argsort(x)
            at = np.minimum(np.searchsorted(x, held[i], sorter=o), len(x) - 1)
            rank[i] = np.where(x[o[at]] == held[i], o[at], COORDINATES)
        order = np.lexsort((hi, lo, val))
        key = np.stack([val, lo, hi])[:, order]
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for g in np.split(order, cut):
            x = g[side[g] == 0]
            y = x if lo[g[0]] == hi[g[0]] else g[side[g] == 1]
            for i in x:
                both = np.minimum(n[i] - own[i], (n - own)[y])
                k = y[(c[y] != c[i]) & (100 * both >= percent * (n[i] + n[y] - both))]
                if y is x:
                    k = k[v[k] > v[i]]
                if len(k):
                    same = sig[k] == sig[i]
                    rarest = np.where(same, rank[i], COORDINATES).argmin(axis=1)
                    k = k[(same.sum(axis=1) >= matches) & (held[i][rarest] == val[i])]
                    left.append(np.minimum(v[k], v[i]))
                    right.append(np.maximum(v[k], v[i]))
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})
    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def _candidates(sigs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """(v, n, rid, sig, values) of classes that share enough values with others;
    ``values`` are those, rarest first."""
    reps = sigs.join(classes.select("k1", "k2", F.col("rep").alias("doc_id"), "v"), ["k1", "k2", "doc_id"])
    reps = written(reps.select("v", "n", "rid", "sig").dropDuplicates(["v"]), "values")
    postings = _postings(reps)
    shared = written(postings.groupBy("value").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    lists = postings.join(shared, "value").groupBy("v").agg(F.array_sort(F.collect_set(F.struct("held", "value"))).alias("x"))
    lists = written(lists.where(F.size("x") >= matches).select("v", F.col("x.value").alias("values")), "lists")
    return written(lists.join(reps, "v"), "candidates")


def _members(docs: DataFrame, found: DataFrame, percent: int, words: int) -> DataFrame:
    """Candidates with their full sets and the number of shingles that no other
    candidate has (``own``), but for those whose own shingles rule out any link."""
    text = join_counted(docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text"), found.select("rid", "v"), "rid", "inner")
    sets = written(_sets(text, words).dropDuplicates(["v"]), "sets")
    own = (sets.select("v", F.explode("shingles").alias("s")).groupBy("s")
           .agg(F.count("*").alias("k"), F.min("v").alias("v")).where("k = 1")
           .groupBy("v").agg(F.count("*").alias("own")))
    members = found.join(sets, "v").join(own, "v", "left").fillna(0, ["own"])
    members = members.where(f"100 * (n - own) >= {percent} * n")
    return written(members.select("v", "n", "own", "values", "sig", "shingles"), "members")


def _blocks(posted: DataFrame, group: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, in pairs of blocks (see ``_across``)."""
    at = posted.join(group.withColumnRenamed("id", "v"), "v", "left").withColumn("c", F.coalesce("component", "v"))
    mixed = at.groupBy("value").agg(F.count("*").alias("held"), F.min("c").alias("lo"), F.max("c").alias("hi")
                                    ).where("lo <> hi").select("value", "held")
    at = at.join(mixed, "value").join(members.select("v", "sig", "values"), "v")
    at = at.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    at = at.withColumn("own_block", F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = written(at.select(
        "value", F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high"),
        (F.col("own_block") > F.col("other")).cast("int").alias("side"), "v", "n", "own", "c", "sig", "values"), "across")
    buckets = max(1, -(-at.count() // BUCKET_ROWS))
    return at.withColumn("bucket", F.pmod(F.xxhash64("value", "low", "high"), F.lit(buckets)))


def _groups(members: DataFrame, percent: int, matches: int) -> DataFrame:
    """(id, component) of the members that have a link."""
    posted = members.select("v", "n", "own", F.explode(
        F.slice("values", F.lit(1), F.greatest(F.lit(0), F.size("values") - matches + 1))).alias("value"))
    # first pairs: each member with the one of the list that has least for itself
    heads = posted.groupBy("value").agg(F.min(F.struct("own", "v", "n")).alias("h"), F.count("*").alias("held")
                                        ).where("held > 1")
    first = (posted.join(heads, "value").where("v <> h.v").where(_possible("", "h.", percent))
             .select(F.least("v", "h.v").alias("a"), F.greatest("v", "h.v").alias("b")).distinct())
    links = written(_confirmed(first, members, matches, percent), "links")
    group = written(components(links), "groups")
    # then pairs across components
    second = _across(_blocks(posted, group, members), matches, percent).distinct()
    more = written(_confirmed(second, members, matches, percent), "links")
    return components(links.unionAll(more)) if more.limit(1).count() else group


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES, words: int = WORDS) -> DataFrame:
    """Components of similar documents (doc_id, text).

    Returns, for every row, doc_id, n_shingles (size of its set), component_id
    (the smallest doc_id that links lead to, itself included), kept (doc_id =
    component_id), group_id (of the component, null for the empty set) and rid
    (a hash of id and text; both tell rows of one id apart).  Null or empty
    texts, and texts without words, have the empty set and are linked with
    nothing.  Texts of fewer than ``words`` words have one shingle.  Rows with
    equal sets are linked.  Rows without an id take no part (component_id null,
    kept true).  Repeated rows come out as often as they went in.  Other columns
    are not looked at."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = written(signatures(docs, words), "signatures")
    classes = sigs.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes.withColumn("v", F.xxhash64("k1", "k2")), "classes")
    members = _members(docs, _candidates(sigs, classes, matches), percent, words)
    group = _groups(members, percent, matches)

    named = classes.join(group.withColumnRenamed("id", "v"), "v", "left").withColumn("c", F.coalesce("component", "v"))
    named = written(named.select("k1", "k2", "rep", "c"), "named")
    lowest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = written(named.join(lowest, "c").select("k1", "k2", "component_id", F.col("c").alias("group_id")), "named")
    out = sigs.select("doc_id", "rid", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "group_id", "rid")
