"""Approximate nearest neighbours by inner product: a graph per shard.

Vectors are dealt over shards by a hash of their id.  In each shard a
hierarchical navigable small-world graph is built, level by level arrays of
neighbour places (-1: none), and stored in the shared folder as flat arrays.
Queries then visit every shard in blocks; the nearest of each shard are merged.

Inner products become distances by one more coordinate, sqrt(m - |x|^2) with m
the largest |x|^2 of the shard (0 for queries), so the graph's geometry is
Euclidean.  Vectors are inserted in batches no larger than a quarter of the
graph that is there, and many searches go forward together in lockstep, as
array operations.  Results are scored again in double precision on the
original vectors.  Equal vectors are one node; the ids of those that several
rows have are in a written table, with which hits are expanded.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, scratch, written
from .warc import filesystem

LINKS = 16                 # neighbours on upper levels; twice as many on the lowest
BUILD_WIDTH = 64
SEARCH_WIDTH = 160
MIN_SHARDS = 12
SHARD_BYTES = 4 << 20       # of vectors, in double precision, in one shard: recall falls as shards grow
QUERY_BLOCK = 4096
LOCKSTEP = 256
VISITED_BYTES = 64 << 20


class Graph:
    """vectors: float32 rows; levels: from the lowest, (places, neighbours), where
    ``places`` are the rows on a level and ``neighbours`` rows of rows."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], entry: int):
        self.vectors, self.levels, self.entry = vectors, levels, entry
        self.norms = np.einsum("ij,ij->i", vectors, vectors)

    def _step(self, q: np.ndarray, best: np.ndarray, dist: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of many queries at once on one level, from the
        places ``best`` (-1: none).  Returns the nearest places and distances, sorted."""
        neighbours = self.levels[level]
        n, b = len(self.vectors), len(q)
        seen = np.zeros((b, n), dtype=bool)
        row = np.arange(b)[:, None]
        pad = width - best.shape[1]
        if pad > 0:
            best = np.pad(best, ((0, 0), (0, pad)), constant_values=-1)
            dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        seen[np.broadcast_to(row, best.shape)[best >= 0], best[best >= 0]] = True
        open_ = best >= 0
        qn = np.einsum("ij,ij->i", q, q)
        live = np.arange(b)
        while len(live):
            d = np.where(open_[live], dist[live], np.inf)
            at = d.argmin(axis=1)
            some = np.isfinite(d[np.arange(len(live)), at])
            live, at = live[some], at[some]
            if not len(live):
                break
            open_[live, at] = False
            near = neighbours[best[live, at]]
            ok = near >= 0
            ok &= ~seen[live[:, None], near]
            seen[np.broadcast_to(live[:, None], near.shape)[ok], near[ok]] = True
            nd = np.full(near.shape, np.inf, dtype=np.float32)
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            p = near[r, c]
            nd[r, c] = self.norms[p] + qn[live[r]] - 2 * np.einsum("ij,ij->i", self.vectors[p], q[live[r]])
            nd[nd >= dist[live, -1][:, None]] = np.inf
            busy = np.isfinite(nd).any(axis=1)
            live_b = live[busy]
            if len(live_b):
                all_d = np.concatenate([dist[live_b], nd[busy]], axis=1)
                all_p = np.concatenate([best[live_b], near[busy]], axis=1)
                all_o = np.concatenate([open_[live_b], np.isfinite(nd[busy])], axis=1)
                o = np.argsort(all_d, axis=1, kind="stable")[:, :width]
                k = np.arange(len(live_b))[:, None]
                dist[live_b], best[live_b], open_[live_b] = all_d[k, o], all_p[k, o], all_o[k, o]
        best[~np.isfinite(dist)] = -1
        return best, dist

    def search(self, q: np.ndarray, width: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Nearest places of each query on level ``down_to``: greedy on the levels above."""
        best = np.full((len(q), 1), self.entry)
        dist = ((self.vectors[self.entry] - q) ** 2).sum(axis=1, dtype=np.float32)[:, None]
        for level in range(len(self.levels) - 1, down_to - 1, -1):
            best, dist = self._step(q, best, dist, width if level == down_to else 1, level)
        return best, dist


def _diverse(vectors: np.ndarray, best: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Of sorted candidates, those nearer to the new vector than to any chosen
    before; free places go to the nearest of the others.  -1: none."""
    b, k = best.shape
    x = vectors[np.maximum(best, 0)]
    norm = np.einsum("bkd,bkd->bk", x, x)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((b, k), dtype=bool)
    near = np.full((b, k), np.inf, dtype=np.float32)      # to the nearest one chosen
    for j in range(k):
        take = (best[:, j] >= 0) & (dist[:, j] < near[:, j]) & (chosen.sum(axis=1) < keep)
        chosen[:, j] = take
        near[take] = np.minimum(near[take], between[take, j])
    order = np.argsort(~chosen * k * 2 + (best < 0) * k * 4 + np.arange(k), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(best, order, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, keep - k))), constant_values=-1)


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """Graph of float32 rows; the rows with the highest levels go in first."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    top = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 12)
    order = np.argsort(-top, kind="stable")
    height = int(top.max()) + 1
    levels = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(height)]
    g = Graph(vectors, levels, int(order[0]))
    done = 1
    while done < n:
        batch = order[done: done + min(LOCKSTEP, max(1, done // 4), max(1, VISITED_BYTES // n))]
        g_top = top[batch]
        q = vectors[batch]
        best = np.full((len(batch), 1), g.entry)
        dist = ((vectors[g.entry] - q) ** 2).sum(axis=1, dtype=np.float32)[:, None]
        for level in range(height - 1, -1, -1):
            joins = g_top >= level
            if not joins.any():
                best, dist = g._step(q, best, dist, 1, level)
                continue
            best, dist = g._step(q, best[:, :1].copy(), dist[:, :1].copy(), BUILD_WIDTH, level)
            keep = levels[level].shape[1]
            chosen = _diverse(vectors, best[joins], dist[joins], keep // 2 if level == 0 else keep)
            rows = batch[joins]
            levels[level][rows, : chosen.shape[1]] = chosen
            _link_back(vectors, levels[level], rows, chosen)
        done += len(batch)
    return g


def _link_back(vectors: np.ndarray, neighbours: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
    """Enter ``rows`` with the neighbours chosen for them; full lists are chosen anew."""
    r, c = np.nonzero(chosen >= 0)
    to, new = chosen[r, c], rows[r]
    o = np.argsort(to, kind="stable")
    to, new = to[o], new[o]
    place, first, count = np.unique(to, return_index=True, return_counts=True)
    keep = neighbours.shape[1]
    most = int(count.max(initial=0))
    cand = np.full((len(place), keep + most), -1, dtype=np.int64)
    cand[:, :keep] = neighbours[place]
    cand[np.repeat(np.arange(len(place)), count), keep + np.arange(len(to)) - np.repeat(first, count)] = new
    full = (cand >= 0).sum(axis=1) > keep
    some = cand[~full]
    some = np.take_along_axis(some, np.argsort(some < 0, axis=1, kind="stable"), axis=1)
    neighbours[place[~full]] = some[:, :keep]
    for part in np.array_split(np.flatnonzero(full), max(1, full.sum() // 512)):
        if len(part):
            x = cand[part]
            d = ((vectors[np.maximum(x, 0)] - vectors[place[part]][:, None]) ** 2).sum(axis=2)
            d[x < 0] = np.inf
            s = np.argsort(d, axis=1, kind="stable")
            x, d = np.take_along_axis(x, s, axis=1), np.take_along_axis(d, s, axis=1)
            neighbours[place[part]] = _diverse(vectors, x, d, keep)


# ---------------------------------------------------------------- Spark
def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: not null, not
    zero, without null or non-finite components, with an id."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & good & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def index(vectors: DataFrame, folder: str, shards: int) -> DataFrame:
    """Builds the graph of each shard of different vectors (equal lengths; vec_id,
    the smallest of the vector, vid, many, embedding) and writes it below ``folder``; returns (shard, path, rows, dim)."""
    def run(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        t = t.sort_by([("vec_id", "ascending"), ("vid", "ascending")])      # the same graph whatever the order of arrival
        x = _matrix(t["embedding"])
        ids, vids, many = t["vec_id"].to_numpy(), t["vid"].to_numpy(), t["many"].to_numpy().astype(np.int8)
        square = np.einsum("ij,ij->i", x, x)
        space = np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)
        g = build(space)
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        path = f"{folder}/shard-{shard}-{uuid.uuid4().hex}.parquet"
        flat = lambda a: [a.tobytes()]
        cols = {"ids": flat(ids), "vids": flat(vids), "many": flat(many), "vectors": flat(x), "space": flat(space), "entry": [g.entry],
                **{f"level{k}": flat(v) for k, v in enumerate(g.levels)}}
        pq.write_table(pa.table(cols), filesystem(path)[1], filesystem=fs)
        return pa.table({"shard": [shard], "path": [path], "rows": [len(x)], "dim": [x.shape[1]]})
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInArrow(run, "shard long, path string, rows long, dim long"), "graphs")


_open: dict[str, tuple] = {}


def _load(path: str, rows: int, dim: int) -> tuple:
    if path not in _open:
        _open.clear()
        fs, at = filesystem(path)
        t = pq.read_table(at, filesystem=fs)
        get = lambda name, kind: np.frombuffer(t[name][0].as_py(), dtype=kind)
        levels = [get(c, np.int32).reshape(rows, -1) for c in t.column_names if c.startswith("level")]
        g = Graph(get("space", np.float32).reshape(rows, -1), levels, t["entry"][0].as_py())
        _open[path] = (g, get("ids", np.int64), get("vids", np.int64), get("many", np.int8) > 0, get("vectors", np.float64).reshape(rows, dim))
    return _open[path]


def nearest(vectors: DataFrame, queries, k: int = 20, width: int = SEARCH_WIDTH, min_shards: int = MIN_SHARDS,
            shard_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest found for each vector that ``queries`` (a condition on
    vec_id) selects: query_id, rank (from 1), vec_id, score, nearest first, ties
    to the smaller vec_id.  Candidates are all other usable vectors of the same
    length; with fewer than ``k``, all.  Vectors that are null, zero or hold
    null or non-finite components take no part; of rows equal in id and vector
    one does.  An id with several vectors is asked for with each, has an answer
    for each, and is a candidate with each.  Other columns are not looked at."""
    spark = vectors.sparkSession
    good = written(usable(vectors).dropDuplicates(["vec_id", "embedding"]), "vectors")
    lengths = [r[0] for r in good.select(F.size("embedding")).distinct().collect()]
    parts = [_nearest(spark, good.where(F.size("embedding") == n), queries, k, width, min_shards,
                      shard_rows or max(1, SHARD_BYTES // (8 * n))) for n in sorted(lengths)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _different(good: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each different vector once (vec_id, its smallest, vid, many: several rows
    have it, embedding), and (low, vid, vec_id) of those with many: an answer
    needs the ``k`` + 1 smallest ids at most, the query's own among them."""
    w = W.partitionBy("embedding").orderBy("vec_id")
    rows = good.withColumn("r", F.row_number().over(w)).withColumn(
        "low", F.min("vec_id").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("r") <= k + 1)
    rows = written(rows.withColumn("vid", F.xxhash64("embedding")), "members")
    several = rows.where("r = 2").select("low", "vid", F.lit(True).alias("many"))
    several = written(several, "several")
    different = join_counted(rows.where("r = 1").select("low", "vid", "embedding"), several, ["low", "vid"], "left")
    members = join_counted(rows.select("low", "vid", "vec_id"), several.select("low", "vid"), ["low", "vid"], "left_semi")
    return (written(different.select(F.col("low").alias("vec_id"), "vid", F.coalesce("many", F.lit(False)).cast("int").alias("many"),
                                     "embedding"), "different"), written(members, "ids"))


def _search(g: Graph, x: np.ndarray, q: np.ndarray, k: int, width: int) -> np.ndarray:
    """Places found for each query (-1: none), at least ``width``; where the last of
    them scores as the answers' last does, so that others of that score may have
    been left out, the search is made twice as wide."""
    rows = len(x)
    width = min(width, max(rows, 2))
    best, _ = g.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), width)
    if width >= rows:
        return best
    score = np.einsum("bkd,bd->bk", x[np.maximum(best, 0)], q)
    score[best < 0] = -np.inf
    score = -np.sort(-score, axis=1)
    many = (best >= 0).sum(axis=1)
    # one more than k: the query's own vector may be among them
    tied = np.flatnonzero((many > k) & (score[:, min(k, width - 1)] == score[np.arange(len(q)), np.maximum(many, 1) - 1]))
    for part in np.array_split(tied, max(1, len(tied) * width // (LOCKSTEP * SEARCH_WIDTH))):
        if len(part):
            more = _search(g, x, q[part], k, 2 * width)
            best = np.pad(best, ((0, 0), (0, max(0, more.shape[1] - best.shape[1]))), constant_values=-1)
            best[part, : more.shape[1]] = more
    return best


def _nearest(spark, good, queries, k, width, min_shards, shard_rows) -> DataFrame:
    different, members = _different(good, k)
    count = different.count()
    shards = max(1, min(min_shards, -(-count // 64)), -(-count // shard_rows))
    graphs = index(different, scratch(spark, "hnsw"), shards)
    asked = good.where(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).withColumn("qv", F.xxhash64("q"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = written(asked.repartition(blocks), "queries")

    def run(t: pa.Table) -> pa.Table:
        path, rows, dim = (t[c][0].as_py() for c in ("path", "rows", "dim"))
        g, ids, vids, many, x = _load(path, rows, dim)
        q, qid, qv = _matrix(t["q"]), t["query_id"].to_numpy(), t["qv"].to_numpy()
        out: list[list] = [[], [], [], [], [], []]
        step = max(1, min(LOCKSTEP, VISITED_BYTES // rows))
        for at in range(0, len(q), step):
            best = _search(g, x, q[at: at + step], k, max(width, 2 * k + 2))
            own = np.arange(len(best))[:, None] + np.zeros_like(best)
            # a vector of the query's own id alone is no answer; of many, other ids may be
            ok = (best >= 0) & ((ids[best] != qid[at: at + step][:, None]) | many[best])
            o, p = own[ok], best[ok]
            score = np.einsum("ij,ij->i", x[p], q[at: at + step][o])
            order = np.lexsort((ids[p], -score, o))
            o, p, score = o[order], p[order], score[order]
            mine = ids[p] == qid[at: at + step][o]         # other ids of these come later: beside the k
            before = np.cumsum(~mine) - ~mine
            rank = before - before[np.searchsorted(o, o)]
            top = mine | (rank < k)
            o, p = o[top], p[top]
            for to, part in zip(out, (qid[at: at + step][o], qv[at: at + step][o], ids[p], vids[p], many[p], score[top])):
                to.append(part)
        return pa.table(dict(zip(("query_id", "qv", "low", "vid", "many", "score"), map(np.concatenate, out))))

    # a task for each block of queries and shard
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    visits = asked.withColumn("block", block).withColumn("shard", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    visits = visits.join(graphs, "shard")
    found = written(visits.groupBy("shard", "block").applyInArrow(
        run, "query_id long, qv long, low long, vid long, many boolean, score double"), "found")
    alone = found.where("not many").select("query_id", "qv", F.col("low").alias("vec_id"), "score")
    expanded = join_counted(found.where("many"), members, ["low", "vid"], "inner").where("vec_id <> query_id")
    found = alone.unionByName(expanded.select("query_id", "qv", "vec_id", "score"))
    w = W.partitionBy("query_id", "qv").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
