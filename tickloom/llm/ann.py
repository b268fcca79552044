"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Vectors are dealt to shards of about SHARD rows by a hash of their id. A shard's vectors get one
more component that makes all norms equal, so the largest inner product is the smallest
distance, and one node for each different vector (copies share it: of a node's ids only the
TOP + 1 smallest can ever be among the nearest, so the others are not stored). The graph is built
by inserting nodes in random order, a batch at a time: a greedy beam search from the medoid over
the graph so far proposes neighbours, and relaxed distance pruning keeps a candidate only if no
kept one is ALPHA times nearer to it than the node is; reverse edges are pruned the same way.
One more edge for each node along a random cycle makes every node reachable. Every shard is
searched for every query with a beam, queries in blocks; scores are then computed exactly in
double precision on the original vectors, and the best of all shards are merged.

Defined results: rows without vec_id or whose vector is null, zero, of another length than most,
or holds a null or non-finite component take no part; rows repeating a vec_id count once, with
the smallest vector; equal scores rank by vec_id; with fewer candidates than TOP all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import staged, table

TOP = 20
SHARD = 8192
QUERY_BLOCK = 4096
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 128
ALPHA = 1.2


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, wide: int = 4, visited: bool = False):
    """Node ids (Q, beam) nearest first, -1 for none; with ``visited`` also the bitmap of seen nodes.

    All queries move together; each step expands the ``wide`` best unexpanded nodes of each.
    """
    n, m = len(x), len(q)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    ids = np.full((m, beam), n, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = ((q - x[entry]) ** 2).sum(1)
    seen[:, entry] = True
    todo = ids < n
    xx = (x * x).sum(1)
    live = np.arange(m)
    while len(live):
        best = np.argpartition(np.where(todo[live], dist[live], np.inf), min(wide, beam - 1), axis=1)[:, :wide]
        pick = np.take_along_axis(ids[live], best, 1)
        ok = np.take_along_axis(todo[live], best, 1)
        todo[live[:, None], best] = False
        near = np.where(ok[:, :, None], graph[np.where(ok, pick, 0)], n).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[live[:, None], near], n, near)
        seen[live[:, None], near] = True
        width = int((near < n).sum(1).max(initial=0))
        if width:
            near.sort(axis=1)
            near = near[:, :width]
            at = np.minimum(near, n - 1)
            d = xx[at] - 2 * np.einsum("ijk,ik->ij", x[at], q[live]) + (q[live] ** 2).sum(1)[:, None]
            d[near == n] = np.inf
            every = np.concatenate([dist[live], d.astype(np.float32)], 1)
            all_ids = np.concatenate([ids[live], near], 1)
            all_todo = np.concatenate([todo[live], near < n], 1)
            keep = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(every, keep, 1)
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            todo[live] = np.take_along_axis(all_todo, keep, 1) & (dist[live] < np.inf)
        live = live[todo[live].any(1)]
    order = np.argsort(dist, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, 1)
    ids = np.where(np.take_along_axis(dist, order, 1) < np.inf, ids, -1)
    return (ids, seen[:, :n]) if visited else ids


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node p[i] at most ``degree`` diverse neighbours of cand[i] (-1: none), nearest first."""
    m, n = len(p), len(x)
    cand = np.sort(np.where(cand == p[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    at = np.where(cand < 0, 0, cand)
    v = x[at]
    d = ((v - x[p][:, None, :]) ** 2).sum(2)
    d[cand < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    vv = (v * v).sum(2)
    out = np.full((m, degree), n, np.int64)
    alive = d < np.inf
    rows = np.arange(m)
    for t in range(degree):
        any_left = alive.any(1)
        if not any_left.any():
            break
        first = alive.argmax(1)
        out[any_left, t] = cand[rows, first][any_left]
        star = v[rows, first]
        to_star = vv - 2 * np.einsum("ijk,ik->ij", v, star) + (star * star).sum(1)[:, None]
        alive &= alpha * alpha * to_star > d
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5, batch: int = 256) -> tuple[np.ndarray, int]:
    """(neighbours (n, degree + 1), n for none; entry node)."""
    n = len(x)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree + 1), n, np.int64)
    cycle = np.empty(n, np.int64)
    cycle[order] = np.roll(order, -1)
    if n <= 2 * degree:
        every = np.tile(np.arange(n), (n, 1))
        graph[:, :degree] = robust_prune(x, np.arange(n), every, degree, alpha)
    else:
        order = np.concatenate([[entry], order[order != entry]])
        done = 1
        while done < n:
            take = order[done : done + min(batch, max(1, done))]
            done += len(take)
            found = beam_search(x, graph[:, :degree], entry, x[take], beam)
            # nodes of one batch don't see each other through the graph yet: a few of them join as candidates
            mates = np.broadcast_to(take, (len(take), len(take)))
            if len(take) > 48:
                g = (x[take] ** 2).sum(1)[None, :] - 2 * x[take] @ x[take].T
                mates = take[np.argpartition(g, 24, axis=1)[:, :24]]
            graph[take, :degree] = robust_prune(x, take, np.concatenate([found, mates], 1), degree, alpha)
            out = graph[take, :degree]
            src, dst = np.repeat(take, degree), out.ravel()
            real = dst < n
            src, dst = src[real], dst[real]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            head = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
            size = np.diff(np.append(head, len(dst)))
            nth = np.arange(len(dst)) - np.repeat(head, size)
            who = dst[head]
            extra = np.full((len(who), int(size.max(initial=0))), -1, np.int64)
            extra[np.repeat(np.arange(len(who)), size), nth] = src
            old = graph[who, :degree]
            free = degree - (old < n).sum(1)
            roomy = size <= free
            for r in np.flatnonzero(roomy):
                a = degree - free[r]
                new = extra[r, : size[r]]
                new = new[~np.isin(new, old[r])]
                graph[who[r], a : a + len(new)] = new
            if (~roomy).any():
                w = who[~roomy]
                graph[w, :degree] = robust_prune(x, w, np.concatenate([np.where(old[~roomy] < n, old[~roomy], -1), extra[~roomy]], 1), degree, alpha)
    graph[:, degree] = cycle
    return graph, entry


def _build(top: int):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        v = np.ascontiguousarray(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        order = np.argsort(ids)
        ids, v = ids[order], v[order]
        same = v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
        _, first, back = np.unique(same, return_index=True, return_inverse=True)
        by = np.argsort(back, kind="stable")
        nth = np.arange(len(by)) - np.repeat(np.cumsum(np.bincount(back)) - np.bincount(back), np.bincount(back))
        kept = by[nth <= top]
        x = v[first].astype(np.float32)
        norm = (x.astype(np.float64) ** 2).sum(1)
        x = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)
        graph, entry = build_graph(x)
        return pa.table(
            {
                "shard": t.column("shard").slice(0, 1),
                "nodes": pa.array([len(x)], pa.int32()),
                "entry": pa.array([entry], pa.int32()),
                "vectors": pa.array([v[first].astype(np.float64).tobytes()], pa.binary()),
                "edges": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
                "owner": pa.array([back[kept].astype(np.int32).tobytes()], pa.binary()),
                "ids": pa.array([ids[kept].astype(np.int64).tobytes()], pa.binary()),
            }
        )

    return run


def _search(top: int, beam: int):
    def run(t: pa.Table) -> pa.Table:
        outs = []
        for row in t.to_pylist():
            n = row["nodes"]
            v = np.frombuffer(row["vectors"]).reshape(n, -1)
            x = v.astype(np.float32)
            norm = (v**2).sum(1)
            x = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)
            graph = np.frombuffer(row["edges"], np.int32).reshape(n, -1).astype(np.int64)
            owner, ids = np.frombuffer(row["owner"], np.int32), np.frombuffer(row["ids"], np.int64)
            by = np.argsort(owner, kind="stable")
            begin = np.searchsorted(owner[by], np.arange(n + 1))
            qid = np.array([q["vec_id"] for q in row["queries"]], np.int64)
            qv = np.array([q["v"] for q in row["queries"]], np.float64)
            for a in range(0, len(qid), 256):
                q = qv[a : a + 256]
                flat = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
                found = beam_search(x, graph, row["entry"], flat, min(max(beam, top + 1), max(n, 2)))
                for k in range(len(q)):
                    nodes = found[k][found[k] >= 0]
                    score = (v[nodes] * q[k]).sum(1)
                    many = begin[nodes + 1] - begin[nodes]
                    pick = np.repeat(begin[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    c, s = ids[by[pick]], np.repeat(score, many)
                    other = c != qid[a + k]
                    c, s = c[other], s[other]
                    o = np.lexsort((c, -s))[:top]
                    outs.append((np.full(len(o), qid[a + k]), c[o], s[o]))
        cat = lambda i, kind: np.concatenate([o[i] for o in outs]) if outs else np.zeros(0, kind)
        return pa.table({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64)})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    rows = rows.where(fine).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, top: int = TOP, modulus: int = 20, shard_rows: int = SHARD, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row whose id ``modulus`` divides."""
    rows = staged(usable(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % modulus == 0)
    n, queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % modulus == 0, 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries // query_block))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = staged(
        dealt.groupBy("shard").applyInArrow(_build(top), "shard int, nodes int, entry int, vectors binary, edges binary, owner binary, ids binary"),
        "graph",
    )
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    # the stated query set against all shards, a block of bounded size at a time
    q = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    q = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = q.join(index, F.col("s") == F.col("shard")).drop("s")
    found = met.groupBy("shard", "block").applyInArrow(_search(top, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))

