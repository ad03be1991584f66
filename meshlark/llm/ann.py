"""Approximate nearest neighbours by NN-descent and greedy graph search.

Vectors are dealt over cells of like direction, whose centres are fitted to a sample of SAMPLE vectors
at most, and within a cell over shards of about SHARD. A search looks at little more of a large shard
than of a small one, so shards are as large as a task can well hold. Each gets a neighbour graph: it starts
from random blocks and improves by iterated Spark joins of neighbours of neighbours, in which
everything a vector is linked with, in either direction, meets and is compared. A query goes to the
shards of its nearest cells, as many as hold the share COVER of the exact neighbours of PROBES sample
queries, which are compared with every vector. There it searches the graph greedily (it keeps its EF
best, expands the best that are not expanded; queries go AT_ONCE side by side), and Spark merges the answers by exact inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import discard, release, shuffle_partitions, written
from meshlark.llm.embed_dedup import parsed

SHARD, DEGREE, ROUNDS = 16_384, 20, 6
#: Vectors that meet at once around one of them; larger neighbourhoods meet in parts, none is left out.
HOOD = 40
#: New neighbours that a vector takes from one meeting; others come up again in the next round.
TAKEN = 8
EF, ENTRIES, EXPAND = 160, 48, 8
#: Vectors that the cells are fitted to, cells at most, sample queries, and the share of their neighbours to reach.
SAMPLE, CELLS, PROBES, COVER = 16_384, 1024, 256, 0.99
#: Queries that search a shard in one task: fewest, where there are tasks to spare, and most; and those side by side.
BLOCKS, AT_ONCE = (1024, 8192), 64


def _points(batches, single: bool):
    for batch in batches:
        at, vectors = parsed(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([len(v) for v in vectors], pa.int32()), pa.array([(v.astype(np.float32 if single else np.float64) + 0).tobytes() for v in vectors], pa.binary())], ["id", "dim", "vec"])


def _stack(vectors: list[bytes], single: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float32 if single else np.float64).reshape(len(vectors), -1)
    return x.astype(np.float64)


def _meet(batches, single: bool, taken: int):
    """Rows (key, v, vec, bar) in order of key: all of a key are compared; each gets the best above its bar."""
    now, rows, out = None, [], ([], [], [])

    def settle():
        if len(rows) < 2:
            return
        ids, x = np.array([r[0] for r in rows]), _stack([r[1] for r in rows], single)
        s = x @ x.T
        s[ids[:, None] == ids[None, :]] = -np.inf
        best = np.argpartition(-s, min(taken, len(rows) - 1) - 1, axis=1)[:, :taken]
        got = np.take_along_axis(s, best, 1)
        i, j = np.nonzero((got > np.array([r[2] for r in rows])[:, None]) & np.isfinite(got))
        out[0].append(ids[i])
        out[1].append(ids[best[i, j]])
        out[2].append(got[i, j])

    def send():
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], ["id", "near", "score"])

    for batch in batches:
        for *key, v, vec, bar in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                settle()
                now, rows = key, []
                if len(out[0]) > 2000:
                    yield send()
            rows.append((v, vec, bar))
    settle()
    yield send()


def _best(found: DataFrame, degree: int) -> DataFrame:
    top = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    found = found.groupBy("id", "near").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= degree)


def neighbour_graph(points: DataFrame, single: bool, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(id, near, score): each of points(shard, n, id, vec) and its neighbours in its shard of about n, as found."""
    parts = shuffle_partitions(points.sparkSession)
    meet = lambda df, *key: df.repartition(2 * parts, *key).sortWithinPartitions(*key).select(*key, "v", "vec", "bar").mapInArrow(lambda it: _meet(it, single, taken), "id long, near long, score double")
    taken = degree
    half, first = degree // 2, []
    for seed in (0, 1):  # two layouts of random blocks: one alone would leave the blocks unconnected
        start = points.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / (half + 1)).cast("long")))
        first.append(meet(start.select("shard", "block", F.col("id").alias("v"), "vec", F.lit(float("-inf")).alias("bar")), "shard", "block"))
    found = first[0].unionByName(first[1])
    graph, taken, before = written(_best(found, degree).select("id", "near", "score"), "ann-graph"), TAKEN, None
    for k in range(rounds):
        links = graph.select("id", "near").unionByName(graph.select(F.col("near").alias("id"), F.col("id").alias("near"))).distinct()
        links = links.select("id", F.col("near").alias("v"))
        size = links.groupBy("id").agg(F.ceil(F.count("*") / HOOD).cast("int").alias("blocks")).where("blocks > 1")
        hood = links.join(size, "id", "left").select("id", "v", F.pmod(F.xxhash64("v", F.lit(k)), F.coalesce("blocks", F.lit(1))).alias("block"))
        bars = graph.groupBy("id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        state = points.select("id", "vec").join(bars, "id", "left").select(F.col("id").alias("v"), "vec", F.when(F.col("n") >= degree, F.col("least")).otherwise(F.lit(float("-inf"))).alias("bar"))
        found = meet(hood.join(state, "v"), "id", "block")
        then = written(_best(found.unionByName(graph), degree).select("id", "near", "score"), "ann-graph")
        total = then.agg(F.sum("score").alias("s"), F.count("*").alias("n")).first()
        discard(graph)
        graph = then
        release(points.sparkSession)  # a round's shuffle files are many times the input
        if before is not None and abs((total["s"] or 0.0) - before) < 0.002 * max(1e-9, abs(before)):
            break
        before = total["s"] or 0.0
    return graph


def fit_cells(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k directions by spherical k-means, and the mean vector of each cell."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = u[np.linspace(0, len(u) - 1, k).astype(np.int64)]
    for _ in range(12):
        own = (u @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, u)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), centres)
    own = (u @ centres.T).argmax(axis=1)
    size = np.bincount(own, minlength=k)[:, None]
    means = np.zeros_like(centres)
    np.add.at(means, own, x)
    return centres, np.where(size > 0, means / np.maximum(size, 1), centres * np.linalg.norm(x, axis=1).mean())


def _celled(batches, cells: dict, single: bool, probes: dict | None):
    """id, dim, vec and its cells: the nearest by direction, or the probes[dim] of the largest inner product."""
    for batch in batches:
        out = []
        for dim, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if dim not in cells:
                out.append([0])
                continue
            x = np.frombuffer(vec, np.float32 if single else np.float64).astype(np.float64)
            near = cells[dim][0 if probes is None else 1] @ x
            out.append(np.argsort(-near, kind="stable")[: 1 if probes is None else probes[dim]].tolist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], ["id", "dim", "vec", "cells"])


def _exact(batches, ids: np.ndarray, queries: np.ndarray, dim: int, single: bool, k: int):
    """Of every query the k best rows (id, dim, vec, cells) of this partition: (query, id, cell, score)."""
    best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
    for batch in batches:
        rows = [(i, v, c[0]) for i, n, v, c in zip(*(c.to_pylist() for c in batch.columns), strict=True) if n == dim]
        if not rows:
            continue
        own, cell, s = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), _stack([r[1] for r in rows], single) @ queries.T
        for j, q in enumerate(ids):
            at = np.flatnonzero(own != q)
            at = at[np.argpartition(-s[at, j], k)[:k]] if len(at) > k else at
            score, i, c = (np.concatenate(p) for p in zip(best[j], (s[at, j], own[at], cell[at]), strict=True))
            keep = np.lexsort((i, -score))[:k]
            best[j] = score[keep], i[keep], c[keep]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(b[0]) for b in best])), *[pa.array(np.concatenate([b[n] for b in best])) for n in (1, 2, 0)]], ["query", "id", "cell", "score"])


def _sample(df: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of n rows, by a hash of their id, and never more than twice that."""
    return df.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(max(1, n // most))) == 0).limit(2 * most)


def route(points: DataFrame, asked: DataFrame, single: bool, k: int, shard_size: int, cover: float = COVER) -> tuple[dict, DataFrame, dict]:
    """The cells of each dimension of more than a shard, points with their cell, and how many cells a query visits."""
    cells, probes, kind = {}, {}, np.float32 if single else np.float64
    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > shard_size).collect()}  # one row for so many vectors
    for dim, n in sizes.items():
        x = np.stack([np.frombuffer(r["vec"], kind) for r in _sample(points.where(F.col("dim") == dim), n, SAMPLE).select("vec").collect()]).astype(np.float64)
        cells[dim] = fit_cells(x, min(CELLS, -(-n // shard_size), len(x)))
    fields = "id long, dim int, vec binary, cells array<int>"
    placed = written(points.select("id", "dim", "vec").mapInArrow(lambda it: _celled(it, cells, single, None), fields), "ann-cells")
    for dim in sizes:
        own = asked.where(F.col("dim") == dim)
        rows = _sample(own, own.count(), PROBES).select("id", "vec").collect()
        if not rows:
            probes[dim] = 1
            continue
        ids, q = np.array([r["id"] for r in rows], np.int64), np.stack([np.frombuffer(r["vec"], kind) for r in rows]).astype(np.float64)
        found = placed.mapInArrow(lambda it, ids=ids, q=q, dim=dim: _exact(it, ids, q, dim, single, k), "query long, id long, cell long, score double")
        top = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        true = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query", "cell").collect()  # PROBES times k
        rank = np.argsort(np.argsort(-(q @ cells[dim][1].T), axis=1, kind="stable"), axis=1)
        at = {int(i): j for j, i in enumerate(ids)}
        needed = np.sort([rank[at[r["query"]], r["cell"]] for r in true])
        probes[dim] = int(needed[max(0, int(np.ceil(cover * len(needed))) - 1)]) + 1
    return cells, placed, probes


def _search(x: np.ndarray, starts: np.ndarray, links: np.ndarray, q: np.ndarray, own: np.ndarray, entries: np.ndarray, ef: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Greedy searches side by side: for each row of q the rows of x found near it and their inner products.

    own: a query's own row of x, where its search begins too, or -1.
    """
    n, out, live = len(x), [(np.zeros(0, np.int64), np.zeros(0))] * len(q), np.arange(len(q))
    beam = np.tile(entries, (len(q), 1))
    mine = np.flatnonzero((own >= 0) & ~np.isin(own, entries))
    beam = np.hstack([beam, beam[:, :1]])
    beam[mine, -1] = own[mine]
    opened = np.zeros(beam.shape, bool)
    opened[:, -1] = True  # an entry again, but for those with a row of their own
    opened[mine, -1] = False
    seen = np.zeros((len(q), n), bool)
    np.put_along_axis(seen, beam, True, 1)
    score = np.einsum("qmd,qd->qm", x[beam], q)
    score[opened] = -np.inf
    while len(live):
        if beam.shape[1] > ef:
            at = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
            beam, score, opened = (np.take_along_axis(z, at, 1) for z in (beam, score, opened))
        fresh = np.where(opened, -np.inf, score)
        width = min(EXPAND, fresh.shape[1])
        at = np.argpartition(-fresh, width - 1, axis=1)[:, :width]
        more = ~np.take_along_axis(opened, at, 1)
        going = more.any(axis=1)
        for r in np.flatnonzero(~going).tolist():
            held = score[r] > -np.inf
            out[live[r]] = beam[r][held], score[r][held]
        if not going.all():
            live, beam, score, opened, at, more = (z[going] for z in (live, beam, score, opened, at, more))
            if not len(live):
                break
        np.put_along_axis(opened, at, True, 1)
        r, c = np.nonzero(more)
        node = beam[r, at[r, c]]
        count = starts[node + 1] - starts[node]
        row, new = np.repeat(r, count), links[np.repeat(starts[node] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        unseen = ~seen[live[row], new]
        row, new = np.divmod(np.unique(row[unseen] * n + new[unseen]), n)
        seen[live[row], new] = True
        size = np.bincount(row, minlength=len(live))
        place = row, beam.shape[1] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        wider = lambda z, empty: np.hstack([z, np.full((len(live), size.max(initial=0)), empty, z.dtype)])  # noqa: B023, E731
        beam, score, opened = wider(beam, 0), wider(score, -np.inf), wider(opened, True)
        beam[place], score[place], opened[place] = new, np.einsum("ij,ij->i", x[new], q[live[row]]), False
    return out


def _answers(shard: pa.Table, queries: pa.Table, single: bool, k: int, ef: int) -> pa.Table:
    out = ([], [], [])
    if shard.num_rows and queries.num_rows:
        ids = shard.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        near = shard.column("near").combine_chunks()
        a = np.repeat(np.argsort(order), np.diff(near.offsets.to_numpy()))
        x = _stack(shard.column("vec").to_pylist(), single)[order]
        ids = ids[order]
        n, b = len(ids), np.searchsorted(ids, near.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        both = np.unique(np.append(a * n + b, b * n + a))  # in either direction, by first end
        starts, links = np.searchsorted(both, np.arange(n + 1) * n), both % n
        del a, b, both
        entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64))
        asked, sought = queries.column("query").to_numpy(), queries.column("sought").to_pylist()
        own = np.minimum(np.searchsorted(ids, asked), n - 1)
        own = np.where(ids[own] == asked, own, -1)
        for i in range(0, len(asked), AT_ONCE):
            few = slice(i, i + AT_ONCE)
            v = _stack(sought[few], single)
            for q, w, (at, _) in zip(asked[few].tolist(), v, _search(x, starts, links, v, own[few], entries, ef), strict=True):
                score = x[at] @ w
                best = np.lexsort((ids[at], -score))[:k]
                out[0].append(np.full(len(best), q, np.int64))
                out[1].append(ids[at[best]])
                out[2].append(score[best])
    cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.Table.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, ef: int = EF, shard_size: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row that is_query (a Column) holds for, its k nearest others found.

    Nearest is the largest inner product of the original vectors in double precision; ties go to the
    smaller id. Null, empty or zero vectors, vectors with null or non-finite components and rows with
    a null id take no part; vectors meet those of their own length; of rows that share an id one
    takes part (the least as bytes). An empty table gives no rows; other columns are not read.

    Equal vectors are one node, under their least id, and stand for all their ids in the last merge.
    Every row is indexed. A query visits the shards of some cells, by route(); a task holds one shard
    and so many queries at most as BLOCKS says.
    """
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    base = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    points = base.where("id is not null and v is not null").select("id", "v").mapInArrow(lambda it: _points(it, single), "id long, dim int, vec binary")
    points = written(points.groupBy("id").agg(F.min(F.struct("vec", "dim")).alias("p")).select("id", "p.dim", "p.vec"), "ann-points")
    nodes = points.groupBy("dim", "vec").agg(F.min("id").alias("node"))
    alike = written(points.join(nodes, ["dim", "vec"]).select("id", "node"), "ann-alike")
    folded = written(nodes.select(F.col("node").alias("id"), "dim", "vec"), "ann-nodes")
    discard(points)
    points = folded
    wanted = alike.join(base.where("asked").select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    asked = written(points.join(wanted.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select("id", "dim", "vec"), "ann-asked", 4)
    cells, placed, probes = route(points, asked, single, k + 1, shard_size)
    discard(points)
    points = placed.select("id", "dim", "vec", F.col("cells")[0].alias("cell"))
    subs = points.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("subs"), F.count("*").alias("held")).withColumn("n", F.ceil(F.col("held") / F.col("subs")))
    points = points.join(subs, ["dim", "cell"]).withColumn("shard", F.xxhash64("dim", "cell", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")))
    graph = neighbour_graph(points.select("shard", "n", "id", "vec"), single)
    lists = graph.groupBy("id").agg(F.collect_list("near").alias("near"))  # DEGREE long at most
    nodes = points.join(lists, "id", "left").select("shard", "id", "vec", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    sent = asked.mapInArrow(lambda it: _celled(it, cells, single, probes), "id long, dim int, vec binary, cells array<int>")
    sent = sent.select("id", "dim", "vec", F.explode("cells").alias("cell")).join(subs, ["dim", "cell"])
    sent = sent.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    sent = written(sent.select(F.xxhash64("dim", "cell", "sub").alias("at"), F.col("id").alias("query"), F.col("vec").alias("sought")), "ann-sent")
    discard(asked)
    block = min(BLOCKS[1], max(BLOCKS[0], sent.count() // (2 * shuffle_partitions(sent.sparkSession))))
    blocks = sent.groupBy("at").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    queries = sent.join(blocks, "at").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks").cast("long")))
    times = blocks.select(F.col("at").alias("shard"), F.col("blocks").cast("long").alias("times"))
    nodes = nodes.join(times, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("part"), "id", "vec", "near")
    # k others of a query are among the least ids of the k + 1 best nodes: each node before one gives an id before it
    found = nodes.groupBy("shard", "part").cogroup(queries.groupBy("at", "block")).applyInArrow(lambda s, q: _answers(s, q, single, k + 1, ef), "query_id long, vec_id long, score double")
    found = found.select(F.col("query_id").alias("query"), F.col("vec_id").alias("node"), "score")
    best = lambda df, key, last: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), last)))
    found = best(found, "query", "node").where(F.col("rank") <= k + 1).drop("rank")
    least = alike.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("rank") <= k + 1)
    found = found.join(least.select("node", F.col("id").alias("vec_id")), "node")
    found = best(found, "query", "vec_id").where(F.col("rank") <= k + 1).drop("rank")
    found = found.join(wanted, "query").where("vec_id <> query_id")
    return best(found, "query_id", "vec_id").where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
