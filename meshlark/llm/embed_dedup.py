"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions; each table's bucket is the tuple of
BITS projections, shifted and cut into cells of WIDTH. Vectors at cosine c are at distance
sqrt(2 - 2c), so similar ones meet in some table; the exact cosine in double precision decides.

A pair that meets in several tables is counted in the first only: every row carries all its buckets.
Equal vectors are folded into one with their number before they are dealt out. Within a table the
rows stream through their task in bucket order and are compared in blocks of BLOCK vectors; a bucket
beyond a block is dealt out as pairs of blocks, so no task or memory grows with a bucket. Counts are
added up in the task; of the links only a spanning set goes on to find components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import components, discard, numbered, place, shuffle_partitions, written

COSINE = 0.93
#: At cosine 0.93 one projection agrees with probability 0.85, eight with 0.275; all 40 tables miss a
#: pair with probability (1 - 0.275)**40 = 2.6e-6, and at 0.95 with 6e-8.
TABLES, BITS, WIDTH, BLOCK, SALTS = 40, 8, 2.0, 512, 16


def usable(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None for x in v)


def parsed(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of the usable vectors (not null, not zero, all components finite) and the vectors, as doubles."""
    at, out = [], []
    for i, v in enumerate(column):
        if usable(v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                at.append(i)
                out.append(x)
    return np.array(at, np.int64), out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def buckets(x: np.ndarray, tables: int, bits: int, width: float) -> np.ndarray:
    """One bucket hash for each vector and table. The directions follow from the dimension alone."""
    rng = np.random.Generator(np.random.PCG64(1000 + x.shape[1]))
    planes, shifts = rng.standard_normal((x.shape[1], tables * bits)), rng.random(tables * bits) * width
    odd = rng.integers(1, 2**62, size=tables * bits, dtype=np.int64) | 1
    cells = np.floor((unit(x) @ planes + shifts) / width).astype(np.int64)
    h = (cells * odd).reshape(len(x), tables, bits).sum(axis=2).view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _hashed(batches, single: bool):
    """Usable rows with their keys and vectors, the others with neither. single: the column holds
    32-bit floats, so that is how the vectors travel, without loss."""
    for batch in batches:
        at, vectors = parsed(batch.column(2).to_pylist())
        rest = pa.array(np.setdiff1d(np.arange(len(batch)), at))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rest), batch.column(1).take(rest), pa.nulls(len(rest), pa.list_(pa.int64())), pa.nulls(len(rest), pa.binary())], ["id", "label", "keys", "vector"])
        ids, labels = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
        keys = np.zeros((len(at), TABLES), np.int64)
        size = np.array([len(v) for v in vectors], np.int64)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            keys[rows] = buckets(np.stack([vectors[i] for i in rows]), TABLES, BITS, WIDTH)
        flat = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * TABLES, keys.reshape(-1))
        yield pa.RecordBatch.from_arrays([ids, labels, flat, pa.array([v.astype(np.float32 if single else np.float64).tobytes() for v in vectors], pa.binary())], ["id", "label", "keys", "vector"])


def _compare(a: dict, b: dict | None, table: int, least: float, counts: dict, links: list) -> None:
    """Count the links between two blocks of a bucket (b None: within a), where this table is the pair's first."""
    other = a if b is None else b
    if len(a["ids"]) == 0 or len(other["ids"]) == 0:
        return
    near = unit(a["x"]) @ unit(other["x"]).T >= least
    if b is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return
    if table:
        new = ~(a["keys"][i, :table] == other["keys"][j, :table]).any(axis=1)
        i, j = i[new], j[new]
    for k, w, of in ((i, other["n"][j], a), (j, a["n"][i], other)):
        got = np.bincount(k, weights=w, minlength=len(of["ids"]))
        for at in np.flatnonzero(got):
            counts[int(of["ids"][at])] = counts.get(int(of["ids"][at]), 0) + int(got[at])
    # a spanning set: of the links, only those that join two sets that were apart so far
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v in zip(a["ids"][i].tolist(), other["ids"][j].tolist(), strict=True):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            links.append((u, v))


def _block(rows: list, single: bool) -> dict:
    return {"ids": np.array([r[0] for r in rows], np.int64), "n": np.array([r[1] for r in rows], np.float64), "keys": np.array([r[2] for r in rows], np.int64).reshape(len(rows), TABLES), "x": np.stack([np.frombuffer(r[3], np.float32 if single else np.float64) for r in rows]).astype(np.float64)}


def _linked(batches, least: float, single: bool):
    """Rows in order of (table, label, key, dimension, left, right, side): side 0 and 1 are the two blocks of a pair of blocks."""
    now, rows = None, {0: [], 1: []}

    def settle():
        if now is not None:
            table, left, right = now[0], now[4], now[5]
            if left == right:
                if len(rows[0]) > 1:
                    _compare(_block(rows[0], single), None, table, least, counts, links)
            elif rows[0] and rows[1]:
                _compare(_block(rows[0], single), _block(rows[1], single), table, least, counts, links)

    counts: dict[int, int] = {}
    links: list[tuple[int, int]] = []

    def out():
        ids = list(counts)
        a, b = [u for u, _ in links], [v for _, v in links]
        batch = pa.RecordBatch.from_arrays([pa.array(ids + a, pa.int64()), pa.array([None] * len(ids) + b, pa.int64()), pa.array([counts[i] for i in ids] + [None] * len(a), pa.int64())], ["a", "b", "n"])
        counts.clear()
        links.clear()
        return batch

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("table", "label", "key", "dim", "left", "right", "side", "id", "n", "keys", "vector")]
        for *at, side, i, n, keys, vector in zip(*cols, strict=True):
            if at != now:
                settle()
                now, rows = at, {0: [], 1: []}
                if len(counts) + len(links) > 100_000:
                    yield out()
            rows[side].append((i, n, keys, vector))
    settle()
    yield out()


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = COSINE) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept.

    Rows of equal, non-null label (of any label if label_col is None) are linked at a cosine of at
    least ``cosine`` in double precision. n_links counts the other rows linked directly, component_id
    is the least id of the rows reachable, kept says it is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components, vectors of different lengths, and rows with a null label
    link with nothing. A null id has a null component, no links, and is kept. Rows that repeat an id are
    rows of their own: an id joins nothing, and each has the links of its vector. An empty table gives
    no rows; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    kind, plain = vectors.schema[vectors.columns[int(place(vectors, id_col)[1:])]].dataType, numbered(vectors)
    vector = place(vectors, vector_col)
    single = plain.schema[vector].dataType.elementType.simpleString() == "float"
    label = F.lit(0) if label_col is None else F.xxhash64(place(vectors, label_col))
    known = F.col(place(vectors, id_col)).isNotNull() & (F.lit(True) if label_col is None else F.col(place(vectors, label_col)).isNotNull())
    base = plain.select(F.col(place(vectors, id_col)).cast("long").alias("id"), label.cast("long").alias("label"), F.when(known, F.col(vector)).alias("vector"))
    hashed = written(base.mapInArrow(lambda it: _hashed(it, single), "id long, label long, keys array<long>, vector binary"), "p-stable")
    usable = hashed.where("vector is not null")
    folded = usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    folded = written(folded.withColumn("vid", F.monotonically_increasing_id()), "p-stable-folded")

    marks = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int"))  # half of each key tells whether a pair has met before
    dealt = folded.select(F.col("vid").alias("id"), "label", "n", marks.alias("keys"), "vector", F.length("vector").alias("dim"), F.posexplode("keys").alias("table", "key"))
    bucket = ["table", "label", "key", "dim"]
    large = dealt.groupBy(*bucket).agg(F.count("*").alias("rows")).where(f"rows > {BLOCK}").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    dealt = dealt.join(large.drop("rows"), bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    dealt = dealt.withColumn("meet", F.explode(meet)).select(*bucket, "meet.left", "meet.right", "meet.side", "id", "n", "keys", "vector")
    dealt = dealt.repartition(2 * parts, *bucket, "left", "right").sortWithinPartitions(*bucket, "left", "right", "side")
    found = written(dealt.mapInArrow(lambda it: _linked(it, cosine, single), "a long, b long, n long"), "p-stable-links")

    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("more")).withColumnRenamed("a", "vid")
    classes = components(found.where("b is not null").select("a", "b").distinct()).withColumnRenamed("id", "vid")
    least = classes.join(folded.select("vid", "rep"), "vid").groupBy("component").agg(F.min("rep").alias("least"))
    # a class may hold a third of all vectors: its rows are salted, its least id goes to every salt
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = classes.withColumn("salt", F.pmod(F.xxhash64("vid"), F.lit(SALTS)).cast("int")).join(least, ["component", "salt"]).select("vid", "least")
    each = folded.select("vid", "label", "vector", "rep", "n").join(counts, "vid", "left").join(classes, "vid", "left")
    each = each.select("label", "vector", "rep", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("least", "rep").alias("component"))
    each = written(each, "p-stable-vectors")
    discard(found)
    discard(folded)

    ones = each.where("n = 1").select(F.col("rep").alias("id"), "links", "component")
    copies = usable.select("id", "label", "vector").join(each.where("n > 1").drop("rep", "n"), ["label", "vector"]).select("id", "links", "component")
    others = hashed.where("vector is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = ones.unionByName(copies).unionByName(others)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
