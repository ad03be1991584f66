"""Stored topologies: digests of their columns, a signature for the build that made them, import of older tables.

A topology table has one row a cell: key (a reference frame), id, level, tile_x, tile_y, ix, iy, op. An older
one has one row a reference frame with lists; ``decoded`` turns any of three list layouts into the first.
"""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = ("topo_ids", "topo_tuples", "topo_ops")
#: The five numbers of a cell in topo_tuples, in order.
TUPLE = ("tile_x", "tile_y", "level", "ix", "iy")
#: A digest adds up the parts of its rows' hashes: so many hex digits a part, and parts a hash.
DIGITS, PARTS = 12, 5


def build_signature(parameters: dict, *implementations) -> str:
    """A namespace for what a build makes: it changes with a parameter or with the source of a function."""
    text = json.dumps(parameters, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256("\0".join([text, *(inspect.getsource(f) for f in implementations)]).encode()).hexdigest()


def _spelled(c: Column) -> Column:
    """A value as text, null apart from every other."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def column_digests(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """(keys, column, type, n, digest): for each key and column, what is in the column at each place.

    ``place`` names the columns that tell a key's rows apart; they are part of every digest, so that values
    which change places change it, while the order of rows and their partitions do not. A row's part is
    the sha256 of column name, type, place and value; the parts of a key's rows are added up in pieces,
    combined before the shuffle, so no task gathers a key. Equal tables have equal digests; unlike ones
    differ but for a chance of about 2^-240.
    """
    named = [f for f in rows.schema.fields if f.name not in keys and f.name not in place]
    where = F.concat_ws("\u001f", *[_spelled(F.col(p)) for p in place])
    spelled = lambda f: F.concat_ws("\u001e", F.lit(f.name), F.lit(f.dataType.simpleString()), where, _spelled(F.col(f.name) if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(f.name)))
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.sha2(spelled(f), 256).alias("hash")) for f in named])).alias("c")).select(*keys, "c.*")
    piece = lambda k: F.conv(F.substring("hash", 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(20,0)")
    added = long.groupBy(*keys, "column", "type").agg(F.count("*").alias("n"), *[F.sum(piece(k)).alias(f"_{k}") for k in range(PARTS)])
    return added.select(*keys, "column", "type", "n", F.sha2(F.concat_ws(",", "n", *[f"_{k}" for k in range(PARTS)]), 256).alias("digest"))


def topology_digests(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """(keys, digest): one for all columns of a key, by which a store tells a conflict from a repeat."""
    columns = column_digests(rows, keys, place)
    # as many entries as the table has columns
    return columns.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "column", "type", "n", "digest"))), ";"), 256).alias("digest"))


def new_and_conflicting(rows: DataFrame, store: DataFrame, keys: list[str], place: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that the store lacks, and the keys that both have with different content.

    Keys with equal content are neither: storing them again changes nothing.
    """
    ours = topology_digests(rows, keys, place)
    theirs = topology_digests(store, keys, place).withColumnRenamed("digest", "stored")
    both = ours.join(theirs, keys, "left")
    new = rows.join(both.where("stored is null").select(*keys), keys, "left_semi")
    return new, both.where("stored <> digest").select(*keys)


def _vector(table: DataFrame, name: str) -> Column:
    """A vector column's list, wherever the layout holds it: a list, or a struct with one named data."""
    kind = table.schema[name].dataType
    if isinstance(kind, T.StructType):
        if "data" not in kind.names:
            raise TypeError(f"{name}: a struct without data")
        return F.col(f"{name}.data")
    if isinstance(kind, T.ArrayType):
        return F.col(name)
    raise TypeError(f"{name}: neither a list nor a struct: {kind.simpleString()}")


def decoded(table: DataFrame, path_col: str = "input_paths") -> DataFrame:
    """(key, id, tile_x, tile_y, level, ix, iy, op) of an older table with one row a reference frame.

    topo_ids, topo_ops and topo_tuples are lists (of a fixed size or not: Parquet tells them alike), or
    structs whose ``data`` is one; topo_tuples is flat, five numbers a cell, or a list of five-number
    lists. The key is the last of input_paths. Binary paths are refused: they are pickled objects, which
    are never opened. A null vector, a null in a vector, or vectors of different lengths are errors of
    the row, raised when it is read.
    """
    if isinstance(table.schema[path_col].dataType, T.BinaryType):
        raise ValueError(f"{path_col} holds pickled objects, which are never opened")
    ids, tuples, ops = (_vector(table, n) for n in VECTORS)
    inner = table.select(tuples.alias("t")).schema["t"].dataType.elementType
    if isinstance(inner, T.ArrayType):
        tuples = F.when(F.exists(tuples, lambda t: t.isNull() | (F.size(t) != len(TUPLE))), F.raise_error(F.lit("topo_tuples: a cell without five numbers"))).otherwise(F.flatten(tuples))
    rows = table.select(F.element_at(path_col, -1).alias("key"), ids.alias("ids"), tuples.alias("tuples"), ops.alias("ops"))
    nulls = F.lit(False)
    for c in ("ids", "tuples", "ops"):
        nulls |= F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(True))
    sized = (F.size("ids") == F.size("ops")) & (F.size("tuples") == F.size("ids") * len(TUPLE))
    fault = F.when(nulls, F.lit("a null vector, or a null in one")).when(~sized, F.lit("ids, tuples and ops have different lengths"))
    checked = rows.withColumn("ids", F.when(fault.isNull(), F.col("ids")).otherwise(F.raise_error(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("?")), F.lit(": "), fault))))
    cell = checked.select("key", "tuples", "ops", F.posexplode("ids").alias("_k", "id"))
    return cell.select("key", "id", *[F.get("tuples", F.col("_k") * len(TUPLE) + j).alias(n) for j, n in enumerate(TUPLE)], F.get("ops", F.col("_k")).alias("op"))


def encoded(rows: DataFrame) -> DataFrame:
    """The inverse of decoded(): (input_paths, topo_ids, topo_tuples, topo_ops), cells in the order of id.

    One row holds a reference frame's topology, which its finest grid bounds.
    """
    cells = F.array_sort(F.collect_list(F.struct("id", F.array(*TUPLE).alias("t"), "op")))
    whole = rows.groupBy("key").agg(cells.alias("c"))
    return whole.select(F.array("key").alias("input_paths"), F.col("c.id").alias("topo_ids"), F.flatten("c.t").alias("topo_tuples"), F.col("c.op").alias("topo_ops"))
