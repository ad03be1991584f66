"""Block-structured plotfiles: the text header, and the binary boxes of each level.

A plotfile is a folder with ``Header`` and ``Level_k/Cell_D_*``. The binary files describe themselves:
each box is a text line (number format, corners, components) and then its doubles, x fastest, one
component after another. Files come through Spark's reader, so any store will do.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "fields array<string>, ndim int, time double, max_level int, low array<double>, high array<double>, ratios array<int>, boxes array<array<int>>, steps array<int>, dx array<array<double>>"
BOX = re.compile(r"\(\(([-\d,]+)\) \(([-\d,]+)\) \(([-\d,]+)\)\)")
LINE = re.compile(rb"FAB \(\((\d+),.*?\(\(([-\d,]+)\) \(([-\d,]+)\) \(([-\d,]+)\)\) (\d+)\n")


def _whole(text: str) -> list[int]:
    return [int(v) for v in text.split(",")]


def parse_header(text: str) -> dict:
    """The header's entries by name, in the order in which its lines hold them."""
    lines = iter(text.splitlines())
    take = lambda kind: [kind(v) for v in next(lines).split()]
    next(lines)  # version
    out: dict = {"fields": [next(lines).strip() for _ in range(int(next(lines)))]}
    out["ndim"], out["time"], out["max_level"] = int(next(lines)), float(next(lines)), int(next(lines))
    for name in ("low", "high"):
        out[name] = take(float)[: out["ndim"]]
    out["ratios"] = take(int)
    out["boxes"] = [_whole(a) + _whole(b) for a, b, _ in BOX.findall(next(lines))]
    out["steps"] = take(int)
    out["dx"] = [take(float) for _ in range(out["max_level"] + 1)]
    return out


def read_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """One row a plotfile of the glob of folders: path and what its header says."""

    def run(batches):
        for batch in batches:
            rows = [{"path": p.removesuffix("/Header"), **parse_header(t)} for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    ints, reals = pa.list_(pa.int32()), pa.list_(pa.float64())
    kind = pa.schema([("path", pa.string()), ("fields", pa.list_(pa.string())), ("ndim", pa.int32()), ("time", pa.float64()), ("max_level", pa.int32()), ("low", reals), ("high", reals), ("ratios", ints), ("boxes", pa.list_(ints)), ("steps", ints), ("dx", pa.list_(reals))])
    files = spark.read.text(f"{pattern}/Header", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(run, f"path string, {HEADER}")


def read_boxes(spark: SparkSession, pattern: str, fields: list[str] | None = None) -> DataFrame:
    """(path, level, field, x0, y0, x1, y1, values): each box of each level of 2-D plotfiles, corners inclusive
    in the level's cells, values row-major with x fastest.

    Only the components asked for are decoded, by their byte offsets within a box. A field that the
    plotfile lacks raises.
    """
    names = read_headers(spark, pattern).select(F.col("path").alias("plotfile"), "fields")
    files = spark.read.format("binaryFile").load(f"{pattern}/Level_*/Cell_D_*")
    at = r"^(.*)/Level_(\d+)/Cell_D_\d+$"
    files = files.select(F.regexp_extract("path", at, 1).alias("folder"), F.regexp_extract("path", at, 2).cast("int").alias("level"), "content")
    tail = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")  # noqa: E731  the readers write schemes in two ways
    met = files.join(names, tail("folder") == tail("plotfile")).select("plotfile", "level", "fields", "content")

    def run(batches):
        for batch in batches:
            for path, level, known, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = known if fields is None else fields
                missing = [f for f in wanted if f not in known]
                if missing:
                    raise ValueError(f"{path} has no field {missing[0]}")
                start, rows = 0, []
                while start < len(content):
                    m = LINE.match(content, start)
                    if m is None or m[1] != b"8":
                        raise ValueError(f"{path}, level {level}: no box of doubles at byte {start}")
                    (x0, y0), (x1, y1) = _whole(m[2].decode()), _whole(m[3].decode())
                    cells = (x1 - x0 + 1) * (y1 - y0 + 1)
                    for f in wanted:
                        v = np.frombuffer(content, "<f8", cells, m.end() + 8 * cells * known.index(f))
                        rows.append({"path": path, "level": level, "field": f, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "values": v})
                    start = m.end() + 8 * cells * int(m[5])
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("path", pa.string()), ("level", pa.int32()), ("field", pa.string()), *[(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")], ("values", pa.list_(pa.float64()))])
    return met.mapInArrow(run, "path string, level int, field string, x0 int, y0 int, x1 int, y1 int, values array<double>")


def cells(boxes: DataFrame) -> DataFrame:
    """(path, level, field, x, y, v) of read_boxes' rows."""
    wide = F.col("x1") - F.col("x0") + 1
    long = boxes.select("path", "level", "field", "x0", "y0", wide.alias("wide"), F.posexplode("values").alias("k", "v"))
    return long.select("path", "level", "field", (F.col("x0") + F.col("k") % F.col("wide")).alias("x"), (F.col("y0") + F.floor(F.col("k") / F.col("wide")).cast("int")).alias("y"), "v")
