"""Boxes of plotfiles as a Spark data source: partitions planned from box offsets, bytes read on demand.

``spark.read.format("plotboxes").option("path", glob)`` gives (plotfile, level, box, field, x0, y0, x1, y1,
values). Planning reads only the text files: ``Header`` for fields and cell sizes, ``Level_k/Cell_H`` for the
boxes and where each begins in its ``Cell_D`` file. A task then seeks to the components that it needs: a
filter on plotfile, level, box or field reaches the plan and skips plotfiles, levels, boxes and byte
ranges. No file is ever read whole, so there is no limit to its size.

Paths are opened on the driver and on executors alike, so they have to be on a file system that all of
them mount; ``plotfile.read_boxes`` reads through Spark instead, from any store, whole files at a time.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from meshlark.sources.plotfile import BOX, parse_header

SCHEMA = "plotfile string, level int, box int, field string, x0 int, y0 int, x1 int, y1 int, values array<double>"
FILTERED = ("plotfile", "level", "box", "field")
#: Cells of one partition, about; a box is not split over partitions.
PARTITION_CELLS = 4_000_000
LINE_END = 512  # a box's text line is shorter than this


@dataclass
class Box:
    level: int
    number: int
    x0: int
    y0: int
    x1: int
    y1: int
    file: str
    offset: int

    @property
    def cells(self) -> int:
        return (self.x1 - self.x0 + 1) * (self.y1 - self.y0 + 1)


@dataclass
class Boxes(InputPartition):
    plotfile: str
    fields: list[tuple[str, int]]  # name and component
    boxes: list[Box]


def level_boxes(plotfile: str, level: int) -> list[Box]:
    """The boxes of a level in the order of its Cell_H, with their files and byte offsets."""
    with open(f"{plotfile}/Level_{level}/Cell_H", encoding="ascii") as f:
        text = f.read()
    corners = [[int(v) for v in (*a.split(","), *b.split(","))] for a, b, _ in BOX.findall(text)]
    places = re.findall(r"FabOnDisk:\s+(\S+)\s+(\d+)", text)
    if len(corners) != len(places):
        raise ValueError(f"{plotfile}, level {level}: {len(corners)} boxes and {len(places)} places on disk")
    return [Box(level, i, *c, f"{plotfile}/Level_{level}/{name}", int(at)) for i, (c, (name, at)) in enumerate(zip(corners, places, strict=True))]


class PlotBoxes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plotboxes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PlotBoxesReader(self.options)


class PlotBoxesReader(DataSourceReader):
    """Options: path, a glob of plotfile folders; tile, to cut boxes into tiles of tile x tile cells."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("plotboxes needs the option path")
        self.pattern = options["path"].removeprefix("file://")
        self.tile = int(options.get("tile", 0))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on plotfile, level, box and field are settled here; the rest by Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in FILTERED or None in values:
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = values & self.wanted[name] if name in self.wanted else values

    def _asked(self, name: str, value) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def partitions(self) -> list[Boxes]:
        out = []
        for folder in sorted(glob.glob(self.pattern)):
            if not os.path.exists(f"{folder}/Header") or not self._asked("plotfile", folder):
                continue
            with open(f"{folder}/Header", encoding="ascii") as f:
                head = parse_header(f.read())
            fields = [(n, k) for k, n in enumerate(head["fields"]) if self._asked("field", n)]
            if not fields:
                continue
            boxes = [b for level in range(head["max_level"] + 1) if self._asked("level", level) for b in level_boxes(folder, level) if self._asked("box", b.number)]
            boxes.sort(key=lambda b: (b.file, b.offset))
            held, cells = [], 0
            for b in boxes:
                if self.tile and ((b.x1 - b.x0 + 1) % self.tile or (b.y1 - b.y0 + 1) % self.tile):
                    raise ValueError(f"{folder}: box {b.number} of level {b.level} is not made of tiles of {self.tile}")
                if held and (cells + b.cells) * len(fields) > PARTITION_CELLS:
                    out.append(Boxes(folder, fields, held))
                    held, cells = [], 0
                held.append(b)
                cells += b.cells
            if held:
                out.append(Boxes(folder, fields, held))
        return out or [Boxes("", [], [])]

    def read(self, partition: Boxes) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("plotfile", pa.string()), ("level", pa.int32()), ("box", pa.int32()), ("field", pa.string()), *[(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")], ("values", pa.list_(pa.float64()))])
        for b in partition.boxes:
            with open(b.file, "rb") as f:
                f.seek(b.offset)
                line = f.readline(LINE_END)
                if not line.startswith(b"FAB ((8,") or not line.endswith(b"\n"):
                    raise ValueError(f"{b.file}: no box of doubles at byte {b.offset}")
                rows = []
                for name, k in partition.fields:
                    f.seek(b.offset + len(line) + 8 * k * b.cells)
                    raw = f.read(8 * b.cells)
                    if len(raw) < 8 * b.cells:
                        raise ValueError(f"{b.file}: ends within the box at byte {b.offset}")
                    v = np.frombuffer(raw, "<f8").reshape(b.y1 - b.y0 + 1, -1)
                    high, wide = (self.tile, self.tile) if self.tile else v.shape
                    for y in range(0, v.shape[0], high):
                        for x in range(0, v.shape[1], wide):
                            rows.append((partition.plotfile, b.level, b.number, name, b.x0 + x, b.y0 + y, b.x0 + x + wide - 1, b.y0 + y + high - 1, v[y : y + high, x : x + wide].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlotBoxes)
