"""The plotfile data source on files written by hand: planned offsets, skipped bytes, tiles."""

import builtins

import numpy as np
import pytest

from meshlark.sources import plotboxes as B

FAB = "FAB ((8, (64 11 52 0 1 12 0 1023)),(8, (8 7 6 5 4 3 2 1)))"
BOXES = {0: [(0, 0, 3, 3), (4, 0, 7, 3), (0, 4, 7, 7)], 1: [(2, 2, 5, 3), (8, 8, 15, 15)]}


def write(folder, seed):
    """A plotfile of two levels, with two boxes a Cell_D file in an order of their own."""
    rng, want = np.random.default_rng(seed), {}
    folder.mkdir()
    head = ["HyperCLaw-V1.1", "2", "rho", "temp", "2", str(float(seed)), "1", "0 0", "2 2", "2", "((0,0) (7,7) (0,0)) ((0,0) (15,15) (0,0))", "5 10", "0.25 0.25", "0.125 0.125"]
    (folder / "Header").write_text("\n".join(head) + "\n")
    for level, boxes in BOXES.items():
        (folder / f"Level_{level}").mkdir()
        raw, places = {0: b"", 1: b""}, {}
        for i in reversed(range(len(boxes))):
            x0, y0, x1, y1 = boxes[i]
            v = rng.random((2, y1 - y0 + 1, x1 - x0 + 1))
            places[i] = f"FabOnDisk: Cell_D_0000{i % 2} {len(raw[i % 2])}"
            raw[i % 2] += f"{FAB}(({x0},{y0}) ({x1},{y1}) (0,0)) 2\n".encode() + v.astype("<f8").tobytes()
            for f, name in enumerate(("rho", "temp")):
                want[level, i, name] = v[f]
        for k, r in raw.items():
            (folder / f"Level_{level}" / f"Cell_D_0000{k}").write_bytes(r)
        lines = ["1", "1", "2", "0", f"({len(boxes)} 0", *[f"(({a},{b}) ({c},{d}) (0,0))" for a, b, c, d in boxes], ")", str(len(boxes)), *[places[i] for i in range(len(boxes))]]
        (folder / f"Level_{level}" / "Cell_H").write_text("\n".join(lines) + "\n")
    return want


@pytest.fixture(scope="module")
def plots(tmp_path_factory):
    at = tmp_path_factory.mktemp("plots")
    return at, {f"{at}/plt{k}": write(at / f"plt{k}", k) for k in range(3)}


def test_all_boxes(spark, plots):
    at, want = plots
    B.register(spark)
    got = spark.read.format("plotboxes").option("path", f"file://{at}/plt*").load().collect()
    assert len(got) == 3 * 5 * 2
    for r in got:
        v = want[r.plotfile][r.level, r.box, r.field]
        assert (r.x0, r.y0, r.x1, r.y1) == BOXES[r.level][r.box] and np.array_equal(np.array(r["values"]).reshape(v.shape), v)


def test_filters_reach_the_plan_and_skip_bytes(spark, plots, monkeypatch):
    at, want = plots
    B.register(spark)
    df = spark.read.format("plotboxes").option("path", f"{at}/plt*").load().where(f"level = 1 and field = 'temp' and plotfile in ('{at}/plt0', '{at}/plt2') and x0 > 2")
    got = df.collect()
    assert {(r.plotfile, r.box) for r in got} == {(f"{at}/plt0", 1), (f"{at}/plt2", 1)}
    reader, read = B.PlotBoxesReader({"path": f"{at}/plt*"}), []
    rest = list(reader.pushFilters([B.EqualTo(("level",), 1), B.EqualTo(("field",), "temp"), B.In(("plotfile",), (f"{at}/plt0",)), B.EqualTo(("x0",), 2), B.EqualTo(("level",), None)]))
    assert [f.attribute for f in rest] == [("x0",), ("level",)]

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    plan = reader.partitions()
    monkeypatch.setattr(builtins, "open", lambda *a, o=open, **k: Counted(o(*a, **k)) if "Cell_D" in str(a[0]) else o(*a, **k))
    rows = [r for p in plan for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["level"], r["box"], r["field"]) for r in rows] == [(1, 0, "temp"), (1, 1, "temp")]
    assert sum(read) == 8 * (8 + 64)  # one component of two boxes of level 1, and nothing else


def test_partitions_follow_the_cells(plots, monkeypatch):
    at, _ = plots
    monkeypatch.setattr(B, "PARTITION_CELLS", 64)
    plan = B.PlotBoxesReader({"path": f"{at}/plt1"}).partitions()
    assert sum(len(p.boxes) for p in plan) == 5 and len(plan) > 2
    assert all(len(p.boxes) == 1 or sum(b.cells for b in p.boxes) * 2 <= 64 for p in plan)


def test_tiles(spark, plots):
    at, want = plots
    B.register(spark)
    got = spark.read.format("plotboxes").option("path", f"{at}/plt0").option("tile", "2").load().where("level = 1 and field = 'rho'").collect()
    assert len(got) == 2 + 16
    for r in got:
        x0, y0, _, _ = BOXES[1][r.box]
        v = want[r.plotfile][1, r.box, "rho"][r.y0 - y0 : r.y1 - y0 + 1, r.x0 - x0 : r.x1 - x0 + 1]
        assert v.shape == (2, 2) and np.array_equal(np.array(r["values"]).reshape(2, 2), v)
    with pytest.raises(ValueError, match="not made of tiles"):
        B.PlotBoxesReader({"path": f"{at}/plt0", "tile": "4"}).partitions()


def test_faults_are_named(plots, tmp_path):
    assert B.PlotBoxesReader({"path": f"{tmp_path}/none*"}).partitions() == [B.Boxes("", [], [])]
    with pytest.raises(ValueError, match="path"):
        B.PlotBoxesReader({})
    write(tmp_path / "cut", 9)
    data = tmp_path / "cut" / "Level_1" / "Cell_D_00001"
    data.write_bytes(data.read_bytes()[:-8])
    reader = B.PlotBoxesReader({"path": f"{tmp_path}/cut"})
    with pytest.raises(ValueError, match="ends within"):
        [list(reader.read(p)) for p in reader.partitions()]
