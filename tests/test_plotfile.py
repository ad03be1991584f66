"""Plotfiles written by hand and read back."""

import numpy as np
import pytest

from meshlark.sources import plotfile

FAB = "FAB ((8, (64 11 52 0 1 12 0 1023)),(8, (8 7 6 5 4 3 2 1)))"


def write(folder, time):
    rng = np.random.default_rng(int(time * 10))
    (folder / "Level_0").mkdir(parents=True)
    (folder / "Level_1").mkdir()
    head = ["HyperCLaw-V1.1", "2", "rho", "temp", "2", str(time), "1", "0 0", "2 1", "2", "((0,0) (7,3) (0,0)) ((0,0) (15,7) (0,0))", "5 10", "0.25 0.25", "0.125 0.125"]
    (folder / "Header").write_text("\n".join(head) + "\n")
    want = {}
    for level, boxes in ((0, [(0, 0, 3, 3), (4, 0, 7, 3)]), (1, [(2, 2, 5, 3)])):
        raw = b""
        for x0, y0, x1, y1 in boxes:
            v = rng.random((2, y1 - y0 + 1, x1 - x0 + 1))
            raw += f"{FAB}(({x0},{y0}) ({x1},{y1}) (0,0)) 2\n".encode() + v.astype("<f8").tobytes()
            for f, name in enumerate(("rho", "temp")):
                for (y, x), s in np.ndenumerate(v[f]):
                    want[level, name, x0 + x, y0 + y] = s
        (folder / f"Level_{level}" / "Cell_D_00000").write_bytes(raw)
    return want


def test_headers_and_boxes(spark, tmp_path):
    want = {t: write(tmp_path / f"plt{i}", t) for i, t in enumerate((0.5, 1.5))}
    heads = {r.path.rsplit("/", 1)[1]: r for r in plotfile.read_headers(spark, f"file://{tmp_path}/plt*").collect()}
    assert heads["plt1"].time == 1.5 and heads["plt0"].fields == ["rho", "temp"] and heads["plt0"].boxes == [[0, 0, 7, 3], [0, 0, 15, 7]]
    assert heads["plt0"].dx == [[0.25, 0.25], [0.125, 0.125]] and heads["plt0"].ratios == [2] and heads["plt0"].high == [2.0, 1.0]
    got = plotfile.cells(plotfile.read_boxes(spark, f"file://{tmp_path}/plt1")).collect()
    assert {(r.level, r.field, r.x, r.y): r.v for r in got} == want[1.5] and len(got) == len(want[1.5])
    one = plotfile.read_boxes(spark, f"file://{tmp_path}/plt*", ["temp"])
    assert {r.field for r in one.collect()} == {"temp"} and one.count() == 6
    with pytest.raises(Exception, match="no field"):
        plotfile.read_boxes(spark, f"file://{tmp_path}/plt0", ["absent"]).collect()
