"""What only shows on larger tables: rounds and size estimates of components, repeated order lines, copies of one place."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from rotaframe.operators import fits, joins, shoeboxes, storage
from rotaframe.operators.shoeboxes import BOX
from rotaframe.plans import frames as plans


def test_rounds_of_components_do_not_grow_with_their_width(spark, monkeypatch):
    ids = random.Random(4).sample(range(-(10**12), 10**12), 400)
    edges = [*zip(ids[:399], ids[1:399], strict=False), (ids[399], ids[399]), (ids[0], None)]  # one long chain, a node tied to itself, an end that is missing
    tables, written = [], storage.written

    def counted(df, path=None):
        tables.append(written(df, path))
        return tables[-1]

    monkeypatch.setattr(storage, "written", counted)
    got = {r.node: r.component for r in joins.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(ids[:399], min(ids[:399])), ids[399]: ids[399]}
    assert len(tables) < 20


def test_of_repeated_order_lines_the_least_supplier_stands(spark, tmp_path):
    # the supplier that comes first has the larger place: 150 is 0 on the panel, 20 is 20
    spark.createDataFrame([(1, 2, 7, 150), (1, 2, 7, 20), (1, 2, 9, 3), (3, 1, 4, 8)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.row_id: (round(r.px * 0.2, 6), round(r.py * 0.2, 6)) for r in plans.predictions(spark, str(tmp_path)).collect()}
    assert got == {10: (7.25, 20.5), 25: (4.25, 8.5)}


def test_sets_of_touching_boxes_stay_whole_whatever_the_batches(monkeypatch):
    def batch(k):
        component = np.repeat(np.arange(2 * k, 2 * k + 3), [2, 2, 1]).astype(np.int64)  # the last set goes on in the next batch
        arrays = [pa.array([[1.0, 2.0, 3.0, 4.0]] * 5)] * 3
        ends = [pa.array(np.full(5, v, dtype=np.int32)) for v in (0, 2, 0, 2, 0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(component), pa.array(np.arange(5) + 10 * k), *ends, *arrays, pa.array([bytes([5, 5, 3, 3])] * 5, type=pa.binary())], names=["component", "row_id", *BOX, "pixels", "background", "profile", "mask"])

    monkeypatch.setattr(fits, "AT_ONCE", 8)
    got = list(fits._whole_sets(iter([batch(k) for k in range(3)])))
    sets = [set(c["component"].tolist()) for c in got]
    assert len(sets) > 3 and sum(map(len, sets)) == 7 and set.union(*sets) == set(range(7))
    assert sum(len(c["x"]) for c in got) == 15 * 4 and got[0]["y"].tolist() == [0, 0, 1, 1] * 2


def test_neighbours_are_counted_without_pairs_of_boxes(spark, monkeypatch, capsys):
    monkeypatch.setattr(shoeboxes, "VOXELS", 2000)
    length = 0.9 * (50.0**2 + 50.0**2 + 250.0**2) ** 0.5
    rows = [(k, 0, 0, -50 / length, 50 / length, -250 / length, 0.5 if k < 40 else 0.9) for k in range(41)]  # forty in one place, one by itself
    boxes = storage.checkpoint(shoeboxes.reflection_boxes(spark.createDataFrame(rows, "row_id long, id int, panel int, s1_x double, s1_y double, s1_z double, phi double"), {0: plans.EXPERIMENT}, plans.WIDTHS))
    masks = shoeboxes.neighbour_masks(boxes, {0: plans.EXPERIMENT}, plans.WIDTHS, tiles=(4, 4, 4))
    masks.explain()
    assert "Join" not in capsys.readouterr().out
    got = {r.row_id: bytes(r["mask"]) for r in masks.collect()}
    assert len(got) == 41 and set(got[40]) == {3, 5}
    assert all(got[k] == got[0] and set(got[k]) == {3, 5 | 32} for k in range(40))
