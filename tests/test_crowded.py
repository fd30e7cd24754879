"""Joins by distance, relaxation and zones where points are crowded, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import quadtree, spatial, topology
from test_parity import plain_relax

POINT = "id int, x double, y double, r double"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), *map(float, v)) for i, v in rows], POINT)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Six thousand points, a third of them in one cell, some of those on one spot; stored."""
    rng = np.random.default_rng(1)
    xy = np.concatenate((rng.uniform(-300, 300, (4000, 2)), rng.normal(0.5, 0.05, (1500, 2)) + (96, -40), np.full((500, 2), 17.25)))
    path = str(tmp_path_factory.mktemp("crowded"))
    frame(spark, [(i, (*p, 1.0)) for i, p in enumerate(xy)]).write.mode("overwrite").parquet(path)
    return xy, spark.read.parquet(path)


def close(xy, reach):
    order = np.argsort(xy[:, 0])
    out = set()
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if xy[j, 0] - xy[i, 0] > reach:
                break
            if math.hypot(*(xy[i] - xy[j])) <= reach:
                out.add((min(i, j), max(i, j)))
    return out


def test_pairs_in_a_crowded_cell_equal_brute_force(spark, crowded, monkeypatch):
    xy, points = crowded
    tree = quadtree.Quadtree.over(points, 3.0, most=100)
    assert tree.depth == tree.deepest  # the spot cannot be parted by place
    met = quadtree.near_pairs(points, 3.0, tree=tree).where(F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) <= 3.0)
    rows = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    want = close(xy, 3.0)
    assert rows.agg(F.max("n"), F.count("*")).first()[:] == (1, len(want))
    assert rows.select("a", "b").where("a < 700 or b >= 5900").count() == sum(a < 700 or b >= 5900 for a, b in want)


def test_no_key_holds_a_crowded_place(spark, crowded):
    _, points = crowded
    own = quadtree.Quadtree.over(points, 3.0, most=100).keyed(points, 0.0, F.xxhash64("id"))
    sizes = [r["n"] for r in own.groupBy(*quadtree.KEY).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 160  # parts of a spot go by hash
    tasks = [r["n"] for r in own.repartition(8, *quadtree.KEY).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(tasks) < 4 * np.median(tasks)
    plain = quadtree.Quadtree.over(points, 3.0, most=10**6)
    assert plain.depth == -1 and plain.keyed(points).groupBy(*quadtree.KEY).count().agg(F.max("count")).first()[0] > 1000


def test_null_and_single_points_meet_nothing(spark):
    points = spark.createDataFrame([(1, None, 0.0), (2, 0.0, None), (3, 0.0, 0.0)], "id int, x double, y double")
    assert spatial.pairs_within(points, 1.0).count() == 0
    assert spatial.pairs_within(points.limit(0), 1.0).count() == 0


def test_delta_rounds_equal_a_plain_loop_and_write_less(spark):
    rng = np.random.default_rng(4)
    points = {i: (*rng.uniform(-60, 60, 2), float(rng.uniform(0.5, 2.0))) for i in range(300)}
    points |= {300 + i: (*rng.normal(0, 3, 2), 1.0) for i in range(60)} | {400: (40.0, 40.0, 1.0), 401: (40.0, 40.0, 1.0)}
    zones, seen = [(3.0, 4.0, 2.3), (-20.0, 0.0, 6.0), (-16.0, 0.0, 4.0)], []
    want = plain_relax(points, zones, 30)
    got = topology.relax(frame(spark, points.items()), 30, zones, seen=seen).collect()
    assert len(got) == len(points)
    for r in got:
        assert abs(r["x"] - want[r["id"]][0]) < 1e-5 and abs(r["y"] - want[r["id"]][1]) < 1e-5
    assert seen[0] < 250 and seen[-1] < seen[0] / 2
    table = spark.createDataFrame([(k, *z) for k, z in enumerate(zones)], "at int, zx double, zy double, zr double")
    for r in topology.relax(frame(spark, points.items()), 3, table).collect():
        plain = plain_relax(points, zones, 3) if r["id"] == got[0]["id"] else None
        assert plain is None or abs(r["x"] - plain[r["id"]][0]) < 1e-6
    none = []
    still = topology.relax(frame(spark, [(1, (0, 0, 1)), (2, (9, 9, 1))]), 30, [], seen=none)
    assert none == [0] and still.count() == 2


def test_crowded_relaxation_equals_the_plain_grid(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = {i: (*rng.normal(0, 4, 2), float(rng.uniform(0.2, 2.0))) for i in range(250)}
    want = plain_relax(points, [], 4)
    over = quadtree.Quadtree.over
    monkeypatch.setattr(topology.Quadtree, "over", lambda p, edge: over(p, edge, 10, 3))
    for r in topology.relax(frame(spark, points.items()), 4).collect():
        assert abs(r["x"] - want[r["id"]][0]) < 1e-6 and abs(r["y"] - want[r["id"]][1]) < 1e-6


def test_many_zones_equal_a_loop_without_nested_loops(spark):
    rng = np.random.default_rng(6)
    points = [(i, (*rng.uniform(-500, 500, 2), 1.0)) for i in range(800)]
    zones = [(k, float(rng.uniform(-500, 500)), float(rng.uniform(-500, 500)), float(rng.choice((0.5, 4, 31, 64, 300)) * (k % 7 == 0) or 3)) for k in range(10_000)] + [(10_000, 0.0, 0.0, 0.0), (10_001, 1.0, 1.0, -2.0)]
    df, table = frame(spark, points), spark.createDataFrame(zones, "zone int, zx double, zy double, zr double")
    met = spatial.within_zones(df, table)
    zx, zy, zr = (np.array([z[k] for z in zones]) for k in (1, 2, 3))
    want = {(i, zones[k][0]) for i, (x, y, _) in points for k in np.flatnonzero(np.hypot(zx - x, zy - y) < zr)}
    assert {(r["id"], r["zone"]) for r in met.collect()} == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    some = [(k, x, y, r) for k, x, y, r in zones if k % 25 == 0 and r < 40]
    at = {i: np.array(v[:2]) for i, v in points}
    for _, x, y, r in some:
        for i, p in at.items():
            d = math.hypot(p[0] - x, p[1] - y)
            if d < r:
                at[i] = p + (p - (x, y)) * 0.6 * (r - d) / max(d, 1e-9)
    out = topology.push_out_of(df, spark.createDataFrame(some, "at int, zx double, zy double, zr double"), 0.6).collect()
    assert len(out) == 800
    for r in out:
        assert abs(r["x"] - at[r["id"]][0]) < 1e-9 and abs(r["y"] - at[r["id"]][1]) < 1e-9


def test_rings_of_many_eyes_equal_one_eye_at_a_time(spark, crowded):
    _, points = crowded
    eyes = [(f"e{k}", float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (96.5, -39.5), (17, 17), (-290, 280), (900, 900), (95, -80)])]
    rows = spatial.detail_rings(points, spark.createDataFrame(eyes, "eye string, ex double, ey double"), (12.0, 90.0), (6.0, 4.0), (30, 80), 10.0).collect()
    for name, x, y in eyes:
        want = {(r["id"], r["tier"], round(r["d2"], 6)) for r in spatial.detail_tiers(points, x, y, (12.0, 90.0), (6.0, 4.0), (30, 80), 10.0).collect()}
        assert {(r["id"], r["tier"], round(r["d2"], 6)) for r in rows if r["eye"] == name} == want
    assert spatial.detail_rings(points.limit(0), spark.createDataFrame(eyes, "eye string, ex double, ey double")).count() == 0
