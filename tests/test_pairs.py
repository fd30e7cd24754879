"""Pairs by leaves and their rims: what is shuffled, and pairs of shared spots."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillmap.operators import quadtree, spatial, topology
from quillmap.plans import lookups
from test_crowded import close, frame


def test_points_of_a_crowded_place_go_to_few_leaves(spark):
    """A tree of small leaves must not send each point to all of them within reach."""
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 1, (1500, 2))
    points = frame(spark, [(i, (*p, 1.0)) for i, p in enumerate(xy)])
    tree = quadtree.Quadtree.over(points, 0.5, 200)
    rows = quadtree.met_rows(points, 0.5, tree=tree)
    assert rows.where("NOT rim").count() == 1500
    assert rows.count() < 1500 * 20
    met = quadtree.near_pairs(points, 0.5, tree=tree)
    assert met.agg(F.count("*"), F.count_distinct("a", "b")).first()[:] == (len(close(xy, 0.5)),) * 2


def test_an_even_layout_is_shuffled_little_more_than_once(spark):
    xy = np.random.default_rng(5).uniform(-2000, 2000, (3000, 2))
    points = frame(spark, [(i, (*p, 1.0)) for i, p in enumerate(xy)])
    assert quadtree.met_rows(points, 7.0).count() < 3000 * 1.5


def test_pieces_of_any_size_give_all_pairs_once(spark):
    """Leaves in one piece or cut into many: the same pairs."""
    rng = np.random.default_rng(7)
    xy = np.concatenate((rng.uniform(-40, 40, (600, 2)), rng.normal(3, 0.3, (400, 2))))
    points = frame(spark, [(i, (*p, 1.0)) for i, p in enumerate(xy)])
    tree = quadtree.Quadtree.over(points, 16.0, 150)
    batches = quadtree.met_rows(points, 2.0, tree=tree).coalesce(1).toArrow().to_batches(64)
    kept = quadtree.PIECE, quadtree.PAIRS
    want = close(xy, 2.0)
    try:
        for quadtree.PIECE, quadtree.PAIRS in ((1 << 16, 1 << 20), (180, 1000), (256, 50)):
            got = []
            for own, met, pairs, _ in quadtree.meetings(iter(batches), 2.0):
                a, b = own.column("id").to_numpy(), met.column("id").to_numpy()
                got += [(a[i], b[j]) for i, j in ((i, j) for x, y in pairs for i, j in zip(x, y)) if a[i] < b[j]]
            assert len(got) == len(want) and set(got) == want
    finally:
        quadtree.PIECE, quadtree.PAIRS = kept


def test_shared_spots_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SPOT", 40)  # a spot in several lists
    rng = np.random.default_rng(3)
    xy = np.concatenate((rng.integers(0, 6, (300, 2)) / 4, np.full((150, 2), 0.5), rng.uniform(-3, 3, (200, 2))))
    got = spatial.spot_pairs(frame(spark, [(i, (*p, 1.0)) for i, p in enumerate(xy)]), 0.5, 8).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]) for r in got} == close(xy, 0.5)
    assert all(r["d"] == round(math.hypot(*(xy[r["a"]] - xy[r["b"]])), 4) for r in got)


def test_pairs_of_spots_leave_their_tasks_only_as_rows_of_the_answer(spark, monkeypatch):
    """Lists of idents go to the leaves, as a rim to few, and no pair is joined with them after."""
    xy = np.random.default_rng(4).uniform(-200, 200, (2000, 2))
    met = []
    monkeypatch.setattr(spatial, "near_pairs", lambda *a, **k: (met.append((a, k)), quadtree.near_pairs(*a, **k))[1])
    out = spatial.spot_pairs(frame(spark, [(i, (*p, 1.0)) for i, p in enumerate(xy)]), 0.5, 10_000)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    ((points, reach), how) = met[0]
    assert quadtree.met_rows(points, reach, also=("ids",), tree=how["tree"]).count() < 2000 * 1.5
    assert out.count() == len(close(xy, 0.5))
    monkeypatch.setattr(quadtree, "ITEMS", 10)
    cuts = [list(range(5))[c] for c in quadtree._cuts(np.array([4, 6, 50, 1, 2]))]
    assert cuts == [[0, 1], [2], [3, 4]] and len(list(quadtree._cuts(np.zeros(99, int)))) == 1


def test_rounds_of_all_points_read_no_older_rounds(spark):
    """Points without a place stay, and a crowded start stores each round once."""
    rng = np.random.default_rng(8)
    rows = [(i, *rng.uniform(-5, 5, 2).tolist(), 2.0) for i in range(60)] + [(60, None, 1.0, 2.0), (61, float("nan"), 1.0, 2.0)]
    seen = []
    out = topology.relax(spark.createDataFrame(rows, "id int, x double, y double, r double"), 2, [], seen=seen)
    assert out.count() == 62 and seen[0] > 50
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "relax-deltas" not in text and "Join" not in text


def test_zones_of_one_disc_are_compared_once(spark, monkeypatch):
    """Also in several lists, with a repeated and a null zone; the join meets a disc, not its zones."""
    monkeypatch.setattr(spatial, "SPOT", 8)
    points = frame(spark, [(1, (0.0, 0.0, 1.0)), (2, (3.0, 0.0, 1.0)), (3, (40.0, 0.0, 1.0))])
    zones = spark.createDataFrame([(k, 1.0, 0.0, 2.5) for k in range(50)] + [(7, 1.0, 0.0, 2.5), (None, 39.0, 0.0, 4.0)], "zone int, zx double, zy double, zr double")
    met = spatial.within_zones(points, zones)
    got = sorted(((r["id"], r["zone"], r["d"]) for r in met.collect()), key=str)
    assert got == sorted([(i, k, d) for i, d in ((1, 1.0), (2, 2.0)) for k in [*range(50), 7]] + [(3, None, 1.0)], key=str)
    assert "Generate inline(zones" in met._jdf.queryExecution().optimizedPlan().toString()


def test_a_distance_is_rounded_before_zones_are_told_out(spark, monkeypatch):
    points = frame(spark, [(1, (0.12345, 0.0, 1.0))])
    monkeypatch.setattr(lookups, "_points", lambda *_: points)
    monkeypatch.setattr(lookups, "table", lambda *_: spark.createDataFrame([(14_000 * k,) for k in range(1, 60)], "c_custkey long"))
    met = lookups.many_zones(spark, "")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and plan.index("Generate inline(zones") < plan.index("round(")  # printed from the top
    zones = spark.createDataFrame([(k, 0.0, 0.0, 1.0) for k in range(3)], "zone int, zx double, zy double, zr double")
    assert sorted((r["zone"], r["d"]) for r in spatial.within_zones(points, zones, digits=4).collect()) == [(k, round(0.12345, 4)) for k in range(3)]


def test_rounds_over_tiles_equal_rounds_one_by_one(spark, monkeypatch):
    """Seven rounds, so two passes, where crowds lie across borders and corners of tiles; a pass reads and stores the points once."""
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.normal(c, 4, (60, 2)) for c in ((0, 0), (1024, 3), (1020, 1024), (-1024, 500), (512, 2048))])
    points = frame(spark, [(i, (*p, float(rng.uniform(1, 3)))) for i, p in enumerate(xy)] + [(900, (1030.0, 1.0, 1.0))])
    zones, kept = [(1024.0, 0.0, 5.0)], []
    monkeypatch.setattr(topology, "dropped", kept.append)
    seen, plain = [], []
    got = {r["id"]: (r["x"], r["y"]) for r in topology.relax(points, 7, zones, seen=seen).collect()}
    assert len(kept) == 2
    monkeypatch.setattr(topology, "FULL", 10)
    want = {r["id"]: (r["x"], r["y"]) for r in topology.relax(points, 7, zones, seen=plain).collect()}
    assert len(got) == len(want) == 301 and seen == plain and len(seen) == 7
    assert all(math.dist(got[i], want[i]) < 1e-6 for i in want)
