"""Operators against plain loops: relaxation, monuments, texts, hashes, the height field, and the stages as commands."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from quillmap import cli
from quillmap.functions import geometry as G
from quillmap.functions import noise
from quillmap.functions import text as T
from quillmap.operators import anchors, articles, placement, spatial, stats, terrain, topology
from quillmap.plans import atlas, bridge, stages
from quillmap.sources import binaries, layouts, wikitext
from quillmap.sources.storage import optional, required


def plain_relax(points, zones, rounds):
    """The same relaxation, pair by pair."""
    ids = sorted(points)
    at = {i: np.array(points[i][:2]) for i in ids}
    home, r = {i: v.copy() for i, v in at.items()}, {i: points[i][2] for i in ids}

    def push(share):
        for zx, zy, zr in zones:
            for i in ids:
                away = at[i] - (zx, zy)
                d = math.hypot(*away)
                if d < zr:
                    at[i] = at[i] + share * (zr - d) * away / (d + 1e-9)

    for _ in range(rounds):
        move = {i: np.zeros(2) for i in ids}
        for a in ids:
            for b in ids:
                want, d = 0.9 * max(r[a], r[b]), math.hypot(*(at[a] - at[b]))
                if a != b and d < want:
                    move[a] += (at[a] - at[b]) / (d + 1e-9) * (want - d - 1e-9) * 0.9
        for i in ids:
            at[i] = at[i] + move[i]
        push(0.6)
        for i in ids:
            d = math.hypot(*(at[i] - home[i]))
            if d > 20:
                at[i] = home[i] + (at[i] - home[i]) * 20 / d
    push(1.0)
    return at


def test_relaxation_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    points = {i: (*rng.uniform(-12, 12, 2), float(rng.uniform(1, 2.5))) for i in range(120)}
    zones = [(3.0, 4.0, 2.3), (-6.0, 0.0, 2.3)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in points.items()], "id int, x double, y double, r double")
    want = plain_relax(points, zones, 5)
    for r in topology.relax(df, 5, zones).collect():
        assert abs(r["x"] - want[r["id"]][0]) < 1e-6 and abs(r["y"] - want[r["id"]][1]) < 1e-6
    pair = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.4, 0.0, 1.0)], "id int, x double, y double, r double")
    assert [round(r["mx"], 6) for r in topology.moves(pair, 0.9).orderBy("id").collect()] == [-0.45, 0.45]


def test_a_monument_without_members_fails(spark):
    figures = spark.createDataFrame([("Ada", 0, "Q1", 5, 1.0, 2.0, 1800, "birth", "A"), ("Bo", 1, "Q2", 9, 3.0, 4.0, 1900, "birth", "A"), ("Cy", 2, "Q3", 9, 3.0, 4.0, 1900, None, "A")], "title string, row_idx long, qid string, sitelinks int, x double, y double, death_year int, geo_source string, country_qid string")
    places = spark.createDataFrame([("A", 10.0), ("A", 20.04), ("B", None)], "country_qid string, lon double")
    lists = lambda *rows: spark.createDataFrame(list(rows), "label string, people array<string>")
    (m,) = anchors.monuments(lists(("one", ["Nobody", "Ada", "Bo", "Cy"])), figures, places).collect()
    assert (m["seat_qid"], m["seat_title"], m["people"], m["member_qids"], m["era"], m["n_members"], m["lon_spread"], m["x"]) == ("Q2", "Bo", ["Nobody", "Ada", "Bo", "Cy"], ["Q1", "Q2"], "19th century", 2, 0.0, 2.0)
    with pytest.raises(ValueError, match="empty"):
        anchors.monuments(lists(("one", ["Ada", "Bo"]), ("empty", ["Nobody", "Cy"])), figures, places)


def test_leads_keep_nulls_and_blank_texts_count_nothing(spark):
    rows = [(1, None, 100), (2, " \n ", 500), (3, "One __TOC__ two. Three", 99), (4, "A  b. C", 100), (5, "x", None)]
    out = {r["id"]: tuple(r)[1:] for r in articles.quality_cut(spark.createDataFrame(rows, "id int, lead_text string, article_word_count int")).collect()}
    assert out == {1: (None, 100, None, None), 2: ("", 500, 0, 0), 4: ("A b. C", 100, 3, 2)}


def test_leads_without_galleries_and_other_namespaces():
    text = "<gallery>\nFile:a.jpg|cap\n</gallery>'''Ada''' of [[Wikipedia:X]][[:Category:Y|z]] [[file:q.png|thumb]][[London|town]].\n== A ==\n[[Help:z|h]] b"
    row = wikitext.article("Ada", text)
    assert row["lead_text"] == "Ada of town." and row["links"] == ["London"] and row["article_word_count"] == 7


def test_residue_hashes_and_defaults(spark):
    rows = spark.createDataFrame([(0, "Q1", None, None, None, None, None), (1, "Q22", 1800, 1850, 10.0, 90, 500)], "row_idx long, qid string, birth_year int, death_year int, lon double, sitelinks int, words int")
    got = {r["qid"]: r for r in placement.place(rows).collect()}
    want = int.from_bytes(hashlib.blake2b(b"Q1", digest_size=8).digest(), "big") % 10_000_000 / 10_000_000 * 2 * math.pi
    assert abs(got["Q1"]["base_angle"] - want) < 1e-12 and abs(got["Q22"]["base_angle"] - 190 / 360 * 2 * math.pi) < 1e-12
    assert got["Q1"]["sitelinks"] == 0 and got["Q1"]["book_scale"] == 0.8 and abs(got["Q1"]["radius"] - 600) < 15
    assert spark.createDataFrame([(None,)], "q string").select(noise.residue(F.col("q")).alias("v")).first()["v"] is None


def test_hashes_and_generator_equal_integer_arithmetic(spark):
    m = 0xFFFFFFFF

    def generator(seed):
        a = seed & m
        while True:
            a = (a + 0x6D2B79F5) & m
            t = (a ^ (a >> 15)) * (1 | a) & m
            t = ((t + ((t ^ (t >> 7)) * (61 | t) & m)) & m) ^ t
            yield ((t ^ (t >> 14)) & m) / 2**32

    ids = [0, 1, 65535, 65536, 123456789, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", G.near_hash(F.col("i")).alias("a"), G.far_hash(F.col("i")).alias("b"), *(G.mulberry(F.col("i"), F.lit(n)).alias(f"u{n}") for n in (1, 2, 3)))
    for r in df.collect():
        g = generator(r["i"])
        assert r["a"] == (r["i"] * 2654435761 & m) / 2**32 and r["b"] == ((r["i"] ^ 0x9E3779B9) * 2246822519 & m) / 2**32
        assert [r["u1"], r["u2"], r["u3"]] == [next(g) for _ in range(3)]


def test_picks_the_nearer_of_point_and_monument(spark):
    points = spark.createDataFrame([(1, 3.0, 0.2), (2, 2.0, 1.0), (3, -1.0, 0.0)], "id int, x double, y double")
    stones = spark.createDataFrame([(7, 10.0, 1.5), (8, 0.0, 2.0)], "id int, x double, y double")
    eyes = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0), (1, 7.0, 1.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0)], "eye int, ex double, ey double, dx double, dy double")
    got = {r["eye"]: (r["kind"], r["id"]) for r in spatial.pick(points, stones, eyes).collect()}
    assert got == {0: ("point", "1"), 1: ("monument", "7"), 2: ("monument", "8")}


def test_facets_come_first_and_chords_fill_gaps(spark):
    raster = spark.createDataFrame([(i, j, float(3 * i + j * j)) for i in range(4) for j in range(4)], "i int, j int, h double")
    points = spark.createDataFrame([(1, 0.25, 0.5, 0.5, 0.25), (2, 2.5, 2.25, 2.25, 2.5), (3, 2.0, 2.0, 2.0, 2.0)], "id int, x double, y double, row double, col double")
    tri = spark.createDataFrame([(0.0, 0.0, 5.0, 1.0, 0.0, 5.0, 0.0, 1.0, 5.0, 0, 0), (-1.0, -1.0, 9.0, 3.0, -1.0, 9.0, -1.0, 3.0, 9.0, 1, 1)], "x1 double, y1 double, h1 double, x2 double, y2 double, h2 double, x3 double, y3 double, h3 double, gi long, gj long")
    got = {r["id"]: r["h"] for r in spatial.facet_height(points, tri, raster, 1.0).collect()}
    assert got == {1: 5.0, 2: 6.75 + 4 + 2.5, 3: 10.0}


def test_layouts_of_unknown_columns(spark):
    polar = spark.createDataFrame([(2.0, math.pi / 2, "t")], "radius double, angle double, title string")
    r = layouts.with_xy(polar).first()
    assert abs(r["x"]) < 1e-12 and r["y"] == 2.0 and r["title"] == "t"
    with pytest.raises(ValueError, match="needs x and y"):
        layouts.with_xy(polar.drop("angle"))
    titles = spark.createDataFrame([(1, "Anna"), (0, "Hans")], "row_idx int, title string")
    assert [x["row_idx"] for x in layouts.find_titles(titles, " AN ").collect()] == [0, 1] and layouts.find_titles(titles, "  ").count() == 0


def test_offsets_need_no_dense_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(n)) for k, n in zip(rng.choice(10**9, 500, replace=False), rng.integers(0, 50, 500))]
    out = stats.running_offsets(spark.createDataFrame(rows, "k long, n int").repartition(7), ["k"], "n").orderBy("place").collect()
    sizes = [n for _, n in sorted(rows)]
    assert [r["starts"] for r in out] == np.concatenate(([0], np.cumsum(sizes))).tolist() and out[-1]["k"] is None
    assert [tuple(r) for r in stats.running_offsets(spark.createDataFrame([], "k long, n int"), ["k"], "n").collect()] == [(None, 0, 0)]


def test_watched_counts_in_one_pass(spark):
    kept, seen = stats.watched(spark.range(10), F.col("id") < 4, "w")
    assert kept.count() == 4 and (seen.get["n"], seen.get["kept"], seen.get["pct"]) == (10, 4, 40.0)


def test_height_field_equals_a_pointwise_reading(spark):
    """Cells of the field, term by term with scalar arithmetic."""
    places, state = list(range(256)), 0x9E3779B1
    for i in range(255, 0, -1):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        places[i], places[state % (i + 1)] = places[state % (i + 1)], places[i]
    gradients = [(1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1)]
    ease = lambda t: (lambda t: t**3 * (t * (t * 6 - 15) + 10))(min(1.0, max(0.0, t)))

    def noise2(x, y, period=None):
        i, j = math.floor(x), math.floor(y)

        def dot(di, dj):
            column = (i + di) % period if period else i + di
            g = gradients[places[(places[column & 255] + (j & 255) + dj) & 255] & 7]
            return g[0] * (x - i - di) + g[1] * (y - j - dj)

        u, v = ease(x - i), ease(y - j)
        return (1 - v) * ((1 - u) * dot(0, 0) + u * dot(1, 0)) + v * ((1 - u) * dot(0, 1) + u * dot(1, 1))

    def height(x, z):
        r = math.hypot(x, z)
        turn = math.atan2(z, x) - 0.6 * math.log(max(r, 1) / 700)
        dunes = weights = 0.0
        for k in (6, 12, 24, 48, 96, 192):
            away = (math.log(max(r, 1)) - math.log(k * 300 / (2 * math.pi))) / math.log(2)
            if abs(away) < 1:
                w = 0.5 * (1 + math.cos(math.pi * away))
                a, b = k * turn / (2 * math.pi), k * math.log(max(r, 1)) / (2 * math.pi * 4.5)
                f = sum(noise2(a * 2**o, b * 2**o, k * 2**o) / 2**o for o in range(3)) / 1.75
                dunes, weights = dunes + w * (1 - abs(f)) ** 2, weights + w
        dunes = 70 * (dunes / weights if weights > 1e-6 else dunes)
        rest = 60 * (1 - ease((r - 700) / 4500)) - 18 * (1 - ease(r / 1400))
        rest += ease((r - 700) / 700) * (1 - ease((r - 2400) / 2800)) * 60 * math.cos(3 * turn + 0.5 * noise2(x / 2600, z / 2600))
        return dunes, rest

    rows = terrain.field_rows(spark, 24).collect()
    assert len(rows) == 576
    for q in rows[::7]:
        x, z = (q["j"] + 0.5) * 750 - 9000, (q["i"] + 0.5) * 750 - 9000
        dunes, rest = height(x, z)
        assert abs(q["dunes"] - dunes) < 1e-6 and abs(q["rest"] - rest) < 1e-6
    left = terrain.gradient_noise(np.array([0.3]), np.array([4.2]), 6)
    assert np.allclose(left, terrain.gradient_noise(np.array([6.3]), np.array([4.2]), 6))


def test_height_map_is_calm_at_the_centre_and_under_books(spark):
    points = spark.createDataFrame([(3000.0 + 300 * (i % 10), 300.0 * (i // 10 % 12) - 1800) for i in range(960)], "x double, y double")
    grid, books, envelope = terrain.heightmap(points, 64)
    bare, none, _ = terrain.heightmap(None, 64)
    assert none.max() == 0 and books.max() > 0 and envelope[32, 32] < 0.01 and envelope[32, 46] < envelope[32, 17]
    assert grid.shape == (64, 64) and np.isfinite(grid).all() and not np.allclose(grid, bare)
    near = terrain.window(spark, 3000.0, 0.0, 400.0, 16)
    assert near.shape == (16, 16)
    n = terrain.normals(np.add.outer(np.zeros(6), np.arange(6.0)), 1.0)
    assert np.allclose(n, np.array([-1, 1, 0]) / math.sqrt(2))
    x, z = terrain.jittered(np.arange(5), np.arange(5), 70.0, 0.3)
    assert (np.hypot(x - 70 * np.arange(5), z - 70 * np.arange(5)) <= 21).all()


def test_density_equals_direct_sums(spark):
    counts = np.zeros((12, 12))
    counts[3, 4], counts[7, 8] = 5, 2

    def blurred(g, sigma):
        n = max(1, int(4 * sigma + 0.5))
        w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
        fold = lambda i, m: (lambda p: p if p < m else 2 * m - 1 - p)(i % (2 * m))
        out = np.zeros_like(g)
        for i in range(len(g)):
            for j in range(len(g)):
                out[i, j] = sum(w[a + n] * w[b + n] * g[fold(i + a, len(g)), fold(j + b, len(g))] for a in range(-n, n + 1) for b in range(-n, n + 1)) / sum(w) ** 2
        return out

    d = blurred(counts, 1.1)
    want = blurred(np.clip(d / np.percentile(d, 98), 0, 1), 2.0)
    assert np.allclose(terrain.density(counts, 2400.0), want) and terrain.density(np.zeros((4, 4))).max() == 0


def test_stages_run_as_commands(spark, tmp_path, capsys):
    dump, wiki = stages.entity_dump(spark, SF), stages.article_dump(spark, SF)
    path = lambda name: str(tmp_path / name)
    (tmp_path / "g.json").write_text(json.dumps({"min_pool": 30, "citizenship_aliases": {"C26": "C1"}, "_ignore": [], "regions": stages.REGIONS}))
    cli.main(["figures", "--dump", dump, "--out", path("f.parquet")])
    cli.main(["figures", "--dump", dump, "--out", path("f.parquet"), "--limit", "20"])
    cli.main(["prefilter", "--in", path("f.parquet"), "--out", path("p.parquet"), "--death-year-max", "1900"])
    assert "kept" in capsys.readouterr().out and spark.read.parquet(path("f.trial.parquet")).count() <= 20
    cli.main(["articles", "--in", path("p.parquet"), "--dump", wiki, "--out", path("a.parquet")])
    cli.main(["cut", "--in", path("a.parquet"), "--out", path("c.parquet"), "--min-article-words", "200"])
    cli.main(["places", "--in", path("p.parquet"), "--dump", dump, "--out", path("w.parquet")])
    cli.main(["place", "--figures", path("c.parquet"), "--places", path("w.parquet"), "--gazetteer", path("g.json"), "--out", path("l.parquet")])
    cut, laid = spark.read.parquet(path("c.parquet")), spark.read.parquet(path("l.parquet"))
    assert 0 < cut.count() == laid.count() and cut.agg(F.min("article_word_count")).first()[0] >= 200
    (tmp_path / "m.json").write_text(json.dumps({"one": [r["title"] for r in laid.where("geo_source is not null or true").limit(3).collect()]}))
    spark.createDataFrame([(laid.first()["x"], laid.first()["y"])], "x double, y double").write.parquet(path("t.parquet"))
    cli.main(["relax", "--placement", path("l.parquet"), "--teleporters", path("t.parquet"), "--out", path("r.parquet"), "--rounds", "2"])
    assert spark.read.parquet(path("r.parquet")).columns == laid.columns
    cli.main(["inspect", "--in", path("r.parquet"), "--out", path("h.parquet"), "--bins", "16"])
    assert spark.read.parquet(path("h.parquet")).agg(F.sum("n")).first()[0] == laid.count()
    cli.main(["heightmap", "--books", path("none.parquet"), "--out", path("h.npz"), "--res", "32"])
    cli.main(["mesh", "--heightmap", path("h.npz"), "--out", path("g.bin"), "--stride", "2"])
    assert binaries.read_raster(path("h.npz"))["H"].shape == (32, 32) and len(binaries.read_soup(path("g.bin"))) == 15 * 15 * 6
    with pytest.raises(FileNotFoundError, match="dump not found"):
        cli.main(["figures", "--dump", path("nowhere.json"), "--out", path("x.parquet")])


def test_exports_and_their_readers(spark, tmp_path):
    rows = bridge.positions(spark, SF)
    missing = layouts.write_spawn(rows, ["Q3", "Q0x", "Q1"], str(tmp_path / "s.json"))
    back = layouts.read_json(spark, str(tmp_path / "s.json"), "qid string, title string, x double, y double").collect()
    assert missing == ["Q0x"] and [r["qid"] for r in back] == ["Q3", "Q1"]
    layouts.write_world(str(tmp_path / "w.json"))
    assert layouts.read_json(spark, str(tmp_path / "w.json"), "R_INNER double, REF_YEAR double").first()["R_INNER"] == 600.0
    assert optional(spark, str(tmp_path / "no.parquet"), "x double").count() == 0
    assert required(spark, str(tmp_path / "w.json"), "world")


def test_era_labels(spark):
    df = spark.createDataFrame([(2000, None, None), (-44, -100, -44), (1850, 1800, None), (7, None, 7)], "y int, b int, d int")
    got = [(r["a"], r["b"]) for r in df.select(T.era_label(F.col("y")).alias("a"), T.figure_era(F.col("b"), F.col("d")).alias("b")).collect()]
    assert got == [("the present", ""), ("c.44 BCE", "c.44 BCE"), ("c.1850", "c.1800"), ("c.7", "c.7")]


def test_relaxed_layout_leaves_the_discs(spark):
    rows = atlas.relax_layout(spark, SF)
    assert rows.count() == 1500
    for x, y, r in atlas.MONUMENT_DISCS:
        assert rows.where(F.hypot(F.col("x") - x, F.col("y") - y) < r - 1e-6).count() == 0
