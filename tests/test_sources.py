import bz2
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from quillmap.operators import terrain
from quillmap.plans import atlas
from quillmap.sources import binaries, dumps, wikitext
from quillmap.streaming.stages import figures_stream


def dump(path, extra=()):
    lines = ["["] + [json.dumps(e | {"type": "item"}).replace('{"id"', '{"id"') + "," for e in atlas.ENTITIES] + list(extra) + ["]"]
    with bz2.open(path, "wt") as out:
        out.write("\n".join(lines) + "\n")
    return str(path)


def test_entity_dump(spark, tmp_path):
    rows = dumps.figures(spark, dump(tmp_path / "d.json.bz2"))
    got = {r["qid"]: r for r in rows.collect()}
    assert set(got) == {"Q1", "Q2"}
    assert (got["Q1"]["death_year"], got["Q1"]["claim_count"], got["Q1"]["identifier_count"], got["Q1"]["has_image"], got["Q1"]["citizenships"]) == (1853, 8, 1, True, ["Q145"])
    assert (got["Q2"]["death_year"], got["Q2"]["birth_place_qid"], got["Q2"]["description"]) == (-44, "Q220", None)
    assert [r["qid"] for r in dumps.prefilter(rows).collect()] == ["Q1"] and dumps.prefilter(rows, keep_missing_description=True).count() == 2


def test_malformed_lines_fail_or_are_skipped(spark, tmp_path):
    path = dump(tmp_path / "d.json.bz2", ['{"type": "item", "id": "Q220", broken'])
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        dumps.figures(spark, path).collect()
    lines = dumps.entity_lines(spark, path)
    assert dumps.entities(lines, strict=False).count() == len(atlas.ENTITIES)


def test_empty_maps_written_as_lists(spark, tmp_path):
    human = {"type": "item", "id": "Q77", "labels": [], "descriptions": [], "sitelinks": {"enwiki": {"title": "E"}}, "claims": {"P31": [atlas._snak({"id": "Q5"})], "P570": [atlas._snak({"time": "+1700-01-01T00:00:00Z"})]}}
    bare = {"type": "item", "id": "Q78", "labels": {"en": {"value": 'said "claims":[] once'}}, "claims": [], "sitelinks": [], "aliases": []}
    path = dump(tmp_path / "d.json.bz2", [json.dumps(human) + ",", json.dumps(bare, separators=(",", ":")) + ","])
    got = {r["qid"]: r for r in dumps.figures(spark, path).collect()}  # strict: a malformed line would fail
    assert set(got) == {"Q1", "Q2", "Q77"} and got["Q77"]["description"] is None
    labels = [r["label"] for r in dumps.entities(dumps.entity_lines(spark, path)).select(F.col("e.labels")["en"]["value"].alias("label")).collect()]
    assert 'said "claims":[] once' in labels


def test_places_parse_only_needed_lines(spark, tmp_path):
    ordered = [{"type": "item", "id": e["id"]} | e for e in atlas.ENTITIES]
    path = tmp_path / "p.json"
    path.write_text("\n".join(json.dumps(e) + "," for e in ordered))
    need = spark.createDataFrame([("Q220", None), ("Q9", "")], "birth_place_qid string, death_place_qid string")
    (place,) = dumps.places(spark, str(path), need).collect()
    assert (place["label"], place["lat"], place["lon"], place["country_qid"]) == ("Rome", 41.9, 12.5, "Q38")


XML = """<mediawiki><page><title>Ada &amp; Co</title><ns>0</ns><revision><text>{{Short description|English poet}}'''Ada''' ({{circa|1815}}, ) was a [[poet]] from [[London|the city]].&lt;ref&gt;x&lt;/ref&gt;
== Life ==
Text [[Bob]] [[File:x.png]].
== Work ==
More.</text></revision></page><page><title>Bob</title><ns>0</ns><redirect title="Ada &amp; Co"/><revision><text>#REDIRECT</text></revision></page><page><title>Talk:X</title><ns>1</ns><revision><text>t</text></revision></page><page><title>None</title><ns>0</ns><revision></revision></page></mediawiki>"""


def test_article_dump_and_links(spark, tmp_path):
    (tmp_path / "w.xml").write_text(XML)
    wiki = dumps.pages(spark, str(tmp_path / "w.xml"))
    assert {r["title"]: r["redirect"] for r in wiki.collect()} == {"Ada & Co": None, "Bob": "Ada & Co"}
    people = spark.createDataFrame([("Q1", "Ada & Co"), ("Q3", "Nobody")], "qid string, title string")
    got = {r["qid"]: r for r in dumps.with_articles(people, wiki).collect()}
    a = got["Q1"]
    assert a["short_description"] == "English poet" and a["article_ref_count"] == 1 and a["article_section_count"] == 1 and a["outgoing_qids"] == ["Q1"]
    assert a["lead_text"] == "Ada (c. 1815) was a poet from the city."
    assert got["Q3"]["lead_text"] is None and got["Q3"]["outgoing_qids"] == []


def test_nested_templates():
    assert wikitext.strip("a{{x|{{y|{{ndash}}}}}}b{{ndash}}c") == "ab–c"


def test_binaries_round_trip(spark, tmp_path):
    rows = atlas.placed(spark, SF).withColumns({"geo_source": F.when(F.col("lon").isNotNull(), "birth"), "description": F.when(F.col("row_idx") % 2 == 0, F.concat(F.lit("é "), F.col("country")))})
    p, m = str(tmp_path / "positions.bin"), str(tmp_path / "meta.gz.bin")
    assert binaries.write_positions(rows, p) == binaries.write_meta(rows, m) == 1500
    got, want = binaries.read_positions(p), rows.orderBy("row_idx").collect()
    assert np.allclose(got["x"], [r["x"] for r in want], atol=1e-2) and set(got["geo"]) == {0, 4}
    meta = binaries.read_meta(m)
    assert [(r["title"], r["description"] or "", r["birth_year"], r["death_year"]) for r in want] == meta
    first = open(m, "rb").read()
    binaries.write_meta(rows.repartition(7), m)
    assert open(m, "rb").read() == first


def test_terrain(spark, tmp_path):
    grid = np.zeros((16, 16))
    grid[8, 8] = 100.0
    out = terrain.avalanche(grid, 1.0)
    assert abs(out.sum() - 100) < 1e-9 and out.max() < 100 and np.allclose(terrain.avalanche(np.ones((8, 8)), 1.0), 1)
    points = spark.createDataFrame([(0.0, 0.0), (9000.0, 9000.0), (-9000.0, -9000.0), (9001.0, 0.0)], "x double, y double")
    h = terrain.histogram(points, 8)
    assert h.sum() == 3 and h[7, 7] == 1 and h[0, 0] == 1 and h[4, 4] == 1
    d = terrain.density(h)
    assert d.shape == (8, 8) and 0 <= d.min() and d.max() <= 1
    v, f = terrain.grid_mesh(grid, 160.0)
    s = terrain.soup(v, f)
    assert len(v) == 256 and len(f) == 450 and len(terrain.grid_mesh(grid, 160.0, 1, 40.0)[1]) < 450
    binaries.write_soup(s, str(tmp_path / "g.bin"))
    assert np.allclose(binaries.read_soup(str(tmp_path / "g.bin")), s, atol=1e-4)
    binaries.write_heightmap(grid, 160.0, str(tmp_path / "h.bin"))
    back, world = binaries.read_heightmap(str(tmp_path / "h.bin"))
    assert world == 160.0 and np.array_equal(back, grid.astype(np.float32))


def test_gazetteer(tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"min_pool": 5, "_ignore": ["Greek Fire"], "regions": {"Rome": "Q1"}}))
    g = binaries.load_gazetteer(str(tmp_path / "g.json"))
    assert g["regions"] == {"rome": "Q1"} and g["ignore"] == ["greek fire"] and g["min_pool"] == 5


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("[\n" + ",\n".join(json.dumps(e) for e in atlas.ENTITIES) + "\n]")
    q = figures_stream(spark, str(folder)).writeStream.format("memory").queryName("figures_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["qid"] for r in spark.table("figures_now").collect()] == ["Q1"]


def test_a_line_is_parsed_once(spark, tmp_path):
    """Filters on parsed columns stay above the parser, and a statement's rank keeps the order of the line."""
    path = dump(tmp_path / "d.json.bz2")
    rows = dumps.prefilter(dumps.figures(spark, path), 1900)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(") == 1 and rows.count() == 1
    ranks = [("a", "normal"), ("b", "deprecated"), ("c", "preferred"), ("d", None), ("e", "preferred")]
    human = {"type": "item", "id": "Q90", "sitelinks": {"enwiki": {"title": "E"}}, "claims": {"P31": [atlas._snak({"id": "Q5"})], "P570": [atlas._snak({"time": "+1700-01-01T00:00:00Z"})], "P27": [atlas._snak({"id": i}) | ({"rank": r} if r else {}) for i, r in ranks]}}
    path = dump(tmp_path / "r.json.bz2", [json.dumps(human) + " , \t"])
    assert [r["citizenships"] for r in dumps.figures(spark, path).where("qid = 'Q90'").collect()] == [["c", "e", "a", "d"]]


def test_links_are_normalized_once(spark):
    from quillmap.operators.links import resolve

    pages = spark.createDataFrame([("p", [" :ada_L#x", "Ada L", "Help:y", "", "old", "gone"])], "page_id string, links array<string>")
    out = resolve(pages, spark.createDataFrame([("Old", "Bob")], "source string, target string"), spark.createDataFrame([("Ada L", "Q1", 1), ("Bob", "Q2", 2)], "title string, qid string, row_idx long"))
    assert [tuple(r) for r in out.collect()] == [("p", ["Q1", "Q2"])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(?U)^:") == 1
