"""The stream of links against the batch stage, in any order of files and over restarts."""

import pytest
from pyspark.sql import functions as F

from quillmap.operators.links import resolve
from quillmap.sources import dumps
from quillmap.sources.wikitext import parse_articles
from quillmap.streaming import links

PAGES = {
    "a": [("Ada", None, "x [[Old Bob]] and [[Cy]] and [[old Bob|him]] [[File:x.png]]"), ("Bob", None, "[[Ada]] [[Nowhere]] [[Popular]]")],
    "b": [("Old Bob", "Aaron", None), ("Cy", None, "[[Popular]] [[Old Bob]]")],
    "c": [("Old Bob", "Bob", None), ("Popular", "Ada", None), ("Dee", None, "[[Popular]] [[Cy]]"), ("Old Cy", "Cy", None), ("Empty", None, "no links")],
}
TITLES = [("Ada", "Q1", 1), ("Bob", "Q2", 2), ("Cy", "Q3", 3), ("Cy", "Q33", 4), ("Aaron", "Q4", 5)]


def xml(rows):
    page = lambda t, r, x: f"<page><title>{t}</title><ns>0</ns>" + (f'<redirect title="{r}"/>' if r else "") + f"<revision><text>{x or ''}</text></revision></page>"
    return "<mediawiki>" + "".join(page(*r) for r in rows) + "</mediawiki>"


@pytest.fixture(scope="module")
def batch(spark):
    rows = spark.createDataFrame([r for part in PAGES.values() for r in part], "title string, redirect string, text string")
    titles = spark.createDataFrame(TITLES, "title string, qid string, row_idx int")
    parsed = parse_articles(rows.where("redirect IS NULL")).select(F.col("title").alias("page_id"), "links")
    hops = rows.where("redirect IS NOT NULL").select(F.col("title").alias("source"), F.col("redirect").alias("target"))
    return titles, {r["page_id"]: r["qids"] for r in resolve(parsed, hops, titles).collect()}


@pytest.mark.parametrize("order", ["abc", "cab", "bca"])
def test_any_order_of_files_and_restarts_give_the_batch_result(spark, tmp_path, batch, order):
    titles, want = batch
    folder = tmp_path / "in"
    folder.mkdir()
    for k, name in enumerate(order):  # each file meets a new query that goes on from the checkpoint
        (folder / f"{k}.xml").write_text(xml(PAGES[name]))
        links.follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    told = spark.read.schema(links.RESOLVED).parquet(str(tmp_path / "out"))
    assert {r["page"]: r["qids"] for r in links.outgoing(told, titles).collect()} == want
    assert want["Ada"] == ["Q2", "Q33"] and want["Dee"] == ["Q1", "Q33"]
    links.follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing new
    assert spark.read.schema(links.RESOLVED).parquet(str(tmp_path / "out")).count() == told.count()


def test_a_late_redirect_tells_waiting_links_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.xml").write_text(xml(PAGES["a"]))
    links.follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), files=1)
    (folder / "1.xml").write_text(xml(PAGES["c"]))
    links.follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), files=1)
    rows = [tuple(r) for r in spark.read.schema(links.RESOLVED).parquet(str(tmp_path / "out")).where("page = 'Ada' AND pos = 0").orderBy("turn").collect()]
    assert rows == [("Ada", 0, "Old Bob", 0), ("Ada", 0, "Bob", 1)]


def test_links_and_redirects_meet_by_a_join(spark):
    """No Python function holds state; of repeated rows and several redirects the greatest target is the last word."""
    rows = [r for part in PAGES.values() for r in part] * 2
    pages = spark.createDataFrame(rows, "title string, redirect string, text string")
    told = links.resolved(links.told(pages))
    assert "TransformWithState" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["target"], r["turn"]) for r in told.where("page = 'Cy' AND pos = 1").collect()} == {("Old Bob", 0), ("Aaron", 1), ("Bob", 1)}
    titles = spark.createDataFrame(TITLES, "title string, qid string, row_idx int")
    assert {r["page"]: r["qids"] for r in links.outgoing(told, titles).collect()}["Cy"] == ["Q1", "Q2"]
