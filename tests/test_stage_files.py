"""What the stages over dumps leave on disk."""

import gzip
import os
import xml.etree.ElementTree as ET

import pytest

from conftest import SF
from quillmap.plans import lookups, stages
from quillmap.sources import storage


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """A folder of its own for the tables and dumps of a stage."""
    at = lambda _, name: f"{tmp_path}/{name}-{len(os.listdir(tmp_path))}"
    monkeypatch.setattr(storage, "shared_folder", at)
    monkeypatch.setattr(stages, "shared_folder", at)
    monkeypatch.setattr(lookups, "shared_folder", at)
    return tmp_path


def test_dumps_are_packed_into_whole_files(spark, shared, monkeypatch):
    monkeypatch.setattr(stages, "ROWS", 100)
    rows = 0
    for path in (stages.article_dump(spark, SF), stages.entity_dump(spark, SF)):
        files = [f"{path}/{n}" for n in os.listdir(path) if n.startswith("part-")]
        assert len(files) > 10 and all(n.endswith(".gz") for n in files)
        texts = [gzip.open(n).read() for n in files]
        assert sum(map(os.path.getsize, files)) * 4 < sum(map(len, texts))
        rows += sum(len(ET.fromstring(t).findall("page")) for t in texts) if "wiki" in path else 0
    assert rows == 1500 - 215 + 150  # six in seven, and a redirect to every tenth


def test_articles_leave_only_the_last_table(spark, shared):
    out = stages.dump_articles(spark, SF)
    assert [n.rsplit("-", 1)[0] for n in os.listdir(shared)] == ["articles-cut"]
    assert out.count() > 500


def test_places_are_read_before_the_dump_goes(spark, shared):
    out = stages.dump_located(spark, SF)
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(shared)) == ["figures", "places"]
    assert out.where("lon IS NOT NULL").count() > 0


def test_the_chain_leaves_the_cut_and_its_places(spark, shared):
    out = stages.dump_chain(spark, SF)
    assert sorted(n.rsplit("-", 1)[0] for n in os.listdir(shared)) == ["articles-cut", "places"]
    assert out.count() > 1


def test_the_stream_leaves_only_its_links(spark, shared):
    out = lookups.link_stream(spark, SF)
    assert [n.rsplit("-", 1)[0] for n in os.listdir(shared)] == ["links"]
    assert all(n.endswith(".zstd.parquet") for n in os.listdir(f"{shared}/{os.listdir(shared)[0]}") if n.startswith("part-"))
    assert out.count() == 1500 - 215
