"""Packed files as Spark sources, and their distributed writers, against the plain readers."""

import gzip
import zlib

import numpy as np
import pytest

from conftest import SF
from quillmap.plans import bridge
from quillmap.sources import binaries, packed
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def layout(spark):
    rows = bridge.placed(spark, SF).withColumn("geo_source", F.when(F.col("row_idx") % 3 == 0, "death")).withColumn("description", F.when(F.col("row_idx") % 4 != 0, F.concat(F.lit("é🙂 "), F.repeat(F.lit("x"), (F.col("row_idx") % 7).cast("int")))))
    packed.register(spark)
    return rows.cache()


@pytest.fixture(scope="module")
def files(layout, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packed")
    p, m = str(folder / "positions.bin"), str(folder / "meta.gz.bin")
    assert packed.write_positions(layout, p, 400) == packed.write_meta(layout, m, 400) == 1500
    for path, zipped in ((p, p + ".gz"), (m, m + ".plain")):
        data = open(path, "rb").read()
        open(zipped, "wb").write(gzip.compress(data) if zipped.endswith(".gz") else gzip.decompress(data))
    return p, m


def test_positions_read_back_over_ranges(spark, layout, files):
    want = binaries.read_positions(files[0])
    for path, parts in ((files[0], 4), (files[0] + ".gz", 1)):
        df = spark.read.format("packed_positions").option("rows", 400).load(path)
        assert df.rdd.getNumPartitions() == parts
        rows = df.orderBy("row_idx").collect()
        assert [r["row_idx"] for r in rows] == list(range(1500))
        for c in want:
            assert [r[c] for r in rows] == want[c].tolist()
    order = [r["row_idx"] for r in layout.select("row_idx").orderBy("row_idx").collect()]
    xs = {r["row_idx"]: r["x"] for r in layout.select("row_idx", F.col("x").cast("float").alias("x")).collect()}
    assert [xs[i] for i in order] == want["x"].tolist()


def test_only_wanted_columns_are_read(spark, files, tmp_path):
    cut = str(tmp_path / "cut.bin")
    data = open(files[0], "rb").read()
    open(cut, "wb").write(data[: 4 + 1500 * 8])  # without the codes
    some = spark.read.format("packed_positions").schema("y float, row_idx long").option("rows", 333).load(cut)
    assert some.columns == ["y", "row_idx"] and np.allclose([r["y"] for r in some.orderBy("row_idx").collect()], binaries.read_positions(files[0])["y"])
    with pytest.raises(Exception, match="too early"):
        spark.read.format("packed_positions").load(cut).collect()
    with pytest.raises(Exception, match="no column"):
        spark.read.format("packed_positions").schema("z float").load(cut).collect()


def test_meta_reads_back_over_ranges(spark, layout, files):
    want = binaries.read_meta(files[1])
    assert any("🙂" in d for _, d, _, _ in want) and any(b is None for _, _, b, _ in want)
    for path, parts in ((files[1], 1), (files[1] + ".plain", 4)):
        df = spark.read.format("packed_meta").option("rows", 400).load(path)
        assert df.rdd.getNumPartitions() == parts
        assert [(r["title"], r["description"], r["birth_year"], r["death_year"]) for r in df.orderBy("row_idx").collect()] == want
    table = layout.orderBy("row_idx").select("title", F.coalesce("description", F.lit("")), "birth_year", "death_year").collect()
    assert [tuple(r) for r in table] == want
    assert [r[0] for r in spark.read.format("packed_meta").schema("description string").load(files[1] + ".plain").collect()][:50] == [d for _, d, _, _ in want][:50]


def test_the_same_rows_give_the_same_bytes(layout, files, tmp_path):
    again = str(tmp_path / "m.bin")
    packed.write_meta(layout.repartition(7), again, 400)
    assert open(again, "rb").read() == open(files[1], "rb").read()
    none = str(tmp_path / "none")
    assert packed.write_positions(layout.limit(0), none) == 0 and open(none, "rb").read() == bytes(4)
    assert packed.write_meta(layout.limit(0), none) == 0 and binaries.read_meta(none) == []


def test_heightmap_cells(spark, tmp_path):
    grid = np.arange(36, dtype="<f4").reshape(6, 6) / 4
    path = str(tmp_path / "h.bin")
    binaries.write_heightmap(grid, 100.0, path)
    packed.register(spark)
    rows = spark.read.format("packed_heightmap").option("rows", 7).load(path).collect()
    assert len(rows) == 36 and all(r["h"] == grid[r["i"], r["j"]] for r in rows)


def test_checksums_of_parts_give_that_of_the_whole():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (1000, 77), (3, 70_000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert packed.crc32_of_both(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)
