"""The grid index, phrases by grams and thinning against plain readings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from quillmap.operators import phrases, spatial
from quillmap.sources import grid_index


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    xy = np.concatenate((rng.uniform(-500, 500, (3000, 2)), rng.normal(33, 0.5, (1500, 2))))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9000, None, 0.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    return xy, grid_index.write_index(df, 32.0, str(tmp_path_factory.mktemp("index") / "i"), 24), df


def test_near_reads_the_files_it_needs(index):
    xy, grid, _ = index
    files = []
    for radius in (5.0, 60.0, 300.0, 2000.0):
        near = grid.near(-200.0, 150.0, radius)
        files.append(len(near.inputFiles()))
        assert {r["id"] for r in near.collect()} == set(np.flatnonzero(np.hypot(xy[:, 0] + 200, xy[:, 1] - 150) <= radius).tolist())
    assert files == sorted(files) and files[0] <= 2 and files[1] < 8 and files[-1] >= 20
    assert grid.near(1e6, 0.0, 5.0).count() == 0
    assert {r["id"] for r in grid.box(-10, -10, 40, 40).collect()} == set(np.flatnonzero(((xy >= -10) & (xy <= 40)).all(1)).tolist())


def test_cells_tell_counts_and_bounds(spark, index):
    xy, grid, df = index
    counts = {(r["gx"], r["gy"]): r["n"] for r in grid.counts().collect()}
    assert sum(counts.values()) == len(xy) and counts[1, 1] > 1400
    assert grid.cells.where("gx = 1 AND gy = 1").count() > 3  # a crowded cell is spread
    assert np.allclose(grid.low(), xy.min(0))
    x, y = 40.0, 20.0
    want = {tuple(r) for r in spatial.detail_tiers(df, x, y, caps=(40, 90)).collect()}
    assert {tuple(r) for r in spatial.detail_tiers(grid.near(x, y, 100.0).select("id", "x", "y"), x, y, caps=(40, 90), low=grid.low()).collect()} == want


def test_curve_numbers_each_cell_once(spark):
    cells = spark.range(64 * 64).select((F.col("id") % 64 - 32).alias("gx"), (F.floor(F.col("id") / 64) - 32).alias("gy")).select("gx", "gy", grid_index.curve(F.col("gx"), F.col("gy")).alias("k")).collect()

    def plain(gx, gy):
        return sum(((gx + grid_index.HALF) >> b & 1) << 2 * b | ((gy + grid_index.HALF) >> b & 1) << 2 * b + 1 for b in range(21))

    assert all(r["k"] == plain(r["gx"], r["gy"]) for r in cells)


def by_regex(text, table):
    keys = sorted(table, key=len, reverse=True)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, keys)) + r")\b")
    return [m[1] for m in pattern.finditer((text or "").lower()) if not table[m[1]]]


def test_grams_equal_the_regex_over_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng, texts = random.Random(5), [r["text"] or "" for r in docs.collect()]
    table = {}
    while len(table) < 359:
        words = rng.choice(texts).lower().split()
        if words:
            i, n = rng.randrange(len(words)), rng.choice((1, 1, 2, 2, 3, 4))
            p = " ".join(words[i : i + n]).strip(".,;:!?()\"'")
            if re.fullmatch(r"\w(.*\w)?", p):
                table[p] = rng.random() < 0.2
    given = spark.createDataFrame([(p.title() if k % 5 == 0 and p.title().lower() == p else p, s) for k, (p, s) in enumerate(table.items())], "phrase string, skip boolean")
    got = {r["doc_id"]: r["phrases"] for r in phrases.phrases_in(docs, given, ident="doc_id").collect()}
    want = {r["doc_id"]: w for r in docs.collect() if (w := by_regex(r["text"], table))}
    assert got == want and sum(map(len, want.values())) > 1000


def test_longest_skipped_and_odd_phrases(spark):
    table = {"ancient greek": False, "greek": False, "roman catholic": True, "roman": False, "austro-hungarian": False, "d'or": False, "é": False, "new york": False, "york city": False}
    texts = ["an Ancient Greek and greek poet", "Roman Catholic bishop, roman too", "Greeks, a greek-born", None, "", "the Austro-Hungarian d'or é né", "New York City", "no region", "GREEK\ngreek_x ancient  greek"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    given = spark.createDataFrame([*table.items(), ("greek", None), ("'x", False), ("", False), (None, False)], "phrase string, skip boolean")
    got = {r["id"]: r["phrases"] for r in phrases.phrases_in(rows, given).collect()}
    assert got == {i: w for i, t in enumerate(texts) if (w := by_regex(t, table))}
    assert got[6] == ["new york"] and got[1] == ["roman"]
    assert phrases.phrases_in(rows, given.limit(0)).count() == 0


def test_thinning_counts_through_blocks(spark):
    rng = np.random.default_rng(2)
    ids = rng.choice(100_000, 900, replace=False)
    rows = [(int(i), float(v % 3) if k % 3 else 0.5, 0.5) for k, (i, v) in enumerate(zip(ids, rng.integers(0, 30, 900)))]
    got = {r["id"] for r in spatial.thinned(spark.createDataFrame(rows, "id int, x double, y double"), 1.0, 8, 6, block=700).collect()}
    cells = {}
    for i, x, y in sorted(rows):
        cells.setdefault((x // 1, y // 1), []).append(i)
    assert got == {i for c in cells.values() for k, i in enumerate(c) if len(c) <= 8 or k % 6 == 0}
