import pytest
from pyspark.sql import functions as F

from quillmap.functions import text as T
from quillmap.operators import anchors, placement, spatial, topology


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("v")).first()["v"]


def test_unicode_blanks_and_nulls(spark):
    assert one(spark, T.word_count(F.col("t")), t="a b  c\n") == 3
    assert one(spark, T.word_count(F.col("t")), t=None) is None
    assert one(spark, T.sentence_count(F.col("t")), t="One. Two! three") == 2
    assert one(spark, T.clean_lead(F.col("t")), t=" __TOC__ x  y ") == "x y"


@pytest.mark.parametrize("year,label", [(0, "0th century BCE"), (1, "1st century"), (-1, "1st century BCE"), (1150, "12th century"), (2001, "21st century")])
def test_century(spark, year, label):
    assert one(spark, T.century(F.col("y")), y=year) == label


def test_match_phrase_prefers_the_longest_and_skips_ignored(spark):
    assert one(spark, T.match_phrase(F.col("t"), ["rome", "new rome"], ["greek fire"]), t="Greek fire of New Rome") == "new rome"
    assert one(spark, T.match_phrase(F.col("t"), ["rome"]), t="romeo") is None


def test_grid_pairs_equal_brute_force(spark):
    points = [(i, float((i * 37) % 101) / 3, float((i * 53) % 97) / 3) for i in range(300)] + [(300, 0.0, 0.0), (301, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r["a"], r["b"]) for r in spatial.pairs_within(df, 2.0).collect()}
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 2.0}
    assert got == want


def test_coincident_points_stay_and_discs_push(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 50.0, 0.0, 1.0)], "id int, x double, y double, r double")
    out = {r["id"]: (r["x"], r["y"]) for r in topology.relax(df, rounds=3, zones=[(49.0, 0.0, 3.0)]).collect()}
    assert out[1] == out[2] == (0.0, 0.0) and out[3][0] >= 52.0 - 1e-9
    assert topology.residual(df).first()["pairs"] == 1


def test_ladder_precedence(spark):
    rows = [("Q1", 10.0, "birth", "A", "B", "C"), ("Q2", None, None, None, "B", "C"), ("Q3", None, None, "Z", "X", "C"), ("Q4", None, None, "Z", None, None)]
    figures = spark.createDataFrame(rows, "qid string, lon double, geo_source string, country_qid string, citizen string, region string")
    pool = spark.createDataFrame([("B",), ("C",)], "country_qid string")
    got = {r["qid"]: (r["geo_source"], r["country_qid"]) for r in placement.ladder(figures, pool).collect()}
    assert got == {"Q1": ("birth", "A"), "Q2": ("citizenship", "B"), "Q3": ("gazetteer", "C"), "Q4": (None, "Z")}


def test_monument_constraint(spark):
    bad = spark.createDataFrame([("x", 1, 0.0), ("y", 3, 40.0), ("z", 2, 39.9)], "label string, n_members int, lon_spread double")
    with pytest.raises(ValueError, match="x .*y "):
        anchors.require(bad)
    assert anchors.require(bad.where("label = 'z'")).count() == 1
