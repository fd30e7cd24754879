"""Rows of phrases' grams do not carry their text."""

from quillmap.operators import phrases


def test_no_row_of_a_token_carries_its_text(spark):
    docs = spark.createDataFrame([(1, "the Rome of new rome, and Old  Rome"), (2, None), (3, ""), (4, "rome")], "id int, text string")
    given = spark.createDataFrame([("new rome", False), ("rome", False), ("old rome", True)], "phrase string, skip boolean")
    found = phrases.phrases_in(docs, given)
    assert {r["id"]: r["phrases"] for r in found.collect()} == {1: ["rome", "new rome", "rome"], 4: ["rome"]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("slice(")  # from the top: nothing is cut from a text above the rows of its tokens
