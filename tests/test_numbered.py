"""Numbers of rows for packed files come without a join of the rows."""

from pyspark.sql import functions as F

from quillmap.operators import stats


def test_rows_are_numbered_without_joining_them(spark):
    rows = spark.createDataFrame([(i * 7 % 101, "x" * (i % 5)) for i in range(101)], "k long, t string").repartition(6)
    out, whole = stats.numbered(rows.withColumn("n", F.octet_length("t")), ["k"], ["n"])
    got = out.orderBy("k").collect()
    assert whole == [101, sum(len(r["t"]) for r in got)]
    assert [r["place"] for r in got] == list(range(101))
    assert [r["n_at"] for r in got] == [sum(len(q["t"]) for q in got[:i]) for i in range(101)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the sums of ranges
    assert stats.numbered(rows.limit(0), ["k"], [])[1] == [0]
