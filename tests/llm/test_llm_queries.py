import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same

from quillmap.llm import common, decontaminate, mixing, near_dedup, queries, shingles, toxicity

SF, STAGED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) > 0


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage of the pipeline takes and gives, in stored order."""
    import corpus_pipeline as P

    docs, out = common.table(spark, STAGED, "documents"), []
    for name, stage in P.STAGES:
        given = docs.orderBy(*common.stored_order(docs)).collect()
        docs = common.written(stage(spark, docs, STAGED), f"test-{name}")
        out.append((name, given, docs.orderBy(*common.stored_order(docs)).collect()))
    return out


def test_stages_keep_columns_and_find_work(stages):
    assert [name for name, _, _ in stages] == ["toxicity", "near_dedup", "decontaminate", "mix", "tokens"]
    for name, given, got in stages[:-1]:
        assert got[0].__fields__ == given[0].__fields__, name
    for name, given, got in stages[:3]:
        assert 0 < len(got) < len(given), name


def test_toxicity_stage_drops_what_scores_high(spark, stages):
    _, given, got = stages[0]
    model = toxicity.fit(common.table(spark, STAGED, "documents"), common.table(spark, STAGED, "labels"))
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in given if toxicity.probability(r["text"] or "", model) < 0.7)


def test_near_dedup_stage_equals_all_pairs(spark, stages):
    _, given, got = stages[1]
    rows = sorted(given, key=lambda r: r["doc_id"])
    weights = near_dedup.frequencies(spark.createDataFrame([(r["text"],) for r in rows], "text string"))
    sets = [weights.of(r["text"] or "") for r in rows]
    total, root = [w.sum(dtype=np.float64) for _, w in sets], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if min(total[a], total[b]) < 0.8 * max(total[a], total[b]) or not total[a]:
                continue
            m = near_dedup._minima(*sets[a], *sets[b])
            if m >= 0.8 * (total[a] + total[b] - m) - 1e-6:
                ra, rb = sorted((root[a], root[b]))
                root = [ra if r == rb else r for r in root]
    assert sorted(r["doc_id"] for r in got) == [rows[i]["doc_id"] for i, r in enumerate(root) if r == i]


def test_decontamination_stage_equals_brute_force(spark, stages):
    _, given, got = stages[2]
    windows = lambda t: set(shingles.windows(decontaminate.template(t or "")[0]).tolist())
    items = [w for r in common.table(spark, STAGED, "benchmark").collect() if (w := windows(r["text"]))]
    leaks = lambda r: any(len(windows(r["text"]) & w) >= 0.8 * len(w) for w in items)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in given if not leaks(r))


def test_mixing_stage_equals_sql_and_sorts_by_position(spark, stages):
    _, given, got = stages[3]
    con = duckdb.connect()
    docs = spark.createDataFrame(given).toPandas()
    con.register("documents", docs)
    times = {d: taken // size if size else 1 for d, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({queries.MIXING_SQL})").fetchall()}
    count: dict = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {d: n for d, n in times.items() if n}
    at = {r["doc_id"]: iter(sorted(r["positions"])) for r in mixing.plan(spark.createDataFrame(given)).collect()}
    order = [next(at[r["doc_id"]], 0.0) for r in got]
    assert order == sorted(order)


def test_token_stage_follows_the_stored_order(stages):
    from tokenizers import Tokenizer

    _, given, got = stages[4]
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer()), 0, []
    for r in given:
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline as P

    key = lambda rows: sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert key(P.run(spark, STAGED).collect()) == key(stages[-1][2])
