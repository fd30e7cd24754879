"""Exact top-k, spelling variants and clusters against brute force."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same

from quillmap.llm import common, kdtree, pivots, queries, spelling

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, v int, score double"


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 0, 0.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, v int, score double")


def top(rows, k=5, every=50, scale=256):
    """What exact_top must return, by Python integers."""
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), c) for b, (c, w) in enumerate(kept) if b != a and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])]
    return sorted(out)


def test_exact_top_equals_brute_force_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 64)
    monkeypatch.setattr(pivots, "SPAN", 256)
    monkeypatch.setattr(pivots, "BOXES", 7)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 12))
    x = np.concatenate((centre[rng.integers(0, 6, 700)] + 0.05 * rng.standard_normal((700, 12)), rng.standard_normal((500, 12)))).round(3)
    x[100:500] = x[100]  # a third are one vector
    x[600:640] = np.round(x[600:640])
    rows = [(i, x[i].tolist()) for i in range(1200)]
    rows += [(0, x[0].tolist()), (0, x[1].tolist()), (50, x[50].tolist()), (50, (x[50] / 2).tolist()), (7, x[150].tolist())]
    got = sorted(tuple(r) for r in pivots.exact_top(vectors(spark, rows)).collect())
    assert got == top(rows) and len(got) > 100


def test_exact_top_takes_odd_rows(spark):
    rows = [(0, [1, 2]), (50, [1, 2]), (100, None), (150, []), (200, []), (250, [0, 0]), (300, [1, None]), (350, [float("nan"), 1]), (400, [float("inf"), 1]), (None, [9, 9]), (1, [3]), (450, [-0.001, 0.5]), (50, [1, 2])]
    got = sorted(tuple(r) for r in pivots.exact_top(vectors(spark, rows)).collect())
    assert got == top(rows)
    assert pivots.exact_top(vectors(spark, [])).collect() == []
    assert pivots.exact_top(vectors(spark, [(0, [1.0])])).collect() == []


def test_exact_top_in_large_integers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(4) * 2.0**rng.integers(0, 19)).tolist()) for i in range(120)]
    assert sorted(tuple(r) for r in pivots.exact_top(vectors(spark, rows)).collect()) == top(rows)
    with pytest.raises(Exception, match="64 bits"):
        pivots.exact_top(vectors(spark, [(0, [1e15]), (1, [1e15])])).collect()


def test_bounds_hold_and_near_copies_are_not_all_evaluated():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((8, 64))
    x = np.floor(256 * (centre[rng.integers(0, 8, 2000)] + 0.02 * rng.standard_normal((2000, 64)))).astype("<i4")
    space = pivots.Space(64, int(np.abs(x).max()), pivots.far_apart(x))
    far, norms = pivots.distances(x, space.pivots), (x.astype(float) ** 2).sum(1)
    scores = x[:40].astype(float) @ x.T.astype(float)
    bounds = space.bounds(norms[:40], far[:40], norms, far)
    assert (bounds >= scores).all()
    assert (space.box_bounds(norms[:40], far[:40], np.array([norms.max()]), far.min(0)[None], far.max(0)[None])[:, 0] >= scores.max(1)).all()
    seen = [pivots.in_bound_order(space, x.astype(float), np.arange(2000), x[i].astype(float), bounds[i], 6, -np.inf)[2] for i in range(40)]
    assert max(seen) < 1000


def lloyd(rows, k=8, rounds=10, scale=1024, seed=3):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z)), i) for i, z in enumerate(c))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for z in range(len(c)):
            mine = [v for t, (_, v) in zip(to, kept) if t == z]
            if mine:
                c[z] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, z in found:
        by[z] += d
    return sorted(((i, z, d, by[z], sum(by.values()), hashlib.sha256(",".join(map(str, c[z])).encode()).hexdigest()) for i, d, z in found), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.standard_normal((250, 64)) * 0.1, rng.standard_normal((1, 64)) + 0.01 * rng.standard_normal((200, 64)))).round(4)
    x[30:160] = x[30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (5, x[6].tolist()), (None, x[7].tolist()), (9001, None), (9002, [1.0] * 63), (9003, [None] + [0.0] * 63), (9004, [float("nan")] * 64), (9005, [float("inf")] * 64), (9006, [0.0] * 64)]
    got = sorted((tuple(r) for r in kdtree.clusters(vectors(spark, rows).repartition(5)).collect()), key=str)
    assert got == lloyd(rows, rounds=10)


def test_few_and_no_vectors_make_few_and_no_clusters(spark):
    rows = [(i, [float(i // 2)] * 64) for i in range(4)]
    assert sorted((tuple(r) for r in kdtree.clusters(vectors(spark, rows, "float")).collect()), key=str) == lloyd(rows)
    assert kdtree.clusters(vectors(spark, [])).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        kdtree.clusters(vectors(spark, [(1, [1e6] * 64)])).collect()


def test_descent_prunes_only_dominated_centroids():
    rng = np.random.default_rng(7)
    centre = rng.integers(-500, 500, (8, 16))
    v = np.concatenate([c + rng.integers(-20, 20, (200, 16)) for c in centre] + [rng.integers(-500, 500, (300, 16)), np.repeat(centre[:1], 700, 0)])
    cut = kdtree.leaves_of(v)
    assert sorted(np.concatenate(cut).tolist()) == list(range(len(v))) and max(map(len, cut)) <= kdtree.EQUAL
    lo, hi = np.array([v[r].min(0) for r in cut]), np.array([v[r].max(0) for r in cut])
    whole, open_ = kdtree.descend(lo, hi, centre)
    nearest, leaf = kdtree.squared(v, centre).argmin(1), np.zeros(len(v), int)
    for i, r in enumerate(cut):
        leaf[r] = i
    inner = 0
    for level, nodes, to in whole:
        inner += level > 0 and len(nodes)
        for i, z in zip(nodes, to):
            assert (nearest[(leaf >> level) == i] == z).all() and not open_[i << level : (i + 1) << level].any()
            open_[i << level : (i + 1) << level, z] = True
    assert inner and open_[leaf, nearest].all() and open_.sum() < 5 * len(cut)  # of 8 a leaf without pruning


def plain_vocabulary(docs, length=5, least=3, every=97):
    out = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
            run = ""
    return {w: n for w, n in out.items() if len(w) >= length and n >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(words):
    out = {}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w, n in words.items():
        near = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, ()) if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= 2 * n else None, len(near)]
    rows = set()
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, words[w], near, words[form] if form else None))
    return rows


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ÀÉÿ÷×a", "öööööö"]
    docs = []
    for d in range(150):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdeé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1 :]))
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((d if d % 40 else None, rng.choice((" ", ", ", "1", "_")).join(words)))
    return docs + [(900, None), (901, ""), (902, "12 ... \n"), (3, docs[3][1])]


def test_variants_equal_brute_force(spark, misspelt):
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame([(d, t, None, 1) for d, t in misspelt], "doc_id long, text string, word string, n int")).collect()}
    want = plain_variants(plain_vocabulary(misspelt))
    assert got == want
    assert any(f and r != f for _, f, r, _, _, _ in want) and max(r[4] for r in want) > 5


def test_variants_of_whole_documents(spark):
    docs = common.table(spark, SF, "documents")
    words = plain_vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["word"]: r for r in queries.op12_spelling(spark, SF).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    some = sorted(words, key=lambda w: zlib.crc32(w.encode()))[:150]
    for w in some:
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert (got[w]["n_near"], got[w]["form"]) == (len(near), best if best and words[best] >= 2 * words[w] else None)


def test_no_words_no_variants(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "ab cd ab cd")], "doc_id long, text string")).collect() == []


def test_runs_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 5)
    text = "abc defghijk l  mnopqr..." + "x" * 23 + " é÷À9 z"
    assert list(spelling.runs(text)) == ["abc", "defghijk", "l", "mnopqr", "x" * 23, "é÷À", "z"]


@pytest.mark.parametrize("word", ["a", "ab", "aa", "aab", "abba", "éaaaé", "abcdef"])
def test_neighbourhood_is_whole_and_distinct(word):
    letters = "abé"
    n = len(word)
    want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + a + word[i + 1 :] for i in range(n) for a in letters} | {word[:i] + a + word[i:] for i in range(n + 1) for a in letters}
    seen = []

    def keep(h):
        seen.append(h.ravel())
        return np.arange(h.size)

    (_, codes), = spelling.by_length([word])
    made = [(row.tolist(), near) for row, near in spelling.neighbourhood(codes, np.array(sorted(map(ord, letters))), keep)]
    flat = [x for _, near in made for x in near]
    assert sorted(flat) == sorted(want - {word})
    held = set(np.concatenate(seen).tolist())
    for x in flat:
        if x:
            assert int(spelling.hashes(next(spelling.by_length([x]))[1])[0]) in held


def test_searches_equal_sql_on_a_larger_table(spark):
    sql = queries.oracle_sql()
    for name in ("op11_exact_top", "op13_clusters"):
        assert same(spark, "/root/testdata/sf0.1", queries.queries()[name], sql[name]) > 0
