import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import ann, common, decontaminate, language_id, license_scan, mixing, near_dedup, quality, queries, shingles, token_output, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, lang_pred string, score double, __size int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    long = "alpha beta gamma delta epsilon zeta eta theta " * 4000
    rows = [(1, None, "en", "a", "x", 0.5, 1), (2, "", None, None, None, None, None), (3, long, "en", "a", "x", 1.0, 2), (3, long, "en", "a", "x", 1.0, 2), (None, "null id text of five words", "fr", "b", None, 0.0, 3), (None, None, None, None, None, None, None), (7, "...\n\n 12", "de", "", "y", 0.1, 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none, labels):
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "one two three")], "item_id long, text string")
    no_labels = labels.limit(0)
    for docs, n in ((odd, 7), (none, 0)):
        assert language_id.identify(docs).count() == n
        assert toxicity.detect(docs, labels).count() == n and toxicity.detect(docs, no_labels).count() == n
        assert quality.classify(docs, labels).count() == n and quality.classify(docs, no_labels).count() == n
        assert token_output.export(docs, queries.tokenizer()).count() == n
        assert near_dedup.near_classes(docs).count() == n
        assert decontaminate.find(docs, bench).count() == n and decontaminate.find(docs, bench.limit(0)).count() == n
        assert license_scan.scan(docs).count() == n
        assert mixing.plan(docs).count() == n and mixing.apply(docs).columns == docs.columns
        assert toxicity.reject(docs, labels).schema == docs.schema and toxicity.reject(docs, labels).count() <= n
        assert near_dedup.keep_one(docs).count() <= n and decontaminate.clean(docs, bench).count() == n


def test_language_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_filter_corrects_false_positives_and_slices():
    grams = {f"l{i}": np.arange(i * 1000, i * 1000 + 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(20)}
    filters = language_id.LanguageFilters.build(sorted(grams), grams)
    assert len(filters.tables) == 2
    for lang, g in grams.items():
        hits = filters.hits(g)
        assert hits[filters.langs.index(lang)] == 500 and hits.argmax() == filters.langs.index(lang)


def test_nearest_equals_brute_force_and_skips_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16)).round(3)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (None, [1.0] * 16), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    f = x.astype(np.float32).astype(float)
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = 0
    for q in range(0, 400, 20):
        s = f @ f[q]
        order = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        hit += len(set(order) & set(got[q]))
    assert hit >= 0.98 * 400 and got[60][:3] == [i for i in np.lexsort((np.arange(400), -(f @ f[60]))) if i != 60][:3]
    assert ann.nearest(df.where("vec_id is null")).count() == 0


def test_windows_widen_until_finds_repeat(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "MOST_ROWS", 32)
    x = np.random.default_rng(8).standard_normal((1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<float>")
    got, f, hit = {}, x.astype(float), 0
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 1500, 20):
        order = [int(i) for i in np.argsort(-(f @ f[q])) if i != q][:20]
        hit += len(set(order) & got[q])
    assert hit >= 0.9 * 20 * len(got) and len(got) == 75 and {len(g) for g in got.values()} == {20}


def test_hilbert_visits_neighbours():
    side = 8
    cells = np.array([(i, j) for i in range(side) for j in range(side)])
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert len(set(ann.hilbert(cells, 3).tolist())) == 64 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 13))) for _ in range(60)})
    automaton = toxicity.Automaton(terms)
    for _ in range(800):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["", "a", "b", "c", "ab"])
        w = "".join(w)
        want = min(((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(t)), default=None)
        assert automaton.match(w) == (None if want is None else (want[1], want[0]))


def test_quotation_scores_under_abuse():
    model = toxicity.Model({"moron": 3.0})
    (abuse,) = [m[-1] for m in toxicity.matches("you are a mor0n!", model)]
    (quoted,) = [m[-1] for m in toxicity.matches('she wrote that "the word moron" was once a term', model)]
    assert quoted < abuse


def test_held_out_toxicity_and_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    t = toxicity.detect(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r["toxic"]: r["p"] for r in t}
    assert rate[1] > 0.75 and rate[0] < 0.02
    q = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    rate = {r["quality"]: r["p"] for r in q}
    assert rate[1] > 0.98 and rate[0] < 0.1


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = quality.Field(rng.standard_normal(quality.WIDTH), rng.standard_normal((2, 2)))
    lines = ["A line here.", "### | |", "", "MORE TEXT!! x"]
    phi = np.exp(quality.line_features(lines) @ field.weights)
    move, total, good = np.exp(field.moves), 0.0, np.zeros(4)
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        p = np.prod([phi[i] if y[i] else 1.0 for i in range(4)]) * np.prod([move[y[i], y[i + 1]] for i in range(3)])
        total += p
        good += p * np.array(y)
    assert np.allclose(field.marginals(lines), good / total)


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    rng = random.Random(1)
    alphabet = "abcXYZéÉßÀ×÷ªº²Ⅷ0129'’\"<|>endoftext .,!?\t\n\r  ́İΣσς漢🙂\x1c\x85sTRe"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)] + [None, "<|endoftext|> WE'LL"]
    docs = spark.createDataFrame([(5 * i - 100, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    shards = token_output.write(docs, str(tmp_path), path, frame_bytes=2000)
    got = {r["doc_id"]: r for r in token_output.read(shards).collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        r = got[5 * i - 100]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = shards.where("n_docs > 3").first()
    reader = token_output.ShardReader(one["uri"])
    assert reader.find(int(reader.docs["doc_id"][2]))[0].tolist() == reader.document(2).tolist()
    data = bytearray(open(one["uri"], "rb").read())
    data[10] ^= 255
    broken = tmp_path / "broken.qmt"
    broken.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        token_output.ShardReader(str(broken)).frame(0)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(30):
        base = words(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((n, " ".join(w)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = near_dedup.frequencies(docs)
    sets = [weights.of(t) for _, t in rows]
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            m = near_dedup._minima(*sets[a], *sets[b])
            if m >= 0.8 * (sets[a][1].sum() + sets[b][1].sum() - m) - 1e-6:
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == dict(enumerate(root))


def test_large_bucket_goes_in_chunks(spark):
    rng = random.Random(4)
    base = words(rng, 200).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = spark.sparkContext.broadcast(near_dedup.frequencies(docs))
    reps = near_dedup.signatures(docs, shared).select(F.col("doc_id").alias("rep"), "bands")
    comp = near_dedup.classes(near_dedup.links(reps, docs, shared, chunk=8))
    assert comp.select("l").distinct().count() == 1 and comp.count() == 90
    rows = [(i, " ".join(base[:100] + [f"y{i}_{j}" for j in range(k)])) for i, k in enumerate(range(0, 90, 3))]  # a chain: only neighbours are alike
    chain = spark.createDataFrame(rows, "doc_id long, text string")
    shared = spark.sparkContext.broadcast(near_dedup.frequencies(chain))
    got = near_dedup.classes(near_dedup.links(chain.select(F.col("doc_id").alias("rep"), F.array(F.lit(1).cast("long")).alias("bands")), chain, shared, chunk=4)).collect()
    sets, root = [shared.value.of(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            m = near_dedup._minima(*sets[a], *sets[b])
            if m >= 0.8 * (sets[a][1].sum() + sets[b][1].sum() - m) - 1e-6:
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    assert {r["v"]: r["l"] for r in got} == {i: r for i, r in enumerate(root) if root.count(r) > 1}
    junk = spark.createDataFrame([(i, words(rng, 50)) for i in range(40)], "doc_id long, text string")
    same = junk.select(F.col("doc_id").alias("rep"), F.array(F.lit(1).cast("long")).alias("bands"))
    assert near_dedup.links(same, junk, shared, chunk=8).count() == 0


def test_long_near_copies_go_in_smaller_chunks_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LONG", 40)
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    rng = random.Random(12)
    rows = []
    for g, (length, copies) in enumerate(((3000, 7), (900, 12), (60, 5), (20_000, 3))):
        base = words(rng, length).split()
        for c in range(copies):
            w = list(base)
            for _ in range(length // 200):
                w[rng.randrange(length)] = words(rng, 1)
            rows.append((g * 100 + c, " ".join(w)))
    docs = spark.createDataFrame(rows + [(900 + i, words(rng, 300)) for i in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {d: d // 100 * 100 if d < 900 else d for d in got} and len(got) == 47


def test_recall_of_near_copies(spark):
    rng = random.Random(13)
    rows = []
    for g in range(150):
        base = words(rng, 160).split()
        copy = list(base)
        for _ in range(rng.randint(1, 3)):  # a changed word touches five shingles of a side: similarity from 0.82 on
            copy[rng.randrange(160)] = words(rng, 1)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(150)) >= 149 and all(got[2 * g] == 2 * g for g in range(150))


def test_frequent_shingles_are_counted_exactly(spark):
    rng = random.Random(5)
    shared = words(rng, 10)
    docs = spark.createDataFrame([(i, words(rng, 20) + (" " + shared if i % 3 == 0 else "")) for i in range(60)], "doc_id long, text string")
    w = near_dedup.frequencies(docs)
    assert len(w.grams) == 6 and set(shingles.of(shared).tolist()) == set(w.grams.tolist())
    assert near_dedup.samplers()[1].min() > 0


def test_archives_split_anywhere(spark, tmp_path):
    rng = random.Random(6)
    pages = [(i, f"http://x/{i}", words(rng, 40) + "\x1f") for i in range(60)] + [(100 + i, "u", "y" * 150) for i in range(5)] + [(200, None, None), (201, "z", "short"), (202, "z", "short"), (None, "u", "y" * 150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path)).collect()
    first = None
    for size in (37, 1000, 1 << 20):
        rows = sorted(map(tuple, warc.read(spark, str(tmp_path), size).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
        assert len(rows) == len(pages) and (first is None or rows == first)
        first = rows
    kinds = {r[0]: (r[3], r[4]) for r in first}
    assert kinds[100] == ("response", None) and kinds[104] == ("revisit", 100) and kinds[202] == ("response", None) and kinds[None] == ("revisit", 100)


def test_templates_catch_new_numbers_and_names_only_if_consistent(spark):
    item = "a farmer named Ada has 12 apples and gives 5 apples to Bob so Ada keeps 7 apples out of 12 apples in the end of the long day"
    same = "Well. " + item.replace("12", "30").replace(" 5 ", " 9 ").replace(" 7 ", " 21 ").replace("Ada", "Eve").replace("Bob", "Dan") + " indeed"
    mixed = item.replace("Ada has 12", "Zoe has 44").replace("Ada keeps 7", "Kim keeps 8").replace("of 12", "of 90")
    block = decontaminate.Benchmark.of([(1, item), (2, "tiny item here")])
    assert [i for i, _, _ in block.leaks(same)] == [1]
    assert block.leaks(mixed) == []
    assert [i for i, _, _ in block.leaks("before a tiny item here after")] == [2]
    assert block.leaks("nothing of that kind stands in this text at all") == []


def test_templates_hold_for_new_names_at_sentence_starts_and_longer_names(spark):
    opens = "Ada has 12 apples. Ada gives 5 to Bob."
    trip = "A train leaves Boston at 9 and arrives in Chicago after it has gone 300 km, so how fast was it on its way from Boston?"
    title = "Which Very Old City Stands Upon Seven Green Hills Beside That Long River"
    block = decontaminate.Benchmark.of([(1, opens), (2, trip), (3, title), (4, "12 30 45 99 100"), (5, "Ada Lovelace")])
    found = lambda t: [i for i, _, _ in block.leaks(t)]
    assert found("Once more. Eve has 31 apples. Eve gives 8 to Dan. That is all.") == [1]
    assert found("hear this: " + trip.replace("Boston", "New York").replace("Chicago", "Los Angeles").replace("300 km", "90 miles")) == [2]
    assert found("it was an ordinary text of plain words that ended and then came " + title + " and it went on in plain words as before") == [3]
    assert found("it was " + title.lower() + " and on") == [3] and found(trip.upper()) == [2]
    assert found("the values 7 8 9 10 11 stand here, as Tim Miller wrote") == []
    assert found("the values 12 30 45 99 100 stand here, as Ada Lovelace wrote") == [4, 5]


def test_slots_are_judged_on_one_alignment(spark):
    series = "2 4 8 16 32 64 is a sequence whose next term is what"
    listed = "sort the values 3 9 27 81 3 9 27 81 and then the values 5 25 5 25 5 25 5 in that order"
    block = decontaminate.Benchmark.of([(1, series), (2, listed)])
    assert [x[:2] for x in block.leaks("so " + series)] == [(1, 1.0)]
    assert [x[:2] for x in block.leaks("rows 1 2 3 4 5 6 7 8 9 here and " + series + " then 9 8 7 6 5 4 3")] == [(1, 1.0)]
    assert [x[:2] for x in block.leaks("as follows: " + listed)] == [(2, 1.0)]
    assert block.leaks("sort the values 1 2 3 4 5 6 7 8 and then the values 1 2 3 4 5 6 7 in that order") == []


def test_decontamination_equals_brute_force_in_blocks(spark):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    items = [(r["item_id"], shingles.windows(decontaminate.template(r["text"])[0])) for r in bench.collect()]
    got = {r["doc_id"]: r["items"] for r in decontaminate.find(docs, bench).collect()}
    for r in docs.collect():
        have = set(shingles.windows(decontaminate.template(r["text"])[0]).tolist())
        assert got[r["doc_id"]] == sorted(i for i, w in items if len(have & set(w.tolist())) >= 0.8 * len(set(w.tolist())))
    assert len(list(decontaminate.blocks(bench, 300))) > 3


def test_blocks_of_the_benchmark_change_no_row(spark):
    items = [(i, f"item number {'abcdefgh'[i]} asks what {w} makes of the {w} stone by night") for i, w in enumerate("red green blue black white grey brown pink".split())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[0][1]), (1, items[0][1]), (1, items[5][1]), (None, items[3][1]), (None, "a clean text"), (None, None), (2, items[6][1] + " and " + items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(list(decontaminate.blocks(bench, 30))) > 2
    got = [sorted(map(tuple, decontaminate.find(docs, bench, most=n).collect()), key=str) for n in (30, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 7
    assert sorted((str(r[0]), r[1]) for r in got[0]) == [("1", [0]), ("1", [0]), ("1", [5]), ("2", [1, 6]), ("None", []), ("None", []), ("None", [3])]


def test_wrapped_notices_are_found(spark):
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License.\n */"
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction'
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    for width in (15, 25, 40, 80, 99):
        import textwrap

        wrapped = [(i, "Some code.\n\n" + "\n".join("# " + x for x in textwrap.wrap(t, width)) + "\n\nx = 1") for i, (_, t) in enumerate(license_scan.NOTICES)]
        found = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(spark.createDataFrame(wrapped, "doc_id long, text string")).collect()}
        assert all(label in found[i] for i, (label, _) in enumerate(license_scan.NOTICES)), width
    parted = mit.replace("copy\n", "copy\n\n")
    docs = spark.createDataFrame(list(enumerate([gpl, mit, bsd, parted, mit.replace("\n", " " + "x" * 100 + "\n")])), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(docs).collect()}
    assert "gpl-notice" in got[0] and got[1] == ["mit-notice"] and got[2] == ["bsd-notice"] and got[3] == [""] and got[4] == [""]


def test_mix_meets_targets_and_orders(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 30)), rng.choice(["a", "a", "a", "b", None, "é"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(docs).cache()
    assert plan.where("taken > 2 * size").count() == 0
    src = docs.select("doc_id", "source")
    for r in plan.join(src, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s"), F.sum("size").alias("z")).collect():
        assert abs(r["t"] - r["g"]) <= 30 and r["s"] == r["z"] and r["g"] <= 2 * r["s"]
    assert plan.where(F.exists("positions", lambda u: (u < 0) | (u >= 1))).count() == 0
    assert mixing.apply(docs).count() == plan.agg(F.sum("copies")).first()[0]
    assert sorted(mixing.plan(docs.repartition(7)).select("doc_id", "taken").collect()) == sorted(plan.select("doc_id", "taken").collect())


def test_every_shingle_counts_its_documents(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 300)
    monkeypatch.setattr(near_dedup, "RANGE", 300)
    rng = random.Random(21)
    base = [words(rng, 12) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(4))) for i in range(300)] + [(i % 3, None) for i in range(3)] + [(1, base[0]), (2, base[0]), (None, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    count: dict[int, int] = {}
    for _, t in rows:
        for g in set(shingles.of(t or "").tolist()):
            count[g] = count.get(g, 0) + 1
    w = near_dedup.frequencies(docs)  # also shingles of few documents: their share of a weight is not flat
    assert dict(zip(w.grams.tolist(), w.df.tolist())) == {g: n for g, n in count.items() if n > 1} and w.n_docs == len(rows)
    cut, n, bits = near_dedup.blocked(docs)
    found = near_dedup.answers(near_dedup.asked(cut, bits, 4), 4)
    got = near_dedup.signed(cut, found, spark.sparkContext.broadcast(near_dedup.Weights(n)), bits, 4).collect()
    texts = {near_dedup._copy(t or ""): t or "" for _, t in rows}
    assert len(got) == len(rows)
    for r in got:
        grams = np.unique(shingles.of(texts[bytes(r["copy"])]))
        df = near_dedup._unpacked(bytes(r["df"])).tolist() if r["df"] else [1] * len(grams)
        assert df == [count[g] for g in grams.tolist()]
        weights = w.of(texts[bytes(r["copy"])])[1]
        assert r["bands"] == (near_dedup.signature(grams, weights).tolist() if len(grams) else [])
