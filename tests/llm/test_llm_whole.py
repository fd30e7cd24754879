"""Operators against brute force, and the cases of odd rows, damaged files and other tokenizers."""

import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import common, decontaminate, language_id, license_scan, mixing, near_dedup, quality, queries, token_output, toxicity, warc

SF = "/root/testdata/sf0.001"


def against_sql(df, docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(sql)
    cols = want.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    even = lambda r: tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else None if x is None or isinstance(x, float) else x for x in r)
    return sorted((even(r[c] for c in cols) for r in df.collect()), key=key), sorted(map(even, want.fetchall()), key=key)


def test_language_equals_exact_sets(spark):
    """The same decisions with Python sets in place of bit-sliced filters, counts without false positives."""
    docs = common.table(spark, SF, "documents")
    rows = docs.withColumn("out", common.held_out("doc_id", 4, 2)).collect()
    plain = lambda t: " " + re.sub(r" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t)).strip(" ") + " "

    def grams(text):
        t = plain(text)
        return {t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)}

    n, seen = {}, {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and not r["out"]:
            n[r["lang"]] = n.get(r["lang"], 0) + 1
            for g in grams(r["text"]):
                by = seen.setdefault(g, {})
                by[r["lang"]] = by.get(r["lang"], 0) + 1
    holds = {lang: {g for g, by in seen.items() if by.get(lang, 0) >= min(2, n[lang]) and by[lang] / n[lang] >= 0.125 * max(by[x] / n[x] for x in by if by[x] >= min(2, n[x]))} for lang in n}
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    same = total = 0
    for r in rows:
        own = grams(r["text"] or "")
        share = sorted(((len(own & holds[lang]), lang) for lang in sorted(holds)), reverse=True)
        if share[0][0] > share[1][0]:
            total += 1
            same += got[r["doc_id"]] == share[0][1]
    assert total > 150 and same >= 0.99 * total


def test_a_language_of_one_document_can_be_predicted(spark):
    rows = [(i, f"the quick brown fox number {'abcdefgh'[i % 8]} runs over the lazy dog", "en") for i in range(40)] + [(100, "zažívá příliš žluťoučký kůň úpěl ďábelské ódy", "cs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(docs)
    assert filters.predict("příliš žluťoučký kůň")[0] == "cs" and filters.predict("the lazy fox")[0] == "en"


def test_toxic_matches_equal_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    assert model.terms
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    known: dict = {}

    def nearest(w):
        if w not in known:
            plain = w if w.isalpha() else w.translate(toxicity.SPELT)
            near = [(distance(plain, t), t) for t in model.terms if abs(len(t) - len(plain)) <= 2]
            known[w] = (w, 0) if w in model.terms else None if w in model.ordinary or not plain else min(((t, d) for d, t in near if d <= toxicity.edits(t)), key=lambda x: (x[1], x[0]), default=None)
        return known[w]

    for r in docs.limit(60).collect():
        lower = (r["text"] or "").lower()
        spans = [m.span() for m in toxicity.WORD.finditer(lower)]
        words = [lower[a:b] for a, b in spans]
        hits = [i for i, w in enumerate(words) if nearest(w)]
        found = []
        for i in hits:
            (a, b), near = spans[i], range(max(0, i - toxicity.SPAN), min(len(words), i + toxicity.SPAN + 1))
            lo, hi = spans[near[0]][0], spans[near[-1]][1]
            quoted = any(c in "\"«»“”„" for c in lower[lo:a]) and any(c in "\"«»“”„" for c in lower[b:hi])
            quote = 1.5 * quoted + any(words[j] in toxicity.REPORTS for j in near)
            abuse = 1 + 0.7 * any(words[j] in toxicity.ADDRESS for j in near) + 0.5 * ("!" in lower[b : b + 2]) + 0.5 * any(j in hits and j != i for j in near)
            found.append((a, b, *nearest(words[i]), abuse / (abuse + quote)))
        x = toxicity.features(lower, model, found)
        want = 1 / (1 + math.exp(-(model.weights[0] + float(np.dot(model.weights[1:], x)))))
        assert got[r["doc_id"]]["n_matches"] == len(hits) and abs(got[r["doc_id"]]["score"] - want) < 1e-9


def test_many_quoted_terms_take_linear_time():
    model = toxicity.Model({"moron": 3.0})
    toxicity.matches("a moron", model)
    start = time.process_time()
    assert len(toxicity.matches('he said "moron" twice ' * 20_000, model)) == 20_000
    assert time.process_time() - start < 2


def test_states_are_shared_and_bounded(monkeypatch):
    automaton = toxicity.Automaton(["abcdefgh", "abcdefgx", "zbcdefgh"])
    for w in ("abcdefgh", "abcdegh", "xbcdefgh", "abcdefghh"):
        assert automaton.match(w)
    sets = [s.pairs for s in automaton.states.values()]
    assert len(sets) == len(set(sets))
    monkeypatch.setattr(toxicity, "STATE_PAIRS", 10)
    assert automaton.match("abcdefgy") == ("abcdefgh", 1) and automaton.match("abcdefgx") == ("abcdefgx", 0)


def test_quality_scores_equal_a_plain_field(spark):
    """Scores by forward-backward in logarithms, line by line."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    field = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, field).collect()}
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        phi = np.clip(quality.line_features(lines) @ field.weights, -30, 30)
        ahead, back = np.zeros((len(lines), 2)), np.zeros((len(lines), 2))
        ahead[0] = (0, phi[0])
        for t in range(1, len(lines)):
            ahead[t] = [np.logaddexp(ahead[t - 1, 0] + field.moves[0, k], ahead[t - 1, 1] + field.moves[1, k]) + k * phi[t] for k in (0, 1)]
        for t in range(len(lines) - 2, -1, -1):
            back[t] = [np.logaddexp(field.moves[k, 0] + back[t + 1, 0], field.moves[k, 1] + phi[t + 1] + back[t + 1, 1]) for k in (0, 1)]
        z = ahead + back
        p = np.average(1 / (1 + np.exp(z[:, 0] - z[:, 1])), weights=[len(x) + 1 for x in lines])
        p = min(1 - 1e-4, max(1e-4, p))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-(field.curve[0] + field.curve[1] * math.log(p / (1 - p)))))) < 1e-6


def test_quality_learns_from_whole_texts(spark):
    good, bad = "This is a plain sentence of ordinary words that ends well.\n", "### $$$ | | | ### $$$ | | |\n"
    rows = [(i, good * 320 if i % 2 else good * 260 + bad * 400) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    out = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    assert out == {i: i % 2 for i, _ in rows}
    ids = common.labelled_ids(labels, "quality", 5, 0, 4000)
    assert quality._sample(docs, ids, 2000).count() in range(3, 8) and quality._sample(docs, ids, 300).count() == 0
    one = quality.lines(docs.where("doc_id < 2"), quality.fit(docs, labels)).where("doc_id = 0")
    assert one.count() == 661 and one.where("line < 200").agg(F.min("p_good")).first()[0] > one.where("line between 300 and 600").agg(F.max("p_good")).first()[0]


def test_license_blocks_equal_sql_on_lines_of_any_words(spark):
    texts = ["under cc by nc 4 0", "created using mit the released under", None, "", "a\n\nreleased under\nthe mit license\n", "x" * 120 + " released under the\nmit license", "Released Under\n...\nthe MIT License", "licensed under the apache\nlicense version 2 0\n\nno"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, want = against_sql(license_scan.scan(docs), docs, license_scan.oracle())
    assert got == want and {r[0]: r[6] for r in [tuple(r) for r in license_scan.scan(docs).collect()]}[0] == "cc-by,cc-notice"


def test_mix_keeps_columns_rows_and_their_own_positions(spark):
    rows = [(1, "a b c", "s", 77, 1.5, "x", 9), (1, "a b c", "s", 88, 2.5, "y", 9), (None, "d e", None, 5, None, None, None), (None, "f g h", None, 6, 0.0, "z", 1), (2, None, "s", None, 1.0, "k", 2), (3, "one two three four", "t", 4, 0.5, "m", 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, __size int, u double, row string, id long")
    out = mixing.apply(docs)
    assert out.schema == docs.schema
    taken = [tuple(r) for r in out.collect()]
    assert set(taken) <= set(rows)
    plan = mixing.plan(docs)
    assert len(taken) == plan.agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))).first()[0]
    n = plan.where("doc_id = 1").agg(F.sum("copies")).first()[0]
    assert sum(r[0] == 1 for r in taken) == n
    got, want = against_sql(mixing.curriculum(docs), docs.select("doc_id", "text", "source"), queries.MIXING_SQL)
    assert got == want


def test_mix_follows_its_schedule_and_not_its_ranges(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    some = [sorted(map(str, mixing.plan(docs, buckets=b).collect())) for b in (3, 1024)]
    assert some[0] == some[1]
    late = mixing.curriculum(docs, lambda s: F.when(s == "a", 1.0).otherwise(-1.0)).join(docs.select("doc_id", "source"), "doc_id").where("first_at is not null")
    mean = {r["source"]: r["m"] for r in late.where("last_at = first_at or last_at is not null").groupBy("source").agg(F.avg((F.col("first_at") + F.col("last_at")) / 2).alias("m")).collect()}
    assert mean["a"] > mean["b"] + 0.1
    ranks = [r["training_rank"] for r in mixing.curriculum(docs).collect()]
    assert sorted(ranks) == list(range(1, 3001))


def test_one_of_each_class_stays_with_any_column(spark):
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (None, "one two three four five six", "c"), (4, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, DROP string")
    assert sorted(map(str, map(tuple, near_dedup.keep_one(docs).collect()))) == sorted(map(str, (rows[0], rows[2], rows[3])))


def test_slots_go_to_one_value_both_ways():
    item = "add 3 apples to 8 pears and take 3 plums from 8 cherries then say what is left of all this fruit"
    block = decontaminate.Benchmark.of([(1, item), (2, "42"), (3, "7 8 9")])
    assert [x[0] for x in block.leaks(item.replace("3", "11").replace("8", "20"))] == [1]
    assert block.leaks(item.replace("3", "11").replace("8", "11")) == []
    assert block.leaks("I have 7 cats and 3 dogs") == []


def test_blocks_count_words_between_any_blanks(spark):
    bench = spark.createDataFrame([(i, f"w{i} ".join("abcdefgh") + "\t" + "\n".join("ijklmnop")) for i in range(40)], "item_id long, text string")
    assert len(list(decontaminate.blocks(bench, 100))) >= 6


def test_damaged_archives_fail_and_plain_ones_are_read(spark, tmp_path):
    rng = random.Random(9)
    pages = [(i, f"u{i}", "".join(rng.choice("abcdefgh <>") for _ in range(900))) for i in range(80)]
    folder = tmp_path / "gz"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(folder)).collect()
    (name,) = folder.glob("*.warc.gz")
    data = name.read_bytes()
    offsets = [r["record_offset"] for r in warc.read(spark, str(folder), 5000).orderBy("record_offset").collect()]
    assert len(offsets) == 80
    for at in (offsets[40] + 1, offsets[40] + 200, offsets[0]):
        name.write_bytes(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
        for size in (5000, 1 << 20):
            with pytest.raises(Exception, match="no whole record|digest|invalid"):
                warc.read(spark, str(folder), size).collect()
    name.write_bytes(data[:-30])
    with pytest.raises(Exception, match="no whole record"):
        warc.read(spark, str(folder), 5000).collect()
    plain = tmp_path / "plain"
    plain.mkdir()
    name.write_bytes(data)
    (plain / "a.warc").write_bytes(b"".join(c for _, c in warc.read_range(str(name), 0, len(data))))
    got = [warc.read(spark, str(f), 3000).select("page_id", "payload_digest").orderBy("page_id").collect() for f in (folder, plain)]
    assert got[0] == got[1] and len(got[0]) == 80
    (plain / "a.warc").write_bytes((plain / "a.warc").read_bytes()[:-9])
    with pytest.raises(Exception, match="no whole record"):
        warc.read(spark, str(plain)).collect()


def test_archives_without_a_broadcast_agree(spark, monkeypatch):
    pages = common.table(spark, SF, "pages")
    key = lambda df: sorted(map(str, df.collect()))
    small = key(warc.plan_records(pages))
    monkeypatch.setattr(warc, "SMALL_BYTES", -1)
    assert key(warc.plan_records(pages)) == small
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "y" * 200, 3), (1, "u", "y" * 200, 3)], "page_id long, url string, html string, digest int")
    assert warc.archive(odd).count() == 4 and warc.archive(odd.limit(0)).count() == 0


def test_another_tokenizer_gives_its_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 5, "world": 6, "'": 7, "s": 8}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "other.json")
    other.save(path)
    texts = ["Hello world's hello", "", "world  world"]
    encoder = token_output.Encoder(path)
    assert not encoder.parted and token_output.Encoder(queries.tokenizer()).parted
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session(), "x")


def test_first_windows_suffice_where_vectors_have_near_neighbours(spark, monkeypatch):
    from quillmap.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 512)
    passes, search = [], ann._window_finds
    monkeypatch.setattr(ann, "_window_finds", lambda *a: passes.append(a[2]) or search(*a))
    rng = np.random.default_rng(11)
    x = (rng.standard_normal((300, 32))[rng.integers(0, 300, 12_000)] + 0.15 * rng.standard_normal((12_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, f, hit = {}, x.astype(float), 0
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 12_000, 20):
        s = f @ f[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {v for _, v, _ in got[q]})
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in got[q])
    assert len(passes) == 1 and hit >= 0.9 * 20 * len(got) and len(got) == 600


def test_nearest_takes_odd_and_empty_tables(spark):
    from quillmap.llm import ann

    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "b"), (20, [1.0, 2.0], None), (1, [1.0, 2.0], "c"), (2, [1e-200, 0.0], "d"), (3, None, "e"), (None, [3.0, 1.0], "f"), (4, [float("inf"), 1.0], "g"), (5, [1.0, None], "h"), (40, [-1.0, 0.5], "i")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, SCORE string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).collect())
    zero = [(0, 1, 0, 5.0), (0, 2, 1, 5.0), (0, 3, 20, 5.0), (0, 4, 2, 1e-200), (0, 5, 40, 0.0)]
    assert got[:10] == sorted(zero + zero)  # a repeated row is a query twice, and a candidate of itself
    assert {q for q, *_ in got} == {0, 20, 40} and len(got) == 20
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_with_several_vectors_of_an_id_and_lengths(spark):
    from quillmap.llm import ann

    rng = np.random.default_rng(2)
    rows = [(int(i) % 150, rng.standard_normal(8).round(2).tolist()) for i in range(400)] + [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (20, [1.0, 0.0]), (7, [1.0, 0.0]), (40, [0.5])]
    want = []
    for a, (q, v) in enumerate(rows):
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), c) for b, (c, w) in enumerate(rows) if b != a and len(w) == len(v))
            want += [(q, r + 1, c, round(-s, 9)) for r, (s, c) in enumerate(found[:20])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == sorted(want)


def test_lists_of_numbers_are_no_evidence_and_take_no_time():
    import time

    from quillmap.llm import decontaminate

    numbers = lambda n, by: by.join(str((i * 7919) % 1000) for i in range(n))
    for by in (", ", "; ", ". ", " "):
        long, short = "sort all these many values by their size " + numbers(59, by), "which of these is largest and why " + numbers(24, by)
        block = decontaminate.Benchmark.of([(1, long), (2, short)])
        began = time.time()
        for n in (100, 500, 2000):
            other = by.join(str((i * 104729 + 13) % 977) for i in range(n))
            assert block.leaks(other) == [] and block.leaks("a plain line of words before " + other + " and one behind it") == []
        assert time.time() - began < 3
        assert [i for i, _, _ in block.leaks("see: " + long)] == [1] and [i for i, _, _ in block.leaks("see: " + short + " end")] == [2]


def test_leaks_and_clean_rows_agree_over_any_number_of_blocks(spark):
    from quillmap.llm import common, decontaminate

    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    whole = sorted((r["doc_id"], r["items"], r["best_share"], r["first_word"]) for r in decontaminate.find(docs, bench).collect())
    parts = decontaminate.find(docs, bench, most=300)
    assert len(list(decontaminate.blocks(bench, 300))) > 3 and parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["doc_id"], r["items"], r["best_share"], r["first_word"]) for r in parts.collect()) == whole
    kept = decontaminate.clean(docs, bench, most=300)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, items, _, _ in whole if not items)


def test_long_pieces_and_words_are_not_kept():
    from quillmap.llm import common, queries, token_output

    own = token_output.Encoder(queries.tokenizer())
    texts = ["".join(chr(0x4E00 + (i * 37 + j * 11) % 5000) for j in range(500)) for i in range(200)] + ["x" * 3000 + " plain words", "a" * 100 + "B" * 100]
    assert own.batch(texts) == [own.whole(t) for t in texts]
    assert max(map(len, own.known)) <= token_output.LONGEST
    cache = common.Cache(len, 10)
    assert cache["x" * 1000] == 1000 and not cache and cache["ab"] == 2 and len(cache) == 1
