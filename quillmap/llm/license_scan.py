"""Licence scans: base phrases, and notices found by an exact set-similarity join.

A notice is a set of words; a text block (a line, and with a line of wrapped text the
lines after it, however short, until there are SPAN words) meets it if it holds THRESHOLD of them at least. Words are ordered by the number of documents that hold them, rarest first. A
block that meets a notice of m words holds t = ceil(THRESHOLD m) of them, so it holds one
of the notice's first m - t + 1 words (prefix filter) and t words of all notices (length
filter); from a shared word on, so many must still be left on both sides (positional
filter). What passes is counted exactly. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
#: Lines of at most so many characters count as wrapped, and a block grows by them until it has so many words: the longest notice, and what may stand before it on its line.
WIDTH, SPAN = 100, 48
#: Words once A-Z are lower case, and what parts words in a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases with their labels, and notices with labels of their own.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = (
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "you may not use this file except in compliance with the license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-notice", "licensed under cc by nc 4 0"),
    ("cc-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents of docs(text) each word of the notices stands: one pass, partial sums, a row a word."""
    held = F.array_intersect(F.split(F.lower("text"), GAP), F.array(*map(F.lit, vocabulary)))
    counts = docs.where(F.col("text").isNotNull()).select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in counts}


def blocks_of(text: Column) -> Column:
    """The block that begins with each line: the lines after it while it has under SPAN words, up to a long line or one without a word.

    A block holds what its shorter beginnings hold, so these need no blocks of their own.
    """
    n = lambda line: F.size(F.array_remove(F.split(line, GAP), ""))
    lines = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("words"), (F.length(line) <= WIDTH).alias("open"), n(line).alias("n")))

    def grown(block: Column, line: Column) -> Column:
        more = block["open"] & line["open"] & (line["n"] > 0) & (block["n"] < SPAN)
        return F.struct(F.when(more, F.concat(block["words"], F.lit(" "), line["words"])).otherwise(block["words"]).alias("words"), more.alias("open"), (block["n"] + line["n"]).alias("n"))

    # The lines are bound to a name, or every step would split the text again.
    every = F.transform(F.array(lines), lambda ls: F.transform(ls, lambda line, i: F.when(line["open"], F.aggregate(F.slice(ls, i + 2, SPAN), line, grown, lambda b: b["words"])).otherwise(line["words"])))
    return every[0]


def notices(docs: DataFrame, templates=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, containment) of every block of docs(row, text) that meets a notice."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    count = frequencies(docs, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count[w], w)))}
    sets = [(label, sorted(set(t.split()), key=order.__getitem__)) for label, t in templates]
    need = [math.ceil(threshold * len(t) - 1e-9) for _, t in sets]
    prefixes = [(order[w], place, k, len(t), n) for k, ((_, t), n) in enumerate(zip(sets, need)) for place, w in enumerate(t[: len(t) - n + 1])]
    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(prefixes, "w int, place int, notice int, m int, t int"))
    rare = [w for w, i in order.items() if i in {p[0] for p in prefixes}]
    any_rare = F.arrays_overlap(F.split(F.lower("text"), GAP), F.array(*map(F.lit, rare)))
    ranks = F.create_map(*(x for w, i in order.items() for x in (F.lit(w), F.lit(i))))
    blocks = docs.where("text is not null").where(any_rare).select("row", F.posexplode(blocks_of(F.col("text"))).alias("block", "line"))
    held = F.array_sort(F.transform(F.array_intersect(words(F.col("line")), F.array(*map(F.lit, vocabulary))), lambda w: F.element_at(ranks, w)))
    blocks = blocks.select("row", "block", held.alias("held")).where(F.size("held") >= min(need))
    probes = blocks.select("row", "block", "held", F.posexplode("held").alias("at", "w"))
    met = probes.join(index, "w").where((F.size("held") >= F.col("t")) & (F.least(F.col("m") - F.col("place"), F.size("held") - F.col("at")) >= F.col("t") - F.least("place", "at")))
    ids = F.array(*(F.array(*(F.lit(order[w]) for w in t)) for _, t in sets))
    both = F.size(F.array_intersect("held", F.element_at(ids, F.col("notice") + 1)))
    label = F.element_at(F.array(*(F.lit(x) for x, _ in sets)), F.col("notice") + 1)
    return met.withColumn("both", both).where("both >= t").select("row", label.alias("label"), (F.col("both") / F.col("m")).alias("containment")).distinct()


def _places(all_words: str, phrase: str) -> Column:
    parts = phrase.split()
    n = len(parts)
    starts = F.when(F.size(all_words) >= n, F.sequence(F.lit(0), F.size(all_words) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(all_words, i + 1, n) == F.array(*map(F.lit, parts)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs(doc_id, text).

    Null and empty texts have no word and no label (an empty string) and score 0. A base
    phrase scores 1, else the largest containment of a notice counts. Null ids stay
    null, repeated rows stay; other columns are not read; texts are read whole. Rows are
    told apart by id and a hash of the text, so equal rows share their labels.
    """
    row = F.struct(F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row)
    has = F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("text"), F.lit("cc"))
    n = F.size(F.array_remove(F.split("text", GAP), ""))
    base = rows.select("doc_id", "row", n.cast("long").alias("n_words"), F.when(has, words(F.col("text"))).alias("w"))
    places = [(F.coalesce(_places("w", p), F.array().cast("array<int>")), label) for p, label in PHRASES.items()]
    base = base.select("doc_id", "row", "n_words", *(c.alias(f"p{i}") for i, (c, _) in enumerate(places)))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(places))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(places))))
    base = base.select("doc_id", "row", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))
    own = notices(rows.select("row", "text")).groupBy(F.col("row").alias("r")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    out = base.join(own, F.col("row").eqNullSafe(F.col("r")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def oracle() -> str:
    """The same in DuckDB, by plain comparison of every block with every notice."""
    word = WORD
    phrases = ", ".join(f"({i}, '{p}', '{label}')" for i, (p, label) in enumerate(PHRASES.items()))
    templates = ", ".join(f"({i}, '{label}', '{t}')" for i, (label, t) in enumerate(NOTICES))
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH docs AS (SELECT doc_id, {low} AS low, regexp_extract_all({low}, '{word}') AS w FROM documents),
phrases(k, phrase, label) AS (VALUES {phrases}),
hits AS (
  SELECT d.doc_id, p.label, i FROM docs d, phrases p, unnest(range(len(w))) AS u(i)
  WHERE w[i + 1] = split_part(phrase, ' ', 1) AND array_to_string(w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY doc_id),
templates(k, label, t) AS (VALUES {templates}),
sets AS (SELECT k, label, list_distinct(string_split(t, ' ')) AS s FROM templates),
vocabulary AS (SELECT list_distinct(flatten(list(s))) AS v FROM sets),
lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(low, chr(10)) AS l FROM docs)),
counted AS (SELECT *, len(regexp_extract_all(line, '{word}')) AS n, len(line) <= {WIDTH} AS short FROM lines),
running AS (SELECT *, sum(n) OVER w AS words, sum((NOT (short AND n > 0))::INT) OVER w AS stops FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
blocks AS (SELECT a.doc_id, string_agg(b.line, ' ' ORDER BY b.i) AS block FROM running a JOIN running b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {SPAN}
  WHERE b.i = a.i OR a.short AND b.stops = a.stops AND b.words - b.n - a.words + a.n < {SPAN} GROUP BY a.doc_id, a.i),
held AS (SELECT doc_id, list_intersect(list_distinct(regexp_extract_all(block, '{word}')), v) AS b FROM blocks, vocabulary),
met AS (SELECT doc_id, label, len(list_intersect(b, s)) / len(s)::DOUBLE AS c FROM held, sets WHERE len(list_intersect(b, s)) >= ceil({THRESHOLD} * len(s) - 1e-9)),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN b.labels IS NULL THEN [] ELSE string_split(b.labels, ',') END, coalesce(o.labels, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(o.best, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN own o USING (doc_id)"""
