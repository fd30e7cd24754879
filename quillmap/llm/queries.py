"""One query for each operator over its whole table, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, kdtree, language_id, license_scan, mixing, near_dedup, pivots, quality, spelling, token_output, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    """The vocabulary file; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.export(table(spark, sf_dir, "documents"), tokenizer())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("contaminated", F.size("items") > 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents"))


def op11_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.exact_top(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = (op1_language_id, op2_nearest, op3_toxicity, op4_token_output, op5_quality, op6_near_dedup, op7_warc, op8_decontaminate, op9_license_scan, op10_mixing, op11_exact_top, op12_spelling, op13_clusters)
    return {f.__name__: f for f in own}


#: Records as the archives must give them back.
WARC_SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)"""

MIXING_SQL = """
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, '')))) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
  (('0x' || substr(md5(coalesce(source, 'null')), 1, 4))::BIGINT % 2001 - 1000) / 1000.0::DOUBLE AS b FROM sources),
levels AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS want, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS ahead,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM weighed),
level AS (SELECT (want - ahead) / remaining AS rate FROM levels WHERE cap >= (want - ahead) / remaining * w ORDER BY cap / w LIMIT 1),
goals AS (SELECT source, source_size, b, least(cap, coalesce((SELECT rate FROM level) * w, cap)) AS target FROM levels),
line AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS x FROM rows),
copies AS (SELECT doc_id, size, source_size, target, b, x, x + source_size AS y, (x < target)::INT + (x + source_size < target)::INT AS copies FROM line JOIN goals ON line.source IS NOT DISTINCT FROM goals.source),
placed AS (SELECT *, CASE WHEN x < target THEN CASE WHEN b = 0 THEN x / target ELSE (sqrt((1 - b / 2) * (1 - b / 2) + 2 * b * x / target) - (1 - b / 2)) / b END END AS first_at,
  CASE WHEN y < target THEN CASE WHEN b = 0 THEN y / target ELSE (sqrt((1 - b / 2) * (1 - b / 2) + 2 * b * y / target) - (1 - b / 2)) / b END END AS second_at FROM copies)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies, first_at, coalesce(second_at, first_at) AS last_at,
  row_number() OVER (ORDER BY first_at NULLS LAST, doc_id NULLS FIRST, size) AS training_rank
FROM placed"""


TOP_SQL = """
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT r, len(v) AS w, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept),
scores AS (SELECT q.r AS q, c.r AS c, sum(q.x * c.x)::BIGINT AS score FROM parts q JOIN parts c ON q.w = c.w AND q.i = c.i AND q.r <> c.r WHERE q.r IN (SELECT r FROM kept WHERE vec_id % 50 = 0) GROUP BY q.r, c.r),
ranked AS (SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, b.vec_id)::INT AS rank, b.vec_id AS vec_id, score FROM scores JOIN kept a ON a.r = q JOIN kept b ON b.r = c)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of k-means as a chain of tables of (centroid, component, value)."""
    out = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        "parts AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM kept)",
        f"c0 AS MATERIALIZED (SELECT z - 1 AS z, i, x FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) AS z FROM kept) USING (r) WHERE z <= {k})",
    ]
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT r, min(z) AS z, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY r) AS least FROM (SELECT r, z, sum((parts.x - c{t}.x) * (parts.x - c{t}.x))::BIGINT AS d FROM parts JOIN c{t} USING (i) GROUP BY r, z)) WHERE d = least GROUP BY r)")
        if t < rounds:
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT z, i, coalesce(m, c{t}.x) AS x FROM c{t} LEFT JOIN (SELECT z, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM parts JOIN a{t} USING (r) GROUP BY z, i) USING (z, i))")
    return f"""WITH {", ".join(out)},
digests AS (SELECT z, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY z)
SELECT vec_id, z::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY z)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN digests USING (z) JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """What DuckDB can say of a query. Models, classes, indexes, token ids, template windows and checksums of words are tested by brute force, round trips or held-out labels."""
    return {"op7_warc": WARC_SQL, "op9_license_scan": license_scan.oracle(), "op10_mixing": MIXING_SQL, "op11_exact_top": TOP_SQL, "op13_clusters": clusters_sql()}
