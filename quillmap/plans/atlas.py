"""Registered queries over the bridge views, each beside SQL that DuckDB answers alike."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import geometry as G
from ..functions import noise
from ..functions import text as T
from ..operators import anchors, articles, links, placement, rasters, spatial, stats, terrain, topology
from ..sources import dumps, layouts
from ..operators.quantiles import quantiles
from ..sources.storage import shared_folder, stored
from . import bridge as B
from .bridge import FIGURES, PLACED, SQL_ERA, SQL_RADIUS, SQL_SCALE, SQL_UNCERTAINTY, TAU, placed, positions, sql_pmod, sql_uniform, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# Filters and counts.


@query(f"WITH {FIGURES} SELECT count(*) AS n, sum((order_year < 2000)::INT)::BIGINT AS kept, round(100.0::DOUBLE * sum((order_year < 2000)::INT) / nullif(count(*), 0), 6) AS pct FROM figures")
def prefilter_recency(spark, d):
    kept = F.sum((F.col("order_year") < 2000).cast("int"))
    return B.figures(spark, d).agg(F.count("*").alias("n"), kept.alias("kept"), _r(F.try_divide(100.0 * kept, F.count("*"))).alias("pct"))


STUBS = [(1, "poet", 120), (2, None, 300), (3, "", 100), (4, "king", 99), (5, "nun", None)]


@query(
    f"WITH {FIGURES}, t(id, description, words) AS (SELECT * FROM (VALUES {_sql_values(STUBS)}) v UNION ALL SELECT row_idx, CASE WHEN row_idx % 13 = 0 THEN NULL WHEN row_idx % 11 = 0 THEN '' ELSE title END, CASE WHEN row_idx % 7 <> 0 THEN words % 200 END FROM figures) "
    "SELECT id, coalesce(words >= 100, false) AS long_enough FROM t WHERE description IS NOT NULL"
)
def prefilter_stub_nulls(spark, d):
    """Literal edge cases, and all figures with some descriptions null or empty and some articles unread."""
    k = F.col("row_idx")
    every = B.figures(spark, d).select(k.alias("id"), F.when(k % 13 != 0, F.when(k % 11 == 0, "").otherwise(F.col("title"))).alias("description"), F.when(k % 7 != 0, F.col("words") % 200).alias("words"))
    rows = _values(spark, STUBS, "id long, description string, words int").union(every)
    return rows.where(F.col("description").isNotNull()).select("id", F.coalesce(F.col("words") >= 100, F.lit(False)).alias("long_enough"))


@query(f"WITH {FIGURES} SELECT qid, round({SQL_ERA}, 6) AS radius FROM figures")
def era_radius(spark, d):
    return B.figures(spark, d).select("qid", _r(G.era_radius(F.col("death_year"))).alias("radius"))


@query(f"WITH {FIGURES} SELECT qid, round({SQL_UNCERTAINTY}, 6) AS u FROM figures")
def date_uncertainty(spark, d):
    return B.figures(spark, d).select("qid", _r(G.uncertainty(F.col("birth_year"), F.col("death_year"))).alias("u"))


@query(f"WITH {FIGURES} SELECT qid, round(CASE WHEN {SQL_RADIUS} < 600 THEN 1200 - {SQL_RADIUS} ELSE {SQL_RADIUS} END, 6) AS radius FROM figures")
def radius_reflect(spark, d):
    return B.figures(spark, d).select("qid", _r(G.placed_radius(F.col("qid"), F.col("birth_year"), F.col("death_year"))).alias("radius"))


@query(f"WITH {PLACED} SELECT qid, round(radius, 4) AS radius, round(angle, 6) AS angle, round(x, 4) AS x, round(y, 4) AS y FROM placed")
def polar_position(spark, d):
    return positions(spark, d).select("qid", _r(F.col("radius"), 4).alias("radius"), _r(F.col("angle")).alias("angle"), _r(F.col("x"), 4).alias("x"), _r(F.col("y"), 4).alias("y"))


@query(f"WITH {PLACED} SELECT qid, round(sqrt(x * x + y * y), 4) AS radius, round({sql_pmod('atan2(y, x)', TAU)}, 6) AS angle FROM placed")
def cartesian_to_polar(spark, d):
    return positions(spark, d).select("qid", _r(F.hypot("x", "y"), 4).alias("radius"), _r(G.wrap(F.atan2("y", "x"))).alias("angle"))


@query(f"WITH {FIGURES} SELECT qid, round({SQL_SCALE}, 6) AS scale FROM figures")
def book_scale(spark, d):
    return B.figures(spark, d).select("qid", _r(G.book_scale(F.col("words"))).alias("scale"))


@query(f"SELECT l_orderkey, l_linenumber, {sql_pmod(f'round_even(l_quantity / {TAU} * 256, 0)::BIGINT', '256')}::SMALLINT AS code FROM lineitem")
def quantize_angle_byte(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.angle_byte(F.col("l_quantity")).alias("code"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(round_even(l_discount * 10 * 255, 0), 0), 255)::SMALLINT AS code FROM lineitem")
def quantize_scale_byte(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.to_byte(F.col("l_discount") * 10).alias("code"))


TIER_ROWS = [(1, "major", "birth"), (2, "minor", None), (3, "odd", "gazetteer"), (4, None, "death"), (5, "ordinary", "citizenship")]


@query(
    f"SELECT id, (CASE tier WHEN 'ordinary' THEN 0 WHEN 'minor' THEN 1 WHEN 'major' THEN 2 ELSE 0 END)::SMALLINT AS tier_code, (CASE geo WHEN 'birth' THEN 0 WHEN 'death' THEN 1 WHEN 'citizenship' THEN 2 WHEN 'gazetteer' THEN 3 ELSE 4 END)::SMALLINT AS geo_code FROM (SELECT * FROM (VALUES {_sql_values(TIER_ROWS)}) v(id, tier, geo) UNION ALL "
    "SELECT o_orderkey, CASE WHEN o_orderpriority < '2' THEN 'major' WHEN o_orderpriority < '3' THEN 'minor' WHEN o_orderpriority < '4' THEN 'ordinary' ELSE o_orderpriority END, CASE o_orderkey % 5 WHEN 0 THEN 'birth' WHEN 1 THEN 'death' WHEN 2 THEN 'citizenship' WHEN 3 THEN 'gazetteer' END FROM orders) t"
)
def tier_codes(spark, d):
    """Literal edge cases, and the priorities and statuses of all orders under the names of tiers and sources."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    tier = F.when(F.col("o_orderpriority") < "2", "major").when(F.col("o_orderpriority") < "3", "minor").when(F.col("o_orderpriority") < "4", "ordinary").otherwise(F.col("o_orderpriority"))
    geo = F.when(k % 5 == 0, "birth").when(k % 5 == 1, "death").when(k % 5 == 2, "citizenship").when(k % 5 == 3, "gazetteer")
    rows = _values(spark, TIER_ROWS, "id long, tier string, geo string").union(o.select(k, tier, geo))
    return rows.select("id", T.code_of(F.col("tier"), ("ordinary", "minor", "major"), 0).alias("tier_code"), T.code_of(F.col("geo"), ("birth", "death", "citizenship", "gazetteer"), 4).alias("geo_code"))


@query(f"WITH {FIGURES} SELECT qid, coalesce(birth_year, -32768)::SMALLINT AS birth, death_year::SMALLINT AS death FROM figures")
def year_sentinel(spark, d):
    return B.figures(spark, d).select("qid", F.coalesce("birth_year", F.lit(-32768)).cast("smallint").alias("birth"), F.col("death_year").cast("smallint").alias("death"))


# Entities.


def _snak(value, rank="normal", snaktype="value", datatype="wikibase-item"):
    return {"rank": rank, "mainsnak": {"snaktype": snaktype, "datatype": datatype} | ({"datavalue": {"value": value}} if value is not None else {})}


ENTITIES = [
    {"id": "Q1", "type": "item", "labels": {"en": {"value": "Ada"}}, "descriptions": {"en": {"value": "poet"}}, "sitelinks": {"enwiki": {"title": "Ada"}, "frwiki": {"title": "Ada"}},
     "claims": {"P31": [_snak({"id": "Q5"})], "P570": [_snak({"time": "+1852-11-27T00:00:00Z"}), _snak({"time": "+1853-01-01T00:00:00Z"}, "preferred")], "P569": [_snak({"time": "+1815-12-10T00:00:00Z"})], "P18": [_snak("a.jpg", datatype="commonsMedia")], "P27": [_snak({"id": "Q145"}), _snak({"id": "Q146"}, "deprecated")], "P214": [_snak("7", datatype="external-id")]}},
    {"id": "Q2", "type": "item", "labels": {}, "descriptions": {}, "sitelinks": {"enwiki": {"title": "Bo"}}, "claims": {"P31": [_snak({"id": "Q5"})], "P570": [_snak(None, snaktype="somevalue"), _snak({"time": "-0044-03-15T00:00:00Z"})], "P19": [_snak({"id": ""}), _snak({"id": "Q220"})]}},
    {"id": "Q3", "type": "item", "sitelinks": {"enwiki": {"title": "No death"}}, "claims": {"P31": [_snak({"id": "Q5"})]}},
    {"id": "Q4", "type": "item", "sitelinks": {}, "claims": {"P31": [_snak({"id": "Q5"}, "deprecated")], "P570": [_snak({"time": "+1900-00-00T00:00:00Z"})]}},
    {"id": "Q220", "type": "item", "labels": {"en": {"value": "Rome"}}, "sitelinks": {}, "claims": {"P625": [_snak({"latitude": "x", "longitude": 1}), _snak({"latitude": 41.9, "longitude": 12.5})], "P17": [_snak({"id": "Q38"})], "P31": [_snak({"id": "Q515"})]}},
    {"id": "Q221", "type": "item", "labels": {}, "sitelinks": {}, "claims": {"P17": [_snak({"id": "Q38"})]}},
]
LINES = [(i, json.dumps(e)) for i, e in enumerate(ENTITIES)]
#: An entity of every customer: a person, a place, or one with statements to leave out; <k> is the customer's key, <y> a year of three digits.
MADE = [
    {"id": "QC<k>", "type": "item", "labels": {"en": {"value": "L <k>"}}, "descriptions": {"en": {"value": "d"}}, "sitelinks": {"enwiki": {"title": "T <k>"}, "dewiki": {"title": "T"}}, "claims": {"P31": [_snak({"id": "Q5"})], "P570": [_snak({"time": "+1<y>-00-00T00:00:00Z"})], "P569": [_snak({"time": "+0<y>-01-01T00:00:00Z"}, "deprecated"), _snak({"time": "-0<y>-01-01T00:00:00Z"})], "P27": [_snak({"id": "C<y>"}), _snak({"id": "C<k>"}, "preferred")], "P18": [_snak("i<k>.jpg", datatype="commonsMedia")]}},
    {"id": "QC<k>", "type": "item", "labels": {"en": {"value": "Place <k>"}}, "sitelinks": {}, "claims": {"P625": [_snak({"latitude": "x<k>", "longitude": 1}), _snak({"latitude": "<y>", "longitude": "-0.<k>"})], "P17": [_snak({"id": ""}), _snak({"id": "C<y>"})]}},
    {"id": "QC<k>", "type": "item", "labels": {}, "sitelinks": {"enwiki": {"title": "U <k>"}}, "claims": {"P31": [_snak({"id": "Q5"})], "P570": [_snak(None, snaktype="novalue"), _snak({"time": "-0<y>-03-15T00:00:00Z"}, "preferred"), _snak({"time": "+1<y>-03-15T00:00:00Z"})], "P19": [_snak({"id": "P<k>"})]}},
]
ENTITY_CTE = (
    f"e AS (SELECT j::JSON AS j FROM (VALUES {_sql_values(LINES)}) t(i, j) UNION ALL SELECT replace(replace(CASE c_custkey % 3 "
    + " ".join(f"WHEN {i} THEN '{json.dumps(e)}'" for i, e in enumerate(MADE)) + " END, '<k>', c_custkey::VARCHAR), '<y>', lpad((c_custkey % 1000)::VARCHAR, 3, '0'))::JSON FROM customer)"
)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """The literal edge cases and the entities made of all customers."""
    k = F.col("c_custkey")
    made = F.get(F.array(*(F.lit(json.dumps(e)) for e in MADE)), (k % 3).cast("int"))
    lines = table(spark, d, "customer").select(F.replace(F.replace(made, F.lit("<k>"), k.cast("string")), F.lit("<y>"), F.lpad((k % 1000).cast("string"), 3, "0")).alias("value"))
    e = _values(spark, LINES, "i int, value string").select("value").union(lines).select(F.from_json("value", C.ENTITY).alias("e"))
    return e.withColumn("c", C.ranked(F.col("e.claims")))


def _sql_usable(prop: str) -> str:
    statements = f"from_json(coalesce(json_extract(j, '$.claims.{prop}'), '[]'), '[\"JSON\"]')"
    ok = f"list_filter({statements}, lambda s: coalesce(json_extract_string(s, '$.rank'), 'normal') <> 'deprecated' AND json_extract_string(s, '$.mainsnak.snaktype') = 'value')"
    preferred = "json_extract_string(s, '$.rank') = 'preferred'"
    return f"list_concat(list_filter({ok}, lambda s: {preferred}), list_filter({ok}, lambda s: NOT ({preferred})))"


def _sql_ids(prop: str) -> str:
    return f"list_filter(list_transform({_sql_usable(prop)}, lambda s: json_extract_string(s, '$.mainsnak.datavalue.value.id')), lambda x: x IS NOT NULL AND x <> '')"


def _sql_year(prop: str) -> str:
    times = f"list_transform({_sql_usable(prop)}, lambda s: json_extract_string(s, '$.mainsnak.datavalue.value.time'))"
    years = f"list_transform({times}, lambda t: CASE WHEN starts_with(t, '-') THEN -1 ELSE 1 END * TRY_CAST(nullif(regexp_extract(t, '^.([0-9]+)-', 1), '') AS INT))"
    return f"list_filter({years}, lambda y: y IS NOT NULL)[1]"


@query(
    f"WITH {ENTITY_CTE} SELECT json_extract_string(j, '$.id') AS qid, json_extract_string(j, '$.sitelinks.enwiki.title') AS title, {_sql_year('P569')} AS birth_year, {_sql_year('P570')} AS death_year, {_sql_ids('P27')}[1] AS citizenship, {_sql_ids('P19')}[1] AS birth_place_qid, len({_sql_usable('P18')}) > 0 AS has_image "
    f"FROM e WHERE list_contains({_sql_ids('P31')}, 'Q5') AND {_sql_year('P570')} IS NOT NULL AND json_extract(j, '$.sitelinks.enwiki') IS NOT NULL"
)
def json_entity_rows(spark, d):
    e = _entities(spark, d)
    row = C.figure_row(F.col("e"), F.col("c"))
    return e.where(C.is_figure(F.col("e"), F.col("c"))).select(C.first(row["citizenships"]).alias("citizenship"), *(row[k].alias(k) for k in ("qid", "title", "birth_year", "death_year", "birth_place_qid", "has_image")))


@query(
    f"WITH {ENTITY_CTE} SELECT json_extract_string(j, '$.id') AS qid, len(json_keys(coalesce(json_extract(j, '$.sitelinks'), '{{}}')))::INT AS sitelink_count, coalesce(list_sum(list_transform(json_keys(json_extract(j, '$.claims')), lambda k: json_array_length(json_extract(j, '$.claims.' || k)))), 0)::INT AS claim_count FROM e"
)
def entity_counts(spark, d):
    e = _entities(spark, d)
    return e.select(F.col("e.id").alias("qid"), F.coalesce(F.size("e.sitelinks"), F.lit(0)).alias("sitelink_count"), C.statement_count(F.col("e.claims")).alias("claim_count"))


@query(
    f"WITH {ENTITY_CTE}, p AS (SELECT j, list_filter(list_transform({_sql_usable('P625')}, lambda s: struct_pack(lat := TRY_CAST(json_extract_string(s, '$.mainsnak.datavalue.value.latitude') AS DOUBLE), lon := TRY_CAST(json_extract_string(s, '$.mainsnak.datavalue.value.longitude') AS DOUBLE))), lambda p: p.lat IS NOT NULL AND p.lon IS NOT NULL)[1] AS c FROM e) "
    f"SELECT json_extract_string(j, '$.id') AS qid, json_extract_string(j, '$.labels.en.value') AS label, c.lat AS lat, c.lon AS lon, {_sql_ids('P17')}[1] AS country_qid FROM p"
)
def place_rows(spark, d):
    e = _entities(spark, d)
    row = C.place_row(F.col("e"), F.col("c"))
    return e.select(*(row[k].alias(k) for k in ("qid", "label", "lat", "lon", "country_qid")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


TIMES = [("+1879-03-14T00:00:00Z",), ("-0044-03-15T00:00:00Z",), ("+0000-01-01",), ("1800",), ("",), ("x12-",), ("+99999999999-01-01",)]


@query(f"SELECT t, CASE WHEN starts_with(t, '-') THEN -1 ELSE 1 END * TRY_CAST(nullif(regexp_extract(t, '^.([0-9]+)-', 1), '') AS INT) AS y FROM (SELECT t FROM (VALUES {_sql_values(TIMES)}) v(t) UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' FROM orders)")
def parse_year(spark, d):
    dates = table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return _values(spark, TIMES, "t string").union(dates).select("t", T.parse_year(F.col("t")).alias("y"))


# Texts.

TITLES = [(" :Foo_bar#Baz ",), ("iPhone",), ("#x",), ("",), ("Category:Poets",), (":File: x",), ("a:b:c",), (" help : me",), ("éa",)]
SQL_TITLE = "trim(translate(CASE WHEN instr({0}, '#') > 0 THEN substr({0}, 1, instr({0}, '#') - 1) ELSE {0} END, '_', ' '))".format("regexp_replace(trim(t), '^:\\s*', '')")


#: The literal edge cases, and titles cut from names, names of nations, urls and links of all pages.
ALL_TITLES = (
    f"(SELECT t FROM (VALUES {_sql_values(TITLES)}) v(t) UNION ALL SELECT ' ' || replace(c_name, '#', '_') || ' #' || c_custkey FROM customer UNION ALL SELECT 'Category:' || n_name FROM nation "
    "UNION ALL SELECT url FROM pages UNION ALL SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) FROM pages)"
)


def _titles(spark, d):
    names = table(spark, d, "customer").select(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(" #"), F.col("c_custkey")).alias("t"))
    pages = table(spark, d, "pages")
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("t"))
    return _values(spark, TITLES, "t string").union(names).union(table(spark, d, "nation").select(F.concat(F.lit("Category:"), "n_name"))).union(pages.select("url")).union(hrefs)


@query(f"SELECT t, upper(substr({SQL_TITLE}, 1, 1)) || substr({SQL_TITLE}, 2) AS title FROM {ALL_TITLES}")
def normalize_title(spark, d):
    return _titles(spark, d).select("t", T.normalize_title(F.col("t")).alias("title"))


@query(f"SELECT t, instr(t, ':') > 1 AND lower(trim(split_part(t, ':', 1))) IN ({', '.join(repr(n) for n in T.NAMESPACES)}) AS skip FROM {ALL_TITLES}")
def skip_namespace(spark, d):
    return _titles(spark, d).select("t", T.is_skip_namespace(F.col("t")).alias("skip"))


WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT"


@query(f"SELECT doc_id, {WORDS} AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE 1 + len(regexp_extract_all(text, '[.!?]\\s+[A-Z]')) END::INT AS sentences FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("sentences"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '__[A-Z_]+__', '', 'g'), '\\s+', ' ', 'g'))) AS lead FROM documents")
def lead_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_lead(F.col("text"))).alias("lead"))


LEADS = [("Ada ( ; born 1815) was  here .",), ("Bo (1 , ) x",), ("C ( ) d\n\n\n\ne",), ("plain",)]


@query(
    "SELECT t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\(\\s*[;,:\\s]+', '(', 'g'), '[;,:\\s]+\\)', ')', 'g'), '\\(\\s*\\)', '', 'g'), '\\s+([,.;:])', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g') AS lead FROM (VALUES "
    + _sql_values(LEADS) + ") v(t) UNION ALL SELECT md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\(\\s*[;,:\\s]+', '(', 'g'), '[;,:\\s]+\\)', ')', 'g'), '\\(\\s*\\)', '', 'g'), '\\s+([,.;:])', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')), doc_id::VARCHAR FROM documents"
)
def lead_tidy(spark, d):
    docs = table(spark, d, "documents").select(F.md5(T.tidy_lead(F.col("text"))), F.col("doc_id").cast("string"))
    return _values(spark, LEADS, "t string").select("t", T.tidy_lead(F.col("t")).alias("lead")).union(docs)


@query("SELECT p_partkey, CASE WHEN h = '' THEN NULL ELSE h END AS region FROM (SELECT p_partkey, regexp_extract(lower(p_name), '\\b(part 10|part 1|part 2|part)\\b', 1) AS h FROM part)")
def region_match(spark, d):
    return table(spark, d, "part").select("p_partkey", T.match_phrase(F.col("p_name"), ["part", "part 1", "part 10", "part 2"]).alias("region"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)))::INT AS n_links FROM pages")
def html_title_links(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(found).alias("n_links"))


YEARS = [(-1500,), (-101,), (-100,), (-99,), (-1,), (0,), (1,), (100,), (101,), (1066,), (1100,), (1101,), (1200,), (1850,), (2001,), (2100,), (2201,)]
SQL_ORD = "({0})::VARCHAR || CASE WHEN ({0}) // 10 % 10 = 1 THEN 'th' WHEN ({0}) % 10 = 1 THEN 'st' WHEN ({0}) % 10 = 2 THEN 'nd' WHEN ({0}) % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"WITH {FIGURES} SELECT y, CASE WHEN y > 0 THEN {SQL_ORD.format('(y - 1) // 100 + 1')} || ' century' ELSE {SQL_ORD.format('floor((-y - 1) / 100.0)::BIGINT + 1')} || ' century BCE' END AS era FROM (SELECT y FROM (VALUES {_sql_values(YEARS)}) v(y) UNION ALL SELECT death_year FROM figures)")
def century_label(spark, d):
    return _values(spark, YEARS, "y int").union(B.figures(spark, d).select("death_year")).select("y", T.century(F.col("y")).alias("era"))


SQL_YEAR = "CASE WHEN {0} < 0 THEN (-{0})::VARCHAR || ' BCE' ELSE {0}::VARCHAR END"


@query(
    f"WITH {FIGURES} SELECT qid, CASE WHEN birth_year IS NOT NULL AND death_year IS NOT NULL THEN CASE WHEN birth_year = death_year THEN {SQL_YEAR.format('death_year')} ELSE ({SQL_YEAR.format('birth_year')}) || ' – ' || ({SQL_YEAR.format('death_year')}) END WHEN death_year IS NOT NULL THEN 'd. ' || ({SQL_YEAR.format('death_year')}) ELSE '' END AS span FROM figures"
)
def life_span_label(spark, d):
    return B.figures(spark, d).select("qid", T.life_span(F.col("birth_year"), F.col("death_year")).alias("span"))


URLS = [("Ada Lovelace",), ("C'est (la) vie!",), ("a+b/c?d&é",), ("~x*",)]


@query(f"SELECT t, 'https://en.wikipedia.org/wiki/' || replace(replace(replace(replace(replace(url_encode(replace(t, ' ', '_')), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS url FROM (SELECT t FROM (VALUES {_sql_values(URLS)}) v(t) UNION ALL SELECT c_name FROM customer UNION ALL SELECT p_name FROM part)")
def wiki_url(spark, d):
    rows = _values(spark, URLS, "t string").union(table(spark, d, "customer").select("c_name")).union(table(spark, d, "part").select("p_name"))
    return rows.select("t", T.article_url(F.col("t")).alias("url"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')) AS plain FROM pages")
def html_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.unescape_html(F.col("html"))).alias("plain"))


@query(f"SELECT doc_id, {WORDS} AS words, (len(regexp_extract_all(text, '\\n')) + 1)::INT AS sections, n_chars FROM documents")
def article_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), (F.regexp_count("text", F.lit("\n")) + 1).alias("sections"), "n_chars")


# Joins.

PLACES = "places AS (SELECT 'P' || s_suppkey AS qid, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey / 10.0::DOUBLE END AS lat, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey * 14.4::DOUBLE - 180 END AS lon, CASE WHEN s_suppkey % 3 <> 0 THEN 'C' || s_nationkey END AS country_qid FROM supplier)"
BORN = f"{FIGURES}, born AS (SELECT row_idx, qid, 'P' || (row_idx % 150) AS birth_place_qid, 'P' || (row_idx % 130) AS death_place_qid FROM figures), {PLACES}"


def _places(spark, d):
    s = table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(F.concat(F.lit("P"), k).alias("qid"), F.when(k % 7 != 0, k / 10.0).alias("lat"), F.when(k % 5 != 0, n * 14.4 - 180).alias("lon"), F.when(k % 3 != 0, F.concat(F.lit("C"), n)).alias("country_qid"))


def _born(spark, d):
    return B.figures(spark, d).select("row_idx", "qid", F.concat(F.lit("P"), F.col("row_idx") % 150).alias("birth_place_qid"), F.concat(F.lit("P"), F.col("row_idx") % 130).alias("death_place_qid"))


ANCHORED = f"""{BORN}, anchored AS (SELECT f.row_idx, f.qid, CASE WHEN b.lat IS NOT NULL AND b.lon IS NOT NULL THEN b.lon WHEN d.lat IS NOT NULL THEN d.lon END AS lon,
  CASE WHEN b.lat IS NOT NULL AND b.lon IS NOT NULL THEN 'birth' WHEN d.lat IS NOT NULL AND d.lon IS NOT NULL THEN 'death' END AS geo_source, coalesce(b.country_qid, d.country_qid) AS country_qid
  FROM born f LEFT JOIN places b ON f.birth_place_qid = b.qid LEFT JOIN places d ON f.death_place_qid = d.qid)"""


@query(f"WITH {ANCHORED} SELECT qid, round(lon, 6) AS lon, geo_source, country_qid FROM anchored")
def place_lookup_coalesce(spark, d):
    return placement.anchor(_born(spark, d), _places(spark, d)).select("qid", _r(F.col("lon")).alias("lon"), "geo_source", "country_qid")


@query(f"WITH {BORN} SELECT p.qid, p.lat FROM places p WHERE p.qid IN (SELECT birth_place_qid FROM born UNION SELECT death_place_qid FROM born)")
def place_semi_join(spark, d):
    b = _born(spark, d)
    need = b.select(F.col("birth_place_qid").alias("need")).union(b.select("death_place_qid")).where("need <> ''").distinct()
    p = _places(spark, d)
    return p.join(need, p["qid"] == need["need"], "left_semi").select("qid", "lat")


@query(
    f"WITH {ANCHORED}, pools AS (SELECT country_qid FROM anchored WHERE lon IS NOT NULL AND country_qid IS NOT NULL GROUP BY 1 HAVING count(*) >= 30), asks AS (SELECT *, 'C' || (row_idx % 27) AS citizen, 'C' || (row_idx % 25) AS region FROM anchored) "
    "SELECT a.qid, CASE WHEN lon IS NOT NULL THEN geo_source WHEN c.country_qid IS NOT NULL THEN 'citizenship' WHEN g.country_qid IS NOT NULL THEN 'gazetteer' END AS geo_source, CASE WHEN lon IS NOT NULL THEN a.country_qid ELSE coalesce(c.country_qid, g.country_qid, a.country_qid) END AS country_qid FROM asks a LEFT JOIN pools c ON citizen = c.country_qid LEFT JOIN pools g ON region = g.country_qid"
)
def location_ladder(spark, d):
    a = placement.anchor(_born(spark, d), _places(spark, d))
    asks = a.withColumns({"citizen": F.concat(F.lit("C"), F.col("row_idx") % 27), "region": F.concat(F.lit("C"), F.col("row_idx") % 25)})
    return placement.ladder(asks, placement.pools(a, 30)).select("qid", "geo_source", "country_qid")


@query(
    f"WITH {FIGURES}, pool AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY substr(md5(qid), 1, 2), qid) - 1 AS k, count(*) OVER (PARTITION BY country) AS n FROM figures WHERE lon IS NOT NULL), sizes AS (SELECT DISTINCT country, n FROM pool) "
    f"SELECT f.qid, f.country AS country_qid, round(p.lon, 6) AS lon FROM figures f JOIN sizes s ON f.country = s.country JOIN pool p ON p.country = f.country AND p.k = floor({sql_uniform('f.qid', 'borrow')} * s.n) WHERE f.lon IS NULL"
)
def compatriot_sample(spark, d):
    f = B.figures(spark, d).withColumnRenamed("country", "country_qid")
    return placement.borrow(f.where("lon IS NULL").select("qid", "country_qid"), f.where("lon IS NOT NULL").select("qid", "country_qid", "lon")).select("qid", "country_qid", _r(F.col("lon")).alias("lon"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END::INT AS n_links FROM documents d LEFT JOIN labels l USING (doc_id)")
def article_left_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("title"))
    arts = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("title"), F.col("doc_id").alias("article_idx"), "quality", F.array(F.lit("x")).alias("links"))
    return links.attach_articles(docs, arts).select("doc_id", "quality", F.size("links").alias("n_links"))


#: Links of every customer's page: the same title twice, an old title, other namespaces, one that nobody has.
LINKED = "['cust_' || (c_custkey * 7 % 150 + 1), 'Old ' || (c_custkey * 3 % 50), 'File:x.png', ':Cust ' || (c_custkey * 7 % 150 + 1) || '#life', 'Nowhere ' || c_custkey, 'Cust ' || c_custkey]"


@query(
    f"WITH p AS (SELECT c_custkey AS page_id, unnest({LINKED}) AS t, unnest(range(6)) AS pos FROM customer), l AS (SELECT page_id, pos, upper(substr({SQL_TITLE}, 1, 1)) || substr({SQL_TITLE}, 2) AS link FROM p WHERE NOT starts_with(t, 'File:')), "
    "hops AS (SELECT 'Old ' || n_nationkey AS source, 'Cust ' || (n_nationkey + 1) AS target FROM nation), titles AS (SELECT 'Cust ' || c_custkey AS title, CASE WHEN c_custkey % 10 = 0 THEN 'QQ' ELSE 'Q' END || c_custkey AS qid FROM customer), "
    "hit AS (SELECT page_id, qid, min(pos) AS pos FROM l LEFT JOIN hops ON link = source JOIN titles ON coalesce(target, link) = title GROUP BY 1, 2) SELECT page_id, string_agg(qid, ',' ORDER BY pos) AS qids FROM hit GROUP BY 1"
)
def link_resolution(spark, d):
    """Links between the pages of all customers; every tenth title stands twice, and its last row counts."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    to = (k * 7 % 150 + 1).cast("string")
    listed = F.array(F.concat(F.lit("cust_"), to), F.concat(F.lit("Old "), k * 3 % 50), F.lit("File:x.png"), F.concat(F.lit(":Cust "), to, F.lit("#life")), F.concat(F.lit("Nowhere "), k), F.concat(F.lit("Cust "), k))
    hops = table(spark, d, "nation").select(F.concat(F.lit("Old "), "n_nationkey").alias("source"), F.concat(F.lit("Cust "), F.col("n_nationkey") + 1).alias("target"))
    title = F.concat(F.lit("Cust "), k).alias("title")
    titles = c.select(title, F.concat(F.lit("Q"), k).alias("qid"), k.alias("row_idx")).union(c.where(k % 10 == 0).select(title, F.concat(F.lit("QQ"), k), k + 10_000_000_000))
    return links.resolve(c.select(k.alias("page_id"), listed.alias("links")), hops, titles).select("page_id", F.array_join("qids", ",").alias("qids"))


ANCHORS = [("First", ["Customer#000000001", "Customer#000000002", "Nobody"]), ("Second", ["Customer#000000004", "Customer#000000005", "Customer#000000007"])]
ANCHOR_SQL = "anchors(label, people) AS (VALUES " + ", ".join(f"('{a}', {p})" for a, p in ANCHORS) + "), names AS (SELECT label, unnest(people) AS name, unnest(range(len(people)))::INT AS pos FROM anchors)"
BEST = f"{PLACED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY sitelinks DESC, row_idx) AS k FROM placed) WHERE k = 1), {ANCHOR_SQL}"


def _members(spark, d):
    f = positions(spark, d).select("title", "row_idx", "qid", "sitelinks", "x", "y", "death_year", F.lit("birth").alias("geo_source"), F.col("lon").alias("country_lon"))
    return anchors.members(_values(spark, ANCHORS, "label string, people array<string>"), f)


@query(f"WITH {BEST} SELECT label, pos, name, qid FROM names LEFT JOIN best ON name = title")
def anchor_members(spark, d):
    return _members(spark, d).select("label", "pos", "name", "qid")


@query(f"WITH {BEST} SELECT label, name FROM names WHERE name NOT IN (SELECT title FROM best)")
def anchor_missing(spark, d):
    m = _members(spark, d)
    return m.where("qid IS NULL").select("label", "name")


@query(
    f"WITH {BEST}, m AS (SELECT * FROM names JOIN best ON name = title) SELECT label, round(avg(x), 4) AS x, round(avg(y), 4) AS y, arg_max(name, sitelinks * 1000 - pos) AS seat_title, median(death_year)::DOUBLE AS mid_year, count(*)::INT AS n_members, round(coalesce(max(lon) - min(lon), 0), 6) AS lon_spread FROM m GROUP BY label"
)
def anchor_centroid(spark, d):
    s = anchors.summarize(_members(spark, d))
    return s.select("label", _r(F.col("x"), 4).alias("x"), _r(F.col("y"), 4).alias("y"), "seat_title", F.col("mid_year").cast("double").alias("mid_year"), "n_members", _r(F.col("lon_spread")).alias("lon_spread"))


@query(
    f"WITH {BEST}, m AS (SELECT label, round_even(median(death_year), 0)::BIGINT AS y, count(*)::INT AS n_members FROM names JOIN best ON name = title GROUP BY label) "
    f"SELECT label, n_members, CASE WHEN y > 0 THEN {SQL_ORD.format('(y - 1) // 100 + 1')} || ' century' ELSE {SQL_ORD.format('floor((-y - 1) / 100.0)::BIGINT + 1')} || ' century BCE' END AS era FROM m"
)
def monument_eras(spark, d):
    """The century of the median death year of each monument's members."""
    return anchors.summarize(_members(spark, d)).select("label", "n_members", "era")


@query(f"WITH {PLACES} SELECT country_qid, round(avg(lon), 6) AS lon FROM places WHERE country_qid IS NOT NULL GROUP BY 1")
def country_mean_lon(spark, d):
    return _places(spark, d).where("country_qid IS NOT NULL").groupBy("country_qid").agg(_r(F.avg("lon")).alias("lon"))


SPAWN = [(0, "Q3"), (1, "Q1"), (2, "Q999999999"), (3, "Q7")]


@query(f"WITH {PLACED}, s(pos, want) AS (SELECT * FROM (VALUES {_sql_values(SPAWN)}) v UNION ALL SELECT 10 + s_suppkey, 'Q' || s_suppkey * 3 FROM supplier) SELECT pos, want, qid, title, round(x, 3) AS x FROM s LEFT JOIN placed ON want = qid")
def spawn_anchors(spark, d):
    """Where wanted ids stand: literal ones, and three times each supplier's key, of which some are no figure's."""
    k = F.col("s_suppkey")
    wanted = _values(spark, SPAWN, "pos long, want string").union(table(spark, d, "supplier").select(k + 10, F.concat(F.lit("Q"), k * 3)))
    return layouts.spawns(B.layout(spark, d), wanted).select("pos", "want", "qid", "title", _r(F.col("x"), 3).alias("x"))


POINTS = f"{PLACED}, points AS (SELECT row_idx AS id, x, y, {SQL_SCALE} * 3 AS r FROM placed)"


def _points(spark, d):
    return B.layout(spark, d).select(F.col("row_idx").alias("id"), "x", "y", (F.col("book_scale") * 3).alias("r"))


SQL_PAIR = "sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)"


@query(f"WITH {POINTS}, g AS (SELECT *, floor(x / 8)::BIGINT AS cx, floor(y / 8)::BIGINT AS cy FROM points), n AS (SELECT id, x, y, cx + i AS cx, cy + j AS cy FROM g, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)) SELECT p.id AS a, q.id AS b, round({SQL_PAIR}, 4) AS d FROM g p JOIN n q USING (cx, cy) WHERE p.id < q.id AND {SQL_PAIR} <= 8")
def pairs_within_radius(spark, d):
    return spatial.pairs_within(_points(spark, d), 8.0).select("a", "b", _r(F.col("d"), 4).alias("d"))


ROUND = f"""{POINTS}, g AS (SELECT *, floor(x / 7.02)::BIGINT AS cx, floor(y / 7.02)::BIGINT AS cy FROM points), n AS (SELECT id, x, y, r, cx + i AS cx, cy + j AS cy FROM g, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
pairs AS (SELECT p.id AS a, q.id AS b, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, {SQL_PAIR} AS d, 0.9::DOUBLE * greatest(p.r, q.r) AS want FROM g p JOIN n q USING (cx, cy) WHERE p.id < q.id),
bad AS (SELECT *, (want - (d + 1e-9::DOUBLE)) * 0.9::DOUBLE AS step FROM pairs WHERE d < want)"""


@query(f"WITH {ROUND} SELECT a, b, round(d, 4) AS d FROM bad")
def subsumed_pairs(spark, d):
    return topology.violations(_points(spark, d), 7.02).select("a", "b", _r(F.col("d"), 4).alias("d"))


SQL_MOVED = f"""{ROUND}, m AS (SELECT a AS id, (xa - xb) / (d + 1e-9::DOUBLE) * step AS px, (ya - yb) / (d + 1e-9::DOUBLE) * step AS py FROM bad UNION ALL SELECT b, (xb - xa) / (d + 1e-9::DOUBLE) * step, (yb - ya) / (d + 1e-9::DOUBLE) * step FROM bad),
s AS (SELECT id, sum(px) AS mx, sum(py) AS my FROM m GROUP BY id), moved AS (SELECT p.id, coalesce(mx, 0) AS mx, coalesce(my, 0) AS my, p.x, p.y FROM points p LEFT JOIN s USING (id)), k AS (SELECT *, least(1.0, 20 / greatest(sqrt(mx * mx + my * my), 1e-9)) AS k FROM moved)"""


def _round(spark, d):
    return topology.relax_round(_points(spark, d).withColumns({"x0": F.col("x"), "y0": F.col("y")}), 7.02)


@query(f"WITH {SQL_MOVED} SELECT id, round(x + mx * k, 3) AS x, round(y + my * k, 3) AS y FROM k")
def relax_round(spark, d):
    return _round(spark, d).select("id", _r(F.col("x"), 3).alias("x"), _r(F.col("y"), 3).alias("y"))


@query(f"WITH {SQL_MOVED}, v AS (SELECT sqrt(mx * mx + my * my) * k AS v FROM k) SELECT round(median(v), 5) AS mid, round(max(v), 5) AS most, count(*) FILTER (v > 0.01) AS nudged FROM v")
def move_stats(spark, d):
    return topology.move_stats(_round(spark, d)).select(_r(F.col("mid"), 5).alias("mid"), _r(F.col("most"), 5).alias("most"), "nudged")


MONUMENT_DISCS = [(1000.0, 0.0, 12.0), (-2000.0, 500.0, 12.0), (0.0, 3000.0, 12.0)]


@query()
def relax_layout(spark, d):
    """All rounds with three monument discs; a loop of rounds is beyond SQL, the tests compare it with numpy."""
    return topology.settled(topology.relax(_points(spark, d), zones=MONUMENT_DISCS)).select("id", "x", "y", "radius", "angle", "moved")


ZONES = [("a", 1000.0, 0.0, 150.0), ("b", -2000.0, 500.0, 200.0), ("c", 0.0, 3000.0, 300.0)]


@query(f"WITH {POINTS}, zones(zone, zx, zy, zr) AS (VALUES {_sql_values(ZONES)}) SELECT id, zone, round(sqrt((x - zx) ** 2 + (y - zy) ** 2), 4) AS d FROM points, zones WHERE sqrt((x - zx) ** 2 + (y - zy) ** 2) < zr")
def zone_violations(spark, d):
    return spatial.within_zones(_points(spark, d), _values(spark, ZONES, "zone string, zx double, zy double, zr double")).select("id", "zone", _r(F.col("d"), 4).alias("d"))


@query("WITH n AS (SELECT n_name, cos(n_nationkey) AS x, sin(n_nationkey) AS y FROM nation) SELECT b.n_name AS name, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM n a, n b WHERE a.n_name = (SELECT min(n_name) FROM nation) AND b.n_name <> a.n_name")
def travel_destinations(spark, d):
    n = table(spark, d, "nation").select("n_name", F.cos("n_nationkey").alias("x"), F.sin("n_nationkey").alias("y"))
    here = n.orderBy("n_name").limit(1).select(F.col("n_name").alias("h"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    return n.join(F.broadcast(here), F.col("n_name") != F.col("h")).select(F.col("n_name").alias("name"), _r(F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy"))).alias("d")).orderBy("d")


EYES = [(i, 900.0 * math.cos(i), 900.0 * math.sin(i), math.cos(i), math.sin(i)) for i in range(40)]


@query(
    f"WITH {POINTS}, eyes(eye, ex, ey, dx, dy) AS (VALUES {_sql_values(EYES)}), h AS (SELECT eye, id, (x - ex) ** 2 + (y - ey) ** 2 AS d2 FROM points, eyes WHERE (x - ex) ** 2 + (y - ey) ** 2 <= 3600 AND (x - ex) * dx + (y - ey) * dy > 0 AND abs((x - ex) * dy - (y - ey) * dx) <= 9) SELECT eye, id, round(sqrt(d2), 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY eye ORDER BY d2, id) AS k FROM h) WHERE k = 1"
)
def nearest_in_cylinder(spark, d):
    return spatial.nearest_in_cylinder(_points(spark, d), _values(spark, EYES, "eye int, ex double, ey double, dx double, dy double"), 60.0, 9.0).select("eye", "id", _r(F.col("d"), 4).alias("d"))


@query(f"WITH {POINTS}, n AS (SELECT id, sqrt((x - 700) ** 2 + y ** 2) AS d FROM points), o AS (SELECT id, d, row_number() OVER (ORDER BY d, id)::INT AS place FROM n WHERE d <= 1500) SELECT id, round(d, 4) AS d, place, CASE WHEN place <= 60 THEN 0 ELSE 1 END::INT AS tier FROM o WHERE place <= 600")
def nearest_capped(spark, d):
    return spatial.nearest_capped(_points(spark, d), 700.0, 0.0, 1500.0, (60, 540)).select("id", _r(F.col("d"), 4).alias("d"), "place", "tier")


@query(
    f"WITH {POINTS}, q AS (SELECT id, {sql_pmod('x / 100', '15')} AS r, {sql_pmod('y / 100', '15')} AS c FROM points), k AS (SELECT *, least(floor(r), 14) AS i, least(floor(c), 14) AS j FROM q) SELECT id, round((1 - (r - i)) * (1 - (c - j)) * sin(i * 16 + j) + (1 - (r - i)) * (c - j) * sin(i * 16 + j + 1) + (r - i) * (1 - (c - j)) * sin(i * 16 + 16 + j) + (r - i) * (c - j) * sin(i * 16 + 17 + j), 6) AS h FROM k"
)
def bilinear_sample(spark, d):
    raster = spark.range(256).select((F.col("id") / 16).cast("int").alias("i"), (F.col("id") % 16).cast("int").alias("j"), F.sin("id").alias("h"))
    at = _points(spark, d).select("id", F.pmod(F.col("x") / 100, F.lit(15.0)).alias("row"), F.pmod(F.col("y") / 100, F.lit(15.0)).alias("col"))
    return spatial.bilinear(at, raster, 16).select("id", _r(F.col("h")).alias("h"))


@query(f"WITH {POINTS} SELECT id, round({sql_pmod('x', '10')} + 2 * {sql_pmod('y', '10')}, 5) AS h FROM points")
def triangle_height(spark, d):
    tri = [(0.0, 0.0, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0, 20.0), (10.0, 0.0, 10.0, 10.0, 10.0, 30.0, 0.0, 10.0, 20.0)]
    triangles = _values(spark, tri, ", ".join(f"{k}{i} double" for i in (1, 2, 3) for k in ("x", "y", "h")))
    at = _points(spark, d).select("id", F.pmod("x", F.lit(10.0)).alias("x"), F.pmod("y", F.lit(10.0)).alias("y"))
    return spatial.triangle_height(at, triangles, 5.0).select("id", _r(F.col("h"), 5).alias("h"))


# Windows, tops and statistics.

TIERED = f"{PLACED}, b AS (SELECT *, row_number() OVER (PARTITION BY sec, ring, lon IS NULL ORDER BY sitelinks DESC, row_idx) AS k FROM placed), t AS (SELECT *, CASE WHEN sitelinks >= 80 THEN 'major' WHEN lon IS NOT NULL AND k = 1 THEN 'minor' ELSE 'ordinary' END AS landmark_tier FROM b)"


@query(f"WITH {TIERED} SELECT qid, landmark_tier FROM t")
def tier_cells(spark, d):
    return placed(spark, d).select("qid", "landmark_tier")


@query(f"WITH {PLACED}, t AS (SELECT qid, row_idx, sitelinks, least(floor({sql_pmod('atan2(y, x)', TAU)} / ({TAU} / 24)), 23)::INT AS sec, ring FROM placed), b AS (SELECT *, row_number() OVER (PARTITION BY sec, ring ORDER BY sitelinks DESC, row_idx) AS k FROM t) SELECT qid, sec, ring FROM b WHERE k = 1 AND sitelinks < 80")
def minor_landmarks(spark, d):
    p = B.layout(spark, d).select("row_idx", "qid", "x", "y", "sitelinks")
    return layouts.local_best(p, p.where("sitelinks >= 80")).select("qid", "sec", "ring")


@query(f"WITH {PLACED}, b AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY sitelinks DESC, row_idx) AS k FROM placed) SELECT qid, sec, k::INT AS k FROM b WHERE k <= 4")
def sector_topk(spark, d):
    return layouts.sector_top(positions(spark, d), "angle", 100).select("qid", "sec", "k")


@query(f"WITH {FIGURES} SELECT qid, row_number() OVER (ORDER BY coalesce(birth_year, 0), row_idx)::INT AS place FROM figures WHERE sitelinks >= 118")
def hits_by_year(spark, d):
    hits = B.figures(spark, d).where("sitelinks >= 118")  # few by the floor
    return hits.select("qid", F.row_number().over(Window.orderBy(F.coalesce("birth_year", F.lit(0)), "row_idx")).alias("place"))


@query("SELECT p_brand, arg_max(p_partkey, p_retailprice * 1e7 - p_partkey) AS best FROM part GROUP BY 1")
def title_dedupe(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(F.col("p_retailprice"), -F.col("p_partkey"))).alias("best"))


@query(f"WITH {PLACED}, c AS (SELECT qid, row_idx, floor(x / 500)::BIGINT AS cx, floor(y / 500)::BIGINT AS cy FROM placed), n AS (SELECT *, count(*) OVER (PARTITION BY cx, cy) AS n, row_number() OVER (PARTITION BY cx, cy ORDER BY row_idx) AS k FROM c) SELECT qid FROM n WHERE n <= 8 OR (k - 1) % 6 = 0")
def carpet_thinning(spark, d):
    return spatial.thinned(B.layout(spark, d).select("qid", "row_idx", "x", "y"), 500.0, ident="row_idx").select("qid")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, (sum(strlen(c_name)) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) - strlen(c_name))::BIGINT AS starts FROM customer UNION ALL SELECT NULL, count(*), sum(strlen(c_name))::BIGINT FROM customer")
def blob_offsets(spark, d):
    return stats.running_offsets(table(spark, d, "customer").select("c_custkey", F.octet_length("c_name").alias("n")), ["c_custkey"], "n")


CELLS = "cells AS (SELECT floor(x / 500)::BIGINT AS cx, floor(y / 500)::BIGINT AS cy, count(*) AS n FROM placed GROUP BY 1, 2)"


@query(f"WITH {PLACED}, {CELLS} SELECT * FROM cells")
def cell_counts(spark, d):
    return positions(spark, d).groupBy(spatial.cell(F.col("x"), 500.0).alias("cx"), spatial.cell(F.col("y"), 500.0).alias("cy")).agg(F.count("*").alias("n"))


@query(f"WITH {PLACED}, {CELLS} SELECT cx, cy, (sum(n) OVER (ORDER BY cx, cy ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS starts FROM cells UNION ALL SELECT NULL, NULL, count(*) FROM placed")
def cell_prefix(spark, d):
    return stats.running_offsets(cell_counts(spark, d), ["cx", "cy"], "n").select("cx", "cy", "starts")


@query(f"WITH {FIGURES} SELECT country, n FROM (SELECT country, count(*) AS n, min(row_idx) AS f FROM figures GROUP BY 1) ORDER BY n DESC, f LIMIT 12")
def country_top_n(spark, d):
    return B.figures(spark, d).groupBy("country").agg(F.count("*").alias("n"), F.min("row_idx").alias("f")).orderBy(F.desc("n"), "f").limit(12).select("country", "n")


@query(f"WITH {FIGURES} SELECT qid, sitelinks FROM figures ORDER BY sitelinks DESC, row_idx LIMIT 25")
def global_top_n(spark, d):
    return B.figures(spark, d).orderBy(F.desc("sitelinks"), "row_idx").limit(25).select("qid", "sitelinks")


@query(f"WITH {FIGURES} SELECT qid, sitelinks FROM figures WHERE sitelinks >= (SELECT min(sitelinks) FROM (SELECT sitelinks FROM figures ORDER BY sitelinks DESC LIMIT 40))")
def label_cut(spark, d):
    f = B.figures(spark, d).select("qid", "sitelinks")
    cut = f.orderBy(F.desc("sitelinks")).limit(40).agg(F.min("sitelinks").alias("cut"))
    return f.join(F.broadcast(cut), F.col("sitelinks") >= F.col("cut")).select("qid", "sitelinks")


@query(f"WITH {PLACED} SELECT least(floor((x + 9000) / 18000 * 64), 63)::INT AS i, least(floor((y + 9000) / 18000 * 64), 63)::INT AS j, count(*) AS n FROM placed GROUP BY 1, 2")
def density_hist2d(spark, d):
    bin_of = lambda c: F.least(F.floor((F.col(c) + 9000) / 18000 * 64), F.lit(63)).cast("int")
    return positions(spark, d).groupBy(bin_of("x").alias("i"), bin_of("y").alias("j")).agg(F.count("*").alias("n"))


@query(f"WITH {PLACED}, h AS (SELECT least(floor((x + 9000) / 18000 * 64), 63)::INT AS i, least(floor((y + 9000) / 18000 * 64), 63)::INT AS j, count(*) AS n FROM placed GROUP BY 1, 2) SELECT round(quantile_cont(n, 0.98), 6) AS p98 FROM h")
def density_percentile(spark, d):
    return _rounded(quantiles(stored(density_hist2d(spark, d), "cells"), F.col("n"), {"p98": 0.98}))


SPAN_SQL = "s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM placed)"


@query(f"WITH {PLACED}, {SPAN_SQL} SELECT least(floor((x - x0) / (x1 - x0) * 800), 799)::INT AS i, least(floor((y - y0) / (y1 - y0) * 800), 799)::INT AS j, count(*) AS n FROM placed, s GROUP BY 1, 2")
def range_hist2d(spark, d):
    return stats.range_histogram(B.layout(spark, d).select("x", "y"))


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(_r(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


DEVIATION_SQL = "round(avg((v IS NOT NULL)::INT), 6) AS coverage, round(sqrt(avg(v ** 2)), 6) AS rms, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS most, round(avg(v), 6) AS mean"


#: How many figures stand in each cell of a raster of 64 by 64, empty ones too, as heights.
RASTER = f"""{PLACED}, hist AS (SELECT least(floor((x + 9000) / 18000 * 64), 63)::INT AS i, least(floor((y + 9000) / 18000 * 64), 63)::INT AS j, count(*) AS n FROM placed GROUP BY 1, 2),
raster AS (SELECT (k // 64)::INT AS i, (k % 64)::INT AS j, coalesce(n, 0)::DOUBLE AS h FROM range(4096) t(k) LEFT JOIN hist ON hist.i = k // 64 AND hist.j = k % 64)"""


def _raster(spark, d):
    cells = spark.range(4096).select(F.floor(F.col("id") / 64).cast("int").alias("i"), (F.col("id") % 64).cast("int").alias("j"))
    return cells.join(density_hist2d(spark, d), ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).cast("double").alias("h"))


def _sql_gradient(by: str, along: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY {along})"
    return f"(coalesce(lead(h) OVER {w}, h) - coalesce(lag(h) OVER {w}, h)) / (CASE WHEN {along} IN (0, 63) THEN 1 ELSE 2 END * 281.25::DOUBLE)"


WIND = (0.8, -0.6)
SLOPES = f"{RASTER}, slopes AS (SELECT i, j, {_sql_gradient('i', 'j')} * {WIND[0]}::DOUBLE + {_sql_gradient('j', 'i')} * ({WIND[1]}::DOUBLE) AS v FROM raster)"


@query(f"WITH {SLOPES} SELECT i, j, round(v, 9) AS slope FROM slopes")
def wind_slopes(spark, d):
    """The gradient along the wind of the binned figures."""
    return stats.wind_slopes(_raster(spark, d), 281.25, WIND).select("i", "j", _r(F.col("slope"), 9).alias("slope"))


@query(f"WITH {SLOPES} SELECT round(degrees(atan(quantile_cont(v, 0.95) FILTER (v > 0))), 5) AS up, round(degrees(atan(quantile_cont(-v, 0.95) FILTER (v < 0))), 5) AS down, round(avg((v > 0.01)::INT) FILTER (v > 0), 5) AS steep_up, round(avg((-v > 0.01)::INT) FILTER (v < 0), 5) AS steep_down FROM slopes")
def slope_asymmetry(spark, d):
    return _rounded(stats.slope_asymmetry(stats.wind_slopes(_raster(spark, d), 281.25, WIND), F.col("slope"), 0.01), 5)


#: Points in units of the raster's cells, and how far the drawn facets lie from a smooth surface there; null at the rim.
CHORDS = f"""{RASTER}, spots AS (SELECT row_idx AS id, sqrt(x * x + y * y) AS r, (x + 9000) / 281.25::DOUBLE AS p, (y + 9000) / 281.25::DOUBLE AS q FROM placed),
part AS (SELECT id, r, floor(p)::INT AS i, floor(q)::INT AS j, p - floor(p) AS a, q - floor(q) AS b FROM spots),
four AS (SELECT part.*, h00.h AS h00, h10.h AS h10, h01.h AS h01, h11.h AS h11 FROM part LEFT JOIN raster h00 ON h00.i = part.i AND h00.j = part.j LEFT JOIN raster h10 ON h10.i = part.i + 1 AND h10.j = part.j
  LEFT JOIN raster h01 ON h01.i = part.i AND h01.j = part.j + 1 LEFT JOIN raster h11 ON h11.i = part.i + 1 AND h11.j = part.j + 1),
gaps AS (SELECT id, r, abs((CASE WHEN b <= a THEN (1 - a) * h00 + (a - b) * h10 + b * h11 ELSE (1 - b) * h00 + (b - a) * h01 + a * h11 END) - ((1 - a) * (1 - b) * h00 + a * (1 - b) * h10 + (1 - a) * b * h01 + a * b * h11)) AS v FROM four)"""


@query(f"WITH {CHORDS} SELECT floor(r / 1000)::BIGINT AS band, {DEVIATION_SQL} FROM gaps GROUP BY 1")
def chord_deviation_bands(spark, d):
    """How far the facets of a raster of figures lie from its smooth surface under every figure, by distance from the centre."""
    raster = stored(_raster(spark, d), "raster")
    to = lambda c: ((F.col(c) + 9000) / 281.25)
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < 63)
    points = stored(_points(spark, d).select("id", F.hypot("x", "y").alias("r"), to("x").alias("row"), to("y").alias("col")), "chords")
    here = points.where(inside("row") & inside("col"))
    flat = spatial.chord_height(here, raster).withColumnRenamed("h", "flat")
    smooth = spatial.bilinear(here, raster, 64).withColumnRenamed("h", "smooth")
    both = points.join(flat, "id", "left").join(smooth, "id", "left")
    return _rounded(stats.deviation_stats(both, F.abs(F.col("flat") - F.col("smooth")), F.floor(F.col("r") / 1000)))


PRICE = "l_extendedprice * (1 - l_discount) * ln(2 + l_quantity)"


@query("SELECT l_returnflag AS flag, " + ", ".join(f"round(quantile_cont({PRICE}, {q}), 4) AS {n}" for n, q in (("p05", 0.05), ("mid", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM lineitem GROUP BY 1")
def exact_quantiles(spark, d):
    """Quantiles of a continuous column of a large table, by selection."""
    rows = table(spark, d, "lineitem")
    return _rounded(quantiles(rows, F.expr(PRICE), {"p05": 0.05, "mid": 0.5, "p95": 0.95, "p99": 0.99}, F.col("l_returnflag")), 4).withColumnRenamed("group", "flag")


@query(f"WITH {POINTS} SELECT round(min(r / 3), 6) AS least, round(median(r / 3), 6) AS mid, round(max(r / 3), 6) AS most FROM points")
def scale_range(spark, d):
    return _rounded(quantiles(B.layout(spark, d), F.col("book_scale"), {"least": 0.0, "mid": 0.5, "most": 1.0}))


@query(f"WITH {PLACED} SELECT round(1 - sqrt(avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2), 6) AS dispersion FROM placed")
def angular_dispersion(spark, d):
    return positions(spark, d).agg(_r(1 - F.hypot(F.avg(F.cos("angle")), F.avg(F.sin("angle")))).alias("dispersion"))


@query(f"WITH {PLACED} SELECT round(max(radius), 4) AS rmax, round(min(x), 4) AS x0, round(max(x), 4) AS x1, round(min(y), 4) AS y0, round(max(y), 4) AS y1 FROM placed")
def world_bounds(spark, d):
    return positions(spark, d).agg(_r(F.max("radius"), 4).alias("rmax"), _r(F.min("x"), 4).alias("x0"), _r(F.max("x"), 4).alias("x1"), _r(F.min("y"), 4).alias("y0"), _r(F.max("y"), 4).alias("y1"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_partkey LIMIT 40")
def title_search(spark, d):
    return layouts.find_titles(table(spark, d, "part"), " AN ", "p_name", "p_partkey").select("p_partkey", "p_name")


@query(f"WITH {PLACED} SELECT round(radius * cos(angle), 4) AS x, round(radius * sin(angle), 4) AS y, title, death_year FROM placed")
def sniffed_xy(spark, d):
    return layouts.with_xy(positions(spark, d).drop("x", "y")).select(_r(F.col("x"), 4).alias("x"), _r(F.col("y"), 4).alias("y"), "title", "death_year")


@query(f"WITH {FIGURES} SELECT qid FROM figures WHERE abs(death_year - 1500) <= 50")
def ring_window(spark, d):
    return B.figures(spark, d).where(F.abs(F.col("death_year") - 1500) <= 50).select("qid")


@query(f"WITH {PLACED} SELECT qid FROM placed WHERE sqrt(x * x + y * y) <= 1500 AND abs(x - 200) <= 900 AND abs(y) <= 900")
def disc_clip(spark, d):
    return B.layout(spark, d).where((F.hypot("x", "y") <= 1500) & (F.abs(F.col("x") - 200) <= 900) & (F.abs("y") <= 900)).select("qid")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 45")
def projected_scan(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("l_quantity"), F.upper("l_returnflag").alias("flag"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def row_limit(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "n_chars")


@query("SELECT page_id FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def key_semi_join(spark, d):
    p, k = table(spark, d, "pages"), table(spark, d, "labels").where("quality = 0")
    return p.join(k, p["page_id"] == k["doc_id"], "left_semi").select("page_id")


@query(f"SELECT t FROM {ALL_TITLES} WHERE NOT (instr(t, ':') > 1 AND lower(trim(split_part(t, ':', 1))) IN ({', '.join(repr(n) for n in T.NAMESPACES)}))")
def namespace_filter(spark, d):
    return _titles(spark, d).where(~T.is_skip_namespace(F.col("t")))


@query(f"WITH {FIGURES} SELECT country, sum((lon IS NOT NULL)::INT)::BIGINT AS located, count(*) AS n FROM figures GROUP BY 1")
def located_mask(spark, d):
    return B.figures(spark, d).groupBy("country").agg(F.sum(F.col("lon").isNotNull().cast("int")).alias("located"), F.count("*").alias("n"))


@query(f"WITH {FIGURES} SELECT qid FROM figures WHERE sitelinks >= 80 OR lower(title) IN ('customer#000000001', 'customer#000000010')")
def title_override(spark, d):
    return B.figures(spark, d).where((F.col("sitelinks") >= 80) | F.lower("title").isin("customer#000000001", "customer#000000010")).select("qid")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT AS price, round_even(l_extendedprice, 1) AS even, floor(l_extendedprice + 0.5)::BIGINT AS half_up FROM lineitem")
def numeric_narrowing(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.cast("float").alias("price"), F.bround(x, 1).alias("even"), F.floor(x + 0.5).alias("half_up"))


@query(f"WITH {FIGURES} SELECT qid, round(2000 - ({SQL_ERA} - 600) / 6500 * 2800, 6) AS year FROM figures")
def year_radius_roundtrip(spark, d):
    return B.figures(spark, d).select("qid", _r(G.year_of_radius(G.era_radius(F.col("death_year")))).alias("year"))


@query(f"WITH {FIGURES} SELECT qid, round(ln(1 + greatest(2000 - death_year, 0)), 6) AS age FROM figures")
def log_age(spark, d):
    return B.figures(spark, d).select("qid", _r(F.log1p(F.greatest(2000 - F.col("death_year"), F.lit(0)))).alias("age"))


@query(f"WITH {PLACED} SELECT qid, round({sql_pmod('angle / (2 * pi()) - 0.25 + 0.5', '1')} - 0.5, 6) AS arc, sign(x)::INT AS side FROM placed")
def angle_math(spark, d):
    return positions(spark, d).select("qid", _r(G.hue_arc(F.lit(0.25), F.col("angle") / G.TAU)).alias("arc"), F.signum("x").cast("int").alias("side"))


@query("SELECT l_orderkey, l_linenumber, round(t * t * t * (t * (t * 6 - 15) + 10), 6) AS s FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity / 40 - 0.1::DOUBLE, 0), 1) AS t FROM lineitem)")
def smootherstep(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(G.smootherstep(F.col("l_quantity") / 40 - 0.1)).alias("s"))


SQL_NEAR = "((row_idx * 2654435761::HUGEINT) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE"
SQL_FAR = "((xor(row_idx, 2654435769) * 2246822519::HUGEINT) % 4294967296)::DOUBLE / 4294967296.0::DOUBLE"


@query(f"WITH {PLACED} SELECT qid FROM placed WHERE x * x + y * y < (1500 + ({SQL_NEAR} - 0.5) * 400) ** 2")
def lod_membership(spark, d):
    edge = 1500 + (G.near_hash(F.col("row_idx")) - 0.5) * 400
    return B.layout(spark, d).where(F.col("x") * F.col("x") + F.col("y") * F.col("y") < edge * edge).select("qid")


DETAIL_SQL = f"""{PLACED}, b AS (SELECT min(x) AS x0, min(y) AS y0 FROM placed), c AS (SELECT row_idx, (x - 700) * (x - 700) + y * y AS d2, floor((x - x0) / 100) - floor((700 - x0) / 100) AS gx, floor((y - y0) / 100) - floor((0 - y0) / 100) AS gy FROM placed, b),
w AS (SELECT *, greatest(abs(gx), abs(gy)) AS ring, d2 < (500 + ({SQL_NEAR} - 0.5) * 200) ** 2 AS near, d2 < (1200 + ({SQL_FAR} - 0.5) * 100) ** 2 AS mid FROM c WHERE d2 <= 1250 ** 2),
o AS (SELECT *, row_number() OVER (ORDER BY ring, (abs(gy) <> ring)::INT, CASE WHEN abs(gy) = ring THEN gx ELSE gy END, CASE WHEN abs(gy) = ring THEN gy > 0 ELSE gx > 0 END, row_idx) AS step FROM w),
n AS (SELECT row_idx, d2 FROM o WHERE near ORDER BY step LIMIT 40), m AS (SELECT row_idx, d2 FROM o WHERE mid AND row_idx NOT IN (SELECT row_idx FROM n) ORDER BY step LIMIT 90), t AS (SELECT row_idx, 0 AS tier, d2 FROM n UNION ALL SELECT row_idx, 1, d2 FROM m)"""


def _detail(spark, d):
    return spatial.detail_tiers(_points(spark, d), 700.0, 0.0, (500.0, 1200.0), (200.0, 100.0), (40, 90), 100.0)


@query(f"WITH {DETAIL_SQL} SELECT row_idx AS id, tier::INT AS tier FROM t")
def detail_tiers(spark, d):
    return _detail(spark, d).select("id", "tier")


@query(f"WITH {DETAIL_SQL} SELECT row_idx AS id, row_number() OVER (ORDER BY d2 DESC, row_idx)::INT AS place FROM t WHERE tier = 0")
def near_back_to_front(spark, d):
    near = _detail(spark, d).where("tier = 0")  # 40 rows by the cap
    return near.select("id", F.row_number().over(Window.orderBy(F.desc("d2"), "id")).alias("place"))


@query(f"WITH {FIGURES}, a AS (SELECT row_idx, ((7 * row_idx + 1831565813::HUGEINT * 3) % 4294967296)::BIGINT AS a FROM figures), t AS (SELECT row_idx, (xor(a, a >> 15)::HUGEINT * (a | 1) % 4294967296)::BIGINT AS t FROM a), u AS (SELECT row_idx, xor((t + (xor(t, t >> 7)::HUGEINT * (t | 61) % 4294967296)::BIGINT) % 4294967296, t) AS t FROM t) SELECT row_idx, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 12) AS u FROM u")
def seeded_uniform(spark, d):
    return B.figures(spark, d).select("row_idx", _r(G.mulberry(F.col("row_idx") * 7, F.lit(3)), 12).alias("u"))


@query(f"WITH {FIGURES} SELECT qid, (floor(({SQL_ERA} / 10 + 0.5)) * 10)::INT AS decade, CASE WHEN death_year >= 2000 THEN 'the present' WHEN death_year < 0 THEN 'c.' || (-death_year) || ' BCE' ELSE 'c.' || death_year END AS era FROM figures")
def era_labels(spark, d):
    return B.figures(spark, d).select("qid", G.decade(G.era_radius(F.col("death_year"))).alias("decade"), T.era_label(F.col("death_year")).alias("era"))


@query(f"WITH {PLACED}, t AS (SELECT qid, atan2(x, y) - 1 AS t FROM placed) SELECT qid, round(0.5 - 0.5 * least(greatest(atan2(sin(t), cos(t)) / 1.2, -1), 1), 6) AS at FROM t")
def compass_bearing(spark, d):
    return positions(spark, d).select("qid", _r(G.bearing(F.col("x"), F.col("y"), F.lit(1.0), 1.2)).alias("at"))


@query(f"WITH {BEST}, m AS (SELECT label, avg(x) AS x, avg(y) AS y FROM names JOIN best ON name = title GROUP BY label) SELECT row_number() OVER (ORDER BY x * x + y * y)::INT AS place, label FROM m")
def ordered_by_radius(spark, d):
    m = anchors.summarize(_members(spark, d))
    return m.select(F.row_number().over(Window.orderBy(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("place"), "label")


@query(f"WITH {RASTER} SELECT i, j, round(lead(h) OVER (PARTITION BY i ORDER BY j) - h, 6) AS dj, round(lead(h) OVER (PARTITION BY j ORDER BY i) - h, 6) AS di FROM raster")
def neighbour_diff(spark, d):
    along = lambda a, b: _r(F.lead("h").over(Window.partitionBy(a).orderBy(b)) - F.col("h"))
    return _raster(spark, d).select("i", "j", along("i", "j").alias("dj"), along("j", "i").alias("di"))


@query(f"WITH {TIERED} SELECT landmark_tier, count(*) AS n, round(avg(radius), 4) AS radius, round(avg({SQL_SCALE}), 6) AS scale, sum((lon IS NOT NULL)::INT)::BIGINT AS located FROM t GROUP BY 1")
def placement_chain(spark, d):
    """The whole chain: radius, angle, tier and size, summed up by tier."""
    return placement.tiers(stored(positions(spark, d), "positions")).groupBy("landmark_tier").agg(F.count("*").alias("n"), _r(F.avg("radius"), 4).alias("radius"), _r(F.avg("book_scale")).alias("scale"), F.sum(F.col("lon").isNotNull().cast("int")).alias("located"))


def _sql_blurred(source: str, out: str, sigma: float) -> str:
    """CTEs that blur a raster of 64 x 64 along i, then j, its rims mirrored."""
    n = max(1, int(4 * sigma + 0.5))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    kernel = ", ".join(f"({k}, {w / sum(weights)!r}::DOUBLE)" for k, w in zip(range(-n, n + 1), weights))
    fold = lambda c: f"CASE WHEN ({c} + k + 128) % 128 < 64 THEN ({c} + k + 128) % 128 ELSE 127 - ({c} + k + 128) % 128 END"
    one = lambda name, of, a, b: f"{name} AS (SELECT c.i, c.j, sum(w * s.v) AS v FROM {of} c CROSS JOIN (VALUES {kernel}) t(k, w) JOIN {of} s ON s.{b} = c.{b} AND s.{a} = {fold('c.' + a)} GROUP BY c.i, c.j)"
    return f"{one(out + '_i', source, 'i', 'j')}, {one(out, out + '_i', 'j', 'i')}"


#: The same raster with i along y, as the height field has it.
FIELD = f"""{PLACED}, bins AS (SELECT least(floor((y + 9000) / 18000 * 64), 63)::INT AS i, least(floor((x + 9000) / 18000 * 64), 63)::INT AS j, count(*) AS n FROM placed WHERE abs(x) <= 9000 AND abs(y) <= 9000 GROUP BY 1, 2),
field AS (SELECT (k // 64)::INT AS i, (k % 64)::INT AS j, coalesce(n, 0)::DOUBLE AS v FROM range(4096) t(k) LEFT JOIN bins ON bins.i = k // 64 AND bins.j = k % 64)"""


@query(
    f"WITH {FIELD}, {_sql_blurred('field', 'smooth', 220 / 281.25)}, top AS (SELECT quantile_cont(v, 0.98) AS top FROM smooth), share AS (SELECT i, j, CASE WHEN top > 0 THEN least(greatest(v / top, 0), 1) ELSE 0 END AS v FROM smooth, top), "
    f"{_sql_blurred('share', 'again', 400 / 281.25)} SELECT i, j, round(v, 9) AS density FROM again"
)
def density_field(spark, d):
    """(i, j, density) of 64 x 64 cells: counts, two blurs tile by tile, an exact percentile between them."""
    return rasters.density(B.layout(spark, d), 64, tile=24).select("i", "j", _r(F.col("v"), 9).alias("density"))


@query()
def heightmap(spark, d):
    """(i, j, height) of 64 x 64 cells with the envelope of the placed points; noise is beyond SQL, the tests compare it with array kernels."""
    return rasters.heights(B.layout(spark, d), 64, tile=24).select("i", "j", "height")


def _sql_slide(passes: int = 18) -> str:
    most, out, before = math.tan(math.radians(33.0)) * 281.25, ["s0 AS MATERIALIZED (SELECT i, j, v * 100 AS v FROM field)"], "s0"
    for p in range(passes):
        for by, along in (("j", "i"), ("i", "j")):
            name, w = f"s{p + 1}{along}", f"(PARTITION BY {by} ORDER BY {along})"
            flow = lambda d: f"coalesce(sign({d}) * greatest(abs({d}) - {most!r}::DOUBLE, 0) * 0.25::DOUBLE, 0)"
            out.append(f"{name} AS MATERIALIZED (SELECT i, j, v + {flow('up')} - {flow('down')} AS v FROM (SELECT i, j, v, lead(v) OVER {w} - v AS up, v - lag(v) OVER {w} AS down FROM {before}))")
            before = name
    return ", ".join(out) + f" SELECT i, j, round(v, 5) AS height FROM {before}"


@query(f"WITH {FIELD}, {_sql_slide()}")
def avalanche(spark, d):
    """(i, j, height) of 64 x 64 cells after the sand slide: heaps as high as figures stand in each."""
    heaps = rasters.counted(B.layout(spark, d), 64).withColumn("v", F.col("v") * 100)
    return rasters.avalanche(heaps, 64, terrain.WORLD / 64, tile=24).select("i", "j", _r(F.col("v"), 5).alias("height"))
