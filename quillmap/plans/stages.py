"""The stages from dumps to placed figures, run on dumps that are written from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, articles, placement
from ..sources import dumps
from ..sources.storage import dropped, removed, shared_folder, stored
from . import bridge as B
from .atlas import PLACES, _places, _r, _values, query
from .bridge import FIGURES, SQL_ERA, SQL_UNCERTAINTY, sql_normal, sql_uniform

#: Ids of places in the dump: this and the supplier's number, beyond all ids of figures.
PLACE_ID = "Q9000000000"
#: Rows of a dump's file at the most; files are packed, so a task reads each whole.
ROWS = 16_384
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
REGIONS = {f"region {k}": f"C{k}" for k in range(25)}
GAZETTEER = {"min_pool": 30, "aliases": {"C26": "C1", "C25": "C2"}, "ignore": ["no region 3"], "regions": REGIONS}


def _claim(prop: str, *parts: Column | str, kind: str = "x") -> Column:
    value = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.concat(F.lit(f'"{prop}":[{{"rank":"normal","mainsnak":{{"snaktype":"value","datatype":"{kind}","datavalue":{{"value":{{'), value, F.lit("}}}}]"))


def _time(year: Column) -> Column:
    return F.concat(F.when(year < 0, "-").otherwise("+"), F.lpad(F.abs(year).cast("string"), 4, "0"), F.lit("-00-00T00:00:00Z"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    """Figures as the dump has them: own titles, first citizenships, places, descriptions that name regions."""
    k = F.col("row_idx")
    description = F.when(k % 13 != 0, F.concat(F.when(k % 5 == 0, "no region 3, ").otherwise("poet of "), F.lit("region "), (k % 29).cast("string")))
    return B.figures(spark, d).select(
        "row_idx", "qid", F.concat(F.replace("title", F.lit("#"), F.lit(" ")), F.lit(" "), k.cast("string")).alias("title"), "birth_year", "death_year", "words", F.concat(F.lit("C"), k % 40).alias("citizen"),
        F.concat(F.lit("P"), k % 150).alias("birth"), F.concat(F.lit("P"), k % 130).alias("death"), description.alias("description"),
    )


def _more(ident) -> tuple[Column, ...]:
    """Claims that only some figures have: a gender, an occupation, an image, one external id or two."""
    k = F.col("row_idx")
    outer = lambda prop: _claim(prop, '"id":"', k.cast("string"), '"', kind="external-id")
    return (F.when(k % 4 != 0, ident("P21", F.concat(F.lit("G"), k % 2))), F.when(k % 6 != 0, ident("P106", F.concat(F.lit("J"), k % 9))), F.when(k % 3 == 0, _claim("P18", '"file":"a.jpg"')), F.when(k % 2 == 0, outer("P214")), F.when(k % 8 == 0, outer("P227")))


def entity_dump(spark: SparkSession, d: str) -> str:
    """The folder of a JSON dump with an entity a line: a figure of each order, a place of each supplier."""
    f = _subjects(spark, d)
    ident = lambda p, c: _claim(p, '"id":"', c, '"')
    claims = F.concat_ws(",", ident("P31", F.lit("Q5")), F.when(F.col("birth_year").isNotNull(), _claim("P569", '"time":"', _time(F.col("birth_year")), '"')), _claim("P570", '"time":"', _time(F.col("death_year")), '"'), ident("P27", F.col("citizen")), ident("P19", F.col("birth")), ident("P20", F.col("death")), *_more(ident))
    text = F.concat(F.lit('{"en":{"value":"'), F.col("description"), F.lit('"}}'))
    figures = f.select(F.concat(F.lit('{"type":"item","id":"'), "qid", F.lit('","labels":{},"descriptions":'), F.coalesce(text, F.lit("{}")), F.lit(',"claims":{'), claims, F.lit('},"sitelinks":{"enwiki":{"title":"'), "title", F.lit('"}}},')).alias("value"))
    p = _places(spark, d)
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), _claim("P625", '"latitude":', F.col("lat").cast("string"), ',"longitude":', F.col("lon").cast("string")))
    claims = F.concat_ws(",", point, F.when(F.col("country_qid").isNotNull(), _claim("P17", '"id":"', F.col("country_qid"), '"')))
    places = p.select(F.concat(F.lit('{"type":"item","id":"' + PLACE_ID), F.substring("qid", 2, 20), F.lit('","labels":{"en":{"value":"'), "qid", F.lit('"}},"claims":{'), claims, F.lit('},"sitelinks":{}},')).alias("value"))
    brackets = _values(spark, [("[",), ("]",)], "value string")
    path = shared_folder(spark, "entities")
    brackets.union(figures).union(places).write.options(**PACKED, maxRecordsPerFile=ROWS).text(path)
    return path


def _read(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Figures and the places that they were born or died in, both stored; the dump goes once both are read."""
    path = entity_dump(spark, d)
    rows = stored(dumps.prefilter(dumps.figures(spark, path), 1900), "figures")
    ours = rows.withColumns({c: F.concat(F.lit(PLACE_ID), F.substring(c, 2, 20)) for c in ("birth_place_qid", "death_place_qid")})
    found = stored(dumps.places(spark, path, ours), "places")
    removed(spark, path)
    return rows, found.withColumn("qid", F.concat(F.lit("P"), F.substring("qid", len(PLACE_ID) + 1, 20)))


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures alone, stored."""
    path = entity_dump(spark, d)
    rows = stored(dumps.prefilter(dumps.figures(spark, path), 1900), "figures")
    removed(spark, path)
    return rows


SUBJECTS = f"""{FIGURES}, subjects AS (SELECT row_idx, qid, replace(title, '#', ' ') || ' ' || row_idx AS title, birth_year, death_year, words, 'C' || (row_idx % 40) AS citizen, 'P' || (row_idx % 150) AS birth, 'P' || (row_idx % 130) AS death,
  row_idx % 5 = 0 AS ignored, row_idx % 29 AS named FROM figures WHERE death_year < 1900 AND row_idx % 13 <> 0)"""


SQL_OUTER = "((row_idx % 2 = 0)::INT + (row_idx % 8 = 0)::INT)"


@query(
    f"WITH {SUBJECTS} SELECT qid, title, birth_year, death_year, CASE WHEN ignored THEN 'no region 3, ' ELSE 'poet of ' END || 'region ' || named AS description, citizen AS citizenships, 1::INT AS sitelink_count, "
    f"(5 + (birth_year IS NOT NULL)::INT + (row_idx % 4 <> 0)::INT + (row_idx % 6 <> 0)::INT + (row_idx % 3 = 0)::INT + {SQL_OUTER})::INT AS claim_count, {SQL_OUTER}::INT AS identifier_count, row_idx % 3 = 0 AS has_image, "
    "CASE WHEN row_idx % 4 <> 0 THEN 'G' || (row_idx % 2) END AS gender, birth AS birth_place_qid, death AS death_place_qid, CASE WHEN row_idx % 6 <> 0 THEN 'J' || (row_idx % 9) ELSE '' END AS occupations, 'Q5' AS instance_of_qids FROM subjects"
)
def dump_figures(spark, d):
    """Stages 1 and 2: the dump read, parsed and filtered; all fifteen columns, lists joined by commas."""
    rows = _figures(spark, d)
    return rows.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes))


@query(f"WITH {SUBJECTS}, {PLACES} SELECT qid, qid AS label, CASE WHEN lon IS NOT NULL THEN round(lat, 6) END AS lat, CASE WHEN lat IS NOT NULL THEN round(lon, 6) END AS lon, country_qid FROM places WHERE qid IN (SELECT birth FROM subjects UNION SELECT death FROM subjects)")
def dump_places(spark, d):
    """Stage 5: the places that figures were born or died in."""
    return _read(spark, d)[1].select("qid", "label", _r(F.col("lat")).alias("lat"), _r(F.col("lon")).alias("lon"), "country_qid")


LADDER = f"""{SUBJECTS}, {PLACES}, spots AS (SELECT qid, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END AS lon, country_qid FROM places),
known AS (SELECT s.*, coalesce(b.lon, e.lon) AS lon, CASE WHEN b.lon IS NOT NULL THEN 'birth' WHEN e.lon IS NOT NULL THEN 'death' END AS geo, coalesce(b.country_qid, e.country_qid) AS country FROM subjects s LEFT JOIN spots b ON s.birth = b.qid LEFT JOIN spots e ON s.death = e.qid),
pools AS (SELECT country FROM known WHERE lon IS NOT NULL AND country IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
asks AS (SELECT *, CASE citizen WHEN 'C26' THEN 'C1' WHEN 'C25' THEN 'C2' ELSE citizen END AS c, CASE WHEN named < 25 THEN 'C' || named END AS g FROM known),
rungs AS (SELECT a.qid, CASE WHEN lon IS NOT NULL THEN geo WHEN x.country IS NOT NULL THEN 'citizenship' WHEN y.country IS NOT NULL THEN 'gazetteer' END AS geo_source, CASE WHEN lon IS NOT NULL THEN a.country ELSE coalesce(x.country, y.country, a.country) END AS country_qid, lon, birth_year, death_year, row_idx, title
  FROM asks a LEFT JOIN pools x ON c = x.country LEFT JOIN pools y ON g = y.country),
lenders AS (SELECT country, lon AS lent, row_number() OVER (PARTITION BY country ORDER BY substr(md5(qid), 1, 2), qid) - 1 AS k, count(*) OVER (PARTITION BY country) AS n FROM known WHERE lon IS NOT NULL AND country IS NOT NULL),
located AS (SELECT r.*, coalesce(r.lon, p.lent) AS lon_at FROM rungs r LEFT JOIN lenders p ON r.lon IS NULL AND r.geo_source IN ('citizenship', 'gazetteer') AND p.country = r.country_qid AND p.k = floor({sql_uniform('r.qid', 'borrow')} * p.n))"""


@query(f"WITH {LADDER} SELECT qid, geo_source, country_qid, round(lon_at, 6) AS lon FROM located")
def dump_located(spark, d):
    """Stages 1, 2, 5 and the location ladder of stage 6."""
    rows, found = _read(spark, d)
    return placement.locate(rows, found, GAZETTEER).select("qid", "geo_source", "country_qid", _r(F.col("lon")).alias("lon"))


def article_dump(spark: SparkSession, d: str) -> str:
    """The folder of an XML dump: an article for six figures in seven, a redirect to every tenth."""
    f = _subjects(spark, d)
    k, title = F.col("row_idx"), F.col("title")
    link = F.concat(F.when(k % 10 == 0, "Old ").otherwise(""), title)
    parts = ("{{Short description|S ", k.cast("string"), "}}'''", title, "''' was (; born) a [[P|poet]].[[File:x.png|thumb]]<gallery>File:a.jpg|b c</gallery>\n== Life ==\n", F.repeat(F.lit("word "), (k % 300).cast("int")), "[[", link, "]] [[Help:y]]<ref>x</ref>\n== Work ==\nend.")
    body = T.escape_html(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    page = lambda t, inner: F.concat(F.lit("<page><title>"), t, F.lit("</title><ns>0</ns>"), inner, F.lit("</page>")).alias("value")
    content = f.where(k % 7 != 0).select(page(title, F.concat(F.lit("<revision><text>"), body, F.lit("</text></revision>"))))
    hops = f.where(k % 10 == 0).select(page(F.concat(F.lit("Old "), title), F.concat(F.lit('<redirect title="'), title, F.lit('"/><revision><text>#REDIRECT</text></revision>'))))
    path = shared_folder(spark, "wiki")

    most = ROWS

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = lambda *x: pa.RecordBatch.from_pydict({"value": x})
        yield tag("<mediawiki>")
        left = most
        for batch in batches:
            while batch.num_rows > left:
                yield batch.slice(0, left)
                yield tag("</mediawiki>", "<mediawiki>")  # where a file ends
                batch, left = batch.slice(left), most
            left -= batch.num_rows
            yield batch
        yield tag("</mediawiki>")

    content.union(hops).mapInArrow(framed, "value string").write.options(**PACKED, maxRecordsPerFile=most + 2).text(path)
    return path


def _with_articles(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    path, held = article_dump(spark, d), []
    found = dumps.with_articles(rows, dumps.pages(spark, path), held)
    removed(spark, path)
    out = stored(articles.quality_cut(found), "articles-cut")
    for table in (rows, *held):
        dropped(table)
    return out


READ = "(row_idx % 300 + CASE WHEN row_idx % 10 = 0 THEN 16 ELSE 15 END)"


@query(f"WITH {SUBJECTS}, a AS (SELECT *, {READ} AS n FROM subjects WHERE row_idx % 7 <> 0) SELECT qid, title || ' was (born) a poet.' AS lead_text, 7::INT AS lead_word_count, 1::INT AS lead_sentence_count, n::INT AS article_word_count, 1::INT AS article_section_count, 1::INT AS article_ref_count, 'S ' || row_idx AS short_description, qid AS first_link, 1::INT AS n_links FROM a WHERE n >= 100")
def dump_articles(spark, d):
    """Stages 1 to 4: figures with their articles, links resolved through redirects, stubs cut."""
    out = _with_articles(spark, d, _figures(spark, d))
    return out.select("qid", "lead_text", "lead_word_count", "lead_sentence_count", "article_word_count", "article_section_count", "article_ref_count", "short_description", F.get("outgoing_qids", F.lit(0)).alias("first_link"), F.size("outgoing_qids").alias("n_links"))


@query(
    f"WITH {LADDER.replace('row_idx % 13 <> 0)', 'row_idx % 13 <> 0 AND row_idx % 7 <> 0 AND ' + READ + ' >= 100)')}, r AS (SELECT geo_source, lon_at, {SQL_ERA} + 2.5 * {sql_normal('qid', 'radius')} + 350 * {sql_normal('qid', 'scatter')} * {SQL_UNCERTAINTY} AS r FROM located) "
    "SELECT coalesce(geo_source, 'none') AS geo_source, count(*) AS n, round(avg(CASE WHEN r < 600 THEN 1200 - r ELSE r END), 4) AS radius, round(avg(lon_at), 5) AS lon FROM r GROUP BY 1"
)
def dump_chain(spark, d):
    """Stages 1 to 6 in turn, summed up by the rung that located a figure; unlocated ones turn by blake2b."""
    rows, found = _read(spark, d)
    at = placement.locate(_with_articles(spark, d, rows), found, GAZETTEER)
    figures = at.withColumns({"row_idx": F.substring("qid", 2, 20).cast("long"), "sitelinks": F.col("sitelink_count"), "words": F.col("article_word_count")})
    placed = placement.tiers(placement.place(figures))
    return placed.groupBy(F.coalesce("geo_source", F.lit("none")).alias("geo_source")).agg(F.count("*").alias("n"), _r(F.avg("radius"), 4).alias("radius"), _r(F.avg("lon"), 5).alias("lon"))


BY_NAME = [("North", ["Customer#000000001", "Customer#000000002", "Nobody"]), ("South", ["Customer#000000004", "Customer#000000005", "Customer#000000007"])]


@query(
    f"WITH {B.PLACED}, {PLACES}, means AS (SELECT country_qid, avg(lon) AS mean FROM places WHERE country_qid IS NOT NULL AND lon IS NOT NULL GROUP BY 1), best AS (SELECT * FROM (SELECT *, 'C' || (row_idx % 30) AS cc, row_number() OVER (PARTITION BY title ORDER BY sitelinks DESC, row_idx) AS k FROM placed) WHERE k = 1), "
    "anchors(label, people) AS (VALUES " + ", ".join(f"('{a}', {p})" for a, p in BY_NAME) + "), names AS (SELECT label, unnest(people) AS name, unnest(range(len(people)))::INT AS pos FROM anchors), m AS (SELECT n.*, b.*, mean FROM names n JOIN best b ON name = title LEFT JOIN means ON cc = country_qid WHERE row_idx % 2 >= 0) "
    "SELECT label, round(avg(x), 4) AS x, round(avg(y), 4) AS y, arg_max(qid, sitelinks * 1000 - pos) AS seat_qid, arg_max(name, sitelinks * 1000 - pos) AS seat_title, string_agg(qid, ',' ORDER BY pos) AS members, count(*)::INT AS n_members, round_even(coalesce(max(mean) - min(mean), 0), 1) AS lon_spread FROM m GROUP BY label"
)
def monument_table(spark, d):
    """The monuments whole, with mean longitudes of their members' countries; the limit of spread is wide, as the countries here are made up."""
    f = B.positions(spark, d).select("title", "row_idx", "qid", "sitelinks", "x", "y", "death_year", F.lit("birth").alias("geo_source"), F.concat(F.lit("C"), F.col("row_idx") % 30).alias("country_qid"))
    out = anchors.monuments(_values(spark, BY_NAME, "label string, people array<string>"), f, _places(spark, d), spread=400.0)
    return out.select("label", _r(F.col("x"), 4).alias("x"), _r(F.col("y"), 4).alias("y"), "seat_qid", "seat_title", F.array_join("member_qids", ",").alias("members"), "n_members", "lon_spread")
