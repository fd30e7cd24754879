"""Nested statements of JSON entities: ranked, filtered and read without a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAK = "struct<snaktype:string,datatype:string,datavalue:struct<value:string>>"
#: datavalue.value is declared a string: objects keep their JSON text.
ENTITY = (
    "type string, id string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, "
    f"claims map<string,array<struct<rank:string,mainsnak:{SNAK}>>>, sitelinks map<string,struct<title:string>>"
)
#: Properties that rows read; no others are ranked.
READ = ("P18", "P19", "P20", "P21", "P27", "P31", "P106", "P131", "P17", "P569", "P570", "P625")


def ranked(claims: Column) -> Column:
    """Property that rows read -> its statements that aren't deprecated and have a value, preferred ones first, each rank in input order."""
    valued = lambda s: s["mainsnak"]["snaktype"] == "value"
    rank = lambda s: F.coalesce(s["rank"], F.lit("normal"))
    first = lambda a: F.filter(a, lambda s: (rank(s) == "preferred") & valued(s))
    rest = lambda a: F.filter(a, lambda s: ~rank(s).isin("preferred", "deprecated") & valued(s))
    return F.transform_values(F.map_filter(claims, lambda p, _: p.isin(*READ)), lambda _, a: F.concat(first(a), rest(a)))


def usable(statements: Column, prop: str) -> Column:
    """A property's ranked statements; none give an empty list."""
    return F.coalesce(F.try_element_at(statements, F.lit(prop)), F.array())


def value_of(statement: Column) -> Column:
    return statement["mainsnak"]["datavalue"]["value"]


def ids(statements: Column, prop: str) -> Column:
    """Entity ids of a property, missing and empty ones left out."""
    return F.filter(F.transform(usable(statements, prop), lambda s: F.get_json_object(value_of(s), "$.id")), lambda x: x.isNotNull() & (x != ""))


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def first_year(statements: Column, prop: str) -> Column:
    from .text import parse_year

    return first(F.filter(F.transform(usable(statements, prop), lambda s: parse_year(F.get_json_object(value_of(s), "$.time"))), lambda y: y.isNotNull()))


def first_coordinate(statements: Column, prop: str = "P625") -> Column:
    """struct<lat, lon> of the first statement with both."""
    points = F.transform(usable(statements, prop), lambda s: F.struct(F.get_json_object(value_of(s), "$.latitude").try_cast("double").alias("lat"), F.get_json_object(value_of(s), "$.longitude").try_cast("double").alias("lon")))
    return first(F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))


def statement_count(claims: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(claims), F.lit(0), lambda n, a: n + F.size(a)), F.lit(0))


def external_count(claims: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(claims), F.lit(0), lambda n, a: n + F.size(F.filter(a, lambda s: s["mainsnak"]["datatype"] == "external-id"))), F.lit(0))


def figure_row(entity: Column, c: Column) -> dict[str, Column]:
    """The fifteen columns of a figure; c: its ranked statements, a column of their own."""
    return {
        "qid": entity["id"], "title": F.try_element_at(entity["sitelinks"], F.lit("enwiki"))["title"], "description": F.try_element_at(entity["descriptions"], F.lit("en"))["value"],
        "birth_year": first_year(c, "P569"), "death_year": first_year(c, "P570"), "sitelink_count": F.coalesce(F.size(entity["sitelinks"]), F.lit(0)), "claim_count": statement_count(entity["claims"]),
        "identifier_count": external_count(entity["claims"]), "has_image": F.size(usable(c, "P18")) > 0, "gender": first(ids(c, "P21")), "citizenships": ids(c, "P27"), "birth_place_qid": first(ids(c, "P19")),
        "death_place_qid": first(ids(c, "P20")), "occupations": ids(c, "P106"), "instance_of_qids": ids(c, "P31"),
    }


def is_figure(entity: Column, c: Column) -> Column:
    """A human with a death year and an article."""
    return F.array_contains(ids(c, "P31"), "Q5") & first_year(c, "P570").isNotNull() & F.try_element_at(entity["sitelinks"], F.lit("enwiki")).isNotNull()


def place_row(entity: Column, c: Column) -> dict[str, Column]:
    point = first_coordinate(c)
    return {"qid": entity["id"], "label": F.try_element_at(entity["labels"], F.lit("en"))["value"], "lat": point["lat"], "lon": point["lon"], "instance_of_qids": ids(c, "P31"), "admin_parent_qid": first(ids(c, "P131")), "country_qid": first(ids(c, "P17"))}
