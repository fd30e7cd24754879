"""Joins by distance on a grid, and lookups in rasters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import far_hash, near_hash
from ..sources.storage import dropped, stored
from .quadtree import WIDE, Quadtree, near_pairs

#: How far an eye picks, and how far to the side.
POINT_REACH, MONUMENT_REACH = (6.0, 0.45), (16.0, 1.7)
#: Idents of a list of those on one spot, or zones of one disc.
SPOT = 256


def cell(x: Column, edge: float) -> Column:
    """Grid cell of a coordinate; never null, so that a join on cells pushes no test of the coordinate's whole expression below. Null points meet nothing: their distances are null."""
    return F.coalesce(F.floor(x / edge).cast("long"), F.lit(0).cast("long"))


def pairs_within(points: DataFrame, radius: float, ident: str = "id", strict: bool = False) -> DataFrame:
    """(a, xa, ya, b, xb, yb, d): unordered pairs at distance <= radius (< if strict), a < b, by an equi-join on the leaves of a quadtree, so that no key holds a crowded place."""
    d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    met = near_pairs(points, radius, ident).withColumn("d", d)
    return met.where(F.col("d") < radius if strict else F.col("d") <= radius)


def spot_pairs(points: DataFrame, radius: float, most: int, ident: str = "id", digits: int = 4) -> DataFrame:
    """(a, b, d): the pairs of `pairs_within`, d rounded, where many points share a spot: two spots are compared once, whatever stands on them.

    A spot's idents go in lists of SPOT about, so a task holds few of them. The lists go
    with their spots to the leaves and the tasks there pair them out, so no pair is shuffled.
    """
    here = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(ident).alias("id"), "x", "y")
    heavy = here.groupBy(F.col("x").alias("hx"), F.col("y").alias("hy")).agg(F.ceil(F.count("*") / SPOT).alias("parts")).where("parts > 1")
    rows = here.join(heavy, (F.col("x") == F.col("hx")) & (F.col("y") == F.col("hy")), "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    spots = stored(rows.groupBy("x", "y", part).agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")).select("id", "x", "y", "ids"), "spots")
    met = near_pairs(spots, radius, also=("ids",), tree=Quadtree.over(spots, WIDE * radius, most))
    far = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    near = met.where(far <= radius).select(F.round(far, digits).alias("d"), "idsa", "idsb")
    apart = near.select("d", "idsa", F.explode("idsb").alias("q")).select("d", "q", F.explode("idsa").alias("p"))
    same = spots.where(F.size("ids") > 1).select(F.lit(0.0).alias("d"), "ids", F.explode("ids").alias("q")).select("d", "q", F.explode("ids").alias("p")).where(F.col("p") < F.col("q"))
    return apart.select("p", "q", "d").union(same.select("p", "q", "d")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d")


def _zone_cells(zones: DataFrame) -> tuple[DataFrame, list[int]]:
    """zones with a row for each cell (zl, zcx, zcy) that a disc's square meets, and the levels zl in use.

    A disc goes to a grid whose edge, 2^level, is its radius or up to twice that, so it
    meets three cells a side at the most.
    """
    held = zones.where(F.col("zr") > 0).withColumn("zl", F.ceil(F.log2("zr")).cast("int"))
    levels = sorted(r["zl"] for r in held.select("zl").distinct().collect())  # of powers of two
    edge = F.pow(F.lit(2.0), F.col("zl"))
    span = lambda v: F.sequence(F.floor((F.col(v) - F.col("zr") * (1 + 1e-9)) / edge).cast("long"), F.floor((F.col(v) + F.col("zr") * (1 + 1e-9)) / edge).cast("long"))
    return held.withColumn("zcx", F.explode(span("zx"))).withColumn("zcy", F.explode(span("zy"))), levels


def zone_hits(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points(x, y, ...) and zones(zx, zy, zr, ...) side by side, with d, wherever a point lies strictly inside a disc; any number of either, by an equi-join on cells."""
    cells, levels = _zone_cells(zones)
    x, y = F.col("x"), F.col("y")
    asks = points.where(x.isNotNull() & y.isNotNull()).withColumn("pl", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("pl"))).cast("long")
    met = asks.withColumns({"pcx": at(x), "pcy": at(y)}).join(cells, (F.col("pl") == F.col("zl")) & (F.col("pcx") == F.col("zcx")) & (F.col("pcy") == F.col("zcy")))
    met = met.withColumn("d", F.hypot(x - F.col("zx"), y - F.col("zy"))).where(F.col("d") < F.col("zr"))
    return met.drop("pl", "pcx", "pcy", "zl", "zcx", "zcy")


def within_zones(points: DataFrame, zones: DataFrame, ident: str = "id", digits: int | None = None) -> DataFrame:
    """(id, zone, d): points strictly inside zones(zone, zx, zy, zr), any number of them; d rounded to `digits`.

    Zones of one disc are compared once: they go in lists of SPOT about, which are told
    out for each point inside, with a distance that is rounded but once.
    """
    disc = zones.select("zone", "zx", "zy", "zr")
    heavy = disc.groupBy(*(F.col(c).alias(f"h{c}") for c in ("zx", "zy", "zr"))).agg(F.ceil(F.count("*") / SPOT).alias("parts")).where("parts > 1")
    rows = disc.join(heavy, (F.col("zx") == F.col("hzx")) & (F.col("zy") == F.col("hzy")) & (F.col("zr") == F.col("hzr")), "left")
    part = F.pmod(F.xxhash64("zone"), F.coalesce("parts", F.lit(1)))
    discs = rows.groupBy("zx", "zy", "zr", part).agg(F.collect_list(F.struct("zone")).alias("zones")).select("zx", "zy", "zr", "zones")
    d = F.col("d") if digits is None else F.round("d", digits).alias("d")
    return zone_hits(points.select(ident, "x", "y"), discs).select(ident, d, "zones").select(ident, "d", F.inline("zones")).select(ident, "zone", "d")


def nearest_capped(points: DataFrame, x: float, y: float, radius: float, caps: tuple[int, ...], ident: str = "id") -> DataFrame:
    """Points within a radius, nearest first, dealt to tiers of `caps` rows; what overflows falls to the next tier."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    near = points.select(ident, d.alias("d")).where(F.col("d") <= radius)
    top = near.orderBy("d", ident).limit(sum(caps))
    place = F.row_number().over(Window.orderBy("d", ident))
    tier, at = F.lit(len(caps) - 1), 0
    edges = []
    for cap in caps:
        at += cap
        edges.append(at)
    for k in range(len(caps) - 2, -1, -1):
        tier = F.when(F.col("place") <= edges[k], k).otherwise(tier)
    return top.withColumn("place", place).withColumn("tier", tier.cast("int"))


def nearest_in_cylinder(points: DataFrame, eyes: DataFrame, reach: float, width: float, ident: str = "id") -> DataFrame:
    """For each eye(eye, ex, ey, dx, dy), dx dy of unit length, the nearest point ahead within reach and half width; ties to the smaller id."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asks = eyes.withColumn("o", F.explode(near)).withColumns({"cx": cell(F.col("ex"), reach) + F.col("o.i"), "cy": cell(F.col("ey"), reach) + F.col("o.j")})
    at = points.withColumns({"cx": cell(F.col("x"), reach), "cy": cell(F.col("y"), reach)})
    ux, uy = F.col("x") - F.col("ex"), F.col("y") - F.col("ey")
    ahead = ux * F.col("dx") + uy * F.col("dy")
    side = F.abs(ux * F.col("dy") - uy * F.col("dx"))
    hit = asks.join(at, ["cx", "cy"]).withColumns({"d2": ux * ux + uy * uy, "ahead": ahead, "side": side}).where((F.col("d2") <= reach * reach) & (F.col("ahead") > 0) & (F.col("side") <= width))
    return hit.groupBy("eye").agg(F.min(F.struct("d2", ident)).alias("m")).select("eye", F.col(f"m.{ident}").alias(ident), F.sqrt("m.d2").alias("d"))


def pick(points: DataFrame, monuments: DataFrame, eyes: DataFrame, ident: str = "id") -> DataFrame:
    """(eye, kind, id, d): what an eye looks at: the nearest of points (within 6, 0.45 to the side) and monuments (within 16, 1.7 to the side)."""
    found = [nearest_in_cylinder(rows, eyes, reach, side, ident).select("eye", F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"), "d") for kind, rows, reach, side in (("point", points, *POINT_REACH), ("monument", monuments, *MONUMENT_REACH))]
    best = found[0].union(found[1]).groupBy("eye").agg(F.min(F.struct("d", F.col("kind") == "monument", "kind", "id")).alias("m"))
    return best.select("eye", "m.kind", "m.id", "m.d")


def detail_tiers(points: DataFrame, x: float, y: float, radii: tuple[float, float] = (30.0, 100.0), spreads: tuple[float, float] = (12.0, 0.0), caps: tuple[int, int] = (6_000, 54_000), edge: float = 32.0, ident: str = "id", low: tuple[float, float] | None = None) -> DataFrame:
    """(id, tier, d2) of the points(id, x, y) drawn near (tier 0) or middling (tier 1) from an eye.

    A point is near within the first radius, middling within the second, both spread by
    a hash of its id. Places go by rings of grid cells around the eye, in a ring along
    its rows, then its sides, in a cell by id; what the near cap leaves out may be
    middling, and what the second cap leaves out is drawn by neither. Only rows within the
    largest radius are sorted, and no more than the caps come out. `low` is the least x
    and y of all points, where those given are only the near ones of an index.
    """
    far = radii[1] + spreads[1] / 2
    lo = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0")) if low is None else points.sparkSession.createDataFrame([low], "x0 double, y0 double")
    rows = points.select(F.col(ident).alias("id"), "x", "y").withColumn("d2", (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).where(F.col("d2") <= far * far)
    rows = rows.crossJoin(F.broadcast(lo))  # one row
    gx, gy = (F.floor((F.col(c) - F.col(f"{c}0")) / edge) - F.floor((F.lit(v) - F.col(f"{c}0")) / edge) for c, v in (("x", x), ("y", y)))
    rows = rows.withColumns({"gx": gx, "gy": gy}).withColumn("ring", F.greatest(F.abs("gx"), F.abs("gy")))
    rim = F.abs("gy") == F.col("ring")
    rows = rows.withColumns({"side": F.when(rim, 0).otherwise(1), "along": F.when(rim, F.col("gx")).otherwise(F.col("gy")), "end": F.when(rim, F.col("gy") > 0).otherwise(F.col("gx") > 0)})
    within = lambda radius, spread, h: F.col("d2") < F.pow(radius + (h - 0.5) * spread, F.lit(2.0))
    walk = ("ring", "side", "along", "end", "id")
    near = rows.where(within(radii[0], spreads[0], near_hash(F.col("id")))).orderBy(*walk).limit(caps[0])
    rest = rows.where(within(radii[1], spreads[1], far_hash(F.col("id")))).join(F.broadcast(near.select(F.col("id").alias("taken"))), F.col("id") == F.col("taken"), "left_anti")  # the near cap bounds it
    return near.select("id", F.lit(0).alias("tier"), "d2").union(rest.orderBy(*walk).limit(caps[1]).select("id", F.lit(1).alias("tier"), "d2"))


def detail_rings(points: DataFrame, eyes: DataFrame, radii: tuple[float, float] = (30.0, 100.0), spreads: tuple[float, float] = (12.0, 0.0), caps: tuple[int, int] = (6_000, 54_000), edge: float = 32.0, ident: str = "id") -> DataFrame:
    """(eye, id, tier, d2): what `detail_tiers` draws, for every eye of eyes(eye, ex, ey), whose names differ.

    A nearest-neighbour join that widens ring by ring, twice as many each time: eyes meet
    the points in the cells of their next rings by an equi-join, ranks go on from the
    rings before, and only eyes whose caps are not full ask for more. Each step is stored;
    an eye never meets a point beyond the ring that fills it.
    """
    far = radii[1] + spreads[1] / 2
    x0, y0 = points.agg(F.min("x"), F.min("y")).first()
    empty = points.sparkSession.createDataFrame([], points.select(F.col(ident).alias("id")).schema)
    if x0 is None or eyes.isEmpty():
        return eyes.select("eye").limit(0).crossJoin(empty).select("eye", "id", F.lit(0).alias("tier"), F.lit(0.0).alias("d2"))  # no rows
    at = lambda v, low: F.floor((v - low) / edge).cast("long")
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(ident).alias("id"), "x", "y", at(F.col("x"), x0).alias("cx"), at(F.col("y"), y0).alias("cy"))
    asking = eyes.select("eye", "ex", "ey", at(F.col("ex"), x0).alias("ecx"), at(F.col("ey"), y0).alias("ecy"), F.lit(0).cast("long").alias("nears"), F.lit(0).cast("long").alias("mids"))
    last, low, high, steps, before = math.ceil(far / edge), 0, 1, [], None
    while low <= last:
        high = min(high, last)
        around = F.sequence(F.lit(-high), F.lit(high))
        cells = asking.withColumn("gx", F.explode(around)).withColumn("gy", F.explode(around)).withColumn("ring", F.greatest(F.abs("gx"), F.abs("gy"))).where(F.col("ring") >= low)
        met = cells.withColumns({"mx": F.col("ecx") + F.col("gx"), "my": F.col("ecy") + F.col("gy")}).join(rows, (F.col("mx") == F.col("cx")) & (F.col("my") == F.col("cy")))
        met = met.withColumn("d2", (F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey"))).where(F.col("d2") <= far * far)
        rim = F.abs("gy") == F.col("ring")
        met = met.withColumns({"side": F.when(rim, 0).otherwise(1), "along": F.when(rim, F.col("gx")).otherwise(F.col("gy")), "end": F.when(rim, F.col("gy") > 0).otherwise(F.col("gx") > 0)})
        within = lambda radius, spread, h: F.col("d2") < F.pow(radius + (h - 0.5) * spread, F.lit(2.0))
        met = met.withColumns({"near": within(radii[0], spreads[0], near_hash(F.col("id"))), "mid": within(radii[1], spreads[1], far_hash(F.col("id")))}).where("near OR mid")
        walk = ("ring", "side", "along", "end", "id")
        rank = lambda *by: F.row_number().over(Window.partitionBy("eye", *by).orderBy(*walk))
        met = met.withColumn("taken", F.col("near") & (F.col("nears") + rank("near") <= caps[0])).where("taken OR mid")
        met = met.withColumn("drawn", F.col("taken") | (F.col("mids") + rank("taken") <= caps[1])).where("drawn")
        step = stored(met.select("eye", "id", F.when(F.col("taken"), 0).otherwise(1).alias("tier"), "d2"), "rings")
        steps.append(step)
        low, high = high + 1, 2 * high + 1
        if low <= last:
            count = step.groupBy(F.col("eye").alias("of")).agg(F.count_if(F.col("tier") == 0).alias("n0"), F.count_if(F.col("tier") == 1).alias("n1"))
            asking = asking.join(count, F.col("eye") == F.col("of"), "left").withColumns({"nears": F.col("nears") + F.coalesce("n0", F.lit(0)), "mids": F.col("mids") + F.coalesce("n1", F.lit(0))}).drop("of", "n0", "n1")
            beyond = (low - 1) * edge > radii[0] + spreads[0] / 2  # the next rings hold no near point
            asking = stored(asking.where((F.col("mids") < caps[1]) | (F.lit(not beyond) & (F.col("nears") < caps[0]))), "eyes")
            if before is not None:
                dropped(before)
            before = asking
            if asking.isEmpty():
                break
    out = steps[0]
    for step in steps[1:]:
        out = out.union(step)
    return out


def thinned(points: DataFrame, edge: float, least: int = 8, every: int = 6, ident: str = "id", block: int = 65_536) -> DataFrame:
    """points(ident, x, y) without most of the crowd: of a cell of `edge` with more than `least` points, one in `every` in the order of the ident, a unique whole number.

    Ranks go in two levels: how many points of the cell stand in blocks of `block` idents
    before a point's own, and its rank in that. So no task holds a crowded cell.
    """
    held = points.withColumns({"cx_": cell(F.col("x"), edge), "cy_": cell(F.col("y"), edge), "block_": F.floor(F.col(ident) / block)})
    sizes = held.groupBy("cx_", "cy_", "block_").agg(F.count("*").alias("m_"))
    whole = Window.partitionBy("cx_", "cy_")
    before = whole.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"n_": F.sum("m_").over(whole), "before_": F.coalesce(F.sum("m_").over(before), F.lit(0))})
    inside = Window.partitionBy("cx_", "cy_", "block_").orderBy(ident)
    place = F.col("before_") + F.row_number().over(inside) - 1
    kept = held.join(sizes, ["cx_", "cy_", "block_"]).withColumn("place_", place).where((F.col("n_") <= least) | (F.pmod("place_", F.lit(every)) == 0))
    return kept.select(*points.columns)


def chord_height(points: DataFrame, raster: DataFrame, ident: str = "id") -> DataFrame:
    """(id, h) at points(row, col) over raster(i, j, h): the plane of the half of a cell, parted along its rising diagonal, that holds the point."""
    i, j = F.floor("row").cast("int"), F.floor("col").cast("int")
    fr, fc = F.col("row") - i, F.col("col") - j
    low = fc <= fr
    corner = lambda di, dj, w: F.struct((i + di).alias("i"), (j + dj).alias("j"), w.alias("w"))
    four = F.array(corner(0, 0, F.when(low, 1 - fr).otherwise(1 - fc)), corner(1, 0, F.when(low, fr - fc).otherwise(0.0)), corner(0, 1, F.when(low, 0.0).otherwise(fc - fr)), corner(1, 1, F.when(low, fc).otherwise(fr)))
    asks = points.select(ident, F.explode(four).alias("k")).select(ident, "k.i", "k.j", "k.w").where("w <> 0")
    return asks.join(raster, ["i", "j"]).groupBy(ident).agg(F.sum(F.col("w") * F.col("h")).alias("h"))


def facet_height(points: DataFrame, triangles: DataFrame, raster: DataFrame, edge: float, ident: str = "id") -> DataFrame:
    """(id, h) of every point(x, y, row, col): on a triangle that holds it, its own cell's before a neighbour's, else on the flat chord of its cell; triangles have gi, gj, the cell they belong to."""
    on = triangle_height(points, triangles, edge, ident).withColumnRenamed("h", "drawn").withColumnRenamed(ident, "on")
    flat = chord_height(points, raster, ident).withColumnRenamed("h", "flat").withColumnRenamed(ident, "under")
    both = points.select(ident).join(on, F.col(ident) == F.col("on"), "left").join(flat, F.col(ident) == F.col("under"), "left")
    return both.select(ident, F.coalesce("drawn", "flat").alias("h"))


def bilinear(points: DataFrame, raster: DataFrame, res: int, ident: str = "id") -> DataFrame:
    """(id, h): raster(i, j, h) at points(row, col), clamped at the edges, from four cells by an equi-join."""
    r, c = F.least(F.greatest(F.col("row"), F.lit(0.0)), F.lit(res - 1.0)), F.least(F.greatest(F.col("col"), F.lit(0.0)), F.lit(res - 1.0))
    i0, j0 = F.least(F.floor(r), F.lit(res - 2)), F.least(F.floor(c), F.lit(res - 2))
    fr, fc = r - i0, c - j0
    corner = lambda di, dj, w: F.struct((i0 + di).cast("int").alias("i"), (j0 + dj).cast("int").alias("j"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))
    asks = points.select(ident, F.explode(four).alias("k")).select(ident, "k.i", "k.j", "k.w")
    return asks.join(raster, ["i", "j"]).groupBy(ident).agg(F.sum(F.col("w") * F.col("h")).alias("h"))


def triangle_height(points: DataFrame, triangles: DataFrame, edge: float, ident: str = "id") -> DataFrame:
    """(id, h) of points over triangles(x1, y1, h1, ... h3), one row a point: barycentric, by a join on cells of `edge`; with gi, gj, triangles of the point's own cell come first, and the higher of equal claims."""
    lo = lambda k: F.least(*(F.col(f"{k}{v}") for v in (1, 2, 3)))
    hi = lambda k: F.greatest(*(F.col(f"{k}{v}") for v in (1, 2, 3)))
    span = lambda k: F.sequence(cell(lo(k), edge), cell(hi(k), edge))
    tri = triangles.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    at = points.withColumns({"cx": cell(F.col("x"), edge), "cy": cell(F.col("y"), edge)})
    det = "((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3))"
    met = at.join(tri, ["cx", "cy"]).where(f"{det} <> 0")
    met = met.withColumns({"w1": F.expr(f"((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / {det}"), "w2": F.expr(f"((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / {det}")})
    height = F.expr("w1 * h1 + w2 * h2 + (1 - w1 - w2) * h3")
    own = (F.col("gi") == F.col("cx")) & (F.col("gj") == F.col("cy")) if "gi" in triangles.columns else F.lit(True)
    return met.where("w1 >= -1e-9 and w2 >= -1e-9 and w1 + w2 <= 1 + 1e-9").groupBy(ident).agg(F.max_by(height, F.struct(own, height)).alias("h"))
