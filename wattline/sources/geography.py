"""Reference points and areas: node lists, point-in-polygon joins, county to zone assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.session import cut_lineage

# fixed values: published column -> curated column
GENERATOR_COLUMNS = {"Generator PTID": "ptid", "Generator Name": "name", "Zone": "zone", "Subzone": "subzone",
                     "Latitude": "lat", "Longitude": "lon", "Active": "active", "Aggregation PTID": "aggregation_ptid"}
LOAD_COLUMNS = {"PTID": "ptid", "Load Name": "name", "Zone": "zone", "Subzone": "subzone"}


def generators(raw: DataFrame) -> DataFrame:
    df = raw.select(*[F.trim(F.col(f"`{s}`")).alias(d) for s, d in GENERATOR_COLUMNS.items()])
    return df.withColumns({"ptid": F.col("ptid").try_cast("bigint"), "lat": F.col("lat").try_cast("double"),
                           "lon": F.col("lon").try_cast("double"), "active": F.coalesce(F.upper("active") == "Y", F.lit(False)),
                           "aggregation_ptid": F.col("aggregation_ptid").try_cast("double").try_cast("bigint")})


def loads(raw: DataFrame) -> DataFrame:
    df = raw.select(*[F.trim(F.col(f"`{s}`")).alias(d) for s, d in LOAD_COLUMNS.items()])
    return df.withColumn("ptid", F.col("ptid").try_cast("bigint"))


def flag_priced(nodes: DataFrame, prices: DataFrame) -> DataFrame:
    """has_prices: the point occurs in the price table (distinct ids first, so the fact side shrinks before the join)."""
    priced = prices.select("ptid").filter(F.col("ptid").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return nodes.join(priced, "ptid", "left").withColumn("has_prices", F.coalesce("_hit", F.lit(False))).drop("_hit")


def reference_report(nodes: DataFrame, prices: DataFrame) -> DataFrame:
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    left = nodes.agg(F.count(F.lit(1)).alias("generators"), F.count_if(located).alias("with_coords"),
                     F.count_if(located & F.col("has_prices")).alias("priced_with_coords"))
    ids = prices.select("ptid").filter(F.col("ptid").isNotNull()).distinct()
    unknown = ids.join(nodes.select("ptid"), "ptid", "left_anti").agg(F.count(F.lit(1)).alias("priced_missing"))
    return left.join(ids.agg(F.count(F.lit(1)).alias("priced_nodes"))).join(unknown)


def _crosses(px: Column, py: Column, e: str) -> Column:
    """Does the ray from (px, py) to the right cross edge `e` (struct x1, y1, x2, y2)?"""
    x1, y1, x2, y2 = (F.col(f"{e}.{c}") for c in ("x1", "y1", "x2", "y2"))
    straddles = (y1 > py) != (y2 > py)
    return straddles & (px < x1 + (x2 - x1) * F.try_divide(py - y1, y2 - y1))


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: list[str], area: str, x: str = "lon", y: str = "lat",
                       cell: float = 0.25) -> DataFrame:
    """(point id, area) for points inside an area given as polygon edges (area, x1, y1, x2, y2; holes and multiparts allowed).

    Each edge is filed under the horizontal bands of `cell` degrees it crosses, each point under its own band, so the
    join is an equi-join on the band and a point only meets edges at its latitude.  The edges, a map of fixed size, are sent to
    the points, so a band that holds many points is not one task's.  Inside = odd number of crossings.
    """
    band = lambda v: F.floor(v / F.lit(cell)).cast("long")                        # noqa: E731
    lines = edges.select(F.col(area), F.struct("x1", "y1", "x2", "y2").alias("_e"),
                         F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("_band"))
    spread = points.withColumn("_band", band(F.col(y)))
    hits = spread.join(F.broadcast(lines), "_band").filter(_crosses(F.col(x), F.col(y), "_e"))
    return hits.groupBy(*point_id, area).agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").drop("_n")


def nearest_zone(points: DataFrame, nodes: DataFrame, cell: float = 1.0) -> DataFrame:
    """(county, _nearest): zone of the nearest of all nodes to each point (county, cx, cy), ties to the first zone.

    Nodes are filed in cells, on grids that double their width from round to round.  A round compares a point with the nodes of its own and the eight cells
    around it; a node beyond those is at least one cell width away, so a best distance of no more than that is final.  Other points go
    on to the next, coarser grid, until one round holds them all.  The few rounds grow with the logarithm of the extent.
    """
    sited = nodes.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("zone", "lon", "lat").distinct()
    asked = points.where(F.col("cx").isNotNull() & F.col("cy").isNotNull()).select("county", "cx", "cy")
    box = sited.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).unionByName(asked.agg(F.min("cx").alias("min(lon)"), F.max("cx").alias("max(lon)"), F.min("cy").alias("min(lat)"), F.max("cy").alias("max(lat)"))).collect()
    corners = [v for r in box for v in r if v is not None]
    extent = max(corners) - min(corners) if corners else 0.0
    width, done = cell, None
    while True:
        at = lambda v, w=width: F.floor(v / F.lit(w)).cast("long")                 # noqa: E731
        filed = sited.withColumns({"i": at(F.col("lon")), "k": at(F.col("lat"))})
        around = asked.withColumn("di", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dk", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        met = around.withColumns({"i": at(F.col("cx")) + F.col("di"), "k": at(F.col("cy")) + F.col("dk")}).join(filed, ["i", "k"])
        dist = F.hypot(F.col("lon") - F.col("cx"), F.col("lat") - F.col("cy"))
        best = met.groupBy("county", "cx", "cy").agg(F.min(F.struct(dist.alias("d"), F.col("zone"))).alias("b"))
        last = width > extent
        sure = best if last else best.where(F.col("b.d") <= width)
        found = cut_lineage(sure.select("county", F.col("b.zone").alias("_nearest")))
        done = found if done is None else done.unionByName(found)
        asked = cut_lineage(asked.join(found.select("county"), "county", "left_anti"))
        if last or asked.isEmpty():
            return done
        width *= 2


def county_zones(counties: DataFrame, votes: DataFrame, nodes: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """County -> zone: an override, else the zone with most nodes inside it, else the zone of the nearest node.

    `counties`: county, cx, cy (a representative point).  `votes`: county, zone, one row per node inside.  `nodes`: zone,
    lon, lat.  Ties go to the alphabetically first zone.
    """
    counted = votes.groupBy("county", "zone").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy("county").agg(F.min_by("zone", F.struct(-F.col("_n"), F.col("zone"))).alias("_voted"))
    lone = counties.join(best.select("county"), "county", "left_anti")
    closest = nearest_zone(lone, nodes)
    out = counties.select("county").join(best, "county", "left").join(closest, "county", "left")
    forced = F.create_map(*[F.lit(v) for kv in (overrides or {"": ""}).items() for v in kv])[F.col("county")]
    return out.select("county", F.coalesce(forced, "_voted", "_nearest").alias("zone"))


def cells_in_zones(grid: DataFrame, edges: DataFrame) -> DataFrame:
    """Grid cells (iy, ix, lon, lat) -> (zone, iy, ix) of the zone polygon that holds their centre."""
    return points_in_polygons(grid, edges, ["iy", "ix"], "zone").select("zone", "iy", "ix")

