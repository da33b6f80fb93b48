"""The clipped quadtree against plain ray casting."""

import math
import random

from pyspark.sql import functions as F

from mediafold.operators import timezones as TZ

POLYGON = "zone string, priority int, polygon array<struct<lat:double,lng:double>>"


def star(rng, lat, lng, r, n):
    """A jagged ring of ``n`` vertices."""
    def out(i):
        d = r * (0.6 + 0.4 * rng.random())
        return lat + d * math.sin(2 * math.pi * i / n), lng + d * math.cos(2 * math.pi * i / n)
    return [out(i) for i in range(n)]


def inside(la, ln, polygon):
    odd = False
    for (yi, xi), (yj, xj) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        if (yi > la) != (yj > la) and ln < (xj - xi) * (la - yi) / (yj - yi) + xi:
            odd = not odd
    return odd


def first_zone(la, ln, regions):
    if not la or not ln:
        return None
    return next((z for z, _, p in sorted(regions, key=lambda r: r[1]) if inside(la, ln, p)), None)


def test_cover_matches_ray_casting(spark):
    rng = random.Random(3)
    regions = [("A", 1, star(rng, 10, 20, 12, 10_000)), ("B", 2, star(rng, -5, 30, 9, 3000)),
               ("D", 0, [(0.0, 0.0), (0.0, 16.0), (8.0, 16.0), (8.0, 0.0)]), ("line", 9, [(1.0, 1.0), (2.0, 2.0)]),
               ("bow", 3, [(20.0, 40.0), (30.0, 50.0), (20.0, 50.0), (30.0, 40.0)])]
    points = [(rng.uniform(-15, 32), rng.uniform(5, 52)) for _ in range(700)]
    points += [(8.0, 3.0), (0.0, 1.0), (1.0, 16.0), (1.0, 8.0), (None, 1.0), (1e-12, 8.0), (7.999999999999999, 15.999999999999998)]
    made = spark.createDataFrame([(z, p, [{"lat": a, "lng": b} for a, b in ring]) for z, p, ring in regions], POLYGON)
    made = made.unionByName(spark.createDataFrame([("none", -1, None)], POLYGON))
    cover = TZ.zone_cover(made, cell_vertices=400)
    sizes = cover.leaves.select(F.aggregate("regions", F.lit(0), lambda n, r: n + F.coalesce(F.size(r["polygon"]), F.lit(0))))
    assert cover.depth >= 2 and max(r[0] for r in sizes.collect()) <= 400       # no row above the bound
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(points)], "id long, lat double, lng double")
    got = {r.id: r.zone for r in TZ.zone_lookup(df, made, cell_vertices=400).collect()}
    assert got == {i: first_zone(a, b, regions) for i, (a, b) in enumerate(points)}
    assert len(set(got.values())) >= 5


def test_cover_of_few_or_no_regions(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 50.0, 4.0)], "id long, lat double, lng double")
    none = spark.createDataFrame([], POLYGON)
    assert {r.zone for r in TZ.zone_lookup(df, none).collect()} == {None}
    box = spark.range(1).select(F.lit("box").alias("zone"), F.lit(1).alias("priority"),
                                TZ.box_polygon(F.lit(-40), F.lit(40), F.lit(-60), F.lit(60)).alias("polygon"))
    cover = TZ.zone_cover(box)
    assert cover.splits is None
    # 10 x 14 cells are filled; the box ends inside those from -64 to -56 and from 56 to 64 degrees of longitude
    rows = cover.leaves.select(F.element_at("regions", 1)["polygon"].isNull().alias("filled")).groupBy("filled").count()
    assert {r.filled: r["count"] for r in rows.collect()} == {True: 140, False: 20}
    assert {r.id: r.zone for r in TZ.zone_lookup(df, box).collect()} == {1: "box", 2: None}
