"""Time zones and taken-time resolution (J10: D7, H27, H4, H5).

Zone lookup (D7) finds the region a point lies in among user-supplied regions ``(zone, priority, polygon)`` with
``polygon`` an ``array<struct<lat,lng>>`` of any length.  :func:`zone_cover` lays a quadtree over them: polygons are clipped
to the cells of a grid of ``CELL_DEGREES``, a cell that a region fills carries its zone without a polygon, and a cell with
more than ``CELL_VERTICES`` vertices is split (two levels at a time) and clipped again, so the row of a cell is bounded
however long the borders are.  A point finds its leaf from the split cells of its grid cell and left-joins that one row; it takes the first
candidate (by priority) that fills the cell or contains it, by ray casting over the clipped border, inside the
projection.  Points are never shuffled when the cover is broadcast, which happens only if its measured bytes stay under
``BROADCAST_BYTES``; a larger cover is joined by shuffle.

All cell borders are powers of two, so which cell a point is in is exact.  Clipping rounds a cut on a sloped border to a double: a
point within 1e-12 degrees of such a border may fall on its other side.  ``MAX_DEPTH`` splits are made at most (14 m); more
vertices than ``CELL_VERTICES`` in so small a place stay in one row.

Edge cases: a region whose polygon, or a point whose position, is NULL matches nothing; polygons of fewer than three vertices are
empty; without regions every zone is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.functions import dates as D
from mediafold.session import checkpoint_dir

CELL_DEGREES = 8.0  # a power of two: cell borders and numbers are exact
CELL_VERTICES = 256
SPLIT = 4  # a split cell becomes SPLIT x SPLIT cells (two levels of a quadtree at a time)
MAX_DEPTH = 8
BROADCAST_BYTES = 64 << 20
POLYGON = "array<struct<lat:double,lng:double>>"
# Bytes of a vertex, and of a candidate and a leaf without their vertices, in memory.
VERTEX_BYTES, ROW_BYTES = 40, 96
LOCAL_UTC_MIMES = ["video/mp4", "video/quicktime"]
MAX_LOCAL_SKEW_SECONDS = 27 * 3600


def box_polygon(lat_min: Column, lat_max: Column, lng_min: Column, lng_max: Column) -> Column:
    """A rectangle as a polygon (counter-clockwise)."""
    def pt(la, ln):
        return F.struct(la.cast("double").alias("lat"), ln.cast("double").alias("lng"))
    return F.array(pt(lat_min, lng_min), pt(lat_min, lng_max), pt(lat_max, lng_max), pt(lat_max, lng_min))


def point_in_polygon(lat: Column, lng: Column, polygon: Column) -> Column:
    """Ray casting (even-odd rule); half-open on axis-aligned boxes: [min, max)."""
    n = F.size(polygon)

    def crosses(i):
        a = F.element_at(polygon, i + 1)
        b = F.element_at(polygon, F.when(i == 0, n).otherwise(i))
        yi, xi, yj, xj = a["lat"], a["lng"], b["lat"], b["lng"]
        return ((yi > lat) != (yj > lat)) & (lng < (xj - xi) * (lat - yi) / (yj - yi) + xi)
    hits = F.filter(F.sequence(F.lit(0), n - 1), crosses)
    return (F.size(hits) % 2) == 1


def _clip_half(polygon: Column, axis: str, at: Column, keep_above: bool) -> Column:
    """A polygon cut at ``axis = at``: its part above (or below) the line, along which cuts are joined."""
    other = "lng" if axis == "lat" else "lat"
    n = F.size(polygon)

    def inside(p):
        return p[axis] >= at if keep_above else p[axis] <= at

    def cut(p, q):
        where = p[other] + (q[other] - p[other]) * ((at - p[axis]) / (q[axis] - p[axis]))
        return F.struct(*[(at if c == axis else where).alias(c) for c in ("lat", "lng")])

    def corners(i):
        p, q = F.element_at(polygon, F.when(i == 0, n).otherwise(i)), F.element_at(polygon, i + 1)
        none = F.array().cast(POLYGON)
        return (F.when(inside(q) & inside(p), F.array(q)).when(inside(q), F.array(cut(p, q), q))
                .when(inside(p), F.array(cut(p, q))).otherwise(none))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), corners))).otherwise(polygon)


def _fenced(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and the columns made, which leave through a Generate: no filter on them is pushed into their making."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _settled(rows: DataFrame, size: float) -> DataFrame:
    """``zone, priority, polygon, cy, cx`` of clipped polygons: a region that fills its cell has none, an empty one goes."""
    keep = ["zone", "priority", "cy", "cx"]
    r = _fenced(rows, keep, polygon=F.col("polygon")).where(F.size("polygon") > 2)
    y0, x0 = F.col("cy") * F.lit(size), F.col("cx") * F.lit(size)
    n = F.size("polygon")

    def inner(i):  # an edge that does not run along one side of the cell
        p = F.element_at("polygon", F.when(i == 0, n).otherwise(i))
        q = F.element_at("polygon", i + 1)
        along = [(p[a] == at) & (q[a] == at) for a, lo in (("lat", y0), ("lng", x0)) for at in (lo, lo + F.lit(size))]
        return ~(along[0] | along[1] | along[2] | along[3])
    border = F.exists(F.sequence(F.lit(0), n - 1), inner)
    center = point_in_polygon(y0 + F.lit(size / 2), x0 + F.lit(size / 2), F.col("polygon"))
    r = r.withColumn("_border", border)
    r = _fenced(r, [*keep, "polygon"], border=F.col("_border"), filled=F.when(~F.col("_border"), center))
    return r.where(F.col("border") | F.col("filled")).select(
        "zone", "priority", F.when(F.col("border"), F.col("polygon")).alias("polygon"), "cy", "cx")


def _base_cells(regions: DataFrame) -> DataFrame:
    """Regions clipped to the cells of the grid: cut into bands of latitude first, these along longitude."""
    r = regions.select("zone", "priority", F.col("polygon").cast(POLYGON).alias("polygon")).where(F.size("polygon") > 2)
    for axis, cell in (("lat", "cy"), ("lng", "cx")):
        ends = [F.floor(end(F.col(f"polygon.{axis}")) / CELL_DEGREES).cast("int") for end in (F.array_min, F.array_max)]
        r = _fenced(r, r.columns, low=ends[0], high=ends[1])
        r = r.where("low is not null").withColumn(cell, F.explode(F.sequence("low", "high"))).drop("low", "high")
        for above in (True, False):  # a projection each: lambdas do not share what they compute
            at = (F.col(cell) + (0 if above else 1)) * F.lit(CELL_DEGREES)
            r = r.withColumn("polygon", _clip_half(F.col("polygon"), axis, at, above))
    return _settled(r, CELL_DEGREES)


def _parts(cells: DataFrame, size: float) -> DataFrame:
    """Each cell's regions clipped to its ``SPLIT`` x ``SPLIT`` parts, whose sides are ``size``."""
    y, x, side = F.col("cy") * F.lit(SPLIT * size), F.col("cx") * F.lit(SPLIT * size), SPLIT * size
    whole = F.array(*[F.struct(la.alias("lat"), ln.alias("lng"))
                      for la, ln in ((y, x), (y, x + side), (y + side, x + side), (y + side, x))])
    r = cells.withColumn("polygon", F.coalesce("polygon", whole))
    for axis, cell in (("lat", "cy"), ("lng", "cx")):
        r = r.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        r = r.withColumn(cell, F.col(cell) * SPLIT + F.col("_part")).drop("_part")
        for above in (True, False):
            at = (F.col(cell) + (0 if above else 1)) * F.lit(size)
            r = r.withColumn("polygon", _clip_half(F.col("polygon"), axis, at, above))
    return _settled(r, size)


def _cells_of(cells: DataFrame) -> DataFrame:
    """Vertices and bytes of each cell."""
    return cells.groupBy("cy", "cx").agg(F.sum(F.coalesce(F.size("polygon"), F.lit(0))).alias("n"), F.count("*").alias("k")).select(
        "cy", "cx", "n", (F.col("n") * VERTEX_BYTES + (F.col("k") + 1) * ROW_BYTES).alias("bytes"))


def _leaf_rows(cells: DataFrame, depth: int) -> DataFrame:
    """One row per cell: ``depth, cy, cx, regions`` with the candidates in priority order."""
    return cells.groupBy(F.lit(depth).alias("depth"), "cy", "cx").agg(
        F.array_sort(F.collect_list(F.struct("priority", "zone", "polygon"))).alias("regions"))


@dataclass
class Cover:
    """Quadtree over regions.

    ``leaves``: ``depth, cy, cx, regions``; a cell of depth ``d`` has sides of ``CELL_DEGREES / SPLIT**d``.  ``splits`` (None if
    no cell is split): ``by, bx, splits``, for a cell of the grid all split cells in it as an array of ``depth, cy, cx``.
    """

    leaves: DataFrame
    splits: DataFrame | None
    depth: int
    bytes: int


def zone_cover(regions: DataFrame, cell_vertices: int = CELL_VERTICES) -> Cover:
    """The quadtree over ``regions``: cells of more than ``cell_vertices`` vertices are split, level by level."""
    spark = regions.sparkSession
    cells, leaves, splits, depth, size = _base_cells(regions), [], [], 0, 0
    while True:
        counted = _cells_of(cells)
        dense = (F.col("n") > cell_vertices) & F.lit(depth < MAX_DEPTH)
        n_dense, kept = counted.agg(F.count_if(dense), F.coalesce(F.sum(F.when(~dense, F.col("bytes"))), F.lit(0))).first()
        size += kept
        if not n_dense:
            break
        checkpoint_dir(spark)
        if depth == 0:  # from here on a level reads what the last one wrote, in many small parts
            cells = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).checkpoint()
        split = _cells_of(cells).where(dense).select("cy", "cx")
        leaves.append(_leaf_rows(cells.join(split, ["cy", "cx"], "left_anti"), depth))
        splits.append(split.withColumn("depth", F.lit(depth)))
        depth += 1
        cells = _parts(cells.join(split, ["cy", "cx"]), CELL_DEGREES / SPLIT ** depth).checkpoint()
    leaves.append(_leaf_rows(cells, depth))
    if not splits:
        return Cover(leaves[0], None, 0, size)
    steps = F.pow(F.lit(float(SPLIT)), F.col("depth"))
    grid = [F.floor(F.col(c) / steps).cast("int").alias(b) for c, b in (("cy", "by"), ("cx", "bx"))]
    inner = reduce(DataFrame.unionByName, splits).groupBy(*grid).agg(
        F.collect_set(F.struct("depth", "cy", "cx")).alias("splits"))
    return Cover(reduce(DataFrame.unionByName, leaves).checkpoint(), inner.checkpoint(), depth, size)


def zone_lookup(points: DataFrame, regions: DataFrame, lat: str = "lat", lng: str = "lng",
                cell_vertices: int = CELL_VERTICES) -> DataFrame:
    """``points`` plus ``zone`` (NULL without a position or a region); a projection when the cover is small.

    Zero latitude or longitude means no position.  Several matching regions:
    the lowest ``priority`` wins (the reference used the first zone returned).
    """
    cover = zone_cover(regions, cell_vertices)
    leaves, splits = cover.leaves, cover.splits
    if cover.bytes <= BROADCAST_BYTES:  # split cells are fewer than leaves
        leaves = F.broadcast(leaves)
        splits = F.broadcast(splits) if splits is not None else None
    la, ln = F.col(lat).cast("double"), F.col(lng).cast("double")
    known = F.coalesce((la != 0) & (ln != 0), F.lit(False))
    p = points.select("*", F.when(known, la).alias("_lat"), F.when(known, ln).alias("_lng"))

    def cell(d):
        size = F.lit(CELL_DEGREES / SPLIT ** d)
        return [F.floor(F.col("_lat") / size).cast("int"), F.floor(F.col("_lng") / size).cast("int")]
    at = F.lit(cover.depth)
    if splits is not None:
        y, x = cell(0)
        p = p.select("*", y.alias("by"), x.alias("bx")).join(splits, ["by", "bx"], "left")
        for d in reversed(range(cover.depth)):  # as deep as the cells around the point are split
            y, x = cell(d)
            is_split = F.array_contains("splits", F.struct(F.lit(d).alias("depth"), y.alias("cy"), x.alias("cx")))
            at = F.when(F.coalesce(is_split, F.lit(False)), at).otherwise(F.lit(d))
    size = F.lit(CELL_DEGREES) / F.pow(F.lit(float(SPLIT)), F.col("depth"))
    p = p.withColumn("depth", at).select("*", F.floor(F.col("_lat") / size).cast("int").alias("cy"),
                                         F.floor(F.col("_lng") / size).cast("int").alias("cx"))
    found = F.filter("regions", lambda r: r["polygon"].isNull() | point_in_polygon(F.col("_lat"), F.col("_lng"), r["polygon"]))
    return (p.join(leaves, ["depth", "cy", "cx"], "left")
            .select(*[F.col(f"`{c}`") for c in points.columns], F.try_element_at(found, F.lit(1))["zone"].alias("zone")))


def resolve_taken_time(df: DataFrame) -> DataFrame:
    """Taken time (UTC), local wall clock and zone, in the reference's order.

    Expects struct columns ``taken`` and ``created`` and ``gps`` as produced by
    :func:`mediafold.functions.dates.parse_tag_datetime` (fields ``local``,
    ``offset``, ``utc``), ``mime`` and a looked-up ``zone`` (NULL without
    position).  Adds ``taken_utc``, ``taken_local`` (wall clock as Unix
    seconds) and ``time_zone`` ('' when unknown).  Each step is its own
    projection so the generated code stays small.
    """
    c = F.col
    s = df.select("*",
                  c("taken.utc").alias("_ta"), c("taken.local").alias("_ta_wall"),
                  F.coalesce(c("taken.offset"), F.lit(0)).alias("_ta_off"),
                  c("taken.utc").alias("_tl"), c("taken.local").alias("_tl_wall"),
                  F.coalesce(c("taken.offset"), F.lit(0)).alias("_tl_off"),
                  F.lit("").alias("_tz"))
    # 1. a create date wins for the UTC time
    s = s.withColumn("_cs", c("created.utc").isNotNull())
    cs = c("_cs")
    s = (s.withColumn("_ta_wall", F.when(cs, c("created.local")).otherwise(c("_ta_wall")))
          .withColumn("_ta_off", F.when(cs, F.coalesce(c("created.offset"), F.lit(0))).otherwise(c("_ta_off")))
          .withColumn("_ta", F.when(cs, c("created.utc")).otherwise(c("_ta"))))
    # 2. GPS time as the fallback, in UTC
    s = s.withColumn("_g", c("_ta").isNull() & c("_tl").isNull() & c("gps.utc").isNotNull())
    g = c("_g")
    s = (s.withColumn("_tz", F.when(g, F.lit("UTC")).otherwise(c("_tz")))
          .withColumn("_ta_wall", F.when(g, c("gps.utc")).otherwise(c("_ta_wall")))
          .withColumn("_ta_off", F.when(g, F.lit(0)).otherwise(c("_ta_off")))
          .withColumn("_ta", F.when(g, c("gps.utc")).otherwise(c("_ta"))))
    # 3. implausible local <> UTC difference: local := taken
    s = s.withColumn("_far", c("_ta").isNotNull() & c("_tl").isNotNull()
                     & (F.abs(c("_ta") - c("_tl")) > MAX_LOCAL_SKEW_SECONDS))
    far = c("_far")
    s = (s.withColumn("_tl", F.when(far, c("_ta")).otherwise(c("_tl")))
          .withColumn("_tl_wall", F.when(far, c("_ta_wall")).otherwise(c("_tl_wall")))
          .withColumn("_tl_off", F.when(far, c("_ta_off")).otherwise(c("_tl_off")))
          .withColumn("_ta_wall", F.when(far, c("_ta")).otherwise(c("_ta_wall"))))
    # 4. a local offset, or UTC by default for MP4/QuickTime without local time
    s = s.withColumn("_has_off", c("_tl").isNotNull() & (c("_tl_off") != 0))
    s = s.withColumn("_mp4", ~c("_has_off") & c("_tl").isNull()
                     & F.coalesce(c("mime").isin(*LOCAL_UTC_MIMES), F.lit(False)))
    mp4 = c("_mp4")
    s = (s.withColumn("_tz", F.when(mp4, F.lit("UTC")).otherwise(c("_tz")))
          .withColumn("_ta_wall", F.when(mp4, c("_ta")).otherwise(c("_ta_wall"))))
    # 5. position known: the zone of the place decides
    s = s.withColumn("_pos", F.coalesce(c("has_position"), F.lit(False)))
    pos = c("_pos")
    s = s.withColumn("_tz", F.when(pos & c("zone").isNotNull(), c("zone")).otherwise(c("_tz")))
    s = (s.withColumn("_loc", F.when(c("_tz") == "", F.lit("UTC")).otherwise(c("_tz")))
          .withColumn("_p_local", pos & c("_tl").isNotNull())
          .withColumn("_p_taken", pos & c("_tl").isNull() & c("_ta").isNotNull()))
    loc, p_local, p_taken = c("_loc"), c("_p_local"), c("_p_taken")
    s = (s.withColumn("_ta", F.when(p_local, D.instant_from_wall_clock(c("_tl_wall"), loc)).otherwise(c("_ta")))
          .withColumn("_tl_wall", F.when(p_taken, D.wall_clock_in_zone(c("_ta"), loc)).otherwise(c("_tl_wall")))
          .withColumn("_tl", F.when(p_taken, c("_ta")).otherwise(c("_tl"))))
    # 6. (offset known: the wall clock is kept, the instant stays UTC) -- no change in this representation
    # 7. local time still unset
    s = s.withColumn("_unset", c("_tl").isNull() & c("_ta").isNotNull())
    unset = c("_unset")
    s = s.withColumn("_tl_wall", F.when(unset & (c("_tz") == ""), c("_ta_wall"))
                     .when(unset, D.wall_clock_in_zone(c("_ta"), loc)).otherwise(c("_tl_wall")))
    out = s.withColumn("taken_utc", c("_ta")).withColumn("taken_local", c("_tl_wall")).withColumn("time_zone", c("_tz"))
    return out.drop("_ta", "_ta_wall", "_ta_off", "_tl", "_tl_wall", "_tl_off", "_tz", "_has_off", "_pos",
                    "_cs", "_g", "_far", "_mp4", "_loc", "_p_local", "_p_taken", "_unset")


def birth_from_taken(taken_utc: Column, time_zone: Column, offset_text: Column,
                     default_zone: str = D.DEFAULT_ZONE, offset_policy: str = "respect") -> Column:
    """H4 + H5: the catalog birth time from metadata (NULL when no taken time after 1900)."""
    ok = F.year(F.timestamp_seconds(taken_utc)) > 1900
    return F.when(ok, D.default_zone_fix(taken_utc, time_zone, offset_text, default_zone, offset_policy))
