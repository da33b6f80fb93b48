"""Spatial cell keys (H30): S2 cells by Column expressions.

A point is projected onto the face of a cube, the face's coordinates become 30-bit numbers ``i`` and ``j``, and a Hilbert
curve orders the cells.  The curve is walked four bits of ``i`` and ``j`` at a time: a table of 1,024 entries, made once
from the curve's rule, gives eight bits of the position and the orientation that goes on, so a key is six lookups.
Everything stays in the JVM.

Edge cases: a NULL, zero, NaN or infinite latitude or longitude is no position and has no cell.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_LEVEL = 21  # fixed value: level of the place key
MAX_LEVEL = 30
# Fixed values of the curve: position of each (i, j) quadrant per orientation, and the change of orientation per position.
IJ_TO_POS = [[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]]
POS_TO_ORIENTATION = [1, 0, 0, 3]
STEP = 4  # bits of i and of j in a lookup
STEPS = 6  # 24 bits of 32, the first two of which are empty: 22 levels
TABLE_LEVELS = STEP * STEPS - 2


@cache
def curve_table() -> list[int]:
    """``[i bits | j bits | orientation] -> position bits << 2 | orientation`` of ``STEP`` levels of the curve."""
    table = []
    for key in range(1 << (2 * STEP + 2)):
        i, j, orientation, at = key >> (STEP + 2), (key >> 2) & ((1 << STEP) - 1), key & 3, 0
        for bit in reversed(range(STEP)):
            pos = IJ_TO_POS[orientation][((i >> bit) & 1) << 1 | ((j >> bit) & 1)]
            at, orientation = at << 2 | pos, orientation ^ POS_TO_ORIENTATION[pos]
        table.append(at << 2 | orientation)
    return table


def _face(x: Column, y: Column, z: Column) -> Column:
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    along = F.when((ax >= ay) & (ax >= az), F.when(x < 0, 3).otherwise(0))
    return along.when(ay >= az, F.when(y < 0, 4).otherwise(1)).otherwise(F.when(z < 0, 5).otherwise(2))


def _number(w: Column) -> Column:
    """30-bit number of a face coordinate in -1..1 (quadratic projection)."""
    s = F.when(w >= 0, 0.5 * F.sqrt(1 + 3 * F.abs(w))).otherwise(1 - 0.5 * F.sqrt(1 + 3 * F.abs(w)))
    n = 1 << MAX_LEVEL
    return F.least(F.greatest(F.floor(s * n), F.lit(0).cast("bigint")), F.lit(n - 1).cast("bigint"))


def with_cell_ids(df: DataFrame, lat: str, lng: str, out: str, levels: tuple[int, ...] = (CELL_LEVEL,)) -> DataFrame:
    """``df`` plus the 64-bit cell id of its points at each level (``out``, or ``out_<level>`` for several).

    Levels go from 0 (a face of the cube) to ``TABLE_LEVELS``; the id of a coarser level is the parent's.  Steps are
    kept apart, so nothing is computed twice.
    """
    if not all(0 <= level <= TABLE_LEVELS for level in levels):
        raise ValueError(f"levels go from 0 to {TABLE_LEVELS}")
    names = [out] if len(levels) == 1 else [f"{out}_{level}" for level in levels]
    keep = [F.col(f"`{x}`") for x in df.columns if x not in names]
    c = F.col

    def stage(rows, **made):  # through a Generate, which the optimizer does not fold into the next stage
        return rows.select(*keep, F.inline(F.array(F.struct(*[v.alias(f"__{n}") for n, v in made.items()]))))
    la, ln = c(f"`{lat}`").cast("double"), c(f"`{lng}`").cast("double")
    known = (F.abs(la) + F.abs(ln) < float("inf")) & (la != 0) & (ln != 0)  # NaN sorts above infinity
    s = stage(df, a=F.when(known, F.radians(la)), o=F.when(known, F.radians(ln)))
    s = stage(s, x=F.cos("__a") * F.cos("__o"), y=F.cos("__a") * F.sin("__o"), z=F.sin("__a"))
    x, y, z = c("__x"), c("__y"), c("__z")
    s = stage(s, x=x, y=y, z=z, face=F.when(z.isNotNull(), _face(x, y, z)))
    face = c("__face")

    def by_face(*values):
        out = F.when(face == 0, values[0])
        for n, v in enumerate(values[1:], 1):
            out = out.when(face == n, v)
        return out
    s = stage(s, face=face, u=by_face(y / x, -x / y, -x / z, z / x, z / y, -y / z),
              v=by_face(z / x, z / y, -y / z, y / x, -x / y, -x / z))
    s = stage(s, face=face, i=_number(c("__u")), j=_number(c("__v")))
    mask = (1 << STEP) - 1
    chunks = [f"shiftleft(shiftright(__i, {at}) & {mask}L, {STEP}) | (shiftright(__j, {at}) & {mask}L)"
              for at in range(32 - STEP, 32 - STEP * STEPS - 1, -STEP)]
    table = f"array({', '.join(map(str, curve_table()))})"  # SQL text: one call, folded into a constant
    curve = F.expr(f"aggregate(array({', '.join(chunks)}), CAST(__face & 1 AS BIGINT), (done, chunk) -> "
                   f"shiftleft(shiftright(done, 2), {2 * STEP + 2}) | "
                   f"CAST(get({table}, CAST(shiftleft(chunk, 2) | (done & 3L) AS INT)) AS BIGINT))")
    s = stage(s, face=face, pos=F.shiftright(curve, 2))
    ids = []
    for level, name in zip(levels, names, strict=True):
        pos = F.shiftright(c("__pos"), 2 * (TABLE_LEVELS - level))
        bottom = 2 * (MAX_LEVEL - level)
        ids.append(F.shiftleft(face.cast("bigint"), 61).bitwiseOR(F.shiftleft(pos, bottom + 1)).bitwiseOR(
            F.lit(1 << bottom)).alias(name))
    return s.select(*keep, *ids)


def cell_token(cell_id: Column) -> Column:
    """Prefixed token of a cell id: its 16 hex digits without the zeros behind."""
    return F.concat(F.lit("s2:"), F.rtrim(F.lpad(F.lower(F.hex(cell_id)), 16, "0"), F.lit("0")))


def parent(cell_id: Column, level: int) -> Column:
    """Id of the cell of ``level`` around a finer cell."""
    low = 1 << (2 * (MAX_LEVEL - level))
    return cell_id.bitwiseAND(F.lit(-(low << 1))).bitwiseOR(F.lit(low))
