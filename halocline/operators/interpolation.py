"""Interpolation of gridded fields at points, as equi-joins on axis values.

The values of all axes come from one aggregate over the field and become a table of intervals, each in the buckets of
average width that it touches (at most two a value, however the axis is spaced). A point meets the intervals of its own
bucket and lies in one of them; no axis value is brought to the driver or written into the plan, so an axis may be of any
length. What a point needs of the field is keyed by the values at the corners of its cell. Each cell that holds a point
is joined once to its corners, and the points are joined to the finished cells, whose keys are unique; the field itself
is never broadcast, and is read only around the points. A cell with very many points is thus the only possible hot key,
on one side only: adaptive execution splits it, or `salt` spreads it beforehand.

An axis can have groups: a point then sees only the values of its group, as when each cruise has months of its own. The
field is not multiplied by that, since corners are looked up by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F, types as T

from halocline.operators.ordered import order_key, same, scan
from halocline.session import cut_lineage


def axis_table(grid: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, value): the distinct values of each axis as doubles, from one scan of the field."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), order_key(grid, a).alias("value")) for a in axes])
    return grid.select(F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.isnan("value")).distinct()


def intervals(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., axis, lo, hi, last): neighbouring values of each axis; the last interval of an axis holds its upper end."""
    by = [*by, "axis"]
    pairs = scan(table.select(*by, "value"), by, "value", after=["value"]).filter("next_value IS NOT NULL")
    top = pairs.groupBy(*by).agg(F.max("next_value").alias("_top")).withColumnsRenamed({b: f"_g_{b}" for b in by})
    on = reduce(lambda x, y: x & y, [same(b, f"_g_{b}") for b in by])
    return pairs.join(top, on).select(*by, F.col("value").alias("lo"), F.col("next_value").alias("hi"), (F.col("next_value") == F.col("_top")).alias("last"))


def _located(points: DataFrame, x: Column, spans: DataFrame, by: list[str], lowest: float, width: float, out: str) -> DataFrame:
    """Add `<out>_lo` and `<out>_hi`, the ends of the interval that x lies in; NULL outside."""
    bucket = lambda v: F.floor((v - F.lit(lowest)) / F.lit(width)).cast("bigint")
    dealt = spans.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("lo").alias(f"{out}_lo"), F.col("hi").alias(f"{out}_hi"), "last",
                         F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("_bucket"))
    keyed = points.withColumn("_x", x).withColumn("_at", bucket(F.col("_x")))
    lo, hi = F.col(f"{out}_lo"), F.col(f"{out}_hi")
    on = (F.col("_at") == F.col("_bucket")) & (lo <= F.col("_x")) & ((F.col("_x") < hi) | (F.col("last") & (F.col("_x") == hi)))
    for b in by:
        on = on & (F.col(b) == F.col(f"_by_{b}"))
    return keyed.join(dealt, on, "left").withColumn(f"{out}_w", (F.col("_x") - lo) / (hi - lo)).drop("_x", "_at", "_bucket", "last", *[f"_by_{b}" for b in by])


def _literal(df: DataFrame, axis: str, value: float):
    """An axis value as a literal of the axis type."""
    kind = df.schema[axis].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        at = datetime(1970, 1, 1) + timedelta(microseconds=int(value))
        return F.lit(str(at)).cast("timestamp_ntz").cast(kind)
    return F.lit(value).cast(kind)


def interp_at(points: DataFrame, grid: DataFrame, axes: dict[str, str], cols: list[str], salt: int = 1, by: list[str] = (),
              groups: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Multilinear interpolation of `cols` of `grid` at `points`.

    `axes` maps a grid axis to the column of the points. Outside the grid, or where a corner
    is missing, the result is NULL. `groups` gives axes that differ by the points' columns `by`:
    a function from the table (axis, value) of that axis to one with the columns `by` besides.
    """
    by, groups = list(by), dict(groups or {})
    table = cut_lineage(axis_table(grid, list(axes)))
    sizes = {r["axis"]: r for r in table.groupBy("axis").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).collect()}
    for a in axes:
        if a not in sizes or sizes[a]["n"] < 2:
            raise ValueError(f"axis {a} needs two values")
    names = {a: f"_c{k}" for k, a in enumerate(axes)}
    pts = points
    for a, c in axes.items():
        one = table.filter(F.col("axis") == a)
        spans = intervals(groups[a](one), by) if a in groups else intervals(one)
        low, high, n = sizes[a]["a"], sizes[a]["b"], sizes[a]["n"]
        pts = _located(pts, order_key(points, c), spans, by if a in groups else [], low, (high - low) / (n - 1), names[a])
    ends = [f"{c}_{t}" for c in names.values() for t in ("lo", "hi")]
    inside = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ends])
    used = cut_lineage(pts.filter(inside).select(*ends).distinct())

    # Only the part of the field around the points is read: these ranges reach the scan.
    reach = used.agg(*[f(F.col(c)).alias(c) for c in ends for f in (F.min if c.endswith("lo") else F.max,)]).first()
    nodes = grid
    for a, c in names.items():
        if reach[f"{c}_lo"] is not None:
            nodes = nodes.filter(F.col(a).between(_literal(grid, a, reach[f"{c}_lo"]), _literal(grid, a, reach[f"{c}_hi"])))
    nodes = nodes.select(*[order_key(grid, a).alias(f"_n{c}") for a, c in names.items()], *[F.col(c).alias(f"_g_{c}") for c in cols])

    corners = list(product((0, 1), repeat=len(axes)))
    wanted = used.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(corners) - 1))))
    for j, c in enumerate(names.values()):
        upper = F.shiftright(F.col("_k"), len(axes) - 1 - j).bitwiseAND(F.lit(1)) == 1
        wanted = wanted.withColumn(f"_n{c}", F.when(upper, F.col(f"{c}_hi")).otherwise(F.col(f"{c}_lo")))
    found = wanted.join(nodes, [f"_n{c}" for c in names.values()])
    cells = found.groupBy(*ends).agg(*[
        F.max(F.when(F.col("_k") == k, F.col(f"_g_{c}"))).alias(f"_v{k}_{c}") for c in cols for k in range(len(corners))])

    on = list(ends)
    if salt > 1:
        pts = pts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int"))
        cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("_salt")
    out = pts.join(cells, on, "left")
    result = []
    for c in cols:
        terms = []
        for k, bits in enumerate(corners):
            w = reduce(lambda x, y: x * y, [F.col(f"{n}_w") if bit else 1 - F.col(f"{n}_w") for n, bit in zip(names.values(), bits)])
            terms.append(w * F.col(f"_v{k}_{c}"))
        result.append(reduce(lambda x, y: x + y, terms).alias(c))
    return out.select(*points.columns, *result)


def interp_track(track: DataFrame, grid: DataFrame, cols: list[str], time: str = "time", grid_time: str = "ts",
                 salt: int = 1, by: list[str] = (), times: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A gridded field along a track, linear in time, latitude and longitude.

    `times` gives each group of track rows (`by`) the field times it may use.
    """
    return interp_at(track, grid, {grid_time: time, "lat": "lat", "lon": "lon"}, cols, salt, by, {grid_time: times} if times else None)


def regrid(src: DataFrame, dst: DataFrame, cols: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bilinear values of a field on the cells of another grid."""
    return interp_at(dst, src, {lat: lat, lon: lon}, cols)
