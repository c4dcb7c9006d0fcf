"""Ordered work on long series without ever putting one series in one task.

Rows are cut into chunks that follow the order of a key. The cuts come from quantiles of
the key over all rows, so a chunk holds about 1/n of the rows however they are spread over
groups; a single key value that is itself too frequent is cut again by the tie column.
Windows run inside (group, chunk); what must cross a cut travels in a table with one row
per (group, chunk).
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from halocline.functions.clock import micros
from halocline.session import shuffle_width

CHUNK = "_chunk"
_BIG = float("inf")
#: Missing keys come first; a finite number, so that very many of them are cut like any other value.
_LEAST = -1.7976931348623157e308


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def order_key(df: DataFrame, order: str) -> Column:
    """The order column as a double; times become microseconds."""
    kind = df.schema[order].dataType
    col = F.col(f"`{order}`")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return micros(col).cast("double")
    return col.cast("double")


def _quantiles(df: DataFrame, key: Column, n: int) -> list[float]:
    if n <= 1:
        return []
    probs = [i / n for i in range(1, n)]
    got = df.select(F.percentile_approx(key, probs, max(10000, 10 * n)).alias("e")).first()["e"]
    return [float(v) for v in got or []]


def _bucketed(df: DataFrame, col: str, cuts: list[float], out: str) -> DataFrame:
    if not cuts:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=[-_BIG, *cuts, _BIG], inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def _tie_edges(keyed: DataFrame, held: dict[float, int], n: int) -> DataFrame:
    """(_v, _wide, _fine, _step): for each key value that spans several of `n` quantiles, cuts of its rows along the tie column.

    A value that spans m quantiles gets m - 1 cuts, so the table holds fewer than `n` numbers whatever the keys are; that
    is why it may be broadcast. `_fine` are all cuts, `_wide` every `_step`-th of them.
    """
    spark = keyed.sparkSession
    heavy = spark.createDataFrame(list(held.items()), "_v double, _m int")
    most = max(held.values())
    inside = keyed.join(F.broadcast(heavy), F.col("_key") == F.col("_v"))
    probs = [i / most for i in range(1, most)]
    found = inside.groupBy("_v").agg(F.max("_m").alias("_m"), F.percentile_approx("_tie", probs, max(10000, 10 * most)).alias("_e")).collect()
    table = []
    for r in found:
        at = sorted({r["_e"][round(j * most / r["_m"]) - 1] for j in range(1, r["_m"])}) if r["_e"] else []
        step = max(1, math.isqrt(len(at)))
        table.append((r["_v"], at[step - 1::step], at, step))
    return spark.createDataFrame(table, "_v double, _wide array<double>, _fine array<double>, _step int")


def cut(df: DataFrame, order: str, tie: str | None = None, chunks: int | None = None,
        like: DataFrame | None = None) -> DataFrame:
    """Add a `_chunk` number that never decreases along (order, tie); fewer than twice `chunks` of them hold rows.

    The edges come from one pass over the order column of `df`, or of `like`, a table with
    the same column that is cheaper to read and spread alike. A key value met more than once
    among the quantiles is cut again by the tie column; its cuts are looked up in a small table.
    """
    n = chunks or shuffle_width(df.sparkSession)
    keyed = df.withColumn("_key", F.coalesce(order_key(df, order), F.lit(_LEAST)))
    source = keyed if like is None else like.withColumn("_key", F.coalesce(order_key(like, order), F.lit(_LEAST)))
    edges = [e for e in _quantiles(source, F.col("_key"), n) if math.isfinite(e)]
    out = _bucketed(keyed, "_key", sorted(set(edges)), CHUNK)
    held = {v: c for v, c in Counter(edges).items() if c > 1}
    if not held or tie is None:
        return out.drop("_key")
    table = _tie_edges(source.withColumn("_tie", order_key(source, tie)), held, n)
    out = out.withColumn("_tie", order_key(df, tie)).join(F.broadcast(table), F.col("_key") == F.col("_v"), "left")
    before = lambda at: F.size(F.filter(at, lambda a: a <= F.coalesce(F.col("_tie"), F.lit(-_BIG))))
    skip = F.col("_step") * before("_wide")
    # cuts at or below the tie: those skipped in whole steps, and those of the step that is left
    sub = skip + before(F.slice("_fine", skip + 1, F.col("_step")))
    return out.withColumn(CHUNK, F.col(CHUNK).cast("bigint") * (n + 2) + F.coalesce(sub, F.lit(n + 1))).drop("_key", "_tie", "_v", "_wide", "_fine", "_step")


def scan(df: DataFrame, by: list[str], order: str, tie: str | None = None, sums: dict[str, Column] | None = None,
         inclusive: bool = True, totals: bool = False, before: list[str] | None = None,
         after: list[str] | None = None, chunks: int | None = None) -> DataFrame:
    """One ordered pass over each group along (order, tie).

    `sums` adds running sums (and `<name>_total` per group with `totals`), `before` adds
    `prev_<c>` from the row before and `after` adds `next_<c>` from the row after. Rows that
    already carry `_chunk` keep it, so that several scans share one cut.
    """
    by, sums, before, after = list(by), dict(sums or {}), list(before or []), list(after or [])
    rows = df if CHUNK in df.columns else cut(df, order, tie, chunks)
    place = F.struct(order, tie) if tie else F.struct(order)
    borrowed = list(dict.fromkeys(before + after))
    rows = rows.withColumn("_row", F.struct(*borrowed) if borrowed else F.lit(0))
    for name, val in sums.items():
        rows = rows.withColumn(f"_v_{name}", val)

    # One row per (group, chunk). Without a tie column all aggregation buffers are plain
    # numbers, so the partial aggregation hashes instead of sorting.
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    if tie is None:
        aggs += [F.max_by(c, order).alias(f"_l_{c}") for c in before] + [F.min_by(c, order).alias(f"_f_{c}") for c in after]
        last, first = F.struct(*[F.col(f"_l_{c}").alias(c) for c in before]), F.struct(*[F.col(f"_f_{c}").alias(c) for c in after])
    else:
        aggs += [F.max_by("_row", place).alias("_last")] if before else []
        aggs += [F.min_by("_row", place).alias("_first")] if after else []
        last, first = F.col("_last"), F.col("_first")
    ends = rows.groupBy(*by, CHUNK).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    whole = W.partitionBy(*by)
    along = whole.orderBy(CHUNK)
    carry = [F.col(b).alias(f"_o_{b}") for b in by] + [F.col(CHUNK).alias("_o_chunk")]
    for n in sums:
        zero = F.lit(0).cast(ends.schema[f"_t_{n}"].dataType)
        upto = F.sum(f"_t_{n}").over(along.rowsBetween(W.unboundedPreceding, -1))
        carry.append(F.coalesce(upto, zero).alias(f"_off_{n}"))
        if totals:
            carry.append(F.coalesce(F.sum(f"_t_{n}").over(whole), zero).alias(f"{n}_total"))
    carry += [F.lag(last).over(along).alias("_pl")] if before else []
    carry += [F.lead(first).over(along).alias("_nf")] if after else []
    ends = ends.select(*carry)

    inside = W.partitionBy(*by, CHUNK).orderBy(*([F.col(order)] + ([F.col(tie)] if tie else [])))
    frame = inside.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = rows
    for n in sums:
        local = local.withColumn(f"_loc_{n}", F.sum(f"_v_{n}").over(frame))
    if before:
        local = local.withColumn("_p", F.lag("_row").over(inside))
    if after:
        local = local.withColumn("_n", F.lead("_row").over(inside))
    on = F.col(CHUNK) == F.col("_o_chunk")
    for b in by:
        on = on & same(b, f"_o_{b}")
    out = local.join(ends, on, "left")
    cols = [F.col(c) for c in df.columns]
    for n in sums:
        cols.append((F.coalesce(F.col(f"_loc_{n}"), F.col(f"_off_{n}") * 0) + F.col(f"_off_{n}")).alias(n))
        if totals:
            cols.append(F.col(f"{n}_total"))
    cols += [F.when(F.col("_p").isNotNull(), F.col("_p")[c]).otherwise(F.col("_pl")[c]).alias(f"prev_{c}") for c in before]
    cols += [F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col("_nf")[c]).alias(f"next_{c}") for c in after]
    return out.select(*cols)


def running_sum(df: DataFrame, val: Column, by: list[str], order: str, tie: str | None = None,
                name: str = "running", inclusive: bool = True, chunks: int | None = None) -> DataFrame:
    return scan(df, by, order, tie, {name: val}, inclusive, chunks=chunks)


def row_index(df: DataFrame, by: list[str], order: str, tie: str | None = None,
              name: str = "i", chunks: int | None = None) -> DataFrame:
    """Dense position 0, 1, 2 ... of each row in its group."""
    return scan(df, by, order, tie, {name: F.lit(1).cast("bigint")}, False, chunks=chunks)


def halo_blocks(df: DataFrame, by: list[str], index: str, size: int, left: int, right: int) -> DataFrame:
    """Cut an indexed series into blocks of `size` rows and lend each block the `left` rows
    before it and the `right` rows after it. `_own` marks the rows of the block itself.
    """
    i = F.col(index)
    own = F.floor(i / size).cast("bigint")
    first = F.greatest(F.lit(0), F.floor((i - right) / size)).cast("bigint")
    last = F.floor((i + left) / size).cast("bigint")
    return (df.withColumn("_block", F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col("_block") == own))
