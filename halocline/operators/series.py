"""Time series: resampling, stages, gaps, rolling means, correlation, filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from halocline.functions.clock import floor_time, from_micros, micros, seconds_between, step_micros
from halocline.operators.ordered import CHUNK, cut, halo_blocks, row_index, same, scan

BLOCK = 16384


def resample_mean(df: DataFrame, time: str, freq: str, cols: list[str], by: list[str] = (), fill: bool = False) -> DataFrame:
    """Mean per time bin, labelled by the start of the bin. `fill` adds the empty bins as NULL rows."""
    out = (df.withColumn("_bin", floor_time(time, freq)).groupBy(*by, "_bin")
           .agg(*[F.avg(c).alias(c) for c in cols]).withColumnRenamed("_bin", time))
    if not fill:
        return out
    w = step_micros(freq)
    span = out.groupBy(*by).agg(F.min(micros(time)).alias("_a"), F.max(micros(time)).alias("_b"))
    bins = span.select(*by, F.explode(F.sequence("_a", "_b", F.lit(w).cast("bigint"))).alias("_m"))
    bins = bins.withColumn(time, from_micros(F.col("_m"))).drop("_m")
    renamed = out.withColumnsRenamed({c: f"_g_{c}" for c in [*by, time]})
    on = F.col(time) == F.col(f"_g_{time}")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return bins.join(renamed, on, "left").select(*by, time, *cols)


def _wrapped(a: Column, b: Column, wrap: bool) -> Column:
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d) if wrap else d


def find_breaks(df: DataFrame, by: list[str], time: str, tie: str | None = None, gap_minutes: float = 2880.0,
                deg: float | None = 1.0, strict_reference: bool = False) -> DataFrame:
    """Add `is_break`: 1 where a stage ends, before a long gap or a jump in position.

    `deg=None` looks at gaps only. `strict_reference` never tests the first pair, needs a
    positive gap before the row for a gap break, and does not wrap longitudes.
    """
    at = [time] + (["lat", "lon"] if deg is not None else [])
    s = scan(df, by, time, tie, before=[time] if strict_reference else [], after=at)
    gap = seconds_between(time, f"next_{time}") / 60.0 > gap_minutes
    jump = F.lit(False)
    if deg is not None:
        jump = (F.abs(F.col("next_lat") - F.col("lat")) > deg) | (
            _wrapped(F.col("next_lon"), F.col("lon"), not strict_reference) > deg)
    if strict_reference:
        back = seconds_between(f"prev_{time}", time) / 60.0
        cond = F.col(f"prev_{time}").isNotNull() & ((gap & (back > 0)) | jump)
    else:
        cond = gap | jump
    s = s.withColumn("is_break", F.when(cond, 1).otherwise(0).cast("bigint"))
    return s.drop(f"prev_{time}", *[f"next_{c}" for c in at])


def stage_label(df: DataFrame, by: list[str], time: str, tie: str | None = None, gap_minutes: float = 2880.0,
                deg: float | None = 1.0, strict_reference: bool = False) -> DataFrame:
    """Add `stage`: the number of breaks before the row. Both passes share one cut."""
    b = find_breaks(cut(df, time, tie), by, time, tie, gap_minutes, deg, strict_reference)
    return scan(b, by, time, tie, {"stage": F.col("is_break")}, inclusive=False).drop(CHUNK)


def stage_spans(df: DataFrame, by: list[str], time: str, tie: str | None = None, gap_minutes: float = 2880.0) -> DataFrame:
    """Stages by gap only, as rows (group, start, last, n); a gap of exactly the limit does not break."""
    return (stage_label(df, by, time, tie, gap_minutes, None).groupBy(*by, "stage")
            .agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).drop("stage"))


def stage_bias(df: DataFrame, by: list[str], measured: str, bulk: str, min_n: int = 20) -> DataFrame:
    """Mean measured minus bulk of stages with more than `min_n` rows."""
    return (df.groupBy(*by).agg(F.avg(F.col(measured) - F.col(bulk)).alias("bias"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > min_n))


def track_check(df: DataFrame, by: list[str], time: str, tie: str | None = None, limit: float = 2.0) -> DataFrame:
    """Per stage: any large step (full turns excluded), any missing position, mean absolute step."""
    s = scan(df, by, time, tie, before=["lat", "lon"])
    out = []
    for c in ("lat", "lon"):
        d = F.abs(F.col(c) - F.col(f"prev_{c}"))
        out += [F.max(F.when((d > limit) & (F.abs(d - 360) > limit), 1).otherwise(0)).alias(f"{c}_jump"),
                F.avg(d).alias(f"{c}_step")]
    gone = F.max(F.when(F.col("lat").isNull() | F.col("lon").isNull(), 1).otherwise(0)).alias("missing")
    return s.groupBy(*by).agg(*out, gone)


def gap_profile(df: DataFrame, time: str, tie: str | None = None, by: list[str] = ()) -> DataFrame:
    """Minutes since the sample before, per row."""
    s = scan(df, list(by), time, tie, before=[time])
    return s.withColumn("gap", seconds_between(f"prev_{time}", time) / 60.0).drop(f"prev_{time}")


def exact_quantiles(df: DataFrame, col: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """For each group and {name: share}, the smallest value with at least that share of the values at or below it; NULL without values.

    Equal values are counted first. Ranks are running sums of these counts over chunks of the
    value, so no group is sorted in one task however many values it has.
    """
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = scan(counts, by, col, sums={"_upto": F.col("_c")}, totals=True)
    found = ranked.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") >= share * F.col("_upto_total"), F.col(col))).alias(name) for name, share in shares.items()])
    return _join_groups(df.select(*by).distinct(), found, by, "left") if by else found


def gap_summary(gaps: DataFrame, by: list[str], long_minutes: float = 60.0) -> DataFrame:
    """Number, longest, mean, exact median (the lower middle value) and number of long gaps of each group."""
    by = list(by)
    out = gaps.groupBy(*by).agg(
        F.count("gap").alias("n"), F.max("gap").alias("longest"), F.avg("gap").alias("mean"),
        F.count(F.when(F.col("gap") > long_minutes, 1)).alias("n_long"))
    median = exact_quantiles(gaps, "gap", {"median": 0.5}, by)
    out = _join_groups(out, median, by) if by else out.withColumn("median", median.scalar())
    return out.select(*by, "n", "longest", "mean", "median", "n_long")


def rolling_mean(df: DataFrame, col: str, n: int, order: str, tie: str | None = None, by: list[str] = (),
                 name: str = "rolling") -> DataFrame:
    """Centred mean of `n` rows; NULL near the ends and where a value is missing.

    An even window reaches one row further back than forward. `<name>_anomaly` is the value
    minus the mean, where a missing mean counts as 0.
    """
    by = list(by)
    left, right = n // 2, (n - 1) // 2
    rows = halo_blocks(row_index(df, by, order, tie, "_i"), by, "_i", max(BLOCK, 4 * n), left, right)
    frame = W.partitionBy(*by, "_block").orderBy("_i").rowsBetween(-left, right)
    rows = rows.withColumn("_n", F.count(col).over(frame)).withColumn("_m", F.avg(col).over(frame)).filter("_own")
    mean = F.when(F.col("_n") == n, F.col("_m"))
    return rows.select(*df.columns, mean.alias(name), (F.col(col) - F.coalesce(mean, F.lit(0.0))).alias(f"{name}_anomaly"))


def _join_groups(rows: DataFrame, per_group: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their group's row; NULL is a group like others."""
    renamed = per_group.withColumnsRenamed({b: f"_g_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return rows.join(renamed, on, how).drop(*[f"_g_{b}" for b in by])


def _lag_sums(df: DataFrame, col: str, max_lag: int, order: str, tie: str | None, by: list[str]) -> DataFrame:
    """Sums over all pairs (i, i+k) of one series, k = 0..max_lag.

    A block of rows with the next `max_lag` rows yields its share of the sums, so a task
    never holds more than one block however long the series is.
    """
    mean = df.groupBy(*by).agg(F.avg(col).alias("_mean"))
    rows = df.filter(F.col(col).isNotNull())
    rows = _join_groups(rows, mean, by) if by else rows.withColumn("_mean", mean.scalar())
    rows = rows.select(*by, order, *([tie] if tie else []), (F.col(col) - F.col("_mean")).alias("_x"))
    blocks = halo_blocks(row_index(rows, by, order, tie, "_i"), by, "_i", BLOCK, 0, max_lag)
    blocks = blocks.select(*by, "_block", "_own", "_i", "_x")
    kinds = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def sums(key, pdf):
        import pandas as pd
        pdf = pdf.sort_values("_i")
        x, own = pdf["_x"].to_numpy(), int(pdf["_own"].sum())
        out = []
        for k in range(max_lag + 1):
            a = x[:max(0, min(own, len(x) - k))]
            b = x[k:k + len(a)]
            out.append((*key[:-1], k, len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b))
        return pd.DataFrame(out, columns=[*by, "lag", "n", "sx", "sy", "sxx", "syy", "sxy"])

    parts = blocks.groupBy(*by, "_block").applyInPandas(
        sums, f"{kinds + ', ' if kinds else ''}lag long, n long, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy(*by, "lag").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def autocorr(df: DataFrame, col: str, max_lag: int, order: str, tie: str | None = None, by: list[str] = (),
             detrend: int | None = None) -> DataFrame:
    """Autocorrelation at lags 0..max_lag of the demeaned series over its sum of squares.

    `detrend` first takes away a centred rolling mean of that many rows.
    """
    by = list(by)
    if detrend:
        df = rolling_mean(df, col, detrend, order, tie, by, "_roll").withColumn(col, F.col("_roll_anomaly"))
    s = _lag_sums(df, col, max_lag, order, tie, by)
    zero = s.filter("lag = 0").select(*by, F.col("sxx").alias("_whole"))
    s = _join_groups(s, zero, by) if by else s.withColumn("_whole", zero.scalar())
    return s.select(*by, "lag", F.try_divide(F.col("sxy"), F.col("_whole")).alias("r"))


def lag_corr(df: DataFrame, col: str, max_lag: int, order: str, tie: str | None = None, by: list[str] = ()) -> DataFrame:
    """Pearson correlation of the series with itself `lag` rows later, each lag centred anew."""
    s = _lag_sums(df, col, max_lag, order, tie, list(by)).filter("lag > 0")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    va = F.col("sxx") - F.try_divide(F.col("sx") ** 2, F.col("n"))
    vb = F.col("syy") - F.try_divide(F.col("sy") ** 2, F.col("n"))
    return s.select(*by, "lag", F.try_divide(cov, F.sqrt(va * vb)).alias("r"))


def corr_time(ac: DataFrame, by: list[str] = ()) -> DataFrame:
    """Correlation time from the lag nearest to 1/e, and from lag 1."""
    k = F.min_by("lag", F.struct(F.abs(F.col("r") - math.exp(-1.0)), F.col("lag")))
    out = ac.groupBy(*by).agg(k.alias("k"), F.max(F.when(F.col("lag") == 1, F.col("r"))).alias("r1"))
    return out.select(*by, "k", F.when(F.col("k") > 0, F.try_divide(F.lit(1.0), 1.0 - F.exp(F.try_divide(F.lit(-1.0), F.col("k"))))).alias("t_fold"),
                      F.try_divide(F.lit(1.0), 1.0 - F.col("r1")).alias("t_lag1"))


def resample_linear(df: DataFrame, time: str, cols: list[str], freq: str = "1 hour", by: list[str] = ()) -> DataFrame:
    """Uneven series to an even one by linear interpolation; nothing outside the sample range.

    Each sample makes the grid times from itself up to the next sample.
    """
    w = step_micros(freq)
    by = list(by)
    s = scan(df.select(*by, time, *cols), by, time, after=[time, *cols])
    t0, t1 = micros(time), micros(f"next_{time}")
    lo = F.ceil(t0 / F.lit(w)).cast("bigint")
    hi = F.when(t1.isNull(), F.floor(t0 / F.lit(w)).cast("bigint")).otherwise(F.ceil(t1 / F.lit(w)).cast("bigint") - 1)
    out = s.withColumn("_k", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    at = F.col("_k") * F.lit(w)
    f = F.coalesce(F.try_divide((at - t0).cast("double"), (t1 - t0).cast("double")), F.lit(0.0))
    value = [F.when(f == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * f).alias(c) for c in cols]
    return out.select(*by, from_micros(at).alias(time), *value)


def second_diff(df: DataFrame, col: str, by: list[str], order: str, name: str = "d2") -> DataFrame:
    """Second difference along an axis, NULL at both ends."""
    s = scan(df, by, order, before=[col], after=[col])
    return (s.withColumn(name, F.col(f"next_{col}") - 2 * F.col(col) + F.col(f"prev_{col}"))
            .drop(f"next_{col}", f"prev_{col}"))


def fill_nearest(df: DataFrame, col: str, order: str, tie: str | None = None, by: list[str] = (),
                 name: str | None = None) -> DataFrame:
    """Missing values take the nearest present value by position; the earlier one wins a tie."""
    by = list(by)
    rows = row_index(cut(df, order, tie), by, order, tie, "_i")
    have = F.when(F.col(col).isNotNull(), F.col("_i"))
    rows = rows.withColumn("_at", F.when(F.col(col).isNotNull(), F.struct("_i", F.col(col).alias("v"))))
    ends = rows.groupBy(*by, CHUNK).agg(F.max(have).alias("_li"), F.max_by(col, have).alias("_lv"),
                                        F.min(have).alias("_fi"), F.min_by(col, have).alias("_fv"))
    pair = lambda i, v: F.when(F.col(i).isNotNull(), F.struct(F.col(i).alias("_i"), F.col(v).alias("v")))
    earlier = W.partitionBy(*by).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*by).orderBy(F.desc(CHUNK)).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*[F.col(b).alias(f"_o_{b}") for b in by], F.col(CHUNK).alias("_o_chunk"),
                       F.last(pair("_li", "_lv"), ignorenulls=True).over(earlier).alias("_pl"),
                       F.last(pair("_fi", "_fv"), ignorenulls=True).over(later).alias("_nf"))
    # both directions as running frames; a frame open to the end would be quadratic
    up = W.partitionBy(*by, CHUNK).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*by, CHUNK).orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, 0)
    rows = (rows.withColumn("_p", F.last("_at", ignorenulls=True).over(up))
            .withColumn("_n", F.last("_at", ignorenulls=True).over(down)))
    on = F.col(CHUNK) == F.col("_o_chunk")
    for b in by:
        on = on & same(b, f"_o_{b}")
    rows = rows.join(ends, on, "left")
    p, n = F.coalesce("_p", "_pl"), F.coalesce("_n", "_nf")
    near = F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"]).when(
        F.col("_i") - p["_i"] <= n["_i"] - F.col("_i"), p["v"]).otherwise(n["v"])
    filled = F.coalesce(F.col(col), near)
    keep = [filled.alias(c) if c == (name or col) else F.col(c) for c in df.columns]
    return rows.select(*keep, *([filled.alias(name)] if name and name not in df.columns else []))


def coarsen(df: DataFrame, axes: dict[str, tuple[float, float]], factor: int, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Block mean over `factor` cells along each axis given as {name: (start, step)}.

    Blocks at the edge hold fewer cells; missing cells do not count.
    """
    idx = {a: F.floor(F.round((F.col(a) - start) / step) / factor).alias(f"_{a}") for a, (start, step) in axes.items()}
    out = df.groupBy(*by, *idx.values()).agg(*[F.avg(a).alias(a) for a in axes], *[F.avg(c).alias(c) for c in cols])
    return out.drop(*[f"_{a}" for a in axes])


def time_mean(df: DataFrame, cols: dict[str, Column], by: list[str] = ("lat", "lon")) -> DataFrame:
    """Mean over time of fields or of differences of fields, cell by cell."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(n) for n, c in cols.items()])


def net_heat(*terms: str) -> Column:
    """Sum of heat-flux terms; missing when one is missing."""
    out = F.col(terms[0])
    for t in terms[1:]:
        out = out + F.col(t)
    return out


def interannual_std(df: DataFrame, time: str, cols: list[str]) -> DataFrame:
    """Std over years of the monthly means, month by month."""
    monthly = df.groupBy(F.year(time).alias("year"), F.month(time).alias("month")).agg(*[F.avg(c).alias(c) for c in cols])
    return monthly.groupBy("month").agg(*[F.stddev_pop(c).alias(f"{c}_std") for c in cols])
