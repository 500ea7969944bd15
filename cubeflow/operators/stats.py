"""Robust value ranges, trace-key analysis and other statistics over many samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_range(df: DataFrame, percentile: float = 99.5, value: str = "value") -> DataFrame:
    """One row (range_min, range_max, nan_count): the k-th smallest and largest value, k = int((100 - p) / 100 * N / 2) + 1.

    Equal ends give max = min + 1 and no values (0, 1).  The k smallest and largest are found by
    counting equal values and summing the counts in order, so only distinct values are ordered.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    nans = v.agg(F.count(F.when(F.isnan("v"), 1)).alias("nan_count"))
    counts = v.where(~F.isnan("v")).groupBy("v").agg(F.count("*").alias("n"))
    # ranges of values, each summed on its own, so that no task orders all distinct values
    bounds = counts.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("n").alias("total"))
    bin_of = F.when(F.col("b") > F.col("a"), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * 4095)).otherwise(0)
    binned = counts.crossJoin(F.broadcast(bounds)).withColumn("bin", bin_of)  # one row
    k = F.floor((100.0 - percentile) / 100.0 * F.col("total") / 2.0) + 1
    bins = binned.groupBy("bin").agg(F.sum("n").alias("bn"), F.first("total").alias("total"))  # at most 4096 rows
    order = Window.orderBy("bin")
    bins = bins.withColumn("before", F.sum("bn").over(order) - F.col("bn")).withColumn("after", F.col("total") - F.col("before") - F.col("bn"))
    low = bins.where((F.col("before") < k) & (F.col("before") + F.col("bn") >= k)).select("bin", F.lit("low").alias("end"), (k - F.col("before")).alias("rest"))
    high = bins.where((F.col("after") < k) & (F.col("after") + F.col("bn") >= k)).select("bin", F.lit("high").alias("end"), (k - F.col("after")).alias("rest"))
    inside = binned.join(F.broadcast(low.unionByName(high)), "bin")  # two rows
    up, down = Window.partitionBy("end").orderBy("v"), Window.partitionBy("end").orderBy(F.col("v").desc())
    inside = inside.withColumn("up", F.sum("n").over(up)).withColumn("down", F.sum("n").over(down))
    ends = inside.agg(F.min(F.when((F.col("end") == "low") & (F.col("up") >= F.col("rest")), F.col("v"))).alias("lo"), F.max(F.when((F.col("end") == "high") & (F.col("down") >= F.col("rest")), F.col("v"))).alias("hi"))
    out = ends.crossJoin(nans)  # one row each
    return out.select(F.coalesce("lo", F.lit(0.0)).alias("range_min"), F.when(F.col("lo").isNull(), 1.0).when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")).alias("range_max"), "nan_count")


def segments(traces: DataFrame, key: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """(segment, key, first_trace, last_trace, n): runs of equal keys in trace order.

    ``bucket``, a non-decreasing function of the order, lets runs be found in parallel: within a
    bucket by a window, then joined over the buckets' ends.
    """
    if bucket is None:
        w = Window.orderBy(*order)
        marked = traces.withColumn("_new", F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1))
        marked = marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        t = traces.withColumn("_b", bucket)
        w = Window.partitionBy("_b").orderBy(*order)
        ends = t.groupBy("_b").agg(F.max_by(F.col(key), F.struct(*order)).alias("_last"))
        ends = ends.withColumn("_prev", F.lag("_last").over(Window.orderBy("_b"))).withColumn("_has", F.lag(F.lit(1)).over(Window.orderBy("_b")))
        t = t.join(ends.select("_b", "_prev", "_has"), "_b")
        before = F.when(F.row_number().over(w) == 1, F.when(F.col("_has").isNotNull(), F.col("_prev"))).otherwise(F.lag(key).over(w))
        started = F.when((F.row_number().over(w) == 1) & F.col("_has").isNull(), 1).when(before.eqNullSafe(F.col(key)), 0).otherwise(1)
        t = t.withColumn("_new", started)
        starts = t.groupBy("_b").agg(F.sum("_new").alias("_n"))
        starts = starts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))
        marked = t.join(starts.select("_b", "_before"), "_b").withColumn("segment", F.col("_before") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("segment", key).agg(F.min(order[0]).alias("first_trace"), F.max(order[-1] if len(order) == 1 else order[0]).alias("last_trace"), F.count("*").alias("n"))


def folds(traces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold): traces at each gather."""
    return traces.groupBy(*keys).agg(F.count("*").alias("fold"))


def secondary_steps(traces: DataFrame, primary: str, secondary: str) -> DataFrame:
    """(primary, step): the smallest gap between neighbouring secondary keys, the last gap aside; null below three keys."""
    w = Window.partitionBy(primary).orderBy(secondary)
    keys = traces.select(primary, secondary).distinct()
    keys = keys.withColumn("gap", F.col(secondary) - F.lag(secondary).over(w)).withColumn("last", F.lead(secondary).over(w).isNull())
    return keys.groupBy(primary).agg(F.min(F.when(~F.col("last"), F.col("gap"))).alias("step"))


def places(rows: DataFrame, key: str, bucket: Column | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of ``key``, and their number ``places``.

    Counted within buckets, ``bucket`` being a non-decreasing function of the key, and added up over
    these, so that no task orders all rows.  Without one, 65,536 values of a whole-numbered key make a bucket.
    """
    first = F.lit(-(1 << 63))  # of null keys, which come first
    t = rows.withColumn("_b", F.coalesce(F.floor(F.col(key) / 65536) if bucket is None else bucket, first))
    w = Window.orderBy("_b")
    before = t.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("places"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return t.withColumn("_own", own).join(before, "_b").withColumn("place", (F.col("_before") + F.col("_own")).cast("long")).drop("_b", "_own", "_before")


def representative_segment(segs: DataFrame, order: str = "segment", bucket: Column | None = None) -> DataFrame:
    """The one segment with the best n * (1.5 - |i - N/2| / N), i its place among N; ties to the first.

    Segments that have no number get it by their place in ``order``, from 1.  ``bucket`` is as for ``places``.
    """
    placed = places(segs, order, bucket)
    if "segment" not in segs.columns:
        placed = placed.withColumn("segment", F.col("place") + 1)
    scored = placed.withColumn("score", F.col("n") * (1.5 - F.abs(F.col("place") - F.col("places") / 2.0) / F.col("places")))
    return scored.orderBy(F.col("score").desc(), "segment").limit(1).drop("place", "places")


def mean_spacing(traces: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """One row (dx, dy): the mean step of coordinates for each step of a key, by least squares."""
    return traces.agg((F.covar_pop(key, x) / F.var_pop(key)).alias("dx"), (F.covar_pop(key, y) / F.var_pop(key)).alias("dy"))


def azimuth_from_offsets(x: Column, y: Column) -> Column:
    """Compass azimuth, degrees clockwise from north, of an offset vector."""
    return F.pmod(450.0 - F.degrees(F.atan2(y, x)), F.lit(360.0))


def azimuth_from_header(v: Column, scale: Column, radians: bool = False) -> Column:
    scaled = v * scale
    return F.degrees(scaled) if radians else scaled


def coordinate_scale(scalar: Column) -> Column:
    """A header's coordinate scalar as a factor: negative divides, zero is one."""
    s = scalar.cast("double")
    return F.when(s < 0, 1.0 / F.abs(s)).when(s > 0, s).otherwise(1.0)


def last_of_duplicates(traces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of traces with equal keys the last one in file order."""
    return traces.groupBy(*keys).agg(F.max_by(F.struct(*traces.columns), F.col(order)).alias("t")).select("t.*")
