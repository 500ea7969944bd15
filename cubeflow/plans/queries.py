"""Registered queries of the array engine and their SQL equivalents.

Computed doubles leave through ``_r``: floor(x * 1e6 + 0.57) / 1e6, the same arithmetic in both
engines.  Prices in cents times weights in steps of 1/20 often end in quarters of 1e-6, so rounding
at a half would turn on the last bit of a sum's order; at 0.57 it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeflow.descriptor import Axis, Channel, Descriptor, Layout, MetadataItem
from cubeflow.functions import convert, coords
from cubeflow.functions.index import Indexer
from cubeflow.operators import bricks, interp, stats, subset
from cubeflow.plans import volumes as V
from cubeflow.plans.grid import Grid, chunk_grid
from cubeflow.sources import segy
from cubeflow.sources import volume as vol
from cubeflow.sources.paths import work_path
from cubeflow.streaming.ingest import BrickIngest

QUERIES: dict = {}
ORACLES: dict = {}

LIN_SQL = "lin AS (SELECT CAST(l_quantity AS BIGINT) - 1 AS d0, l_suppkey % 10 AS d1, l_partkey % 30 AS d2, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3)"
EMB_SQL = "emb AS (SELECT i - 1 AS d0, vec_id AS d1, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i))"
EVT_SQL = "evt AS (SELECT (epoch_us(ts) - 1704067200000000) // 3600000000 AS d0, user_id AS d1, max(value) AS value FROM events GROUP BY 1, 2)"
LOW, HIGH = (5, 2, 7), (45, 9, 25)
IN_SQL = "d0 >= 5 AND d0 < 45 AND d1 >= 2 AND d1 < 9 AND d2 >= 7 AND d2 < 25"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.57) / 1e6


def _rs(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.57) / 1e6"


# --- subsets ---


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, value FROM lin WHERE {IN_SQL}")
def subset_3d(spark: SparkSession, sf: str) -> DataFrame:
    return subset.subset(V.lin(spark, sf), LOW, HIGH, V.LIN_SHAPE)


GRID = Grid(V.LIN_SHAPE, (0, 1, 2), 8)


@query(ORACLES["subset_3d"])
def subset_bricked(spark, sf):
    return bricks.subset_bricked(bricks.to_bricks(V.lin(spark, sf), GRID), GRID, LOW, HIGH)


@query(f"WITH {LIN_SQL} SELECT d0, d1, value FROM lin WHERE d2 = 12")
def slice_inline(spark, sf):
    return subset.slice_at(V.lin(spark, sf), 2, 12)


@query(f"WITH {LIN_SQL} SELECT d1, d2, value FROM lin WHERE d0 = 30")
def slice_time(spark, sf):
    return subset.slice_at(V.lin(spark, sf), 0, 30)


@query(f"WITH {EMB_SQL} SELECT d0, d1, value FROM emb WHERE d0 >= 8 AND d0 < 40 AND d1 >= 100 AND d1 < 300")
def subset_2d(spark, sf):
    return subset.subset(V.emb(spark, sf), (8, 100), (40, 300))


_CELL = "(d0 & 1) + 2 * (d1 & 1) + 4 * (d2 & 1)"
_LOD1 = f"lod1 AS (SELECT d0 >> 1 AS d0, d1 >> 1 AS d1, d2 >> 1 AS d2, arg_min(value, {_CELL}) FILTER (value IS NOT NULL) AS value FROM lin GROUP BY 1, 2, 3)"


def _next(a: str, b: str) -> str:
    return _LOD1.replace("lod1", b).replace("FROM lin", f"FROM {a}")


@query(f"WITH {LIN_SQL}, {_LOD1} SELECT d0 - 2 AS d0, d1 - 1 AS d1, d2 - 3 AS d2, value FROM lod1 WHERE d0 >= 2 AND d0 < 22 AND d1 >= 1 AND d1 < 5 AND d2 >= 3 AND d2 < 12")
def subset_lod(spark, sf):
    return subset.subset_lod(subset.decimate(V.lin(spark, sf)), LOW, HIGH, 1)


@query(f"WITH {LIN_SQL}, {_LOD1}, {_next('lod1', 'lod2')}, {_next('lod2', 'lod3')} SELECT 1 AS lod, * FROM lod1 UNION ALL SELECT 2, * FROM lod2 UNION ALL SELECT 3, * FROM lod3")
def lod_pyramid(spark, sf):
    levels = subset.pyramid(V.lin(spark, sf), 3)
    out = [level.select(F.lit(k).alias("lod"), "d0", "d1", "d2", "value") for k, level in enumerate(levels) if k]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {LIN_SQL} SELECT d0 >> 1 AS d0, d1 >> 1 AS d1, d2 >> 1 AS d2, bool_or(value > 1500) AS value FROM lin GROUP BY 1, 2, 3")
def lod_1bit(spark, sf):
    return subset.decimate_bits(V.lin(spark, sf).withColumn("value", F.col("value") > 1500))


@query(f"WITH {LIN_SQL} SELECT d0, d1 >> 1 AS d1, d2 >> 1 AS d2, arg_min(value, 2 * (d1 & 1) + 4 * (d2 & 1)) FILTER (value IS NOT NULL) AS value FROM lin GROUP BY 1, 2, 3")
def lod_fullres_dim(spark, sf):
    return subset.decimate(V.lin(spark, sf), full_res_dim=0)


_GRID_SQL = "grid AS (SELECT a.i AS d0, b.i AS d1, c.i AS d2 FROM range(5, 45) a(i), range(2, 9) b(i), range(7, 25) c(i))"


@query(f"WITH {LIN_SQL}, {_GRID_SQL} SELECT d0, d1, d2, coalesce(value, -999.25::DOUBLE) AS value FROM grid LEFT JOIN lin USING (d0, d1, d2)")
def replace_novalue(spark, sf):
    return subset.densified(V.lin(spark, sf), LOW, HIGH, -999.25)


# --- conversion ---

RANGE = (900.0, 105000.0)


def _quantized_sql(top: int, sentinel: int) -> str:
    scale = (RANGE[1] - RANGE[0]) / top
    return f"WITH {LIN_SQL}, {_GRID_SQL} SELECT d0, d1, d2, coalesce(CASE WHEN value IS NOT NULL THEN CAST(floor(least(greatest((value - 900.0::DOUBLE) * {1.0 / scale!r}::DOUBLE, 0.0::DOUBLE), {top}.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) END, {sentinel}) AS value FROM grid LEFT JOIN lin USING (d0, d1, d2)"


def _quantized(spark, sf, fmt):
    d = subset.densified(V.lin(spark, sf), LOW, HIGH)
    return d.withColumn("value", convert.quantize(F.col("value"), fmt, *RANGE, use_novalue=True).cast("long"))


@query(_quantized_sql(254, 255))
def quantize_u8(spark, sf):
    return _quantized(spark, sf, "U8")


@query(_quantized_sql(65534, 65535))
def quantize_u16(spark, sf):
    return _quantized(spark, sf, "U16")


@query(f"WITH q AS ({_quantized_sql(254, 255)}) SELECT d0, d1, d2, {_rs(f'CASE WHEN value <> 255 THEN 900.0::DOUBLE + {(RANGE[1] - RANGE[0]) / 254!r}::DOUBLE * CAST(value AS DOUBLE) END')} AS value FROM q")
def dequantize(spark, sf):
    return _quantized(spark, sf, "U8").withColumn("value", _r(convert.dequantize(F.col("value"), "U8", *RANGE, use_novalue=True)))


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, CAST(floor(least(greatest(value / 100 - 50, 0.0::DOUBLE), 255.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS u8, CAST(floor(least(greatest(value / 100 - 50, -128.0::DOUBLE), 127.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS i8 FROM lin")
def float_to_int_saturating(spark, sf):
    v = F.col("value") / 100 - 50
    return V.lin(spark, sf).select("d0", "d1", "d2", convert.float_to_int(v, "U8").alias("u8"), convert.float_to_int(v, "I8").alias("i8"))


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, floor(value) % 2 <> 0 AS bit, CASE WHEN floor(value) % 2 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS back FROM lin")
def to_bool(spark, sf):
    bit = convert.to_bool(F.floor("value") % 2)
    return V.lin(spark, sf).select("d0", "d1", "d2", bit.alias("bit"), convert.from_bool(bit).alias("back"))


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, CAST(least(greatest(CAST(floor(value) AS BIGINT) - 20000, 0), 65535) AS BIGINT) AS u16 FROM lin")
def int_to_int_saturating(spark, sf):
    return V.lin(spark, sf).select("d0", "d1", "d2", convert.saturate(F.floor("value") - 20000, "U16").cast("long").alias("u16"))


# --- positions ---

N_POINTS = 400
_POS = "pos AS (SELECT id, 0.25::DOUBLE + (id * 37 % 491) / 10.0::DOUBLE AS p0, 0.25::DOUBLE + (id * 17 % 93) / 10.0::DOUBLE AS p1, 0.25::DOUBLE + (id * 29 % 293) / 10.0::DOUBLE AS p2 FROM range(400) r(id))"


def _positions(spark, dims=3):
    step = ((37, 491), (17, 93), (29, 293))
    return spark.range(N_POINTS).select("id", *[(F.lit(0.25) + (F.col("id") * a % m) / F.lit(10.0)).alias(f"p{d}") for d, (a, m) in enumerate(step[:dims])])


def _tap(d: int, off: int) -> str:
    return f"CAST(least(greatest(floor(p{d} - 0.5) + {off}, 0), {V.LIN_SHAPE[d] - 1}) AS BIGINT)"


_FR = ", ".join(f"p{d} - floor(p{d} - 0.5) - 0.5 AS f{d}" for d in range(3))
_NEAR = "near AS (SELECT id, value AS nv FROM pos LEFT JOIN lin ON d0 = CAST(floor(p0) AS BIGINT) AND d1 = CAST(floor(p1) AS BIGINT) AND d2 = CAST(floor(p2) AS BIGINT))"


def _taps(offsets: dict[int, str], dims: int = 3) -> str:
    """Rows (id, weight w, value v, o0, o1, o2) of a separable stencil."""
    axes = " ".join(f"CROSS JOIN (VALUES {', '.join(f'({o})' for o in offsets)}) t{d}(o{d})" for d in range(dims))
    weight = " * ".join("CASE " + " ".join(f"WHEN o{d} = {o} THEN {w.replace('f', f'f{d}')}" for o, w in offsets.items()) + " END" for d in range(dims))
    index = ", ".join(f"CAST(least(greatest(floor(p{d} - 0.5) + o{d}, 0), {V.LIN_SHAPE[d] - 1}) AS BIGINT) AS i{d}" for d in range(dims))
    outs = ", ".join(f"o{d}" for d in range(dims))
    join = " AND ".join(f"lin.d{d} = i{d}" for d in range(dims))
    return f"st AS (SELECT id, {outs}, {weight} AS w, {index} FROM (SELECT *, {_FR} FROM pos) p {axes}), taps AS (SELECT st.*, value AS v FROM st LEFT JOIN lin ON {join})"


_LINEAR = {0: "(1.0::DOUBLE - f)", 1: "f"}
_CUBIC = {-1: "(-0.5::DOUBLE * (f*f*f) + f*f - 0.5::DOUBLE * f)", 0: "(1.5::DOUBLE * (f*f*f) - 2.5::DOUBLE * (f*f) + 1.0::DOUBLE)", 1: "(-1.5::DOUBLE * (f*f*f) + 2.0::DOUBLE * (f*f) + 0.5::DOUBLE * f)", 2: "(0.5::DOUBLE * (f*f*f - f*f))"}


def _value_out(df):
    return df.withColumn("value", _r(F.col("value")))


@query(f"WITH {LIN_SQL}, {_POS}, {_NEAR} SELECT id, {_rs('nv')} AS value FROM near")
def samples_nearest(spark, sf):
    return _value_out(interp.samples(_positions(spark), V.lin(spark, sf), V.LIN_SHAPE, "nearest"))


@query(f"WITH {LIN_SQL}, {_POS}, {_NEAR}, {_taps(_LINEAR)}, s AS (SELECT id, sum(w * v) AS t, sum(w) FILTER (v IS NOT NULL) AS u FROM taps GROUP BY id) SELECT id, {_rs('CASE WHEN nv IS NOT NULL THEN t / u END')} AS value FROM s JOIN near USING (id)")
def samples_linear(spark, sf):
    return _value_out(interp.samples(_positions(spark), V.lin(spark, sf), V.LIN_SHAPE, "linear"))


@query(f"WITH {LIN_SQL}, {_POS}, {_NEAR}, {_taps(_CUBIC)}, ok AS (SELECT a.id, a.w, a.v FROM taps a JOIN taps c ON a.id = c.id AND c.o0 = least(greatest(a.o0, 0), 1) AND c.o1 = least(greatest(a.o1, 0), 1) AND c.o2 = least(greatest(a.o2, 0), 1) WHERE a.v IS NOT NULL AND c.v IS NOT NULL), s AS (SELECT id, sum(w * v) AS t, sum(w) AS u FROM ok GROUP BY id) SELECT id, {_rs('CASE WHEN nv IS NOT NULL THEN t / u END')} AS value FROM near LEFT JOIN s USING (id)")
def samples_cubic(spark, sf):
    return _value_out(interp.samples(_positions(spark), V.lin(spark, sf), V.LIN_SHAPE, "cubic"))


@query(f"WITH {LIN_SQL.replace('min(l_extendedprice)', 'min(l_extendedprice) % 360')}, {_POS}, {_NEAR}, {_taps(_LINEAR)}, s AS (SELECT id, sum(w * (v - floor((v - nv) / 360.0::DOUBLE + 0.5::DOUBLE) * 360.0::DOUBLE)) AS t, sum(w) FILTER (v IS NOT NULL) AS u, any_value(nv) AS nv FROM taps JOIN near USING (id) GROUP BY id) SELECT id, {_rs('CASE WHEN nv IS NOT NULL THEN t / u - floor(t / u / 360.0::DOUBLE) * 360.0::DOUBLE END')} AS value FROM s")
def samples_angular(spark, sf):
    volume = V.lin(spark, sf).withColumn("value", F.col("value") % 360)
    return _value_out(interp.samples(_positions(spark), volume, V.LIN_SHAPE, "angular", value_range=(0.0, 360.0)))


_CORNER = ", ".join(f"(SELECT value FROM lin WHERE d0 = {_tap(0, a)} AND d1 = {_tap(1, b)} AND d2 = CAST(floor(p2) AS BIGINT)) AS v{a}{b}" for a in (0, 1) for b in (0, 1))
_TRI = """CASE WHEN v10 IS NOT NULL AND v01 IS NOT NULL AND u <= 1.0 - v AND v00 IS NOT NULL THEN v00 + u * (v10 - v00) + v * (v01 - v00)
 WHEN v10 IS NOT NULL AND v01 IS NOT NULL AND u >= 1.0 - v AND v11 IS NOT NULL THEN v11 + (1.0 - u) * (v01 - v11) + (1.0 - v) * (v10 - v11)
 WHEN (v10 IS NULL OR v01 IS NULL) AND v00 IS NOT NULL AND v11 IS NOT NULL AND u >= v AND v10 IS NOT NULL THEN v10 + (1.0 - u) * (v00 - v10) + v * (v11 - v10)
 WHEN (v10 IS NULL OR v01 IS NULL) AND v00 IS NOT NULL AND v11 IS NOT NULL AND u <= v AND v01 IS NOT NULL THEN v01 + u * (v11 - v01) + (1.0 - v) * (v00 - v01)
 WHEN (v10 IS NULL OR v01 IS NULL) AND v00 IS NOT NULL AND u = 0 AND v = 0 THEN v00
 WHEN (v10 IS NULL OR v01 IS NULL) AND v00 IS NOT NULL AND u = 0 AND v01 IS NOT NULL THEN v00 + v * (v01 - v00)
 WHEN (v10 IS NULL OR v01 IS NULL) AND v00 IS NOT NULL AND v = 0 AND v10 IS NOT NULL THEN v00 + u * (v10 - v00) END"""


@query(f"WITH {LIN_SQL}, {_POS}, c AS (SELECT id, p0 - floor(p0 - 0.5) - 0.5 AS u, p1 - floor(p1 - 0.5) - 0.5 AS v, {_CORNER} FROM pos) SELECT id, {_rs(_TRI)} AS value FROM c")
def samples_triangular(spark, sf):
    return _value_out(interp.samples(_positions(spark), V.lin(spark, sf), V.LIN_SHAPE, "triangular"))


_HOLES = LIN_SQL.replace("min(l_extendedprice)", "CASE WHEN min(l_extendedprice) > 2000 THEN min(l_extendedprice) END")


@query(f"WITH {_HOLES}, {_POS}, {_NEAR}, {_taps(_LINEAR)}, s AS (SELECT id, sum(w * v) AS t, sum(w) FILTER (v IS NOT NULL) AS u FROM taps GROUP BY id) SELECT id, {_rs('coalesce(CASE WHEN nv IS NOT NULL THEN t / u END, -999.25::DOUBLE)')} AS value FROM s JOIN near USING (id)")
def samples_novalue_rule(spark, sf):
    holes = V.lin(spark, sf).withColumn("value", F.when(F.col("value") > 2000, F.col("value")))
    return _value_out(interp.samples(_positions(spark), holes, V.LIN_SHAPE, "linear", replacement=-999.25))


_POS20 = _POS.replace("range(400)", "range(20)")


def _trace_positions(spark):
    return _positions(spark).where("id < 20")


@query(f"WITH {LIN_SQL}, {_POS20} SELECT id, s AS sample, {_rs('value')} AS value FROM pos CROSS JOIN range(50) r(s) LEFT JOIN lin ON d0 = s AND d1 = CAST(floor(p1) AS BIGINT) AND d2 = CAST(floor(p2) AS BIGINT)")
def traces_nearest(spark, sf):
    return _value_out(interp.traces(_trace_positions(spark), V.lin(spark, sf), V.LIN_SHAPE, 0, "nearest"))


_LINES = "pos AS (SELECT id * 1000 + s AS id, s + 0.5::DOUBLE AS p0, p1, p2 FROM pos0 CROSS JOIN range(50) r(s))"


@query(f"WITH {LIN_SQL}, {_POS20.replace('pos AS', 'pos0 AS')}, {_LINES}, {_NEAR}, {_taps(_LINEAR)}, s AS (SELECT id, sum(w * v) AS t, sum(w) FILTER (v IS NOT NULL) AS u FROM taps GROUP BY id) SELECT id // 1000 AS id, id % 1000 AS sample, {_rs('CASE WHEN nv IS NOT NULL THEN t / u END')} AS value FROM s JOIN near USING (id)")
def traces_linear(spark, sf):
    return _value_out(interp.traces(_trace_positions(spark), V.lin(spark, sf), V.LIN_SHAPE, 0, "linear"))


@query(f"WITH {LIN_SQL}, {_LOD1}, {_POS20} SELECT id, s AS sample, {_rs('value')} AS value FROM pos CROSS JOIN range(25) r(s) LEFT JOIN lod1 ON d0 = s AND d1 = CAST(floor(p1 / 2) AS BIGINT) AND d2 = CAST(floor(p2 / 2) AS BIGINT)")
def traces_lod(spark, sf):
    return _value_out(interp.traces(_trace_positions(spark), subset.decimate(V.lin(spark, sf)), (25, 5, 15), 0, "nearest", lod=1))


PLANE = (1.0, 2.0, 4.0, -70.0)


@query(f"WITH {LIN_SQL}, pos AS (SELECT a.i * 100 + b.i AS id, a.i + 0.5::DOUBLE AS p0, b.i + 0.5::DOUBLE AS p1, least(greatest((-70.0::DOUBLE + 1.0::DOUBLE * (a.i + 0.5::DOUBLE) + 2.0::DOUBLE * (b.i + 0.5::DOUBLE)) / -4.0::DOUBLE, 0.5::DOUBLE), 29.5::DOUBLE) AS p2 FROM range(5, 45) a(i), range(2, 9) b(i)), {_NEAR}, {_taps(_LINEAR)}, s AS (SELECT id, sum(w * v) AS t, sum(w) FILTER (v IS NOT NULL) AS u FROM taps GROUP BY id) SELECT id // 100 - 5 AS d0, id % 100 - 2 AS d1, {_rs('CASE WHEN nv IS NOT NULL THEN t / u END')} AS value FROM s JOIN near USING (id)")
def project_plane(spark, sf):
    return _value_out(interp.project(V.lin(spark, sf), V.LIN_SHAPE, PLANE, 2, LOW, HIGH, "linear"))


@query(f"WITH {LIN_SQL}, w AS (SELECT i AS id, i * 7 % 50 AS d0, i * 3 % 10 AS d1, i * 11 % 30 AS d2 FROM range(300) r(i)) SELECT id, d0, d1, d2, value FROM w LEFT JOIN lin USING (d0, d1, d2)")
def accessor_points(spark, sf):
    wanted = spark.range(300).select("id", (F.col("id") * 7 % 50).alias("d0"), (F.col("id") * 3 % 10).alias("d1"), (F.col("id") * 11 % 30).alias("d2"))
    return interp.points(V.lin(spark, sf), wanted)


@query(f"WITH {LIN_SQL}, w AS (SELECT i AS d0, i % 10 AS d1, i % 30 AS d2, -1.0::DOUBLE * i AS nv FROM range(50) r(i)) SELECT coalesce(lin.d0, w.d0) AS d0, coalesce(lin.d1, w.d1) AS d1, coalesce(lin.d2, w.d2) AS d2, coalesce(nv, value) AS value FROM lin FULL JOIN w ON lin.d0 = w.d0 AND lin.d1 = w.d1 AND lin.d2 = w.d2")
def accessor_update(spark, sf):
    changes = spark.range(50).select(F.col("id").alias("d0"), (F.col("id") % 10).alias("d1"), (F.col("id") % 30).alias("d2"), (F.lit(-1.0) * F.col("id")).alias("value"))
    return interp.updated(V.lin(spark, sf), changes)


# --- chunks ---

_CH = "(d0 // 8) + (d1 // 8) * 7 + (d2 // 8) * 14"


@query("""SELECT c AS chunk, c % 7 AS b0, c // 7 % 2 AS b1, c // 14 AS b2,
 c % 7 * 8 AS min0, c // 7 % 2 * 8 AS min1, c // 14 * 8 AS min2,
 least(c % 7 * 8 + 8, 50) AS max0, least(c // 7 % 2 * 8 + 8, 10) AS max1, least(c // 14 * 8 + 8, 30) AS max2,
 greatest(c % 7 * 8 - 2, 0) AS low0, greatest(c // 7 % 2 * 8 - 2, 0) AS low1, greatest(c // 14 * 8 - 2, 0) AS low2,
 least(c % 7 * 8 + 9, 50) AS high0, least(c // 7 % 2 * 8 + 9, 10) AS high1, least(c // 14 * 8 + 9, 30) AS high2,
 (least(c % 7 * 8 + 8, 50) - c % 7 * 8) * (least(c // 7 % 2 * 8 + 8, 10) - c // 7 % 2 * 8) * (least(c // 14 * 8 + 8, 30) - c // 14 * 8) AS samples
 FROM range(56) r(c)""")
def chunk_grids(spark, sf):
    return chunk_grid(spark, Grid(V.LIN_SHAPE, (0, 1, 2), 8, neg_margin=2, pos_margin=1))


@query(f"""WITH {LIN_SQL}, g AS (SELECT c % 7 AS b0, c // 7 % 2 AS b1, c // 14 AS b2, c AS chunk FROM range(56) r(c))
 SELECT chunk, d0, d1, d2, value, d0 // 8 = b0 AND d1 // 8 = b1 AND d2 // 8 = b2 AS inside FROM lin JOIN g
 ON d0 >= b0 * 8 - 2 AND d0 < b0 * 8 + 9 AND d1 >= b1 * 8 - 2 AND d1 < b1 * 8 + 9 AND d2 >= b2 * 8 - 2 AND d2 < b2 * 8 + 9""")
def chunk_neighbors_margin(spark, sf):
    return bricks.with_halo(V.lin(spark, sf), Grid(V.LIN_SHAPE, (0, 1, 2), 8, neg_margin=2, pos_margin=1))


_STATS = f"st AS (SELECT {_CH} AS chunk, count(*) AS n, count(value) AS n_values, min(value) AS lo, max(value) AS hi FROM lin GROUP BY 1)"


@query(f"WITH {LIN_SQL}, {_STATS} SELECT * FROM st")
def chunk_stats(spark, sf):
    return bricks.chunk_stats(V.lin(spark, sf), GRID)


def _steps(spark, sf):
    return V.lin(spark, sf).withColumn("value", F.when(F.col("d2") >= 8, F.when(F.col("d2") < 16, F.lit(3.5)).otherwise(F.col("value"))))


_STEPS = LIN_SQL.replace("min(l_extendedprice)", "CASE WHEN l_partkey % 30 >= 8 THEN CASE WHEN l_partkey % 30 < 16 THEN 3.5::DOUBLE ELSE min(l_extendedprice) END END")


@query(f"WITH {_STEPS}, {_STATS} SELECT chunk, lo AS value FROM st WHERE n_values > 0 AND lo = hi")
def constant_chunks(spark, sf):
    return bricks.chunk_stats(_steps(spark, sf), GRID).where(bricks.is_constant()).select("chunk", F.col("lo").alias("value"))


@query(f"WITH {_STEPS}, {_STATS} SELECT chunk FROM st WHERE n_values = 0")
def sparse_chunks(spark, sf):
    return bricks.chunk_stats(_steps(spark, sf), GRID).where(bricks.is_novalue()).select("chunk")


_TILES = Grid(V.LIN_SHAPE, (0, 2), 16)


@query(f"WITH {LIN_SQL} SELECT (d0 // 16) + d1 * 4 + (d2 // 16) * 40 AS chunk, count(*) AS n, min(value) AS lo, max(value) AS hi FROM lin GROUP BY 1")
def rebrick_dims(spark, sf):
    return bricks.rebrick(bricks.to_bricks(V.lin(spark, sf), GRID), GRID, _TILES).select("chunk", "n", "lo", "hi")


def _border(spark, mode):
    return spark.range(-40, 90).select(F.col("id").alias("i"), bricks.border_index(F.col("id"), 30, mode).alias("source"))


@query("SELECT i, CASE WHEN abs(i) % 60 >= 30 THEN 60 - abs(i) % 60 - 1 ELSE abs(i) % 60 END AS source FROM range(-40, 90) r(i)")
def border_mirror(spark, sf):
    return _border(spark, "mirror")


@query("SELECT i, least(greatest(i, 0), 29) AS source FROM range(-40, 90) r(i)")
def border_repeat(spark, sf):
    return _border(spark, "repeat")


@query("SELECT i, CASE WHEN i >= 0 AND i < 30 THEN i END AS source FROM range(-40, 90) r(i)")
def border_clear(spark, sf):
    return _border(spark, "clear")


@query("""WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS a, row_number() OVER (ORDER BY l_extendedprice DESC) AS b, count(*) OVER () AS n FROM lineitem),
 k AS (SELECT *, CAST(floor((100.0::DOUBLE - 99.5::DOUBLE) / 100.0::DOUBLE * n / 2.0::DOUBLE) AS BIGINT) + 1 AS k FROM o)
 SELECT max(v) FILTER (a = k) AS range_min, max(v) FILTER (b = k) AS range_max, 0::BIGINT AS nan_count FROM k""")
def value_range_percentile(spark, sf):
    return stats.value_range(V.read(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value")))


@query(f"WITH {LIN_SQL} SELECT (d1 // 8) + (d2 // 8) * 2 AS chunk, count(*) AS n FROM lin WHERE d0 = 0 GROUP BY 1")
def mapped_chunk(spark, sf):
    chunk = F.floor(GRID.chunk_column() / F.lit(GRID.counts[0]))
    return V.lin(spark, sf).where("d0 = 0").groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"))


@query(f"WITH {EVT_SQL} SELECT d0, d1, value, n, lo, hi FROM evt JOIN (SELECT user_id AS d1, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (d1)")
def per_trace_channel(spark, sf):
    return subset.per_trace(V.evt(spark, sf), V.user_traces(spark, sf))


@query(f"WITH {LIN_SQL}, a AS (SELECT {_CH} AS chunk FROM lin WHERE d2 < 20 GROUP BY 1), b AS (SELECT {_CH} AS chunk FROM lin GROUP BY 1), p AS (SELECT {_CH} AS chunk FROM lin WHERE d2 >= 20 GROUP BY 1) SELECT chunk FROM b WHERE chunk IN (SELECT chunk FROM p) OR chunk NOT IN (SELECT chunk FROM a)")
def incremental_copy(spark, sf):
    volume = V.lin(spark, sf)
    return bricks.changed(bricks.to_bricks(volume, GRID), bricks.to_bricks(volume.where("d2 < 20"), GRID)).select("chunk")


@query(f"WITH {LIN_SQL}, a AS (SELECT DISTINCT {_CH} AS chunk FROM lin WHERE d2 < 20) SELECT DISTINCT {_CH} AS chunk FROM lin WHERE {_CH} NOT IN (SELECT chunk FROM a)")
def resume_missing(spark, sf):
    volume = V.lin(spark, sf)
    return bricks.missing(bricks.to_bricks(volume, GRID), bricks.to_bricks(volume.where("d2 < 20"), GRID)).select("chunk")


# --- coordinates ---

TRANSFORM = coords.Transformer(V.LIN.axes, (400000.0, 6500000.0, 0.0), (12.5, 3.25, 0.0), (-3.25, 12.5, 0.0), (0.0, 0.0, -4.0))


@query("SELECT i, 1000.0::DOUBLE + i * 5.0::DOUBLE AS inline_no, 0.0::DOUBLE + i * 2.0::DOUBLE AS ms FROM range(30) r(i)")
def index_to_coord(spark, sf):
    i = F.col("id")
    return spark.range(30).select(i.alias("i"), coords.index_to_coordinate(i, V.LIN.axes[2]).alias("inline_no"), coords.index_to_coordinate(i, V.LIN.axes[0]).alias("ms"))


@query(f"SELECT i, CAST(floor((990.0::DOUBLE + i - 1000.0::DOUBLE) / 145.0::DOUBLE * 29.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS idx, {_rs('(990.0::DOUBLE + i - 1000.0::DOUBLE) / 145.0::DOUBLE * 29.0::DOUBLE + 0.5::DOUBLE')} AS position FROM range(170) r(i)")
def coord_to_index(spark, sf):
    c = F.lit(990.0) + F.col("id")
    return spark.range(170).select(F.col("id").alias("i"), coords.coordinate_to_index(c, V.LIN.axes[2]).alias("idx"), _r(coords.coordinate_to_position(c, V.LIN.axes[2])).alias("position"))


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, {_rs('400000.0::DOUBLE + d2 * 12.5::DOUBLE + d1 * -3.25::DOUBLE')} AS x, {_rs('6500000.0::DOUBLE + d2 * 3.25::DOUBLE + d1 * 12.5::DOUBLE')} AS y, {_rs('d0 * -4.0::DOUBLE')} AS z FROM lin")
def voxel_to_world(spark, sf):
    xyz = TRANSFORM.voxel_to_world({d: F.col(f"d{d}") for d in range(3)})
    return V.lin(spark, sf).select("d0", "d1", "d2", *[_r(c).alias(n) for c, n in zip(xyz, "xyz")])


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, d0 AS v0, d1 AS v1, d2 AS v2, 1000.0::DOUBLE + d2 * 5.0::DOUBLE AS inline_no FROM lin")
def world_to_voxel(spark, sf):
    world = TRANSFORM.voxel_to_world({d: F.col(f"d{d}") for d in range(3)})
    ijk = TRANSFORM.position_to_index(TRANSFORM.world_to_ijk(world))
    voxel = TRANSFORM.ijk_to_voxel(ijk)
    return V.lin(spark, sf).select("d0", "d1", "d2", *[voxel[d].alias(f"v{d}") for d in range(3)], TRANSFORM.ijk_to_annotation(ijk)[0].alias("inline_no"))


# --- trace keys ---

_HDR = "hdr AS (SELECT l_orderkey AS pkey, CAST(l_linenumber AS BIGINT) AS skey, l_suppkey AS off, l_partkey AS part, l_extendedprice AS price, l_quantity AS qty FROM lineitem)"
_SEG = "seg AS (SELECT row_number() OVER (ORDER BY pkey) AS segment, pkey, count(*) AS n FROM hdr GROUP BY pkey)"


@query(f"WITH {_HDR}, {_SEG} SELECT segment, pkey, n FROM seg")
def segment_scan(spark, sf):
    t = V.hdr(spark, sf)
    return stats.segments(t, "pkey", ["pkey", "skey", "off", "part", "price", "qty"], bucket=F.floor(F.col("pkey") / 1024)).select("segment", "pkey", "n")


@query(f"WITH {_HDR}, k AS (SELECT DISTINCT pkey, skey FROM hdr), g AS (SELECT pkey, skey - lag(skey) OVER w AS gap, lead(skey) OVER w IS NULL AS last FROM k WINDOW w AS (PARTITION BY pkey ORDER BY skey)), f AS (SELECT pkey, max(fold) AS fold FROM (SELECT pkey, skey, count(*) AS fold FROM hdr GROUP BY 1, 2) GROUP BY 1) SELECT pkey, fold, min(gap) FILTER (NOT last) AS step FROM f JOIN g USING (pkey) GROUP BY pkey, fold")
def fold_and_steps(spark, sf):
    t = V.hdr(spark, sf)
    return stats.folds(t, ["pkey", "skey"]).groupBy("pkey").agg(F.max("fold").alias("fold")).join(stats.secondary_steps(t, "pkey", "skey"), "pkey")


@query(f"WITH {_HDR}, {_SEG}, s AS (SELECT segment, pkey, n, n * (1.5::DOUBLE - abs((segment - 1) - (SELECT count(*) FROM seg) / 2.0::DOUBLE) / (SELECT count(*) FROM seg)) AS score FROM seg) SELECT segment, pkey, n, {_rs('score')} AS score FROM s ORDER BY s.score DESC, segment LIMIT 1")
def representative_segment(spark, sf):
    t = V.hdr(spark, sf).groupBy("pkey").agg(F.count("*").alias("n"))
    return stats.representative_segment(t, "pkey").select("segment", "pkey", "n", _r(F.col("score")).alias("score"))


@query(f"WITH {_HDR} SELECT pkey, skey, off, part, price, qty, {_rs('(450.0::DOUBLE - degrees(atan2(part - 500.0::DOUBLE, off - 50.0::DOUBLE))) % 360.0::DOUBLE')} AS azimuth FROM hdr")
def azimuth_compass(spark, sf):
    return V.hdr(spark, sf).withColumn("azimuth", _r(stats.azimuth_from_offsets(F.col("off") - 50.0, F.col("part") - 500.0)))


@query(f"WITH {_HDR} SELECT pkey, skey, max(price * 100000 + qty) AS v FROM hdr GROUP BY 1, 2")
def offset_sorted_dedup(spark, sf):
    t = V.hdr(spark, sf).withColumn("v", F.col("price") * 100000 + F.col("qty"))
    return stats.last_of_duplicates(t, ["pkey", "skey"], "v").select("pkey", "skey", "v")


@query(f"WITH {EVT_SQL}, t AS (SELECT DISTINCT d1 FROM evt), g AS (SELECT d1, i AS d0 FROM t, range(720) r(i)) SELECT d0, d1, value FROM g LEFT JOIN evt USING (d0, d1)")
def trace_view(spark, sf):
    return subset.from_traces(subset.to_traces(V.evt(spark, sf), 720)).select("d0", "d1", "value")


_OFF = f"{_HDR}, o AS (SELECT pkey, skey * 10 AS off, row_number() OVER (PARTITION BY pkey ORDER BY skey, off, part, price, qty) - 1 AS i, count(*) OVER (PARTITION BY pkey) AS n FROM hdr), f AS (SELECT max(n) AS fold FROM o), l AS (SELECT off, row_number() OVER (ORDER BY off) - 1 AS w FROM (SELECT DISTINCT off FROM o))"


@query(f"WITH {_OFF}, s AS (SELECT pkey, off, i, n, max(w - i) OVER (PARTITION BY pkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM o JOIN l USING (off)) SELECT pkey, off, i AS trace, i + least(fold - n, greatest(0, m)) AS slot FROM s, f")
def gather_respacing(spark, sf):
    w = Window.partitionBy("pkey").orderBy("skey", "off", "part", "price", "qty")
    t = V.hdr(spark, sf).withColumn("trace", (F.row_number().over(w) - 1).cast("long")).select("pkey", (F.col("skey") * 10).alias("offset"), "trace")
    fold = t.groupBy("pkey").count().agg(F.max("count")).first()[0]
    offsets = t.select("offset").distinct().withColumn("place", F.row_number().over(Window.orderBy("offset")) - 1)
    return segy.respaced(t, fold, offsets, keys=("pkey",)).select("pkey", F.col("offset").alias("off"), "trace", "slot")


# --- trace files ---


def _emb_traces(spark, sf):
    """A trace for each embedding, ten to an inline."""
    t = V.read(spark, sf, "embeddings")
    i, x = F.floor(F.col("vec_id") / 10), F.col("vec_id") % 10
    fields = {"inlinenumber": i, "crosslinenumber": x, "offset": -i, "coordinatescale": F.lit(-100), "ensemblex": F.col("vec_id") * 250, "ensembley": F.lit(-50), "mutestart": x - 5}
    return t.select(F.col("vec_id").alias("trace"), segy.header_column(fields).alias("header"), F.col("embedding").alias("samples"))


_FIELDS = "CAST(vec_id // 10 AS BIGINT) AS inline_no, CAST(vec_id % 10 AS BIGINT) AS crossline_no, CAST(-(vec_id // 10) AS BIGINT) AS offset_no, vec_id % 10 - 5 AS mute"


@query(f"SELECT vec_id AS trace, {_FIELDS}, vec_id * 2.5::DOUBLE AS x, -0.5::DOUBLE AS y FROM embeddings")
def segy_header_fields(spark, sf):
    get = lambda name: segy.header_field(F.col("header"), *segy.TRACE_FIELDS[name])
    scale = stats.coordinate_scale(get("coordinatescale"))
    return _emb_traces(spark, sf).select("trace", get("inlinenumber").alias("inline_no"), get("crosslinenumber").alias("crossline_no"), get("offset").alias("offset_no"), get("mutestart").alias("mute"), (get("ensemblex") * scale).alias("x"), (get("ensembley") * scale).alias("y"))


@query("SELECT i - 1 AS d0, vec_id % 10 AS d1, vec_id // 10 AS d2, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)")
def segy_roundtrip(spark, sf):
    """Written as a file of IEEE samples, scanned, placed by its keys and read back as a volume."""
    path = f"{work_path(spark, 'segy')}.segy"
    segy.write_traces(_emb_traces(spark, sf), path, format=5, interval=4000, text="C01 EMBEDDINGS")
    _, voxels, _ = segy.imported(spark, path, segy.ImportOptions(brick_log2=5, ignore_warnings=True))
    return voxels.select("d0", "d1", "d2", F.col("value").cast("double").alias("value"))


_BITS = "b AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_orderkey * 2654435761 + l_linenumber * 40503 + l_partkey) % 4294967296 AS bits FROM lineitem)"


@query(f"WITH {_BITS}, m AS (SELECT *, CAST(bits & 16777215 AS DOUBLE) AS mant, (bits >> 24) & 127 AS ex, bits >> 31 AS neg FROM b WHERE ((bits >> 24) & 127) BETWEEN 56 AND 72) SELECT DISTINCT bits, CASE WHEN neg = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * mant * pow(2.0::DOUBLE, 4.0::DOUBLE * (ex - 64) - 24.0::DOUBLE) AS value FROM m")
def ibm_float(spark, sf):
    bits = F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503 + F.col("l_partkey"), F.lit(1 << 32))
    b = V.read(spark, sf, "lineitem").select(bits.alias("bits")).where(F.shiftright("bits", 24).bitwiseAND(F.lit(127)).between(56, 72)).distinct()
    return b.select("bits", segy.ibm_column(F.col("bits")).alias("value"))


@query("SELECT vec_id % 10 AS secondary, vec_id // 10 AS segment_key, 10::BIGINT AS n FROM embeddings WHERE vec_id % 10 = 0")
def segy_segments(spark, sf):
    headers = segy.trace_headers(_emb_traces(spark, sf), segy.ImportOptions())
    segs = segy.scan_segments(headers, run=64)
    return segs.select((F.col("first_trace") % 10).alias("secondary"), F.col("primary").alias("segment_key"), "n")


# --- datasets ---


def _dataset(spark, sf) -> vol.Volume:
    axes = tuple(Axis(n, name, "m", 0, n - 1) for n, name in zip(V.LIN_SHAPE, ("Sample", "Crossline", "Inline")))
    d = Descriptor(axes, (Channel("Amplitude", "R64", range_min=RANGE[0], range_max=RANGE[1], use_novalue=True, novalue=-999.25),), Layout(brick_log2=5, lods=2))
    items = [MetadataItem("SurveyCoordinateSystem", "Origin", "DoubleVector2", (1.0, 2.0)), MetadataItem("Import", "Name", "String", "lineitem")]
    v = vol.Volume.create(spark, work_path(spark, "volume"), d, items)
    v.write(V.lin(spark, sf))
    return v


@query(f"WITH {LIN_SQL} SELECT d0 - 5 AS d0, d1 - 2 AS d1, d2 - 7 AS d2, value FROM lin WHERE {IN_SQL}")
def dataset_subset(spark, sf):
    """Created, written, opened again and read through the brick pruning of the request API."""
    return vol.Volume.open(spark, _dataset(spark, sf).path).subset(LOW, HIGH)


@query(f"WITH {LIN_SQL}, {_LOD1}, {_next('lod1', 'lod2')} SELECT d0 - 1 AS d0, d1, d2 - 1 AS d2, value FROM lod2 WHERE d0 >= 1 AND d0 < 11 AND d1 < 2 AND d2 >= 1 AND d2 < 6")
def dataset_subset_lod(spark, sf):
    return _dataset(spark, sf).subset(LOW, HIGH, lod=2).select("d0", "d1", "d2", "value")


@query(ORACLES["samples_linear"])
def dataset_samples(spark, sf):
    return _value_out(_dataset(spark, sf).samples(_positions(spark), method="linear"))


@query(ORACLES["project_plane"])
def dataset_project(spark, sf):
    return _value_out(_dataset(spark, sf).project(PLANE, 2, LOW, HIGH))


@query(ORACLES["subset_3d"])
def dataset_copy(spark, sf):
    """Copied with other bricks, then read whole and cut."""
    copy = _dataset(spark, sf).copy_to(work_path(spark, "copy"), layout={"brick_log2": 6, "lods": 0})
    return subset.subset(copy.voxels(), LOW, HIGH).select("d0", "d1", "d2", "value")


@query(f"WITH {LIN_SQL} SELECT 'Amplitude' AS channel, '012' AS dims, 0 AS lod, 'Normal' AS status, 2::BIGINT AS chunks, 2::BIGINT AS valid_chunks, count(*) AS samples FROM lin")
def dataset_layers(spark, sf):
    return _dataset(spark, sf).layers().where("lod = 0").select("channel", "dims", "lod", "status", "chunks", "valid_chunks", "samples")


@query(f"WITH {LIN_SQL}, up AS (SELECT d0, d1, d2, CASE WHEN d0 < 3 AND d1 < 3 THEN value * 2.0::DOUBLE ELSE value END AS value FROM lin), {_next('up', 'l1')}, {_next('l1', 'l2')} SELECT 0 AS lod, * FROM up UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2")
def update_lod(spark, sf):
    """Voxels set in a stored volume; its levels of detail follow."""
    v = _dataset(spark, sf)
    v.update(V.lin(spark, sf).where("d0 < 3 AND d1 < 3").withColumn("value", F.col("value") * 2))
    names = ["d0", "d1", "d2", "value"]
    levels = [v.voxels(0, lod).select(F.lit(lod).alias("lod"), *names) for lod in range(3)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def _typed_dataset(spark, channel: Channel, voxels: DataFrame) -> vol.Volume:
    axes = tuple(Axis(n, name, "m", 0, n - 1) for n, name in zip(V.LIN_SHAPE, ("Sample", "Crossline", "Inline")))
    v = vol.Volume.create(spark, work_path(spark, "typed"), Descriptor(axes, (channel,), Layout(brick_log2=5)))
    v.write(voxels)
    return v


_CELL3 = "CAST(l_quantity AS BIGINT) - 1 AS d0, l_suppkey % 10 AS d1, l_partkey % 30 AS d2"


@query(f"WITH u AS (SELECT {_CELL3}, max(l_orderkey) AS k FROM lineitem GROUP BY 1, 2, 3) SELECT d0 - 5 AS d0, d1 - 2 AS d1, d2 - 7 AS d2, CAST(CAST(k AS HUGEINT) * 9223372036854 + 9007199254740993 AS VARCHAR) AS value FROM u WHERE {IN_SQL}")
def samples_u64(spark, sf):
    """Integers of 64 bits, beyond what a double holds, stored and read by their type."""
    number = F.max("l_orderkey").cast("decimal(20,0)") * F.lit(9223372036854).cast("decimal(20,0)") + F.lit(9007199254740993)
    cells = V.read(spark, sf, "lineitem").groupBy(*V.lin_cell()).agg(number.cast("decimal(20,0)").alias("value"))
    v = _typed_dataset(spark, Channel("Number", "U64"), cells)
    return v.subset(LOW, HIGH).select("d0", "d1", "d2", F.col("value").cast("string").alias("value"))


@query(f"WITH u AS (SELECT {_CELL3}, min(l_extendedprice) AS c0, max(l_extendedprice) AS c1 FROM lineitem GROUP BY 1, 2, 3) SELECT d0 - 5 AS d0, d1 - 2 AS d1, d2 - 7 AS d2, c0, c1 FROM u WHERE {IN_SQL}")
def subset_components(spark, sf):
    """A channel of two components."""
    pair = F.struct(F.min("l_extendedprice").alias("c0"), F.max("l_extendedprice").alias("c1"))
    cells = V.read(spark, sf, "lineitem").groupBy(*V.lin_cell()).agg(pair.alias("value"))
    v = _typed_dataset(spark, Channel("Pair", "R64", components=2), cells)
    return v.subset(LOW, HIGH).select("d0", "d1", "d2", "value.c0", "value.c1")


@query("WITH t AS (SELECT user_id AS d1, [CAST(count(*) AS DOUBLE), min(value), max(value)] AS v FROM events GROUP BY 1) SELECT i - 1 AS d0, d1 - 2 AS d1, v[i] AS value FROM t, range(2, 4) r(i) WHERE d1 >= 2")
def subset_per_trace(spark, sf):
    """A region of a channel that has three values for each trace."""
    users = V.read(spark, sf, "events").agg(F.max("user_id")).first()[0] + 1
    d = Descriptor((Axis(720, "Hour", "h", 0, 719), Axis(users, "User", "", 0, users - 1)), (Channel("Value", "R64"), Channel("Stats", "R64", mapping="PerTrace", mapped_values=3)), Layout(brick_log2=5))
    v = vol.Volume.create(spark, work_path(spark, "traces"), d)
    v.write_traces(V.user_traces(spark, sf).select("d1", F.array(F.col("n").cast("double"), "lo", "hi").alias("values")), "Stats")
    return v.subset((1, 2), (3, users), channel="Stats").select((F.col("d0") + 1).alias("d0"), "d1", "value")


# --- a volume that grows with its tables: quantity x supplier x part ---

_BIG = "big AS (SELECT CAST(l_quantity AS BIGINT) - 1 AS d0, l_suppkey AS d1, l_partkey AS d2, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT max(l_suppkey) + 1 AS n1, max(l_partkey) + 1 AS n2 FROM lineitem)"


def _big_dataset(spark, sf, lods: int = 0) -> vol.Volume:
    cells, shape = V.big(spark, sf)
    axes = tuple(Axis(n, name, "", 0, n - 1) for n, name in zip(shape, ("Quantity", "Supplier", "Part")))
    v = vol.Volume.create(spark, work_path(spark, "big"), Descriptor(axes, (Channel("Price", "R64", use_novalue=True, novalue=-999.25),), Layout(brick_log2=6, lods=lods)))
    v.write(cells)
    return v


@query(f"WITH {_BIG} SELECT d0 - 5 AS d0, d1 - n1 // 4 AS d1, d2 - n2 // 4 AS d2, value FROM big, s WHERE d0 >= 5 AND d0 < 45 AND d1 >= n1 // 4 AND d1 < n1 - n1 // 4 AND d2 >= n2 // 4 AND d2 < n2 - n2 // 4")
def big_subset(spark, sf):
    v = _big_dataset(spark, sf)
    _, n1, n2 = v.descriptor.shape
    return v.subset((5, n1 // 4, n2 // 4), (45, n1 - n1 // 4, n2 - n2 // 4))


@query(f"WITH {_BIG}, {_next('big', 'l1')} SELECT d0, d1, d2, value FROM l1")
def big_lod(spark, sf):
    return _big_dataset(spark, sf, 1).voxels(0, 1)


@query(f"WITH {_BIG}, p AS (SELECT id, id * 7 % n1 AS d1, id * 131 % n2 AS d2 FROM s, range(64) r(id)) SELECT id, k AS sample, value FROM p CROSS JOIN range(50) g(k) LEFT JOIN big ON big.d0 = k AND big.d1 = p.d1 AND big.d2 = p.d2")
def big_traces(spark, sf):
    v = _big_dataset(spark, sf)
    _, n1, n2 = v.descriptor.shape
    at = lambda step, n: (F.col("id") * step % n + 0.5).alias
    return v.traces(spark.range(64).select("id", F.lit(0.5).alias("p0"), at(7, n1)("p1"), at(131, n2)("p2")), method="nearest")


_META = "m(category, name, type, number) AS (VALUES ('Trace', 'fold', 'Int', 3), ('Trace', 'step', 'Int', 5), ('Import', 'fold', 'Int', 7), ('Import', 'code', 'Int', 9))"
_META2 = "m2(category, name, type, number) AS (VALUES ('Trace', 'fold', 'Int', 30), ('Trace', 'new', 'Int', 40), ('Other', 'x', 'Int', 50))"


def _meta(spark, rows):
    return vol.metadata_frame(spark, [MetadataItem(c, n, "Int", v) for c, n, v in rows])


def _first(spark):
    return _meta(spark, [("Trace", "fold", 3), ("Trace", "step", 5), ("Import", "fold", 7), ("Import", "code", 9)])


@query(f"WITH {_META} SELECT category, name, type, number FROM m WHERE category = 'Trace'")
def metadata_select(spark, sf):
    return vol.select_metadata(_first(spark), "Trace").select("category", "name", "type", F.col("int_v")[0].alias("number"))


@query(f"WITH {_META}, {_META2}, c AS (SELECT * FROM m2 WHERE category = 'Trace' UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.category = 'Trace' AND m2.category = m.category AND m2.name = m.name)) SELECT * FROM c WHERE NOT (category = 'Import' AND name = 'code')")
def metadata_copy_clear(spark, sf):
    other = _meta(spark, [("Trace", "fold", 30), ("Trace", "new", 40), ("Other", "x", 50)])
    out = vol.clear_metadata(vol.copy_metadata(_first(spark), other, "Trace"), "Import", "code")
    return out.select("category", "name", "type", F.col("int_v")[0].alias("number"))


@query(f"WITH {LIN_SQL} SELECT d0, d1, d2, d0 - 14 AS l0, d1 AS l1, d2 AS l2, (d0 - 14) + d1 * 11 + d2 * 110 AS at, d0 >= 16 AND d0 < 24 AND d1 < 8 AND d2 < 8 AS inside FROM lin WHERE d0 >= 14 AND d0 < 25 AND d1 < 9 AND d2 < 9")
def index_algebra(spark, sf):
    x = Indexer(Grid(V.LIN_SHAPE, (0, 1, 2), 8, neg_margin=2, pos_margin=1), 2)
    voxel = [F.col(f"d{d}") for d in range(3)]
    local = x.voxel_to_local(voxel)
    rows = V.lin(spark, sf).where(x.local_in_process_area(local))
    return rows.select("d0", "d1", "d2", *[c.alias(f"l{d}") for d, c in enumerate(local)], (local[0] + local[1] * 11 + local[2] * 110).alias("at"), x.voxel_in_process_area(voxel).alias("inside"))


@query("SELECT CAST(l_quantity AS BIGINT) - 1 AS d0, l_suppkey % 10 AS d1, l_partkey % 30 AS d2, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3")
def stream_ingest(spark, sf):
    """A stream of line items into bricks, micro-batch by micro-batch, read back merged."""
    static = V.read(spark, sf, "lineitem")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    cell = [(F.col("l_quantity").cast("long") - 1).alias("d0"), (F.col("l_suppkey") % 10).alias("d1"), (F.col("l_partkey") % 30).alias("d2"), F.col("l_extendedprice").alias("value")]
    sink = BrickIngest(spark, work_path(spark, "stream"), GRID)
    sink.start(stream.select(*cell), availableNow=True).awaitTermination()
    return sink.voxels()
