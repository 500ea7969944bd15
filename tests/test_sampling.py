import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflow.descriptor import Channel, InvalidArgument
from cubeflow.functions import convert, coords
from cubeflow.operators import bricks, interp, stats, subset
from cubeflow.plans.grid import Grid
from cubeflow.sources.volume import from_numpy

SHAPE = (9, 7, 6)


def volume(holes=0.0, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=tuple(reversed(SHAPE))) * 10
    a[rng.random(a.shape) < holes] = np.nan
    return a


def positions(spark, n=120, seed=7):
    rng = np.random.default_rng(seed)
    p = rng.random((n, 3)) * np.array(SHAPE)
    p[: n // 4] = np.floor(p[: n // 4]) + 0.5
    return p, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, p0 double, p1 double, p2 double")


def at(a, i):
    return a[tuple(min(max(int(x), 0), n - 1) for x, n in zip(i, SHAPE))[::-1]]


def plain(a, p, method, value_range=(-20.0, 20.0)):
    base = [math.floor(x - 0.5) for x in p]
    f = [x - b - 0.5 for x, b in zip(p, base)]
    nearest = at(a, [math.floor(x) for x in p])
    if method == "nearest" or math.isnan(nearest):
        return nearest
    width = value_range[1] - value_range[0]
    total = weight = 0.0
    if method in ("linear", "angular"):
        for o in itertools.product((0, 1), repeat=3):
            w = np.prod([f[d] if o[d] else 1 - f[d] for d in range(3)])
            v = at(a, [b + k for b, k in zip(base, o)])
            if not math.isnan(v):
                if method == "angular":
                    v -= math.floor((v - nearest) / width + 0.5) * width
                total, weight = total + w * v, weight + w
        out = total / weight
        return out - math.floor((out - value_range[0]) / width) * width if method == "angular" else out
    per = [[-0.5 * t**3 + t**2 - 0.5 * t, 1.5 * t**3 - 2.5 * t**2 + 1, -1.5 * t**3 + 2 * t**2 + 0.5 * t, 0.5 * (t**3 - t**2)] for t in f]
    for o in itertools.product((-1, 0, 1, 2), repeat=3):
        v, c = at(a, [b + k for b, k in zip(base, o)]), at(a, [b + min(max(k, 0), 1) for b, k in zip(base, o)])
        if not math.isnan(v) and not math.isnan(c):
            w = np.prod([per[d][o[d] + 1] for d in range(3)])
            total, weight = total + w * v, weight + w
    return total / weight


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic", "angular"])
@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_samples_against_numpy(spark, method, holes):
    a = volume(holes)
    p, df = positions(spark)
    got = {r.id: r.value for r in interp.samples(df, from_numpy(spark, a), SHAPE, method, value_range=(-20.0, 20.0)).collect()}
    for i, x in enumerate(p):
        want = plain(a, x, method)
        assert got[i] is None if math.isnan(want) else got[i] == pytest.approx(want, rel=1e-9, abs=1e-9), (i, x)


def test_discrete_replacement_and_errors(spark):
    a = volume(0.3)
    p, df = positions(spark)
    voxels = from_numpy(spark, a)
    got = {r.id: r.value for r in interp.samples(df, voxels, SHAPE, "cubic", Channel("c", discrete=True), replacement=-1.0).collect()}
    assert all(got[i] == (-1.0 if math.isnan(plain(a, x, "nearest")) else plain(a, x, "nearest")) for i, x in enumerate(p))
    with pytest.raises(InvalidArgument):
        interp.method_for("spline", None)


def test_traces_equal_samples_and_planes_equal_samples(spark):
    a, voxels = volume(), from_numpy(spark, volume())
    starts = spark.createDataFrame([(0, 99.0, 2.3, 1.7), (1, -5.0, 6.9, 0.1)], "id long, p0 double, p1 double, p2 double")
    got = {(r.id, r.sample): r.value for r in interp.traces(starts, voxels, SHAPE, 0, "cubic").collect()}
    assert len(got) == 2 * SHAPE[0]
    for (i, s), v in got.items():
        x = (s + 0.5, *((2.3, 1.7), (6.9, 0.1))[i])
        assert v == pytest.approx(plain(a, x, "cubic"))
    plane = (0.5, 1.0, -2.0, 1.0)
    rows = interp.project(voxels, SHAPE, plane, 2, (1, 0, 0), (9, 7, 6), "linear").collect()
    assert len(rows) == 8 * 7
    for r in rows:
        x, y = r.d0 + 1.5, r.d1 + 0.5
        z = min(max((0.5 * x + y + 1.0) / 2.0, 0.5), SHAPE[2] - 0.5)
        assert r.value == pytest.approx(plain(a, (x, y, z), "linear"))
    with pytest.raises(InvalidArgument):
        interp.project(voxels, SHAPE, (1, 1, 0, 0), 2, (0, 0, 0), SHAPE)


def test_levels_against_numpy(spark):
    a = volume(0.4)
    got = {(r.d0, r.d1, r.d2): r.value for r in subset.decimate(from_numpy(spark, a)).collect()}
    for i in itertools.product(*[range((n + 1) // 2) for n in SHAPE]):
        cell = [at(a, [2 * x + k for x, k in zip(i, o[::-1])]) for o in itertools.product((0, 1), repeat=3) if all(2 * x + k < n for x, k, n in zip(i, o[::-1], SHAPE))]
        want = next((v for v in cell if not math.isnan(v)), None)
        assert got[i] == want


@pytest.mark.parametrize("dims,brick", [((0, 1, 2), 4), ((0, 2), 3), ((1, 2), 8)])
def test_bricks_round_trip(spark, dims, brick):
    a = volume(0.3)
    a[:2, :4, :4] = 7.0
    g = Grid(SHAPE, dims, brick)
    voxels = from_numpy(spark, a)
    stored = bricks.to_bricks(voxels, g).cache()
    key = lambda df: sorted(map(tuple, df.select("d0", "d1", "d2", "value").collect()))
    assert key(bricks.from_bricks(stored, g)) == key(voxels.where("value is not null"))
    low, high = (1, 2, 0), (6, 7, 3)
    assert key(bricks.subset_bricked(stored, g, low, high)) == key(subset.subset(voxels.where("value is not null"), low, high))
    other = Grid(SHAPE, (0, 1), 5)
    assert key(bricks.from_bricks(bricks.rebrick(stored, g, other), other)) == key(voxels.where("value is not null")) if len(set(dims) & {0, 1}) > 1 else True


def test_halo(spark):
    g = Grid(SHAPE, (0, 1, 2), 4, neg_margin=1, pos_margin=2)
    got = {(r.chunk, r.d0, r.d1, r.d2, r.inside) for r in bricks.with_halo(from_numpy(spark, volume()), g).collect()}
    want = set()
    for c in range(g.total):
        (low, high), (wl, wh) = g.bounds(c), g.bounds(c, margin=True)
        want |= {(c, *i, all(x >= a and x < b for x, a, b in zip(i, low, high))) for i in itertools.product(*[range(x, y) for x, y in zip(wl, wh)])}
    assert got == want


def test_value_range(spark):
    rng = np.random.default_rng(0)
    for values in ([1.0], [2.0, 2.0], list(np.round(rng.normal(size=3000), 2)), [float(x) for x in range(1000)]):
        for p in (99.5, 90.0):
            k = int((100 - p) / 100 * len(values) / 2) + 1
            lo, hi = sorted(values)[k - 1], sorted(values)[-k]
            r = stats.value_range(spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "value double"), p).first()
            assert (r.range_min, r.range_max, r.nan_count) == (lo, lo + 1 if hi <= lo else hi, 1)
    r = stats.value_range(spark.createDataFrame([], "value double")).first()
    assert (r.range_min, r.range_max, r.nan_count) == (0.0, 1.0, 0)


def test_conversions(spark):
    df = spark.createDataFrame([(-1e9,), (-0.5,), (0.49,), (0.5,), (1.5,), (2.5,), (254.5,), (1e9,), (None,)], "v double")
    col = lambda c: [r[0] for r in df.select(c).collect()]
    assert col(convert.float_to_int(F.col("v"), "U8")) == [0, 0, 0, 1, 2, 3, 255, 255, None]
    assert col(convert.float_to_int(F.col("v"), "I8"))[:3] == [-128, 0, 0]
    assert col(convert.quantize(F.col("v"), "U8", 0.0, 254.0, True)) == [0, 0, 0, 1, 2, 3, 254, 254, 255]
    q = convert.quantize(F.col("v"), "U16", 0.0, 10.0, True)
    back = col(convert.dequantize(q, "U16", 0.0, 10.0, True))
    assert back[8] is None and back[5] == pytest.approx(2.5, abs=10 / 65534)
    c = Channel("c", "R32", use_novalue=True, novalue=-1e9, range_min=0, range_max=254)
    assert col(convert.convert(F.col("v"), c, "U8"))[0] == 255 and col(convert.convert(F.col("v"), c, "R64", 3.0))[0] == 3.0 and col(convert.convert(F.col("v"), c, "1Bit"))[:4] == [False, True, True, True]
    assert convert.novalue_of("U16", 5.0) == 65535 and convert.novalue_of("1Bit", 5.0) is False and convert.novalue_of("R32", 5.0) == 5.0 and convert.novalue_of("U32", 5.5) == 6


def test_coordinates(spark):
    from cubeflow.plans.volumes import LIN

    t = coords.Transformer(LIN.axes, (100.0, -50.0, 3.0), (12.5, 3.25, 0.5), (-3.25, 12.5, 0.0), (0.1, 0.0, -4.0))
    df = spark.createDataFrame([(3.0, 4.0, 7.0), (0.0, 0.0, 0.0), (29.4, 9.0, 49.0), (-0.6, 1.0, 1.0), (29.5, 1.0, 1.0)], "i double, j double, k double")
    ijk = [F.col(c) for c in "ijk"]
    back = t.world_to_ijk(t.ijk_to_world(ijk))
    for r in df.select(*ijk, *[c.alias(f"b{n}") for n, c in enumerate(back)]).collect():
        assert (r.b0, r.b1, r.b2) == pytest.approx((r.i, r.j, r.k), abs=1e-9)
    index = df.select(*[c.alias(f"x{n}") for n, c in enumerate(t.position_to_index(ijk))]).collect()
    assert [tuple(r) for r in index] == [(3, 4, 7), (0, 0, 0), (29, 9, 49), (-1, -1, -1), (-1, -1, -1)]
    ann = t.annotation_to_ijk(t.ijk_to_annotation(ijk))
    for r in df.select(*ijk, *[c.alias(f"b{n}") for n, c in enumerate(ann)]).collect():
        assert (r.b0, r.b1, r.b2) == pytest.approx((r.i, r.j, r.k), abs=1e-9)
    s = coords.transformer_from_metadata(LIN.axes, {("SurveyCoordinateSystem", "Origin"): (5.0, 6.0), ("SurveyCoordinateSystem", "InlineSpacing"): (1.0, 0.0), ("SurveyCoordinateSystem", "CrosslineSpacing"): (0.0, 2.0)})
    xyz = spark.range(1).select(*s.ijk_to_world([F.lit(2.0), F.lit(3.0), F.lit(4.0)])).first()
    assert tuple(xyz) == pytest.approx((5 + 1010, 6 + 2 * 106, -8.0))
    assert coords.cross((1, 0, 0), (0, 1, 0)) == (0, 0, 1) and coords.length((3, 4, 0)) == 5 and coords.normalize((0, 0, 2)) == (0, 0, 1)
