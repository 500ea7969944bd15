import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeflow.descriptor import InvalidArgument, InvalidOperation, ReadError
from cubeflow.operators import stats
from cubeflow.sources import segy


def make(spark, path, n_inline=4, n_cross=5, fold=1, samples=20, fmt=5, little=False, drop=()):
    rng = np.random.default_rng(1)
    rows, data, k = [], {}, 0
    for i in range(n_inline):
        for x in range(n_cross):
            for o in range(fold):
                if (i, x, o) in drop:
                    continue
                h = bytearray(240)
                for name, v in (("inlinenumber", 100 + 2 * i), ("crosslinenumber", 10 + x), ("offset", 50 * o), ("ensemblex", 1000 + 25 * i), ("ensembley", -7), ("coordinatescale", -10), ("mutestart", 5), ("muteend", -3)):
                    segy.pack_field(h, name, v, little)
                v = np.floor(rng.normal(size=samples) * 100).astype(np.float32)
                rows.append((k, bytes(h), [float(s) for s in v]))
                data[i, x, o] = v
                k += 1
    df = spark.createDataFrame(rows, "trace long, header binary, samples array<float>")
    segy.write_traces(df.repartition(3), str(path), format=fmt, interval=4000, text="C01 TEST\nC02 LINES", endianness="little" if little else "big")
    return rows, data


@pytest.mark.parametrize("fmt,little", [(1, False), (5, False), (5, True), (3, False), (2, True), (8, False)])
def test_round_trip(spark, tmp_path, fmt, little):
    path = tmp_path / "a.segy"
    rows, _ = make(spark, path, fmt=fmt, little=little)
    info = segy.file_info(str(path), little)
    assert (info.traces, info.samples, info.interval, info.format) == (20, 20, 4000, fmt)
    assert info.text.startswith("C01 TEST") and segy.FileInfo.from_json(info.to_json()) == info
    got = segy.read_traces(spark, str(path), endianness="little" if little else "big", partitionBytes=1500).collect()
    want = {r[0]: (r[1], [max(-128, min(127, s)) for s in r[2]] if fmt == 8 else r[2]) for r in rows}
    assert {r.trace: (bytes(r.header), list(r.samples)) for r in got} == want
    size = path.stat().st_size
    assert size == 3600 + 20 * info.trace_bytes and [p.name for p in tmp_path.iterdir()] == ["a.segy"]


def test_ranges_of_traces(spark, tmp_path):
    path = tmp_path / "a.segy"
    make(spark, path)
    got = segy.read_traces(spark, str(path), headersOnly="true", partitionBytes=700, firstTrace=7, lastTrace=9)
    assert sorted(r.trace for r in got.collect()) == [7, 8] and got.columns == ["trace", "header"]
    reader = segy.SegyReader(segy.file_info(str(path)), True, 700, 7, 9)
    assert [(p.first, p.last) for p in reader.partitions()] == [(7, 9)]


def test_ibm_floats(spark):
    bits = np.array([0, 0x42640000, 0xC276A000, 0x40800000, 0x41100000], dtype=np.uint32)
    want = [0.0, 100.0, -118.625, 0.5, 1.0]
    assert segy.ibm_to_ieee(bits).tolist() == want and segy.ieee_to_ibm(np.array(want, np.float32)).tolist() == bits.tolist()
    got = spark.createDataFrame([(int(b),) for b in bits], "b long").select(segy.ibm_column(F.col("b")).alias("v")).collect()
    assert [r.v for r in got] == want
    v = np.random.default_rng(0).normal(size=1000).astype(np.float32)
    assert np.allclose(segy.ibm_to_ieee(segy.ieee_to_ibm(v)), v, rtol=1e-6)


def test_text_headers():
    for ebcdic in (True, False):
        block = segy.write_text_header(["C 1 CLIENT 42 (TEST)"], ebcdic)
        assert len(block) == 3200 and segy.is_ebcdic(block) == ebcdic and segy.read_text_header(block).startswith("C 1 CLIENT 42 (TEST)")


def test_header_fields(spark):
    h = bytearray(240)
    segy.pack_field(h, "inlinenumber", -70000)
    segy.pack_field(h, "mutestart", -2)
    df = spark.createDataFrame([(bytes(h),)], "header binary")
    f = lambda name, little=False: segy.header_field(F.col("header"), *segy.TRACE_FIELDS[name], little=little)
    assert tuple(df.select(f("inlinenumber"), f("mutestart"), segy.header_field(F.col("header"), 0, 4)).first()) == (-70000, -2, 0)
    assert segy.parse_mapping(["cdp=25:2", "Mine=5"])["ensemblenumber"] == (25, 2) and segy.parse_mapping({"mine": [7, 2]})["mine"] == (7, 2)


def test_poststack_import_and_export(spark, tmp_path):
    path = tmp_path / "a.segy"
    _, data = make(spark, path, drop={(1, 2, 0)})
    d, voxels, table = segy.imported(spark, str(path), segy.ImportOptions(brick_log2=5))
    assert d.shape == (20, 5, 4) and [a.name for a in d.axes] == ["Sample", "Crossline", "Inline"] and d.layout.lods == 4
    got = {(r.d0, r.d1, r.d2): r.value for r in voxels.collect()}
    assert got == {(s, x, i): float(v) for (i, x, _), values in data.items() for s, v in enumerate(values)}
    assert {(r.d1, r.d2): (r.x, r.y, r.mute_end) for r in table.collect()}[0, 3] == (pytest.approx(107.5), pytest.approx(-0.7), -3)
    segy.exported(voxels, table, str(tmp_path / "b.segy"), 20)
    a, b = (segy.read_traces(spark, str(tmp_path / f"{n}.segy")).orderBy("trace").collect() for n in "ab")
    assert [(bytes(r.header), r.samples) for r in a] == [(bytes(r.header), r.samples) for r in b]
    assert (tmp_path / "a.segy").read_bytes()[3600:] == (tmp_path / "b.segy").read_bytes()[3600:]


def test_prestack_offset_sorted_and_checks(spark, tmp_path):
    path = tmp_path / "a.segy"
    make(spark, path, fold=3, drop={(0, 0, 0), (2, 3, 1)})
    with pytest.raises(InvalidOperation):
        segy.imported(spark, str(path), segy.ImportOptions())
    d, voxels, table = segy.imported(spark, str(path), segy.ImportOptions(prestack=True))
    assert d.shape == (20, 3, 5, 4)
    slots = {(r.d3, r.d2): sorted((x.d1, x.offset) for x in table.where((F.col("d3") == r.d3) & (F.col("d2") == r.d2)).collect()) for r in table.where("d3 in (0, 2) and d2 in (0, 3)").select("d3", "d2").distinct().collect()}
    assert slots[0, 0] == [(1, 50), (2, 100)] and slots[2, 3] == [(0, 0), (2, 100)]
    d, _, table = segy.imported(spark, str(path), segy.ImportOptions(offset_sorted=True))
    assert d.shape == (20, 3, 5, 4) and table.count() == 58
    with pytest.raises(InvalidArgument):
        segy.ImportOptions(primary_key="sourcex").survey_type  # noqa: B018
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ReadError):
        segy.file_info(str(tmp_path / "short"))


def plain_slots(gather, offsets, fold):
    """Trace by trace: wait for the offset's place while the rest still fits."""
    out, slot = [], 0
    for i, o in enumerate(gather):
        room = fold - len(gather)
        if o not in offsets:
            if (out[-1] - i + 1 if out else 0) < room:
                return list(range(len(gather)))
            want = 0
        else:
            want = offsets.index(o)
        slot = min(max(slot, want), fold - (len(gather) - i))
        out.append(slot)
        slot += 1
    return out


def test_gather_respacing(spark):
    rng, rows, want, fold = random.Random(3), [], {}, 8
    offsets = [10 * k for k in range(fold)]
    for g in range(60):
        gather = sorted(rng.choice(offsets + ([35] if g % 7 == 0 else [])) for _ in range(rng.randrange(1, fold + 1)))
        want[g] = plain_slots(gather, offsets, fold)
        rows += [(g, 0, 100 * g + i, o) for i, o in enumerate(gather)]
    df = spark.createDataFrame(rows, "primary long, secondary long, trace long, offset long")
    listed = spark.createDataFrame(list(enumerate(offsets)), "place long, offset long")
    got = {}
    for r in segy.respaced(df, fold, listed).orderBy("trace").collect():
        got.setdefault(r.primary, []).append(r.slot)
    assert got == want


def test_segments_over_buckets(spark):
    rng, keys, key = random.Random(4), [], 0
    for _ in range(300):
        key += rng.choice([0, 0, 0, 1, 5])
        keys.append(key)
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "trace long, primary long")
    whole = stats.segments(df, "primary", ["trace"]).collect()
    parts = segy.scan_segments(df, run=7).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == len(set(keys))


def test_places_without_a_task_of_all_rows(spark):
    rng = random.Random(4)
    keys = sorted(rng.sample(range(-300_000, 300_000), 200)) + [1 << 40]
    df = spark.createDataFrame([(k, rng.randint(1, 50)) for k in rng.sample(keys, len(keys))], "pkey long, n long").cache()
    placed = {r.pkey: (r.place, r.places) for r in stats.places(df, "pkey").collect()}
    assert placed == {k: (i, len(keys)) for i, k in enumerate(keys)}
    n = {r.pkey: r.n for r in df.collect()}
    score = [n[k] * (1.5 - abs(i - len(keys) / 2) / len(keys)) for i, k in enumerate(keys)]
    best = score.index(max(score))
    for segs in (df, df.join(spark.createDataFrame([(k, 7 * i) for i, k in enumerate(keys)], "pkey long, segment long"), "pkey")):
        numbered = "segment" in segs.columns
        one = stats.representative_segment(segs, "segment" if numbered else "pkey")
        assert [(r.pkey, r.segment, r.n, r.score) for r in one.collect()] == [(keys[best], 7 * best if numbered else best + 1, n[keys[best]], pytest.approx(score[best]))]
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(_b" in plan and "windowspecdefinition(segment" not in plan and "windowspecdefinition(pkey" not in plan
    holes = spark.createDataFrame([(5,), (None,), (-9,)], "pkey long")
    assert [(r.pkey, r.place) for r in stats.places(holes, "pkey").orderBy("place").collect()] == [(None, 0), (-9, 1), (5, 2)]


def test_several_files(spark, tmp_path):
    make(spark, tmp_path / "a.segy")
    make(spark, tmp_path / "b.segy", n_inline=2)
    both = segy.read_files(spark, [str(tmp_path / "b.segy"), str(tmp_path / "a.segy")])
    assert both.count() == 30 and both.select("trace").distinct().count() == 30
    infos = [segy.file_info(str(tmp_path / f"{n}.segy")) for n in "ab"]
    assert segy.merged(infos).traces == 30


def test_volume_import_export_and_line_information(spark, tmp_path):
    path = tmp_path / "a.segy"
    make(spark, path, fold=2)
    v = segy.import_volume(spark, str(path), str(tmp_path / "v"), segy.ImportOptions(prestack=True, mute=True, azimuth=True, brick_log2=5, crs_wkt="LOCAL"))
    assert v.descriptor.shape == (20, 2, 5, 4) and v.metadata("ImportInformation", "SurveyType").first().string_v == "Prestack"
    assert {tuple(r["values"]) for r in v.traces_of("Mute").collect()} == {(5, -3)} and v.traces_of("Offset").count() == 40
    survey = {r.name: tuple(r.double_v) for r in v.metadata("SurveyCoordinateSystem").collect() if r.double_v}
    assert survey == {"Origin": pytest.approx((-25, -0.7)), "InlineSpacing": pytest.approx((1.25, 0)), "CrosslineSpacing": pytest.approx((0, 0), abs=1e-9)}
    segy.export_volume(v, str(tmp_path / "b.segy"))
    assert (tmp_path / "a.segy").read_bytes()[3600:] == (tmp_path / "b.segy").read_bytes()[3600:]
    headers = segy.trace_headers(segy.read_traces(spark, str(path), headersOnly="true"), segy.ImportOptions())
    line = segy.line_information(headers).first()
    assert line.ensemble_numbers == [100, 102, 104, 106] and line.traces == [10] * 4 and [p.x for p in line.positions] == pytest.approx([100, 102.5, 105, 107.5])
    assert {(r.primary, r.place) for r in segy.ensemble_index(headers).collect()} == {(100, 0), (102, 1), (104, 2), (106, 3)}


def test_npz(spark, tmp_path):
    from cubeflow.sources.volume import from_npz, to_numpy

    a = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "a.npz", v=a)
    assert np.array_equal(to_numpy(from_npz(spark, str(tmp_path / "a.npz")), (4, 3, 2)), a)


def test_the_last_inline_counts_its_own_traces(spark):
    """As at 0.1 GB, where the traces are not a multiple of ten."""
    df = spark.createDataFrame([(i, i // 10) for i in range(256)], "trace long, primary long")
    assert {(r.primary, r.first_trace, r.n) for r in segy.scan_segments(df, run=64).collect()} == {(k, 10 * k, 10 if k < 25 else 6) for k in range(26)}
