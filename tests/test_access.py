import asyncio

import numpy as np
import pytest

from cubeflow.descriptor import Axis, Channel, Descriptor, IndexOutOfRange, InvalidArgument, Layout
from cubeflow.operators import interp
from cubeflow.sources.access import AccessManager
from cubeflow.sources.volume import Volume, from_numpy

SHAPE = (40, 35, 33)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    a = np.random.default_rng(2).normal(size=tuple(reversed(SHAPE)))
    a[3, 4, 5] = np.nan
    d = Descriptor(tuple(Axis(n, f"A{n}") for n in SHAPE), (Channel("V", "R64", use_novalue=True),), Layout(brick_log2=5, lods=1))
    v = Volume.create(spark, str(tmp_path_factory.mktemp("acc") / "v"), d)
    v.write(from_numpy(spark, a))
    return a, v, AccessManager(v)


def test_requests_give_arrays(spark, made):
    a, v, m = made
    assert np.array_equal(m.requestVolumeSubset((3, 2, 1), (20, 30, 9)).data, a[1:9, 2:30, 3:20], equal_nan=True)
    assert np.array_equal(asyncio.run(_awaited(m)), a[0:2, 0:2, 0:2])
    p = [(3.5, 4.2, 5.9), (30.1, 2.2, 8.8)]
    frame = spark.createDataFrame([(k, *x) for k, x in enumerate(p)], "id long, p0 double, p1 double, p2 double")
    want = {r.id: r.value for r in interp.samples(frame, from_numpy(spark, a), SHAPE, "cubic").collect()}
    assert m.requestVolumeSamples(p).data.tolist() == [want[0], want[1]]
    traces = m.requestVolumeTraces(p, 0, interpolationMethod="nearest").data
    assert traces.shape == (2, 40) and np.array_equal(traces[1], a[8, 2, :])
    plane = m.requestProjectedVolumeSubset((0, 0, 0), SHAPE, (0, 0, 1, -7.5), 2).data
    assert np.array_equal(plane, a[7])
    assert m.getVolumeSubsetBufferSize((0, 0, 0), (2, 2, 2)) == 64 and m.getVolumeTracesBufferSize(3, 0) == 480 and m.getProjectedVolumeSubsetBufferSize((0, 0, 0), (4, 4, 9), 2) == 64
    assert m.getVDSProduceStatus((0, 1, 2)) == "Normal" and m.prefetchVolumeChunk(0).wait()[0].chunk == 0
    with pytest.raises(InvalidArgument):
        m.requestVolumeSamples([(1.0,)])


async def _awaited(m):
    return await m.requestVolumeSubset((0, 0, 0), (2, 2, 2))


def test_pages_and_values(made):
    a, v, m = made
    pages = m.createPageAccessor()
    assert pages.getChunkCount() == 8 and pages.getChunkMinMaxExcludingMargin(7) == ((32, 32, 32), SHAPE)
    assert np.array_equal(pages.readPage(0), a[:32, :32, :32], equal_nan=True) and pages.readPageAtPosition((40, 0, 0)) is None
    values = m.createValueAccessor()
    assert values.getValues([(3, 4, 5), (32, 34, 39)]) == [None, a[32, 34, 39]]
    with pytest.raises(IndexOutOfRange):
        values.getValue((33, 0, 0))
    before = pages.getChunkVolumeDataHash(7)
    writable = m.createPageAccessor()
    writable.volume = Volume.open(v.spark, v.path, "ReadWrite")
    writable.writePage(7, np.full((1, 3, 8), 2.0))
    writable.commit()
    editor = AccessManager(writable.volume).createValueAccessor()
    editor.setValue((0, 0, 0), 9.0)
    editor.setValue((0, 0, 1), None)
    editor.commit()
    assert editor.getValues([(32, 33, 33), (0, 0, 0), (0, 0, 1), (0, 0, 2)]) == [2.0, 9.0, None, a[0, 0, 2]]
    assert m.createPageAccessor().getChunkVolumeDataHash(7) != before
