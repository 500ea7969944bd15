import math

import numpy as np

from pyspark.sql import functions as F

from cubeflow.llm import common, covertree

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def plain(rows, cosine=covertree.COSINE):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, dtype=np.float32).astype(np.float64) if ok(v) else None for _, v in rows]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])) >= cosine] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[root[i]] = min(low.get(root[i], rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), len(linked[i]), str(low.get(root[i]))) for i in range(n))


def got(spark, rows):
    frame = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], SCHEMA)
    out = covertree.near_duplicates(frame).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out)


def test_against_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in (0.02, 0.15, 0.2, 0.25, 0.3, 0.6) for _ in range(2)]
    vectors += [vectors[5]] * 7 + [3 * vectors[5], -vectors[5]]
    rows = [(1000 - i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16), (5, [None] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, rows[0][1]), (9, rows[3][1]), (9, rows[3][1])]
    assert got(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(3, [1.0, 0.0])]) == [("3", 0, "3")]
    assert got(spark, [(3, None)]) == [("3", 0, "3")]


def test_dual_traversal_finds_all(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 8)).repeat(20, 0) + rng.normal(size=(800, 8)) * rng.choice([0.01, 0.1, 0.3], (800, 1))
    tree = covertree.Tree(a.astype(np.float32))
    pairs = {(int(i), int(j)) for p, q in covertree.dual(tree, tree, 0.95) for i, j in zip(p, q)}
    u = tree.raw / tree.norm[:, None]
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.95)) if True}


def test_components_beyond_the_range_of_squares(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.0001e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 0.0]), (7, [float("inf"), 1.0]), (8, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(docs).collect()}
    assert got == {**dict.fromkeys((0, 1, 2, 3), (3, 0)), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def shuffled(spark, run):
    """What ``run`` returns, and the MB that its stages wrote to the shuffle."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        listed = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(listed.apply(k).stageId(), listed.apply(k).attemptId()): listed.apply(k).shuffleWriteBytes() for k in range(listed.size())}

    before = stages()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(size for stage, size in stages().items() if stage not in before) / 1e6


def clustered(n, seed):
    """Two thirds unrelated vectors of 64 components, the others in dense and loose groups, with copies."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, 64))
    for at, size, noise in ((0, n // 8, 0.1), (n // 8, n // 8, 0.22), (n // 4, n // 16, 0.27)):
        vectors[at : at + size] = rng.normal(size=64) + rng.normal(size=(size, 64)) * noise
    vectors[5 : 12] = vectors[4]
    return [[float(x) for x in v] for v in vectors.astype(np.float32)]


def test_shuffles_and_keeps_in_proportion_to_vectors(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(covertree, "BLOCK", 32)
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = list(enumerate(clustered(900, 3)))
    out, mb = shuffled(spark, lambda: got(spark, rows))
    assert out == plain(rows)
    raw = 900 * 64 * 4 / 1e6
    assert mb < 4 * raw  # 29 blocks, so 435 pairs of blocks
    assert sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) / 1e6 < raw  # cuts of vectors are deleted


def test_equal_vectors_under_shared_hashes_and_signed_zeros(spark, monkeypatch):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, -0.0]), (2**60 + 1, [-1.0, 0.0]), (None, [-1.0, -1.0]), (6, None)]
    assert got(spark, rows) == plain(rows)
    monkeypatch.setattr(covertree, "_key", lambda e: F.size(e))
    assert got(spark, rows) == plain(rows)


def test_dual_traversal_by_pivots_and_axes(monkeypatch):
    monkeypatch.setattr(covertree, "LEAST_SHELL", 4)
    vectors = np.array(clustered(1500, 4), dtype=np.float32)
    pivots = covertree.Pivots([v.astype(np.float64) for v in vectors[::3]], 40 * covertree.BLOCK)
    where, _ = pivots.nearest(list(vectors.astype(np.float64)))
    cells = [np.flatnonzero(where == k) for k in range(len(pivots.unit))]
    trees = [covertree.Tree(vectors[c], axes=pivots.axes[64], pivot=pivots.of(k)) if len(c) else None for k, c in enumerate(cells)]
    pairs = set()
    for i, a in enumerate(trees):
        for j, b in enumerate(trees):
            if a and b:
                pairs |= {(int(cells[i][x]), int(cells[j][y])) for p, q in covertree.dual(a, b, 0.95) for x, y in zip(p, q)}
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.95))}


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 32)
    monkeypatch.setattr(covertree, "GROUPS", 3)
    rows = list(enumerate(clustered(400, 5)))
    assert got(spark, rows) == plain(rows)
