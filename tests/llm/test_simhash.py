import itertools

import xxhash
from pyspark.sql import functions as F

from cubeflow.llm import simhash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(fps.items(), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in fps}


def test_masks_cover_every_pair_within_the_radius():
    tables = simhash.masks(3)
    assert len(tables) == 15
    for bits in itertools.combinations(range(64), 3):
        assert any(not (m & sum(1 << b for b in bits)) for m in tables)


def test_against_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " tail", base.replace("w200 ", ""), base.upper(), None, "", " \t\n", "one", "one two", "ONE two", "x y z", base, "ß É é"]
    texts += [" ".join(f"v{i * k % 97}" for i in range(30 + k)) for k in range(1, 30)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, simhash string")
    rows = simhash.near_duplicates(docs).collect()
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.simhash & (1 << 64) - 1 for r in rows} == want
    assert {r.doc_id: r.component_id for r in rows} == plain_components(want)


def test_chains_empty_tables_and_null_ids(spark):
    fps = spark.createDataFrame([(1 << k,) for k in range(0, 60)] + [((1 << k) - 1,) for k in range(1, 40)], "fp long")
    from cubeflow.llm.common import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(fps)).collect()}
    values = {r.fp: r.fp for r in fps.collect()}
    want = plain_components(dict(sorted(values.items())))
    assert {n: c for n, c in want.items() if n in got} == got and all(want[n] == n for n in want if n not in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(nulls).select("doc_id", F.col("component_id")).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
