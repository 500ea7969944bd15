from collections import defaultdict

import numpy as np

from cubeflow.llm import mixing


def plain_targets(sizes):
    """Reshares by weight, round after round, until no source is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit >= 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


def rows_for_test():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        source = [None, "a", "b", "é", "z", "hot", "hot", "hot"][i % 8]
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 1200)))), "en", source, 1, "x"))
    return rows + [(900, None, "en", "only null", 0, None), (901, "", "en", "a", 0, None), (901, "", "en", "a", 0, None), (902, "one\ttwo\n three", "en", "tiny", 0, None), (None, "x y", "en", "a", 0, None)]


def test_targets_caps_and_words(spark):
    rows = rows_for_test()
    docs = frame(spark, rows)
    got = mixing.taken_words(mixing.uses(docs)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    source_of = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == round(want[s]), s
    again = mixing.taken_words(mixing.uses(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = {r.doc_id: r for r in mixing.mixed_documents(docs).collect()}
    for r in got:
        if r.doc_id not in (901,):
            assert len(texts[r.doc_id].text.split()) == r.taken if r.taken else r.doc_id not in texts
    for i, r in texts.items():
        own = (next(x[1] for x in rows if x[0] == i)).split()
        assert set(r.text.split()) <= set(own) and r.n_chars == len(r.text)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = mixing.Permutation(n, 99)
        x = p(np.arange(n))
        assert sorted(x.tolist()) == list(range(n)) and (p.inverse(x) == np.arange(n)).all()


def test_empty_table(spark):
    assert mixing.taken_words(mixing.uses(frame(spark, []))).collect() == []
    only = mixing.taken_words(mixing.uses(frame(spark, [(1, None, "en", None, 0, "")]))).collect()
    assert [tuple(r) for r in only] == [(1, 0, 0, 0.0, 0)]
