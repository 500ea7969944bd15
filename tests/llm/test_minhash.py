import hashlib

import numpy as np

from cubeflow.llm import minhash


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in minhash.neighbours(docs.repartition(5)).collect()}
    ids = sorted(texts)
    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b, r = texts[i] or "", texts[j] or "", got[i]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) and 0 <= r.near_next <= 1
        errors += [r.near_edited - jaccard(a, edited), r.near_next - jaccard(a, b)]
    return got, np.array(errors)


def test_likeness_against_jaccard(spark):
    rng = np.random.default_rng(4)
    texts, words = {}, [f"w{k}" for k in range(5000)]
    for i in range(0, 240, 2):
        base = list(rng.choice(words, int(rng.integers(5, 900))))
        texts[i * 37] = " ".join(base)
        for k in rng.choice(len(base), len(base) // 40):
            base[k] = "changed"
        texts[i * 37 + 1] = "\t".join(base) + " é"
    texts |= {9001: None, 9002: "", 9003: "  \n", 9004: "one two", 9005: "one two", 90000: "x " * 20000, 10**12: "the end of it all is here"}
    got, errors = check(spark, texts)
    assert abs(errors.mean()) < 0.01 and np.abs(errors).max() < 0.17 and errors.std() < 0.04
    assert got[9004].fingerprint == got[9005].fingerprint and got[9001].fingerprint == got[9003].fingerprint == minhash.EMPTY
    assert got[9001].near_next == 1 and got[9003].near_next == 0
    assert len(got[0].fingerprint) == 2 * minhash.BINS


def test_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.neighbours(spark.createDataFrame([], schema)).collect() == []
    r = minhash.neighbours(spark.createDataFrame([(5, "abcd")], schema)).collect()[0]
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())
    rows = minhash.neighbours(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "x"), (1, "x"), (-7, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.near_next) for r in rows if r.doc_id) == [(-7, 0.0), (1, 0.0), (1, 1.0)]
    assert [r.near_next for r in rows if r.doc_id is None] == [None, None]
