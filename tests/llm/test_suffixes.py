import hashlib
import random
import re
from collections import Counter

import numpy as np

from cubeflow.llm import suffixes


def plain_passages(texts, length=suffixes.WORDS.length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        told = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                told[i : i + length] = [True] * length
        out.append(sum(told))
    return out


def plain(texts, length=suffixes.BYTES.length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts):
    docs = spark.createDataFrame([(i, t, "c", i, "h") for i, t in enumerate(texts)], "doc_id long, text string, kept string, spans long, whole string")
    rows = suffixes.deduplicated(docs.repartition(3)).collect()
    by_id = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert len(rows) == len(texts) and all((r.spans, r.whole) == (r.doc_id, "h") for r in rows)
    assert [r.n_passage_words for r in sorted(rows, key=lambda r: r.doc_id)] == plain_passages(texts)
    return [by_id[i] for i in range(len(texts))]


def noise(rng, n, letters="abcdefghij é"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_cover_reaches_every_difference():
    for kind in (suffixes.BYTES, suffixes.WORDS):
        assert {(a - b) % kind.v for a in kind.cover for b in kind.cover} == set(range(kind.v))
        assert kind.aspects * kind.step >= kind.v - 1 and kind.length - kind.step + 1 > kind.prefix


def test_against_brute_force(spark):
    rng = random.Random(11)
    long, mid = noise(rng, 3000), noise(rng, 700)
    texts = [None, "", "short", "x" * 399, "x" * 400, "y" * 401, "z" * 1500, noise(rng, 5000)]
    for n in (300, 380, 399, 400, 401, 500, 672, 900, 2000):
        for _ in range(4):
            a = rng.randrange(0, len(long) - n)
            texts.append(noise(rng, rng.randrange(600)) + long[a : a + n] + noise(rng, rng.randrange(600)))
    texts += [noise(rng, 100) + mid + noise(rng, k) for k in range(0, 60, 5)]
    texts += [mid, mid, long, long[:1500] + "!" + long[1501:], long[5:], mid + mid, noise(rng, 450) * 3, "ab" * 900]
    assert got(spark, texts) == plain(texts)


def test_passages_of_words(spark):
    rng = random.Random(5)
    voc = [noise(rng, rng.randrange(1, 9), "abcdefghijklmnop") for _ in range(400)]
    said = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    shared, other = said(400).split(" "), said(55)
    texts = [None, "", said(50), "a " * 51, "b\n" * 50, said(3000)]
    for n in (49, 50, 51, 52, 60, 90, 200):
        for _ in range(4):
            a = rng.randrange(0, len(shared) - n)
            texts.append(said(rng.randrange(1, 80)) + "\t" + rng.choice([" ", "\n", "  "]).join(shared[a : a + n]) + " " + said(rng.randrange(1, 80)))
    texts += [said(20) + " " + other + " " + said(k) for k in range(1, 40)] + [other, other, said(60) + " x " + said(3), said(53).replace(" ", "\n")]
    assert got(spark, texts) == plain(texts)


def test_a_passage_that_most_texts_share(spark):
    """Hot names are dealt by text; the result is the same."""
    rng = random.Random(8)
    hot = noise(rng, 620)
    texts = [noise(rng, rng.randrange(90)) + (hot if i % 8 else hot[:380]) + noise(rng, rng.randrange(90)) for i in range(900)]
    assert got(spark, texts) == plain(texts)


def test_names_travel_packed(spark, monkeypatch):
    """Names that recur come back by text, hot ones too, whether a bucket's groups are settled at once or as they come; few rows are sent."""
    rng = random.Random(21)
    held = {2 * i: [rng.randrange(9000) * 0x9E3779B97F4A7C15 % (1 << 63) for _ in range(rng.randrange(60))] + [77] * (i % 3) for i in range(1200)}
    seen = Counter(k for keys in held.values() for k in keys)
    want = {h: {k for k in keys if seen[k] > 1} for h, keys in held.items()}
    texts = spark.createDataFrame([(h, " ".join(map(str, keys))) for h, keys in held.items()], "h long, text string").repartition(3)

    def make(row):
        keys = np.array(row["text"].as_py().split(), dtype=np.int64)
        return keys, np.full(len(keys), row["h"].as_py())

    for packed in (suffixes.PACKED, 40):
        monkeypatch.setattr(suffixes, "PACKED", packed)
        rows = suffixes.repeated_names(texts, make).collect()
        assert {r.h: set(r["keys"]) for r in rows} == {h: keys for h, keys in want.items() if keys}
    monkeypatch.undo()
    sent = suffixes._over_texts(texts, "key long, h long", make, buckets=8)
    assert sent.count() <= 3 * 8 < sum(seen.values()) // 100


def test_recurring_names_return_packed(spark):
    """No row of Spark's for each name, and each text once."""
    texts = spark.createDataFrame([(2 * i, "x") for i in range(50)], "h long, text string")
    names = suffixes.repeated_names(texts, lambda row: (np.array([7, 7, row["h"].as_py() // 4]), np.full(3, row["h"].as_py())))
    assert "Aggregate" not in names._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.h, sorted(r["keys"])) for r in names.collect()) == [(2 * i, sorted({7, i // 2})) for i in range(50)]


def test_first_two_of_each_name():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(0, 60))
        keys, text = rng.integers(0, int(rng.integers(1, 40)), n), np.sort(rng.integers(0, 4, n))
        for of in (None, text):
            seen, want = Counter(), []
            for i in range(n):
                k = (keys[i], 0 if of is None else of[i])
                seen[k] += 1
                want += [i] * (seen[k] <= 2)
            assert suffixes._twice(keys, of).tolist() == want


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert suffixes.deduplicated(spark.createDataFrame([], schema)).collect() == []
    rows = suffixes.deduplicated(spark.createDataFrame([(None, "q" * 400), (1, "q" * 400), (1, None), (1, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 400, 400, 1), (1, 0, 0, 0), (1, 0, 0, 0), (1, 400, 400, 1)]
