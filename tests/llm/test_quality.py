import math
from collections import Counter

import numpy as np

from cubeflow.llm import quality

SCHEMA = "doc_id long, text string, lang string, threshold string"


def plain_model(texts, order):
    """p(byte | context) by the textbook recursion over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        b = quality.padded(t, order)
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    d = {}
    for o, c in counts.items():
        n = Counter(c.values())
        if not (n[1] and n[2] and n[3]):
            d[o] = (0.75,) * 3
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d[o] = tuple(min(max(x, 0.05), k - 0.05) for k, x in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3])))
    contexts = {o: {} for o in counts}
    for o, c in counts.items():
        for g, n in c.items():
            total, off = contexts[o].get(g[:-1], (0, 0.0))
            contexts[o][g[:-1]] = total + n, off + d[o][min(n, 3) - 1]

    def p(gram):
        o = len(gram)
        if not o:
            return 1 / 256
        lower = p(gram[1:])
        if gram[:-1] not in contexts[o]:
            return lower
        total, off = contexts[o][gram[:-1]]
        n = counts[o][gram]
        return (n - (d[o][min(n, 3) - 1] if n else 0)) / total + off / total * lower

    return p


def test_perplexity_against_the_recursion(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "cat", "sät", "on", "a", "mat", "x"], 40)) for _ in range(60)]
    probe = [texts[0], "the the the", "zzz ü\x00", "q", "", None, "日本", "the cat " * 400]
    p = plain_model(texts, quality.ORDER)
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    docs = spark.createDataFrame([(i, t, "en", "c") for i, t in enumerate(probe)], SCHEMA)
    for shard_entries, chunk in ((quality.SHARD_ENTRIES, quality.CHUNK), (200, 64)):
        monkeypatch.setattr(quality, "SHARD_ENTRIES", shard_entries)
        monkeypatch.setattr(quality, "CHUNK", chunk)
        model = quality.train(trusted)
        assert (model.n_shards > 1) == (shard_entries == 200)
        for r in quality.scored(docs, model).collect():
            b = quality.padded(r.text)
            want = [math.log(p(b[i : i + quality.ORDER])) for i in range(len(b) - quality.ORDER + 1)]
            assert r.text_bytes == len(want)
            assert r.perplexity is None if not want else math.isclose(r.perplexity, math.exp(-sum(want) / len(want)), rel_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    model = quality.train(spark.createDataFrame([("abcabcabd bca cab",), ("aab",)], "text string"))
    for context in (b"abca", b"zzzz", b"\0\0\0a", b"zabc"):
        x = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert math.isclose(np.exp(model.log_probabilities(x)).sum(), 1, rel_tol=1e-9)


def test_nulls_ties_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in quality.trusted_ids(labels).collect()] == [1]
    docs = spark.createDataFrame([(1, "a good text " * 20, None, "c"), (1, "a good text " * 20, None, "c"), (4, None, "en", "c"), (None, "#@!%" * 30, "en", "c"), (5, "", "xx", None)], SCHEMA)
    got = {(r.doc_id, r.good) for r in quality.judged(docs, labels).collect()}
    assert got == {(1, True), (4, False), (None, True), (5, False)}  # one trusted document cannot both train and set thresholds
    none = labels.where("false")
    assert {(r.doc_id, r.good) for r in quality.judged(docs, none).collect()} == {(1, True), (4, False), (None, True), (5, False)}
    assert quality.judged(docs.where("false"), labels).collect() == []


def test_unseen_clean_text_is_kept_with_little_training(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioubdgklmnprst"), rng.integers(2, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words, 50)) for _ in range(240)]
    docs = spark.createDataFrame([(i, t, "en", "") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judged(docs, labels).where("good").collect()}
    assert sum(i in kept for i in range(1, 240, 2)) >= 0.9 * 120


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join(rng.choice(["the", "of", "and", "tion", "house", "tree", "river"], 60)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in rng.choice(["xq", "zz9", "@@", "kpw"], 60)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "") for i, t in enumerate(clean + junk)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judged(docs, labels).where("good").collect()}
    held = [i for i in range(1, 400, 2)]
    assert sum(i in kept for i in held if i < 300) >= 0.97 * 150
    assert not any(i in kept for i in held if i >= 300)


def test_labelled_toxic_documents_are_neither_trusted_nor_kept(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0), (3, 1, 1), (4, 1, None), (5, 0, 0), (6, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == {1, 6}
    docs = spark.createDataFrame([(i, "a good text " * 20, "en", "") for i in (1, 2, 3, 4, 5, 6, 7)] + [(None, "a good text " * 20, "en", "")], SCHEMA)
    got = quality.judged(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "text_bytes", "perplexity", "threshold", "good"]
    assert {r.doc_id for r in got.where("not good").collect()} == {2, 3} and got.count() == 8


def test_thresholds_of_small_languages(spark):
    scores = [(i, "en", float(i)) for i in range(1, 101)] + [(200, "de", 500.0), (201, "fr", 3.0), (202, None, 9.0), (203, "es", None)]
    frame = spark.createDataFrame(scores, "doc_id long, lang string, perplexity double")
    trusted = frame.where("lang in ('en', 'de', 'fr')").select("doc_id")
    got = {r.lang: r.threshold for r in quality.thresholds(frame, trusted, 0.5, least_trusted=50).collect()}
    ordered = sorted([*range(1, 101), 500.0, 3.0])
    whole = float(ordered[50])
    assert got["en"] == 50.0 and got["de"] == 500.0 and got["fr"] == got[None] == got["es"] and abs(got["fr"] - whole) <= 1
