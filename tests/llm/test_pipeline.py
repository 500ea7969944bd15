from collections import defaultdict

import corpus_pipeline
from cubeflow.llm import quality, simhash
from test_lines import plain as plain_lines
from test_mixing import plain_targets
from test_packing import check as check_packing
from test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, tmp_path):
    good = "the tree of the house by the river and the road in the valley under the hill with a stone".split()
    rows = []
    for i in range(150):
        text = "\n".join(" ".join(good[(i * 7 + k * (j + 3)) % len(good)] + ("" if k % 5 else str(i % 9)) for k in range(24)) for j in range(1 + i % 4))
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(text)))
    rows += [(200 + i, "#@! $$ %% ^^ && ** " * 20, "en", "a", 380) for i in range(10)]
    rows += [(300, rows[1][1], "en", "b", 1), (301, rows[1][1] + " z", "en", "b", 1), (302, None, "en", "b", 0), (303, "", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found = docs.collect()
        after = {r.doc_id: getattr(r, "text", None) for r in found}
        if name == "quality":
            assert not any(200 <= i < 210 or i in (302, 303) for i in after) and len([i for i in after if i < 150]) >= 148
            assert all(before[i] == t for i, t in after.items())
        elif name == "lines":
            want = {i: "\n".join(x) for i, x in plain_lines(before).items()}
            assert after == {i: t for i, t in want.items() if t.strip() or not (before[i] or "").strip()}
        elif name == "simhash":
            want = plain_components({i: plain_fingerprint(t) for i, t in sorted(before.items())})
            assert set(after) == set(want.values())
        elif name == "mixing":
            source = {r[0]: r[3] for r in rows}
            sizes, taken = defaultdict(int), defaultdict(int)
            for i, t in before.items():
                sizes[source[i]] += len((t or "").split())
            for i, t in after.items():
                taken[source[i]] += len(t.split())
                assert len(t.split()) <= 2 * len(before[i].split())
            want = plain_targets(sizes)
            assert all(taken[s] == round(want[s]) for s in sizes)
        else:
            check_packing(found, before)
        if name != "packing":
            before = after
    again = {tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {tuple(r)[:5] for r in found}


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_of_each_group(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "x y z w"), (5, "x y z w"), (5, "other words here now"), (7, "x y z w"), (None, None), (8, "")]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "a b c d"), (5, "other words here now"), (5, "x y z w"), (8, "")]
    assert quality.QUANTILE >= 0.99


def test_extra_columns_with_the_helpers_names(spark):
    """Columns that the operators use inside, or add, pass through or are replaced as the docstrings say."""
    from cubeflow.llm import lines, mixing

    names = ["_doc", "_own", "_kept", "_kept_doc", "_lines", "_stays", "_lang", "_toxic", "_zero", "_spread", "_id", "_source", "_size", "_runs", "runs", "_i", "_n", "_h", "place", "line"]
    good = "the tree of the house by the river and the road in the valley under the hill".split()
    rows = [(i, " ".join(good[(i + k) % 16] for k in range(40)) + f"\nline {i} of it\n\nline 3 of it", "en", "a", *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for out in (lines.deduplicated(docs), mixing.mixed_documents(docs), simhash.one_of_each(docs), quality.judged(docs, labels)):
        found = out.collect()
        assert found and all([r[n] for n in names] == list(range(len(names))) for r in found)
