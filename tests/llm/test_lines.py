import itertools
import re

import corpus_pipeline
import xxhash

from cubeflow.llm import lines


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(texts):
    """{doc: its lines that stay}, by comparing every line with all before it."""
    out, before = {}, []
    for d in sorted(texts):
        kept = []
        for line in (texts[d] or "").split("\n"):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
            if not w or not any(w == b or min(len(w), len(b)) >= lines.NEAR_WORDS and near(w, b) for b in before):
                kept.append(line)
            before.append(w)
        out[d] = kept
    return out


def corpus():
    base = "a b c d e f g h".split()
    rows = {0: "a b c d e f g h\nshort one\nx\n\n1 2 3 4 5", 1: "short one\na b c d e f g h \n1 2 3 4", 2: None, 3: "", 4: "1 2 3 4 5 6", 5: "1 2 3 4 5 6 7", 6: "tiny\ta b c d"}
    n = 10
    for i in range(len(base) + 1):
        rows[n] = " ".join(base[:i] + ["Z"] + base[i:]) + f"\nfree line number {n} of its own kind"
        rows[n + 1] = " ".join(base[:i] + base[i + 1 :])
        rows[n + 2] = " ".join(base[:i] + [f"q{i}"] + base[i + 1 :])
        rows[n + 3] = " ".join(base[:i] + [f"q{i}", "r"] + base[i + 2 :])
        n += 4
    for k, (i, j) in enumerate(itertools.combinations(range(5), 2)):
        w = list("vwxyz")
        w[i], w[j] = w[j], w[i]
        rows[100 + k] = " ".join(w)
    rows[200] = "w " * 3000 + "\nlong tail of five words"
    rows[201] = "w " * 3001
    rows[202] = "w " * 3003
    return rows


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in texts.items()], "doc_id long, text string, n_chars long, n_lines string")
    want = plain(texts)
    got = {r.doc_id: r for r in lines.deduplicated(docs).collect()}
    for i, t in texts.items():
        left = "\n".join(want[i])
        if not left.strip() and (t or "").strip():
            assert i not in got
            continue
        assert (got[i].text or "") == left and got[i].n_chars == len(left)
        assert got[i].n_lines == len((t or "").split("\n")) and got[i].n_dropped == got[i].n_lines - len(want[i])


def test_null_ids_repeated_rows_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert lines.deduplicated(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e"), (2, "a b c d e\nkeep"), (2, "a b c d e\nkeep"), (3, "a b c d e"), (3, "other words go in here")]
    got = sorted((r.doc_id or 99, r.text) for r in lines.deduplicated(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, "a b c d e\nkeep"), (2, "a b c d e\nkeep"), (3, "other words go in here")]


def test_rows_without_an_id_whose_hashes_share_digits(spark):
    def digits(text):
        h = xxhash.xxh64_intdigest(text, 42)
        return (h - (1 << 64) if h >> 63 else h) % 10**7

    alone = {digits(t): t for t in (f"p{k} q{k} r{k} s{k} t{k}" for k in range(12000))}
    both = next(t for t in (f"one earlier line stands here\na{k} b{k} c{k} d{k} e{k}" for k in range(12000)) if digits(t) in alone)
    rows = [(1, "one earlier line stands here"), (None, alone[digits(both)]), (None, both)]
    got = {r.text for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"one earlier line stands here", alone[digits(both)], both.split("\n")[1]}


def test_equal_lines_of_any_length_and_lines_without_spaces(spark, tmp_path):
    texts = ["Top\n\nof two\n天地玄黄宇宙洪荒\n日月", " \nTop\nof  two \nof three\n \n天地玄黄宇宙\n日月", "Top", "天地玄黄宇宙洪流\n日星\n天地黄玄\nTops"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in lines.deduplicated(docs, least_words=1).collect()}
    assert got == {0: texts[0], 1: " \nof three\n \n天地玄黄宇宙", 3: "日星\n天地黄玄\nTops"}
    counts = {(r.doc_id, r.n_lines, r.n_dropped) for r in lines.op9_lines(spark, str(tmp_path)).collect()}
    assert counts == {(0, 5, 0), (1, 7, 3), (3, 4, 1)}
    assert {r.text for r in corpus_pipeline.cut_lines(spark, docs, str(tmp_path)).collect()} == set(got.values())
