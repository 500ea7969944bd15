import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cubeflow.llm import packing


def check(rows, texts, capacity=2048):
    """Every id of every document lies in exactly one piece and every sequence is gapless."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    sequences = {}
    for i, ids in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        at = 0
        for start, length, crc, total in pieces:
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens, r.padded_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length, total, padded in sorted(parts):
            assert offset == at and at + length <= capacity
            at += length
        assert {p[2] for p in parts} == {at}
        assert {p[3] for p in parts} == {at if at & (at - 1) == 0 else capacity}
    return sequences


def test_round_trip_against_the_tokenizers_library(spark):
    texts = {0: None, 1: "", 2: "a <|endoftext|> b", 3: "é ß 日本語 \U0001f600 " * 300, 4: "x" * 20000, 5: "1 2\r\n\t 3  " * 900}
    texts |= {i: " ".join(f"word{k * i % 313}" for k in range(i * 7 % 900)) for i in range(6, 120)}
    docs = spark.createDataFrame([(i, t, "extra") for i, t in texts.items()], "doc_id long, text string, ids string")
    rows = packing.pack(docs).collect()
    sequences = check(rows, texts)
    padding = sum(p[0][3] - p[0][2] for p in sequences.values())
    assert padding == 0


def test_open_windows_go_on_to_the_next_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 150)  # the driver's: so many to a task of the later rounds
    texts = {i: " ".join("a" for k in range(i * 37 % 41)) for i in range(1500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(12)
    rows = packing.pack(docs, capacity=32).collect()
    sequences = check(rows, texts, 32)
    assert len({s >> packing.SEQUENCE_BITS + packing.TASK_BITS for s in sequences}) >= 3
    # only the very last windows are cut, so hardly a document below a window is
    assert sum(r.length < r.doc_tokens < 32 for r in rows) <= 120


def test_repeated_null_and_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string"), keep_ids=True)
    assert sorted(r.doc_id or 0 for r in rows.collect() if r.start == 0) == [0, 7, 7]
    whole = packing.sequences(rows).collect()
    assert sum(r.n_tokens for r in whole) == 9 and all(len(r.ids) in (1, 2, 4, 8, 2048) for r in whole)


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    packer, capacity = packing.Packer(64), 64
    for step in range(3000):
        size = int(rng.integers(1, 64))
        options = []
        for h in range(0, capacity - size + 1):
            if h and not packer.count[h]:
                continue
            n = packer.count.copy()
            n[h] -= bool(h)
            if h + size < capacity:
                n[h + size] += 1
            options.append(int((n[1:capacity] ** 2).sum()))
        chosen = packer.level_for(size)
        n = packer.count.copy()
        n[chosen] -= bool(chosen)
        if chosen + size < capacity:
            n[chosen + size] += 1
        assert int((n[1:capacity] ** 2).sum()) == min(options)
        list(packer.add(step, np.arange(size, dtype="<u4")))
