import gzip
import hashlib
import io

import pytest

from cubeflow.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")


def test_round_trip_and_revisits(spark):
    long = "<p>é " * 400
    rows = [(1, "http://a/1", long, "x"), (5, "http://a/5\r\n%41 b", long, "x"), (3, None, long, None), (2, "u", "short", None), (4, "u", "short", None), (6, "u", None, None), (7, "u", "", None)]
    rows += [(None, "u", long, None), (8, "u", "z" * 999, None), (9, "u", "z" * 999, None), (10, "u", "y" * 1000, None), (11, "u", "y" * 1000, None), (12, "u", "é " * 60000, None)]
    got = warc.restored(warc.read_archives(warc.write_archives(pages(spark, rows).repartition(3)))).collect()
    assert sorted((r.page_id or 0, r.url or "", r.html) for r in got) == sorted((r[0] or 0, r[1] or "", r[2] or "") for r in rows)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), None: ("revisit", 5), 10: ("revisit", 11)} | {i: ("response", None) for i in (2, 4, 6, 7, 8, 9, 11, 12)}
    for r in got:
        assert r.payload_digest == hashlib.sha1(r.html.encode()).hexdigest() and r.payload_bytes == len(r.html.encode())


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_members_are_single_records_and_damage_is_found():
    a, b = warc.record(1, "u", b"x" * 300000), warc.record(2, None, b"", 1, True)
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n")
    assert [r[0] for r in warc.read_records(io.BytesIO(a + b))] == [1, 2]
    plain = gzip.decompress(a)
    for bad in (a[:-9], gzip.compress(plain.replace(b"xxxx", b"xxxy", 1)), gzip.compress(plain[:-1]), gzip.compress(plain + b"z"), gzip.compress(plain[:2000]), a[:50] + b"\0\0\0" + a[53:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad + b)))
