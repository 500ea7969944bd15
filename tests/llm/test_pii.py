import hashlib
import random
import re

from cubeflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 14 <= len(d) <= 19 and passes_luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def texts():
    rng = random.Random(7)
    parts = ["a.b@c.de", "x@y.z_q@w.org", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.01", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111111111111", "+1 (504) 555-2652", "+49.30.1234567", "+1", "+12345678901234567", "é", "\U0001f600", "\n", " ", "-", ".", "token = \"abc123def456\"", "555-12-1234", "(504) 555-2652", "joe at host dot com", "0", "12345678901237"]
    out = [None, "", "a" * 30000, "1" * 30000, "1 " * 20000, "1.1" * 9000, "a@" * 9000, "+1" * 5000, "+" + "1 " * 9000, "me@host.com " * 300]
    return out + ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(40))) for _ in range(250)]


def test_base_spans_against_the_plain_patterns(spark):
    all_texts = texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(all_texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.detected(docs).select("doc_id", pii.span_text(pii.F.filter("spans", lambda s: s["base"])).alias("base"), pii.span_text("spans").alias("spans")).collect()}
    for i, t in enumerate(all_texts):
        assert got[i].base == plain(t), t
        assert set(got[i].base.split(",")) <= set(got[i].spans.split(",")) or not got[i].base


def test_query_columns_empty_and_repeated(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op4_pii(spark, str(tmp_path)).collect()
    assert {(r.n_email, r.n_ip, r.base_sha256, r.spans) for r in rows} == {(1, 0, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6")} and len(rows) == 3
    assert pii.detected(docs.where("false")).collect() == []


def test_added_spans_and_redaction(spark):
    good = [f"my token = \"{i:032x}\" and ssn 123-45-{6000 + i}." for i in range(40)]
    bad = [f"invoice 123-45-{6000 + i}7 version 3" for i in range(40)]
    odd = [None, "", "x 1.2.3.4@a.b é +49.30.1234567, me@x.yz"]
    docs = spark.createDataFrame([(i, t, 1, "t", "r") for i, t in enumerate(good + bad + odd)], "doc_id long, text string, spans long, _text string, row string")
    rows = pii.redacted(docs).collect()
    assert all((r.spans, r._text, r.row) == (1, "t", "r") for r in rows)
    got = {r.doc_id: r.text for r in rows}
    assert all("[secret]" in got[i] for i in range(40)) and all(got[40 + i] == bad[i] for i in range(40))
    assert [got[80 + i] for i in range(3)] == [None, "", "x [email] é [phone], [email]"]


def spelled(rng, n):
    """Texts with one loose span each, and whether it is personal."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        ssn, phone = f"{rng.randrange(100, 660)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", f"{digits(3)}-{digits(3)}-{digits(4)}"
        key = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        out.append(rng.choice([
            (f"his {rng.choice(['ssn', 'SSN', 'national id'])}: {ssn}.", True), (f"please {rng.choice(['call', 'phone', 'fax'])} {phone}, thanks", True),
            (f"the {rng.choice(['token', 'password', 'api_key'])} = \"{key}\" there", True),
            (f"{rng.choice(['order', 'serial', 'invoice'])} {ssn}-{digits(0)}x", False), (f"{rng.choice(['article', 'isbn', 'version'])} {phone}/{digits(2)}", False),
            ("the password: " + rng.choice(["forgotten", "unchanged", "somewhere"]) + " again", False),
        ]))
    return out


def test_held_out_precision_and_recall(spark):
    """Trained without labels, on texts that are not counted."""
    rng = random.Random(3)
    cases = spelled(rng, 1200)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id for r in pii.detected(docs).where("size(spans) > 0").collect()}
    held = range(600, 1200)
    right = sum(i in found and cases[i][1] for i in held)
    assert right / max(1, sum(i in found for i in held)) >= 0.95 and right / sum(cases[i][1] for i in held) >= 0.9


def test_many_matches_in_one_text(spark):
    """Time follows the number of matches."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "10.0.0.1 " * n)], "doc_id long, text string")
        began = time.time()
        r = pii.detected(docs).select(pii.F.size("spans").alias("n"), pii.F.element_at("spans", -1)["start"].alias("last")).first()
        assert (r.n, r.last) == (n, 9 * (n - 1))
        return time.time() - began

    seconds(2000)
    assert seconds(80000) < 20 * max(1.0, seconds(4000))


def test_em_finds_the_unreliable_labeler():
    rng = random.Random(1)
    counts, true_of = {}, {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = tuple((1 if true else -1) if rng.random() < q else (-1 if true else 1) for q in (0.95, 0.9, 0.9, 0.5, 0.85, 0.9))
        counts[0, votes] = counts.get((0, votes), 0) + 1
        true_of[0, votes] = true_of.get((0, votes), 0) + true
    p = pii.posteriors([(k, v, float(n)) for (k, v), n in counts.items()])
    right = sum(n - true_of[key] if q < 0.5 else true_of[key] for (key, n), q in zip(counts.items(), p))
    assert right / 4000 >= 0.97
    # turning the unreliable vote changes next to nothing, turning a reliable one does
    by = dict(zip(counts, p))
    shift = lambda j: sum(abs(by[0, v] - by[0, w]) for _, v in counts if (0, w := (*v[:j], -v[j], *v[j + 1 :])) in by)
    assert shift(3) < 0.3 * min(shift(j) for j in (0, 1, 2))
