"""Personal data by weakly supervised span detection, in DataFrame operations only.

Base detectors (strict patterns with their checks) always count.  Looser patterns propose further
spans.  Labelers vote on every proposal: for (1), against (-1) or nothing (0).  Expectation-
maximisation over the counted vote patterns of all documents estimates how reliable each labeler
is.  Its posteriors train a logistic span classifier, which sees not the votes but the span and its
surroundings: kind, the word before, length, share of digits, the characters on both sides, check digits.  It is
applied as a column expression.  The driver sees only counts, of vote patterns, at most
len(KINDS) * 3 ** len(LABELERS), and of feature patterns, at most len(KINDS) * the product of WIDTHS.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import cut

#: Kinds in the order that ties in a document's spans follow.
KINDS = ("email", "ip", "card", "phone", "secret", "national_id")
BASE_KINDS = KINDS[:4]
#: Fixed by the contract.  Where a pattern starts with a run of characters, it may start only at the
#: run's beginning or where the last match ended, which finds the same spans without rescanning the run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: A maximal run of digits with single separators; only runs of 14 to 19 digits can count.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Looser patterns: kind, what a text must contain to be looked at, pattern.
LOOSE = (
    ("email", r"(?i)[\[(]at[\])]|\bdot\b", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)|\bdot\b) ?[A-Za-z]{2,24}\b"),
    ("card", r"[0-9]{4}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"),
    ("phone", r"[0-9]{3}[-. ][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"),
    ("secret", r"[=:]", r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b ?[=:] ?[\"']?(?=[A-Za-z+/_=-]{0,255}[0-9])[A-Za-z0-9+/_=-]{8,256}"),
    ("national_id", r"[0-9]{3}-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
#: Gazetteers, fixed word lists.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
PLACEHOLDERS = ("example", "changeme", "placeholder", "password", "unknown", "optional", "required")
#: Words that stand before personal data, by kind, and before numbers that are none.
CONTEXT_BEFORE = {
    "email": r"(?i)(e-?mail|mail|contact|write|address)\W*$",
    "ip": r"(?i)(ip|host|server|address|login|from)\W*$",
    "card": r"(?i)(card|visa|credit|debit|account|payment)\W*(no|number)?\W*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell)\W*$",
    "secret": r"(?i)(\W|^)$",
    "national_id": r"(?i)(ssn|social|security|national|id|tax)\W*(no|number)?\W*$",
}
NOT_BEFORE = r"(?i)(version|isbn|issn|order|serial|invoice|article|page|[$€£#§])\W*$"
LABELERS = ("strict", "gazetteer", "context", "shape", "not_context", "frame")
EM_ROUNDS = 30
#: What the classifier sees of a span, each in so many values, and each with a weight of its own for each kind.
FEATURES = ("word", "length", "digits", "left", "right", "valid")
WIDTHS = (32, 8, 4, 4, 4, 3)
#: Code points that are looked at before a span.
CONTEXT = 24
#: Elements that are added up in one go by ``running``.
BLOCK = 64


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often the expression names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add=lambda a, x: a + x) -> Column:
    """array<bigint>: for each element of an array of bigint what the fold of those before it by ``add``, from 0, gives.

    In blocks: arrays that grow by an element are copied, and only short ones may be.
    """
    empty, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def in_block(state, x):
        return F.struct(add(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def block(state, c):
        done = F.aggregate(F.slice(values, c + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), empty.alias("out")), in_block)
        return _bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    first = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK)), first, block)
    return F.when(F.size(values) == 0, empty).otherwise(F.flatten(blocks["out"]))


def matches(text: str, must_contain: Column, pattern: str) -> Column:
    """array<struct<start, end, v, before, after>>: leftmost non-overlapping matches with their code points.

    ``before`` and ``after`` are what stands beside a match, as far as the matches next to it.
    """
    both = F.struct(F.regexp_extract_all(F.col(text), F.lit(pattern), 0).alias("ms"), F.split(F.col(text), pattern, -1).alias("gaps"))

    def placed(b):
        steps = F.transform(b["ms"], lambda m, i: (F.length(m) + F.length(F.get(b["gaps"], i))).cast("bigint"))

        def one(m, i, at):
            start = (F.get(at, i) + F.length(F.get(b["gaps"], i))).cast("int")
            last = F.when(i == 0, F.lit("")).otherwise(F.right(F.get(b["ms"], F.greatest(i - 1, F.lit(0))), F.lit(CONTEXT)))
            before = F.right(F.concat(last, F.get(b["gaps"], i)), F.lit(CONTEXT))
            after = F.left(F.concat(F.get(b["gaps"], i + 1), F.coalesce(F.get(b["ms"], i + 1), F.lit(""))), F.lit(1))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("v"), before.alias("before"), after.alias("after"))

        return _bind(running(steps), lambda at: F.transform(b["ms"], lambda m, i: one(m, i, at)))

    none = F.array().cast("array<struct<start:int,end:int,v:string,before:string,after:string>>")
    return F.when(must_contain, _bind(both, placed)).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """The digits in a string pass the Luhn check."""

    def total(d):
        value = lambda i: F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        folded = lambda n, i: n + F.when(i % 2 == 0, value(i)).otherwise(F.floor(value(i) / 5).cast("int") + (value(i) * 2) % 10)
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), folded)

    return _bind(_digits(v), lambda d: (F.length(d) > 0) & (total(d) % 10 == 0))


def base_spans(text: str) -> dict[str, Column]:
    """The contract's spans by kind."""
    has = lambda p: F.col(text).rlike(p)
    n_digits = lambda s, lo, hi: F.length(_digits(s["v"])).between(lo, hi)
    return {
        "email": matches(text, F.col(text).contains("@"), EMAIL),
        "ip": F.filter(matches(text, has(r"[0-9]\.[0-9]"), IP), lambda s: s["v"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter(matches(text, has("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), CARD), lambda s: luhn(s["v"])),
        "phone": F.filter(matches(text, has(r"\+[0-9]"), PHONE), lambda s: n_digits(s, 10, 15)),
    }


def _with_kind(spans: Column, kind: str, strict: int, source: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["v"].alias("v"), s["before"].alias("before"), s["after"].alias("after"), F.lit(strict).alias("strict"), F.lit(source == "base").alias("base")))


def _overlaps(s: Column, others: Column) -> Column:
    """A span overlaps one of an array of disjoint ones in order; found by halving."""
    n = F.size(others)
    steps = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.call_function("shiftright", F.lit(1 << 24), k))
    ahead = lambda at, step: (at + step <= n) & (F.get(others, at + step - 1)["start"] < s["end"])
    before = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(ahead(at, step), step).otherwise(0))
    return F.when(n == 0, False).otherwise(_bind(before, lambda at: (at > 0) & (F.get(others, F.greatest(at - 1, F.lit(0)))["end"] > s["start"])))


def proposals(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(row, spans): the columns ``keep`` as a struct; base spans and, where they overlap none of these, loose ones, with votes and features."""
    clean = docs.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = {k: _with_kind(s, k, 1, "base") for k, s in base_spans("text").items()}
    loose = F.concat(*[_with_kind(matches("text", F.col("text").rlike(must), p), k, 0, "loose") for k, must, p in LOOSE])
    found = clean.select("row", *[s.alias(k) for k, s in base.items()], loose.alias("loose"))

    def free(s):
        taken = F.lit(False)
        for k in base:
            taken = taken | _overlaps(s, F.col(k))
        return ~taken

    clear = F.when(F.size("loose") == 0, F.col("loose")).otherwise(F.filter("loose", free))
    found = found.select("row", F.array_sort(F.concat(*base, clear)).alias("all"))

    def by_kind(s, table: dict[str, object], otherwise):
        out = None
        for k, value in table.items():
            out = (F if out is None else out).when(s["kind"] == KINDS.index(k), value)
        return out.otherwise(otherwise)

    def vote(s):
        before, after, v, digits = s["before"], s["after"], s["v"], _digits(s["v"])
        placeholder = "(?i)[=:] ?[\"']?(" + "|".join(PLACEHOLDERS) + ")"
        yes_no = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
        gazetteer = by_kind(s, {
            "email": yes_no(F.lower(F.regexp_extract(v, "([A-Za-z]+)$", 1)).isin(*TOP_DOMAINS), F.lit(False)),
            "card": yes_no(digits.rlike("^(" + "|".join(CARD_STARTS) + ")"), F.lit(False)),
            "national_id": yes_no(F.lit(False), v.rlike("^(000|666|9)|-00-|-0000$")),
            "secret": yes_no(v.rlike("(?i)^(token|secret|passw|api|access)") & ~v.rlike(placeholder), v.rlike(placeholder)),
        }, F.lit(0))
        context = by_kind(s, {k: yes_no(before.rlike(p), F.lit(False)) for k, p in CONTEXT_BEFORE.items()}, F.lit(0))
        shape = by_kind(s, {
            "secret": yes_no(v.rlike("(?i)[=:].*[0-9].*[a-z]|[=:].*[a-z].*[0-9]"), ~v.rlike("[=:].*[0-9]")),
            "email": yes_no(v.contains("@"), F.lit(False)),
            "card": yes_no(luhn(v), F.lit(True)),
        }, yes_no(F.lit(False), digits.rlike(r"^([0-9])\1+$")))
        frame = yes_no(before.rlike(r"(^|[\s(\[<:=\"'|,])$") & ((F.length(after) == 0) | after.rlike(r"[\s)\]>;:.,\"'|!?*&%$#]")), before.rlike(r"[0-9./-]$") | after.rlike("[0-9/-]"))
        votes = [gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), yes_no(F.lit(False), before.rlike(NOT_BEFORE)).alias("not_context"), frame.alias("frame")]
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), s["strict"].alias("strict"), *votes, *seen(v, digits, before, after, shape))

    return found.select("row", F.transform("all", vote).alias("spans"))


def seen(v: Column, digits: Column, before: Column, after: Column, shape: Column) -> list[Column]:
    """The FEATURES of a span, each an integer below its width."""
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    bucket = F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(WIDTHS[0] - 1)).cast("int") + 1)
    length = F.least(F.floor(F.log2(F.length(v) + F.lit(1))), F.lit(WIDTHS[1] - 1)).cast("int")
    share = F.least(F.floor(F.length(digits) * WIDTHS[2] / F.greatest(F.length(v), F.lit(1))), F.lit(WIDTHS[2] - 1)).cast("int")
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    return [x.alias(name) for x, name in zip((bucket, length, share, side(F.right(before, F.lit(1))), side(after), shape + 1), FEATURES)]


Patterns = list[tuple[int, tuple[int, ...], float]]


def posteriors(patterns: Patterns) -> list[float]:
    """How likely a span with each (kind, votes, count) pattern is personal, by expectation-maximisation.

    Each labeler votes, given whether a span is personal, by a categorical distribution of its own.
    """
    posterior = [1 / (1 + math.exp(-sum(v))) for _, v, _ in patterns]
    for _ in range(EM_ROUNDS):
        prior = (sum(p * n for p, (_, _, n) in zip(posterior, patterns)) + 1) / (sum(n for _, _, n in patterns) + 2)
        rate = {}
        for j in range(len(LABELERS)):
            for side in (0, 1):
                # a labeler is taken to lean its way: a few votes' worth of prior belief
                mass = {-1: 1.0 + 4 * (1 - side), 0: 1.0, 1: 1.0 + 4 * side}
                for p, (_, v, n) in zip(posterior, patterns):
                    mass[v[j]] += n * (p if side else 1 - p)
                whole = sum(mass.values())
                rate[j, side] = {k: m / whole for k, m in mass.items()}
        posterior = []
        for _, v, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1][x] / rate[j, 0][x]) for j, x in enumerate(v))
            posterior.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
    return posterior


def fit(patterns: Patterns, personal: list[float], rounds: int = 300) -> np.ndarray:
    """Weights of the span classifier, a row a kind: its bias, then one for each value of each feature.

    A logistic regression of ``personal``, how much of each (kind, features, count) pattern is personal,
    by gradient descent with steps of each weight's own size.  No pattern gives a classifier that rejects all.
    """
    weights = np.zeros((len(KINDS), 1 + sum(WIDTHS)))
    if not patterns:
        weights[:, 0] = -1.0
        return weights
    offsets = np.concatenate([[0, 1], 1 + np.cumsum(WIDTHS)[:-1]])
    on = np.array([[0, *f] for _, f, _ in patterns]) + offsets + np.array([[k] for k, _, _ in patterns]) * weights.shape[1]
    count, target = np.array([n for _, _, n in patterns]), np.array(personal)
    flat, squares = weights.ravel(), np.full(weights.size, 1e-8)
    for _ in range(rounds):
        off = (1 / (1 + np.exp(-np.clip(flat[on].sum(1), -30, 30))) - target) * count
        slope = np.bincount(on.ravel(), np.repeat(off, on.shape[1]), weights.size) + 0.05 * flat
        squares += slope**2
        flat -= 0.5 * slope / np.sqrt(squares)
    return weights


def detected(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and ``spans``: array<struct<start, kind, end, base, p>>, in order.

    Null texts count as empty and have no spans.  A base span always stays, whatever its p; a loose
    one stays if its p is at least a half.  Rows are judged each, equal ones alike.  An empty table
    gives no rows.  A kept column of the name ``spans`` is replaced; others may have any name.
    """
    judged = _judged(docs, keep, text)
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in keep if c.lower() != "spans"], "spans")


def _judged(docs: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    kept = cut(proposals(docs, keep, text).select("row", "spans"), "pii-proposals")
    each = kept.select(F.explode("spans").alias("s"))
    votes = each.groupBy("s.kind", *[f"s.{x}" for x in LABELERS]).agg(F.count("*").alias("n"))
    patterns = sorted((r[0], tuple(r[1:-1]), float(r[-1])) for r in votes.collect())
    believed = {(k, v): p for (k, v, _), p in zip(patterns, posteriors(patterns))}
    # a pattern's number is its votes in base three
    number = sum((F.col(f"s.{x}") + 1) * 3**j for j, x in enumerate(LABELERS)) + F.col("s.kind") * 3 ** len(LABELERS)
    belief = [0.0] * (len(KINDS) * 3 ** len(LABELERS))
    for (k, v), p in believed.items():
        belief[sum((x + 1) * 3**j for j, x in enumerate(v)) + k * 3 ** len(LABELERS)] = p
    p = F.element_at(F.lit(belief), (number + 1).cast("int"))
    shown = each.groupBy("s.kind", *[f"s.{x}" for x in FEATURES]).agg(F.count("*").alias("n"), F.avg(F.round(p, 9)).alias("p"))
    rows = sorted(tuple(r) for r in shown.collect())
    weights = fit([(r[0], tuple(r[1:-2]), float(r[-2])) for r in rows], [r[-1] for r in rows])
    table = F.lit(np.round(weights, 9).ravel().tolist())

    def probability(s):
        at = s["kind"] * weights.shape[1]
        z, offset = F.element_at(table, at + 1), 1
        for name, width in zip(FEATURES, WIDTHS):
            z, offset = z + F.element_at(table, at + offset + s[name] + 1), offset + width
        return 1 / (1 + F.exp(-z))

    judged = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), probability(s).alias("p")))
    return kept.select("row", F.filter(judged, lambda s: s["base"] | (s["p"] >= 0.5)).alias("spans"))


def span_text(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each detected span of the text replaced by its kind in brackets; overlapping spans merge into the first.

    Texts without spans stay as they are, null ones too.  Columns of ``docs`` may have any name.
    """
    rows = _judged(docs, tuple(docs.columns), text)
    own = F.col(f"row.`{text}`")
    # the furthest end so far: a span that begins before it belongs to one before
    ends = F.transform(running(F.transform("spans", lambda s: s["end"].cast("bigint")), F.greatest), lambda e: e.cast("int"))
    chars = F.split(own, "")

    def piece(s, i, e, c):
        gap = F.array_join(F.slice(c, F.get(e, i) + 1, F.greatest(s["start"] - F.get(e, i), F.lit(0))), "")
        label = F.when(s["start"] < F.get(e, i), F.lit("")).otherwise(F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]")))
        return F.concat(gap, label)

    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    whole = _bind(F.struct(chars.alias("c"), ends.alias("e")), lambda b: F.concat(F.array_join(F.transform("spans", lambda s, i: piece(s, i, b["e"], b["c"])), ""), F.array_join(F.slice(b["c"], last + 1, F.greatest(F.size(b["c"]) - last, F.lit(0))), "")))
    return rows.select(*[F.when(F.size("spans") == 0, own).otherwise(whole).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_national_id, n_spans of all documents."""
    from cubeflow.llm.common import table

    rows = detected(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: (s["base"] | F.lit(kind not in BASE_KINDS)) & (s["kind"] == KINDS.index(kind)))).cast("long").alias(f"n_{kind}")

    counts = {kind: count(kind) for kind in KINDS}
    more = [counts[kind] for kind in KINDS if kind not in BASE_KINDS]
    return rows.select("doc_id", *[counts[kind] for kind in BASE_KINDS], F.sha2(span_text(base), 256).alias("base_sha256"), span_text("spans").alias("spans"), *more, F.size("spans").cast("long").alias("n_spans"))
