"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

The hashes of a text's word shingles fall into BINS bins by their high bits, and each bin keeps its
smallest.  An empty bin borrows from a non-empty one that depends on nothing but which bins are
empty: it follows a fixed pseudorandom order of the bins and takes the first that has a value
(optimal densification).  The fingerprint stores the low eight bits of each bin's value; the
likeness of two fingerprints is their share of equal bins, less what b-bit values agree by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeflow.llm.common import WORD_GAPS, cut

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
VALUE_BITS = 8
#: An empty bin looks at so many bins of its order one by one before it ranks all that have a value.
PROBES = 6
#: Fingerprint of a text without words.
EMPTY = ""
#: Documents of so many neighbouring ids are put in order together.
ID_RUN = 256


def _probe_table() -> list[int]:
    """The first PROBES bins of each bin's order, bin by bin; a fixed rule of multiplicative hashing."""
    out = []
    for i in range(BINS):
        for t in range(PROBES):
            x = (i * PROBES + t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
            out.append(x >> 64 - BIN_BITS)
    return out


def fingerprint_sql(text: str) -> str:
    """A SQL expression for the fingerprint, lower-case hex of BINS values, of the string expression ``text``.

    ``transform(array(x), y -> ...)[0]`` binds a value that is used often, so that it is computed once.
    """
    shift, value = 64 - BIN_BITS, (1 << VALUE_BITS) - 1
    trimmed = f"btrim(coalesce({text}, ''), ' \\t\\n\\u000b\\f\\r')"
    word_hashes = f"transform(split({trimmed}, '{WORD_GAPS.replace(chr(92), chr(92) * 2)}'), w -> xxhash64(w))"
    shingled = f"if(size(ws) < {SHINGLE}, array(xxhash64(ws)), transform(slice(ws, 1, size(ws) - {SHINGLE - 1}), (x, i) -> xxhash64(x, {', '.join(f'ws[i + {k}]' for k in range(1, SHINGLE))})))"
    # one sentinel, the largest value of its bin, for each bin; after the sort the first of each bin is its smallest
    limits = "array(" + ", ".join(f"{s if (s := (b << shift | (1 << shift) - 1)) < 1 << 63 else s - (1 << 64)}L" for b in range(BINS)) + ")"
    sorted_ = f"sort_array(concat({shingled}, {limits}))"
    lowest = f"filter(hs, (x, i) -> i = 0 or shiftrightunsigned(x, {shift}) != shiftrightunsigned(hs[i - 1], {shift}))"
    # from here the bins are in signed order: position p holds bin (p + BINS/2) mod BINS, which only names them
    empty = f"(x & {(1 << shift) - 1}L) = {(1 << shift) - 1}L"
    # position and value in one number; null for an empty bin
    packed = f"transform(lo, (x, i) -> if({empty}, null, shiftleft(cast(i as bigint), {VALUE_BITS}) | (x & {value}L)))"
    probes = "array(" + ", ".join(map(str, _probe_table())) + ")"
    ranked = f"array_min(transform(ful, e -> (xxhash64(i, shiftright(e, {VALUE_BITS})) & {~value}L) | (e & {value}L)))"
    borrowed = "coalesce(" + ", ".join(f"ps[pr[i * {PROBES} + {t}]]" for t in range(PROBES)) + f", {ranked})"
    values = f"transform(ps, (x, i) -> substring(hex(coalesce(x, {borrowed}) & {value}L | {value + 1}L), 2))"
    bind = lambda name, expression, body: f"element_at(transform(array({expression}), {name} -> {body}), 1)"
    body = bind("ful", "filter(ps, x -> x is not null)", f"lower(array_join({values}, ''))")
    body = bind("pr", probes, body)
    body = bind("ps", packed, body)
    body = bind("lo", lowest, body)
    body = bind("hs", sorted_, body)
    body = bind("ws", word_hashes, body)
    return f"if(length({trimmed}) = 0, '{EMPTY}', {body})"


def likeness_sql(a: str, b: str) -> str:
    """A SQL expression for the estimated Jaccard likeness of two fingerprints, 0 to 1; two empty ones are alike."""
    chance = 1 / (1 << VALUE_BITS)
    width = VALUE_BITS // 4
    same = f"size(filter(sequence(0, {BINS - 1}), i -> substring({a}, i * {width} + 1, {width}) = substring({b}, i * {width} + 1, {width})))"
    return f"case when {a} = {b} then 1D when length({a}) = 0 or length({b}) = 0 then 0D else greatest(0D, ({same} / {BINS}D - {chance}D) / {1 - chance}D) end"


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column; null and blank texts have the empty fingerprint."""
    return docs.withColumn(name, F.expr(fingerprint_sql(f"`{text}`")))


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, run, here, next_text): each row and, after it by ascending doc_id, the next row's text; apart, those with a null id.

    After the last comes the first; equal ids are in the order of their texts.  Rows with a null id
    have no next text (null) and are nobody's next.  Rows are put in order in runs of ID_RUN ids;
    the first row of each run is also sent to the run before, marked by ``here`` = false, so no
    task sees more than a run and one row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("doc_id is not null").withColumn("run", F.floor(F.col("doc_id") / ID_RUN))
    firsts = cut(known.groupBy("run").agg(F.min("doc_id").alias("doc_id")), "runs")
    # by blocks of runs, so that the order over all runs takes a task only a block and the blocks' own firsts
    blocks = firsts.groupBy(F.floor(F.col("run") / 65536).alias("block")).agg(F.max("run").alias("last"))
    blocks = blocks.withColumn("before", F.lag("last").over(Window.orderBy("block"))).select("block", "before")
    top = firsts.agg(F.max("run").alias("top"))
    inside = firsts.withColumn("block", F.floor(F.col("run") / 65536)).withColumn("to", F.lag("run").over(Window.partitionBy("block").orderBy("run")))
    edges = inside.join(blocks, "block").crossJoin(F.broadcast(top))  # one row
    edges = edges.select("doc_id", F.coalesce("to", "before", "top").alias("to"), F.coalesce("to", "before").isNull().alias("wraps"))
    edges = cut(edges, "run-edges").withColumnRenamed("doc_id", "_id")
    sent = known.join(edges, F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("to").alias("run"), F.first("wraps").alias("wraps"))
    sent = sent.select("doc_id", "text", "run", F.lit(False).alias("here"), "wraps")
    both = known.select("doc_id", "text", "run", F.lit(True).alias("here"), F.lit(False).alias("wraps")).unionByName(sent)
    order = Window.partitionBy("run").orderBy(F.col("here").desc(), "doc_id", "text")
    placed = both.withColumn("next_text", F.lead("text").over(order))
    lone = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("long").alias("run"), F.lit(True).alias("here"), F.lit(None).cast("string").alias("next_text"))
    return placed.select("doc_id", "text", "run", "here", "next_text"), lone


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint, its edited text's, and the likenesses to that and to the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text is the text with its last floor(n/2) code points replaced by the first as many
    (or all) of the next document.  A row with a null id has no next one: its edited text lacks the
    last half, and near_next is null.  Null texts count as empty; an only row is its own next.
    """
    placed, lone = with_next(docs)

    def printed(rows: DataFrame) -> DataFrame:
        n = F.length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
        rows = rows.select("doc_id", "run", "here", n.cast("long").alias("n_chars"), "text", F.when(F.col("here"), edited).alias("edited"))
        print_edited = F.when(F.col("here"), F.expr(fingerprint_sql("edited")))
        return rows.select("doc_id", "run", "here", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(fingerprint_sql("text")).alias("fingerprint"), print_edited.alias("edited_fingerprint"), "text")

    order = Window.partitionBy("run").orderBy(F.col("here").desc(), "doc_id", "text")
    known = printed(placed).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("here")
    alone = printed(lone).withColumn("next_fingerprint", F.lit(None).cast("string"))
    out = known.unionByName(alone)
    near = lambda other: F.when(F.col(other).isNotNull(), F.expr(likeness_sql("fingerprint", other)))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses."""
    from cubeflow.llm.common import table

    return neighbours(table(spark, sf_dir, "documents"))
