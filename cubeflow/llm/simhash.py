"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits.  Every bit position gets a non-zero code of r + 1 bits; table v
(1 <= v < 2^(r+1)) keeps the positions whose code has an odd inner product with v.  The codes of
any r differing positions span at most r dimensions, so some v is orthogonal to all of them: in
that table the two fingerprints are equal.  Thus every pair within radius r meets in one of
2^(r+1) - 1 tables, without false negatives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import broadcast_if_small, connected_components, cut, fresh, small_batches

BITS = 64
RADIUS = 3


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 (seed 42) of the shingles; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    s = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = zip(starts, ends[shingle - 1 :].tolist()) if len(w) >= shingle else [(0, len(s))]
    h = np.array([xxhash.xxh64_intdigest(s[a:b], 42) for a, b in spans], dtype="<u8")
    set_in = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        set_in += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "simhash") -> DataFrame:
    """``docs`` with a long column of fingerprints (signed view of the 64 bits)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(name, fingerprint(F.col(text)))


def masks(radius: int = RADIUS) -> list[int]:
    """The bit masks of the covering tables, as signed 64-bit integers."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    out = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` values that differ in 1 to ``radius`` bits.

    Keys that only one fingerprint has are dropped before the join.  The join tests the distance
    itself and writes only pairs that link; a skewed key can be split, as neither side is grouped.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))])
    keyed = fingerprints.select("fp").distinct().select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    keyed = cut(keyed.join(shared, ["t", "key"], "left_semi"), "simhash-keys")
    a, b = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return a.join(b, ["t", "key"]).where(near).select("a", "b").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(id, text_hash, simhash, component): a row for each row of ``docs``; component is a fingerprint that names its group."""
    rows = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle)
    rows = cut(rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "simhash"), "simhash")
    classes = cut(rows.groupBy(F.col("simhash").alias("fp")).agg(F.min("id").alias("low")), "simhash-classes")
    found = connected_components(links(classes, radius))
    lows = found.join(classes, found.node == classes.fp).groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = found.join(lows, "component").select(F.col("node").alias("fp"), "component", "component_id")
    named = classes.join(of_class, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    return rows.join(named, rows.simhash == named.fp).drop("fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(id, simhash, component_id) for every row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest id reachable.  Null and blank texts have fingerprint 0 and are linked like any other.
    Repeated ids give a row each; a null id counts as no id (its row gets the smallest of the
    others, or null).  Equal fingerprints are one class, represented once, however large it is.
    """
    return groups(docs, id_col, text, radius, shingle).select(F.col("id").alias(id_col), "simhash", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest doc_id's, nulls last, then by a hash of the text."""
    rows = cut(groups(docs, "doc_id", "text", radius, shingle), "simhash-groups")
    rank = F.struct(F.col("id").isNull().alias("null_id"), "id", "text_hash")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    each = rows.groupBy("id", "text_hash", "component").agg(F.count("*").alias("n"))
    marked = cut(each.join(best, "component").select("id", "text_hash", "n", (rank == F.col("best")).alias("stays")), "simhash-marked")
    by = fresh(docs, "_i", "_n", "_h")
    plain = lambda rows: broadcast_if_small(rows.select(F.coalesce("id", F.lit(0)).alias(by[0]), F.col("id").isNull().alias(by[1]), F.col("text_hash").alias(by[2])), 40)
    own = docs.withColumns(dict(zip(by, (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))))))
    # rows that stay once as they are, and equal rows of which one stays
    once = own.join(plain(marked.where("not stays or n > 1")), by, "left_anti").select(*docs.columns)
    again = own.join(plain(marked.where("stays and n > 1")), by, "left_semi")
    again = again.groupBy(*by).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return once.unionByName(again)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents."""
    from cubeflow.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
