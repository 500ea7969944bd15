"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts are gathered from every trusted document, summed by n-gram, and joined with the totals of
their contexts and the probabilities of their suffixes, order by order.  The finished table lies in
shards in the shared folder.  All n-grams and contexts that one position of a text can ask for have
the two bytes before it in common, which name the shard; so scoring joins each batch of positions
with the shards one by one, with only as many shards in memory as fit, and shuffles no n-grams.
Orders 1 and 2 (at most 65,536 entries) are in arrays.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cubeflow.llm.common import broadcast_if_small, cut, fresh, shared_path, small_batches

ORDER = 5
QUANTILE = 0.99
#: With fewer held-out trusted documents a language's quantile says little; it is then held to the looser of its own and all languages'.
LEAST_TRUSTED = 50
#: One trusted document in so many is not trained on but sets the thresholds: a model knows its own texts too well.
HELD_OUT = 5
SHARD_ENTRIES = 4_000_000
#: Shards that a worker keeps in memory; at least one.
CACHE_BYTES = 256 << 20
CHUNK = 1 << 19
#: Distinct n-grams that a counting task holds before it hands them on.
MOST_HELD = 4_000_000
CONTEXT = 1 << 48
ORDER_SHIFT = 44


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """The big-endian value of the ``order`` bytes that end at each position from order - 1 on."""
    x = np.zeros(max(0, len(data) - order + 1), dtype=np.int64)
    for k in range(order):
        x = (x << 8) | data[k : k + len(x)]
    return x


def padded(text: str | None, order: int = ORDER) -> bytes:
    return bytes(order - 1) + (text or "").encode("utf-8", "surrogatepass")


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts of ``docs``; each task sums its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        parts, size = [], 0

        def add() -> None:
            if parts:
                held.append(np.unique(np.concatenate(parts), return_counts=True))
                parts.clear()
            if len(held) > 8 or sum(len(h[0]) for h in held) > MOST_HELD:
                g, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                held[:] = [(g, np.bincount(inverse, np.concatenate([h[1] for h in held])).astype(np.int64))]

        def out() -> pa.RecordBatch:
            held.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            g, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([h[1] for h in held]), len(g)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                data = np.frombuffer(padded(text.as_py(), order), dtype=np.uint8)
                for k in range(0, len(data), CHUNK):
                    x = codes(data[k : k + CHUNK + order - 1], order)
                    parts.append(x)
                    size += len(x)
                    if size >= CHUNK:
                        add()
                        size = 0
                        if len(held[0][0]) > MOST_HELD:
                            yield out()
        add()
        yield out()

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of n-grams seen once, twice and oftener; 0.75 where the counts of counts cannot say."""
    seen = counts.agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (x or 0 for x in seen)
    if not (n1 and n2 and n3):
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


@dataclass
class Model:
    """Where the shards lie and the tables of orders 1 and 2; ``gamma``, ``log_p``: by context byte and by bytes, NaN if not seen."""

    folder: str
    n_shards: int
    order: int
    log_p1: np.ndarray
    log_p2: np.ndarray
    log_gamma1: np.ndarray
    cache: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": OrderedDict()}

    def shard(self, k: int) -> HashTable:
        if k not in self.cache:
            store, root = fs.FileSystem.from_uri(f"{self.folder}/shard={k}")
            files = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
            tables = [pq.read_table(f.path, filesystem=store, columns=["key", "value"], partitioning=None) for f in sorted(files, key=lambda f: f.path)]
            got = pa.concat_tables(tables) if tables else pa.table({"key": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
            self.cache[k] = HashTable(got["key"].to_numpy(), got["value"].to_numpy())
            while len(self.cache) > 1 and sum(t.bytes for t in self.cache.values()) > CACHE_BYTES:
                self.cache.popitem(last=False)
        self.cache.move_to_end(k)
        return self.cache[k]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram of full order, given the bytes before it."""
        if self.n_shards == 1:
            return self._in_shard(x, self.shard(0))
        out, where = np.empty(len(x)), shard_of(x, self.n_shards)
        for k in np.unique(where).tolist():
            own = np.flatnonzero(where == k)
            out[own] = self._in_shard(x[own], self.shard(k))
        return out

    def _in_shard(self, x: np.ndarray, table: HashTable) -> np.ndarray:
        out = table.get(x | (self.order << ORDER_SHIFT))
        left = np.flatnonzero(np.isnan(out))
        weight = np.zeros(len(left))
        for o in range(self.order, 2, -1):
            if o < self.order:
                p = table.get((x[left] & ((1 << 8 * o) - 1)) | (o << ORDER_SHIFT))
                hit = ~np.isnan(p)
                out[left[hit]] = weight[hit] + p[hit]
                left, weight = left[~hit], weight[~hit]
            if not len(left):
                return out
            gamma = table.get(((x[left] & ((1 << 8 * o) - 1)) >> 8) | (o << ORDER_SHIFT) | CONTEXT)
            weight = weight + np.nan_to_num(gamma, nan=0.0)
        two = x[left] & 0xFFFF
        last = np.where(np.isnan(self.log_p2[two]), np.nan_to_num(self.log_gamma1[two >> 8], nan=0.0) + self.log_p1[two & 0xFF], self.log_p2[two])
        out[left] = weight + last
        return out


class HashTable:
    """Open addressing over arrays; ``get`` gives NaN for keys that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, np.nan)
        self.bytes = self.keys.nbytes * 2
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.nan)
        look = np.flatnonzero((there != keys) & (there != -1))
        while len(look):
            slot[look] = (slot[look] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[look]]
            hit = there == keys[look]
            out[look[hit]] = self.values[slot[look[hit]]]
            look = look[~hit & (there != -1)]
        return out


def shard_of(x: np.ndarray, n_shards: int) -> np.ndarray:
    """By the two bytes before the last."""
    return ((x >> 8) & 0xFFFF) * 40503 % 65536 % n_shards


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of ``trusted``.  Without any text, every byte is equally likely."""
    spark = trusted.sparkSession
    counts = {order: cut(gram_counts(trusted, order), "kn-counts")}
    for o in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * o) - 1))
        counts[o] = counts[o + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n"))
        if o > 1:
            counts[o] = cut(counts[o], "kn-counts")
    tables, below = [], None
    log_p1, log_p2, log_gamma1 = np.full(256, -math.log(256)), np.full(1 << 16, np.nan), np.full(256, np.nan)
    for o in range(1, order + 1):
        d1, d2, d3 = discounts(counts[o])
        cost = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = counts[o].withColumn("d", cost).withColumn("context", F.shiftright("gram", 8))
        contexts = cut(own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("off")).select("context", "total", (F.col("off") / F.col("total")).alias("gamma")), "kn-contexts")
        own = own.join(contexts, "context")
        if o == 1:
            own = own.withColumn("lower", F.lit(1 / 256))
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (o - 1)) - 1))).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        below = cut(own.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p")), "kn-p")
        if o <= 2:  # at most 256 and 65,536 rows
            for gram, p in below.toLocalIterator():
                (log_p1 if o == 1 else log_p2)[gram] = math.log(p)
            for context, _, gamma in contexts.toLocalIterator():
                if o == 2:
                    log_gamma1[context] = math.log(gamma)
                else:
                    unseen = np.ones(256, dtype=bool)
                    unseen[[r.gram for r in below.select("gram").collect()]] = False
                    log_p1[unseen] = math.log(gamma / 256)
        else:
            flag = o << ORDER_SHIFT
            tables.append(below.select(F.col("gram").bitwiseOR(F.lit(flag)).alias("key"), F.log("p").alias("value"), F.shiftright("gram", 8).alias("by")))
            tables.append(contexts.select(F.col("context").bitwiseOR(F.lit(flag | CONTEXT)).alias("key"), F.log("gamma").alias("value"), F.col("context").alias("by")))
    entries = tables[0]
    for t in tables[1:]:
        entries = entries.unionByName(t)
    n_shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    shard = F.col("by").bitwiseAND(F.lit(0xFFFF)) * 40503 % 65536 % n_shards
    folder = shared_path(spark, "kn-shards")
    entries.select("key", "value", shard.alias("shard")).repartition(min(n_shards, 2000), "shard").write.partitionBy("shard").parquet(folder)
    return Model(folder, n_shards, order, log_p1, log_p2, log_gamma1)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with text_bytes and perplexity (a byte; null for null and empty texts)."""
    names = docs.columns
    at = names.index("text")
    schema = StructType([*docs.schema.fields, StructField("text_bytes", LongType()), StructField("perplexity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, length = np.zeros(n), np.zeros(n, dtype=np.int64)
            held: list[tuple[int, np.ndarray]] = []
            size = 0

            def settle() -> None:
                x = np.concatenate([h[1] for h in held])
                starts = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])[:-1]])
                sums = np.add.reduceat(model.log_probabilities(x), starts)
                for (i, own), s in zip(held, sums):
                    total[i] += s
                    length[i] += len(own)
                held.clear()

            for i, text in enumerate(batch.column(at)):
                data = np.frombuffer(padded(text.as_py(), model.order), dtype=np.uint8)
                for k in range(0, len(data) - model.order + 1, CHUNK):
                    held.append((i, codes(data[k : k + CHUNK + model.order - 1], model.order)))
                    size += len(held[-1][1])
                    if size >= CHUNK:
                        settle()
                        size = 0
            if held:
                settle()
                size = 0
            perplexity = pa.array(np.exp(-total / np.maximum(length, 1)), mask=length == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), perplexity], names=[*names, "text_bytes", "perplexity"])

    return docs.mapInArrow(run, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that every label calls good and not toxic; repeated and null labels do not count twice."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that any label calls toxic."""
    return labels.where("doc_id is not null and toxic = 1").select("doc_id").distinct()


def thresholds(scores: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """(lang, threshold): the quantile of the trusted documents' perplexity in each language of ``scores``.

    A language with fewer than ``least_trusted`` of them takes the larger of its own and the quantile of all.
    """
    own = scores.where("perplexity is not null").join(trusted, "doc_id", "left_semi")
    by = own.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"), F.count("*").alias("n"))
    whole = own.agg(F.percentile_approx("perplexity", quantile, 10000).alias("whole"))
    langs = scores.select("lang").distinct()
    joined = langs.alias("l").join(by.alias("b"), F.col("l.lang").eqNullSafe(F.col("b.lang")), "left").crossJoin(F.broadcast(whole))  # one row
    return joined.select("l.lang", F.when(F.col("n") >= least_trusted, F.col("own")).otherwise(F.greatest("own", "whole")).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, keep_text: bool = True, least_trusted: int = LEAST_TRUSTED) -> DataFrame:
    """``docs`` with text_bytes, perplexity, threshold and good.

    A document is good if its perplexity does not exceed its language's threshold, a quantile of
    the trusted documents that the model was not trained on, and no label calls it toxic.  Null and
    empty texts are not good.
    A language with fewer than ``least_trusted`` such documents is held to the larger of its own
    quantile and that of all.  Without any such document there is no threshold and all other texts are good.
    Rows that repeat an id are judged each; a null lang is a language of its own.  Columns of
    ``docs`` that have the names of the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("text_bytes", "perplexity", "threshold", "good")
    ids = trusted_ids(labels)
    ids = cut(ids.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0), "trusted")
    model = train(docs.join(broadcast_if_small(ids.where("not held").select("doc_id"), 24), "doc_id", "left_semi"))
    rows = scored(docs if keep_text else docs.select("doc_id", "lang", "text"), model)
    rows = cut(rows if keep_text else rows.drop("text"), "scores")
    limits = thresholds(rows.select("doc_id", "lang", "perplexity"), ids.where("held").select("doc_id"), quantile, least_trusted)
    lang, is_toxic, zero, spread_name = fresh(rows, "_lang", "_toxic", "_zero", "_spread")
    limits = cut(limits, "thresholds").select(F.col("lang").alias(lang), "threshold")
    out = rows.join(broadcast_if_small(limits, 40), F.col("lang").eqNullSafe(F.col(lang)), "left").drop(lang)
    # null ids match nothing; a second key spreads them where the join shuffles
    toxic = toxic_ids(labels).select(F.col("doc_id").alias(is_toxic), F.lit(0).alias(zero))
    spread = F.when(F.col("doc_id").isNull(), F.hash("perplexity", "text_bytes")).otherwise(0)
    out = out.withColumn(spread_name, spread).join(broadcast_if_small(toxic, 24), (F.col("doc_id") == F.col(is_toxic)) & (F.col(spread_name) == F.col(zero)), "left")
    good = F.col(is_toxic).isNull() & F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.withColumn("good", good).drop(is_toxic, zero, spread_name)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, lang, text_bytes, perplexity, threshold of the documents that the classifier keeps."""
    from cubeflow.llm.common import table

    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep_text=False)
    return rows.where("good").drop("good")
