"""Mixing sources to target weights.

The words of each source, its documents laid end to end, form blocks of fixed length.  Every
output shard draws a multinomial count of slots for each source; a last shard settles what the
draws leave over or short.  Slot j of a source is block p(j mod B) in pass j div B, where p is a
pseudorandom permutation of its B block indices, one for each pass, so no block is used oftener
than the passes allow.  Slots meet blocks in an equi-join on (source, block index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeflow.llm.common import cut, fresh, n_words, small_batches

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 256
SHARD_SLOTS = 65536
SEED = 20240601
#: Rows of one source are summed in runs of about so many.
RUN_ROWS = 512


class Permutation:
    """A keyed permutation of range(n): a balanced Feistel network, walked until it lands below n."""

    def __init__(self, n: int, key: int, rounds: int = 6) -> None:
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.keys = np.random.Generator(np.random.Philox(key=key)).integers(0, 1 << 63, rounds, dtype=np.uint64)
        self.mask = np.uint64((1 << self.half) - 1)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        s = np.uint64(self.half)
        a, b = x >> s, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
        return a << s | b

    def _walk(self, index: np.ndarray, back: bool) -> np.ndarray:
        x = self._step(index.astype(np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._step(x[out], back)
        return x.astype(np.int64)

    def __call__(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def inverse(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, True)


def pass_permutation(rank: int, number: int, n_blocks: int, seed: int) -> Permutation:
    return Permutation(n_blocks, (seed << 64) | (rank << 8) | number)


def slots_for(words: int, size: int, rank: int, block: int, seed: int) -> tuple[int, int]:
    """Number of slots that give a source exactly ``words`` words, and the words of the last slot."""
    if not words:
        return 0, 0
    n_blocks = -(-size // block)
    short = n_blocks * block - size
    turns = [number * n_blocks + int(pass_permutation(rank, number, n_blocks, seed).inverse(np.array([n_blocks - 1]))[0]) for number in range(-(-words // size))]
    got = lambda n: n * block - short * sum(n > t for t in turns)
    n = -(-words // block)
    while got(n) < words:
        n += 1
    return n, words - got(n - 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(key, rank, source_size, target): one row a source, from rows of (key, source, size).

    Weights repeat over the sources by code point, null last.  Targets sum to ``share`` of all
    words and stop at ``most`` times the source's words; what is over goes to the others by
    weight.  A source is at its stop exactly if its stop over its weight does not exceed the
    level that the sources from it on would get, so one pass in that order settles all.
    """
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("stop", F.col("source_size") * float(most)).withColumn("ratio", F.col("stop") / F.col("w"))
    by = Window.orderBy("ratio", "rank")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_on = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * share - before) / weight_on)
    per = per.withColumn("stopped", F.col("level") >= F.col("ratio"))
    level = F.min(F.when(~F.col("stopped"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    return per.select("key", "rank", "source_size", F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("w") * level).alias("target"))


def uses(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document and block that it has words in: (doc_id, source, size, source_size, target, at, start, stop, full, part).

    ``at`` is the document's first word in its source, [start, stop) the document's own words in
    the block, ``full`` how often the mix takes the block whole and ``part`` the first word of the
    document that the mix's last, shortened slot does not take (null: no such slot).  Documents
    without words have one row, of nulls.  Null texts have no words; null sources form one source.
    Repeated rows count each; rows equal in id, source and size may swap their results.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("key", key), "mix-sizes")
    n_runs = max(1, rows.count() // RUN_ROWS)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(n_runs)))
    targets = cut(source_targets(rows, weights, share, most), "mix-targets")

    plan = []
    for r in targets.orderBy("rank").toLocalIterator():
        n, last = slots_for(round(r.target), r.source_size, r["rank"], block, seed)
        plan.append((r["rank"], r.key, -(-r.source_size // block), n, last))
    slots = _slots(spark, plan, seed)

    runs = rows.groupBy("key", "run").agg(F.sum("size").alias("run_size"))
    run_at = F.sum("run_size").over(Window.partitionBy("key").orderBy("run")) - F.col("run_size")
    runs = runs.withColumn("run_at", run_at).join(F.broadcast(targets) if len(plan) <= 10_000 else targets, "key")
    placed = rows.join(runs, ["key", "run"])
    in_run = Window.partitionBy("key", "run").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.col("run_at") + F.sum("size").over(in_run) - F.col("size"))
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    laid = placed.withColumn("block", F.explode_outer(span))
    first = F.col("block") * block
    laid = laid.withColumn("start", F.greatest("at", first) - F.col("at")).withColumn("stop", F.least(F.col("at") + F.col("size"), first + block) - F.col("at"))
    used = slots.groupBy("key", "block").agg(F.sum(F.when(F.col("take").isNull(), 1).otherwise(0)).alias("full"), F.max("take").alias("take"))
    # the planner knows no size for what Python makes and would broadcast the slots, which grow with the data
    joined = laid.join(used.hint("merge"), ["key", "block"], "left")
    part = F.greatest(F.col("start"), F.least(F.col("stop"), first + F.col("take") - F.col("at")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "at", "start", "stop", F.coalesce("full", F.lit(0)).alias("full"), F.when(F.col("take").isNotNull(), part).alias("part"))


def _slots(spark, plan: list[tuple], seed: int) -> DataFrame:
    """(shard, key, slot, block, take) of every slot; take is null but for a source's last, shortened one.

    ``plan`` has a row for each source: (rank, key, number of blocks, slots, words of the last slot).
    """
    plan = [p for p in plan if p[3]]
    total = sum(p[3] for p in plan)
    n_shards = -(-total // SHARD_SLOTS)
    share = np.array([p[3] for p in plan], dtype=np.float64) / max(total, 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shards in batches:
            for shard in shards["id"]:
                size = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                counts = np.random.Generator(np.random.Philox(key=(seed << 64) | int(shard))).multinomial(size, share)
                yield pd.DataFrame({"shard": shard, "source_no": np.arange(len(plan)), "n": counts})

    drawn = spark.range(n_shards).mapInPandas(draw, "shard long, source_no long, n long")
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("n")
    ranges = drawn.withColumn("first", before).select("shard", "source_no", "first", (F.col("first") + F.col("n")).alias("last"))
    # the last shard takes what the draws left of each source's slots
    rest = drawn.groupBy("source_no").agg(F.sum("n").alias("first")).select(F.lit(n_shards).cast("long").alias("shard"), "source_no", "first", F.lit(1 << 62).alias("last"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for shard, no, first, last in frame.itertuples(index=False, name=None):
                rank, key, n_blocks, n, last_words = plan[no]
                for lo in range(first, min(last, n), SHARD_SLOTS):
                    slot = np.arange(lo, min(last, n, lo + SHARD_SLOTS))
                    index = np.empty_like(slot)
                    for number in np.unique(slot // n_blocks).tolist():
                        own = slot // n_blocks == number
                        index[own] = pass_permutation(rank, number, n_blocks, seed)(slot[own] - number * n_blocks)
                    take = pd.array(np.where(slot == n - 1, last_words, 0), dtype="Int64")
                    take[slot != n - 1] = pd.NA
                    yield pd.DataFrame({"shard": shard, "key": key, "slot": slot, "block": index, "take": take})

    # a range is a row and becomes up to SHARD_SLOTS: dealt by slots, not by the rows' bytes
    dealt = ranges.unionByName(rest).repartition(max(1, -(-total // (4 * SHARD_SLOTS))), "shard", "source_no")
    return dealt.mapInPandas(fill, "shard long, key string, slot long, block long, take long")


def taken_words(rows: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, from ``uses``."""
    words = F.col("full") * (F.col("stop") - F.col("start")) + F.coalesce(F.col("part") - F.col("start"), F.lit(0))
    group = ["doc_id", "source", "size", "source_size", "target", "at"]
    return rows.groupBy(*group).agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.count("*").alias("n")).select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("taken")).otherwise(F.lit(0)).cast("long").alias("taken"), F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("n")).alias("n")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with each text cut to the words that the mix takes.

    A document's runs of taken words keep the white space between them and are joined by a line
    feed, those of a second pass after those of the first; n_chars (if there) is counted anew.
    Documents of which nothing is taken go.  Rows that agree in id, source and size share runs.
    Other columns of ``docs`` may have any name.
    """
    small_batches(docs.sparkSession)
    pass_runs = lambda k: F.expr(f"filter(sort_array(collect_list(struct(start, {'if(full >= 1, stop, coalesce(part, start))' if k == 1 else 'if(full >= 2, stop, if(full = 1, coalesce(part, start), start))'} as stop))), x -> x.stop > x.start)")
    runs = uses(docs, **options).where("size > 0").groupBy("doc_id", "source", "size").agg(F.concat(pass_runs(1), pass_runs(2)).alias("runs")).where("size(runs) > 0")
    own_id, own_source, own_size, own_runs = fresh(docs, "_id", "_source", "_size", "_runs")
    runs = runs.select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("runs").alias(own_runs))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, runs: pd.Series) -> pd.Series:
        import re

        out = []
        for text, pieces in zip(texts, runs):
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            merged: list[list[int]] = []
            for p in pieces:
                if merged and merged[-1][1] == p["start"]:
                    merged[-1][1] = p["stop"]
                else:
                    merged.append([p["start"], p["stop"]])
            whole = len(merged) == 1 and merged[0] == [0, len(at)]
            out.append(text if whole else "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged))
        return pd.Series(out, dtype=object)

    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (n_words(F.col("text")) == F.col(own_size))
    out = docs.join(runs, same).withColumn("text", cut_out("text", own_runs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all documents."""
    from cubeflow.llm.common import table

    return taken_words(uses(table(spark, sf_dir, "documents")))
