"""Shared helpers: tables, the shared folder, lineage cuts, checked broadcasts and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (fixed by the contracts): space and \x09-\x0D.
WORD_GAPS = "[\\x20\\x09-\\x0D]+"
#: A side of a join is broadcast only if it has at most so many bytes, rows times bytes a row.
BROADCAST_BYTES = 32 << 20


#: Largest Arrow batch that is sent to Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of texts for Python are bounded by bytes: rows alone, as they can be long, bound nothing."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cubeflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: later losses recompute from there."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a cut that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are cut and no longer referred to; else they stay until a chance collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``docs`` has not: each given one, with underscores before it as needed."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted rows fit in BROADCAST_BYTES; else ``df`` as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def words(text):
    """Column: the array of words of a text; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAPS))


def n_words(text):
    """Column: the number of words of a text (long)."""
    return F.size(words(text)).cast("long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star contraction: a logarithmic number of rounds, each a
    fixed number of equi-joins, cut to the shared folder so that nothing is recomputed.  A node
    of very many edges meets only its own minimum, one row, so a join that is skewed on it can
    be split; no pair of its neighbours is ever made.
    """

    def star(both: DataFrame, larger_only: bool) -> DataFrame:
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(low, "a")
        if larger_only:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("a <> m").select("a", F.col("m").alias("b")))

    e = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(star(both, True).distinct(), "edges")
        e = cut(star(large, False).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
