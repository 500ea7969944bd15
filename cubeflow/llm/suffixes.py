"""Removal of long repeated substrings by a difference cover.

Of the suffixes of all texts only those at positions of a difference cover modulo V are sorted at
first: for any two positions there is a shift below V that takes both into the cover, so two equal
strings of LENGTH symbols contain two sampled suffixes, at the same distance from their beginnings,
that agree in their first LENGTH - V + 1 symbols.  Sorting these prefixes names them; a name held
once rules its surroundings out.  Suffixes with repeated names recur with longer names, which reach
to both sides as far as any string that begins in one of ASPECTS ranges before them must agree, and
only the windows around repeated long names are taken on.

The remaining windows are named in turn, by their LENGTH symbols.  Runs of them are first compared
whole: content picks anchors among the windows, and a stretch between two anchors that occurs twice
settles all its windows, so that one occurrence speaks for its class from then on.  What is left,
the ends of repeated runs, is merged with the classes' windows, sorted, and adjacent entries are
compared.  Strings are named by 96 or 128 bits of polynomial hashes.  Sorting is Spark's, which spills;
groups of equal names stream by in sorted order, so the size of a group does not matter.  The names of
sampled positions, most of all rows, travel packed, and are sorted bucket by bucket.  Names that
a sample of the texts shows to recur very often need no comparison: their rows are dealt out by text.

The same search runs over two kinds of symbols: BYTES, strings of 400, and WORDS, passages of 51.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import broadcast_if_small, cut, release, small_batches

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
BATCH = 1 << 16
#: Bytes of text that are worked on at once where whole batches are.
PIECE_BYTES = 1 << 19
#: Names that recur HOT_COUNT times or oftener in one of HOT_SHARE texts are dealt by text and not by name; at most so many.
#: The bound is on this hint alone: names beyond it are compared like any other.
HOT_SHARE, HOT_COUNT, MOST_HOT = 64, 8, 1 << 16
#: Rows of names that go out packed by buckets, that a bucket is meant to hold, and half of those that are held at most before their groups are settled.
PACKED = 1 << 19


class Names:
    """Polynomial hashes, modulo 2^64, of any stretches of one text's symbols; two of them name a stretch."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: list[np.ndarray]) -> None:
        self.n = len(symbols[0])
        self.sums = []
        for k, x in enumerate(symbols):
            up, _ = self._table(k, self.n + 1)
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(x * up[: self.n], out=s[1:])
            self.sums.append(s)

    @classmethod
    def _table(cls, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse."""
        if k not in cls._powers or len(cls._powers[k][0]) < n:
            n = max(1 << 16, 1 << (n - 1).bit_length())
            out = []
            for base in (BASES[k] | 1, pow(BASES[k] | 1, -1, 1 << 64)):
                p = np.ones(n, dtype=np.uint64)
                p[1:] = base
                out.append(np.cumprod(p, dtype=np.uint64))
            cls._powers[k] = tuple(out)
        return cls._powers[k]

    def of(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        s, (_, down) = self.sums[k], self._table(k, self.n + 1)
        h = (s[stop] - s[start]) * down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


_BYTE_VALUES = np.random.Generator(np.random.Philox(key=400)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def byte_symbols(x: np.ndarray, ends: np.ndarray, both: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Values of the bytes of texts laid end to end, and where each text ends among them."""
    return [_BYTE_VALUES[k][x] for k in range(1 + both)], ends


def word_bounds(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words; gaps are space and \\x09-\\x0D, and words end where texts do."""
    word = ~((x == 32) | ((x >= 9) & (x <= 13)))
    before, after = np.zeros(len(x) + 1, dtype=bool), np.zeros(len(x) + 1, dtype=bool)
    before[1:], after[:-1] = word, word
    before[ends], after[ends] = False, False
    return np.flatnonzero(word & ~before[:-1]), np.flatnonzero(word & ~after[1:]) + 1


def word_symbols(x: np.ndarray, ends: np.ndarray, both: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Values of the words of texts laid end to end, and where each text ends among them."""
    names, (start, stop) = Names(byte_symbols(x, ends, both)[0]), word_bounds(x, ends)
    return [names.of(start, stop, k).view(np.uint64) for k in range(1 + both)], np.searchsorted(start, ends)


@dataclass(frozen=True)
class Kind:
    """What strings are made of, how long a repeated one is, and the cover that finds it.

    ``cover`` is a perfect difference set, fixed values: every residue modulo ``v`` is a difference of
    two.  A window begins up to v - 1 symbols before a sampled position; a range of these beginnings,
    ``step`` wide, has in common the length - step + 1 symbols from the range's end on.  One window in
    ``anchor`` is an anchor.
    """

    name: str
    symbols: Callable[[np.ndarray, np.ndarray, bool], tuple[list[np.ndarray], np.ndarray]]
    length: int
    v: int
    cover: tuple[int, ...]
    aspects: int
    step: int
    anchor: int
    least_bytes: int

    @property
    def prefix(self) -> int:
        return self.length - self.v + 1

    def names(self, row, both: bool = True) -> Names:
        x = np.frombuffer(_data(row), dtype=np.uint8)
        return Names(self.symbols(x, np.array([len(x)]), both)[0])

    def sampled(self, n: int) -> np.ndarray:
        """The cover's positions in a text of n symbols at which a prefix fits."""
        return self.sampled_in(np.array([n]))[0]

    def sampled_in(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cover's positions, counted in each text from its start, in texts laid end to end, and the numbers of their texts."""
        starts = np.concatenate([[0], ends[:-1]])
        rounds = -(-(ends - starts) // self.v)
        text = np.repeat(np.arange(len(ends)), rounds)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
        at = ((starts[text] + nth * self.v)[:, None] + np.array(self.cover)[None, :]).ravel()
        text = np.repeat(text, len(self.cover))
        fits = at + self.prefix <= ends[text]
        return at[fits], text[fits]

    def ranges(self, names: Names, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first window, last window): what windows around sampled positions have in common, range by range."""
        out = []
        for k in range(self.aspects):
            start = at - k * self.step
            start = start[(start >= 0) & (start + self.length - self.step + 1 <= names.n)]
            out.append((names.of(start, start + self.length - self.step + 1) ^ np.int64(k), start - self.step + 1, start))
        return tuple(np.concatenate(x) for x in zip(*out))

    def candidates(self, names: Names, keys: np.ndarray) -> np.ndarray:
        """The windows, by start, in the ranges whose long names are among the repeated ones."""
        name, first, last = self.ranges(names, self.sampled(names.n))
        hit = np.isin(name, keys)
        top = max(names.n - self.length, -1)
        edge = np.zeros(top + 2, dtype=np.int64)
        np.add.at(edge, np.clip(first[hit], 0, top + 1), 1)
        np.add.at(edge, np.clip(last[hit] + 1, 0, top + 1), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)

    def stretches(self, names: Names, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) windows of the stretches between neighbouring anchors of a run of candidates."""
        anchors = windows[names.of(windows, windows + self.length) % self.anchor == 0]
        run = np.cumsum(np.concatenate([[0], np.diff(windows) > 1]))
        of = run[np.searchsorted(windows, anchors)]
        joined = np.flatnonzero(of[1:] == of[:-1]) if len(anchors) > 1 else np.empty(0, dtype=np.int64)
        return anchors[joined], anchors[joined + 1]


BYTES = Kind("bytes", byte_symbols, 400, 273, (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256), 4, 69, 32, 400)
#: 51 words are at least as many bytes and the gaps between them.
WORDS = Kind("words", word_symbols, 51, 31, (1, 5, 11, 24, 25, 27), 4, 8, 8, 101)


def repeated(texts: DataFrame, schema: str, make: Callable, keys: list[str], high: str | None = None, whole: bool = False) -> DataFrame:
    """The rows that ``make`` draws from each text (or whole batch of texts), of those whose key another row has too; equal keys stream by in sorted order.

    The upper 32 bits of the long column ``high``, if given, belong to the key.  A row whose key is
    known to recur often goes to a task by its text's hash, so that no task gets all of a hot key;
    the known keys are those of a fixed part of the texts, so a task that runs again deals alike.
    Hashes of texts are even; a row with an odd one is known to recur.
    """
    order, names = keys + [high] * bool(high), [f.split()[0] for f in schema.split(", ")]
    part = _part(texts, schema, make, whole)
    by = [F.col(k) for k in keys] + ([F.shiftright(high, 32)] if high else [])
    often = part.groupBy(*by).agg(F.count("*").alias("c")).where(F.col("c") >= HOT_COUNT).orderBy(F.desc("c"), keys[0]).limit(MOST_HOT)
    hot = np.unique(np.array([r[0] for r in often.collect()], dtype=np.int64))
    rows = _over_texts(texts, schema, make, (keys[0], hot), whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_same = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            same = np.ones(t.num_rows - 1, dtype=bool)
            for k in keys:
                x = t[k].to_numpy()
                same &= x[1:] == x[:-1]
            if high:
                x = t[high].to_numpy() >> 32
                same &= x[1:] == x[:-1]
            before = np.concatenate([[held_same], same])
            keep = before | np.concatenate([same, [False]]) | (t["h"].to_numpy() & 1 == 1)
            held_same = bool(before[-1])
            out = t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1]))
            held = t.slice(t.num_rows - 1).to_batches()[0]
            yield from out.to_batches()
        if held is not None and (held_same or held["h"][0].as_py() & 1):
            yield held

    deal = F.when(F.col("h").bitwiseAND(F.lit(1)) == 1, F.col(keys[0]).bitwiseXOR(F.col("h"))).otherwise(F.col(keys[0]))
    out = rows.repartition(deal).sortWithinPartitions(*order).mapInArrow(run, schema)
    return out.withColumn("h", F.col("h").bitwiseAND(F.lit(-2))).select(*names)


def repeated_names(texts: DataFrame, make: Callable, whole: bool = False) -> DataFrame:
    """(h, keys) for the texts from which ``make`` draws keys (key, h) that another row has too; keys is an array of these.

    As ``repeated``, but rows travel packed, many to a row of Spark's: each goes to the bucket that its
    key (a known one's text) says, Spark sorts the buckets, and what lies in one is sorted here.  Those
    that recur come back to their texts in the same way.
    The number of buckets follows the rows of the fixed part of the texts.
    """
    counts = _part(texts, "key long, h long", make, whole).groupBy("key").agg(F.count("*").alias("c"))
    often = counts.groupBy(F.when(F.col("c") >= HOT_COUNT, F.col("key")).alias("key")).agg(F.sum("c").alias("c"))
    often = often.orderBy(F.col("key").isNotNull(), F.desc("c"), "key").limit(MOST_HOT + 1).collect()
    hot = np.unique(np.array([r.key for r in often if r.key is not None], dtype=np.int64))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * -(-max(1, HOT_SHARE * sum(r.c for r in often)) // (PACKED * tasks))
    rows = _over_texts(texts, "key long, h long", make, ("key", hot), whole, buckets)

    def settled(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of keys that recur, a key's once for neighbours of one text, and one row of each key, odd where it recurs."""
        key, h = np.concatenate(parts, axis=1)
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        keep = ~new | ~np.append(new[1:], True) | (h & 1 == 1)
        rest = np.stack([key[new], h[new] | keep[new]])
        keep[1:] &= new[1:] | (h[1:] != h[:-1])
        return np.stack([key[keep], h[keep] & ~np.int64(1)]), rest

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        parts, size, now = [], 0, None
        for bucket, part in _unpacked(batches):
            if parts and bucket != now:
                yield settled(parts)[0]
                parts, size = [], 0
            now = bucket
            parts.append(part)
            size += part.shape[1]
            if size > 2 * PACKED:
                out, rest = settled(parts)
                yield out
                parts, size = [rest], 0
        if parts:
            yield settled(parts)[0]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for part in recurring(batches):
            parts.append(part)
            size += part.shape[1]
            if size >= PACKED:
                key, h = np.concatenate(parts, axis=1)
                parts, size = [], 0
                yield _packed(h, key, h, buckets)
        if size:
            key, h = np.concatenate(parts, axis=1)
            yield _packed(h, key, h, buckets)

    def by_text(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, h = np.concatenate(parts, axis=1)
        order = np.argsort(h)
        key, h = key[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(key))], names=["h", "keys"])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for bucket, part in _unpacked(batches):
            if parts and bucket != now:
                yield by_text(parts)
                parts = []
            now = bucket
            parts.append(part)
        if parts:
            yield by_text(parts)

    def dealt(packed: DataFrame) -> DataFrame:
        return packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")

    return dealt(dealt(rows).mapInArrow(back, "bucket long, packed binary")).mapInArrow(texts_of, "h long, keys array<long>")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its keys and their h) of packed rows."""
    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed")):
            yield bucket, np.frombuffer(packed.as_buffer(), dtype=np.int64).reshape(2, -1)


def _packed(by: np.ndarray, key: np.ndarray, h: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, as the hash ``by`` says, that has any: its keys and then their h, as the bytes of both."""
    bucket = ((by.view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    key, h, bucket = key[order], h[order], bucket[order].astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(key))
    size, at = np.diff(ends), np.arange(len(key))
    data = np.empty(2 * len(key), dtype=np.int64)
    data[at + np.repeat(first, size)], data[at + np.repeat(ends[1:], size)] = key, h
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((16 * ends).astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), packed], names=["bucket", "packed"])


def _part(texts: DataFrame, schema: str, make: Callable, whole: bool) -> DataFrame:
    """What ``make`` draws from a fixed part of the texts."""
    return _over_texts(texts.where(F.pmod(F.shiftright("h", 1), F.lit(HOT_SHARE)) == 0), schema, make, whole=whole)


def _over_texts(frame: DataFrame, schema: str, make, hot: tuple[str, np.ndarray] | None = None, whole: bool = False, buckets: int = 0) -> DataFrame:
    """``make(row)`` gives arrays for the long columns of ``schema`` for each row, or for each ``whole`` batch; rows go out in large batches.

    With ``hot``, a key column and its known repeated values, h is made odd where the key is one of these.
    With ``buckets``, so many of them, rows (key, h) go out packed by bucket.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*parts)]
            parts.clear()
            if hot is not None and len(hot[1]):
                key, h = cols[names.index(hot[0])], names.index("h")
                at = np.searchsorted(hot[1], key)
                cols[h] = cols[h] | (hot[1][np.minimum(at, len(hot[1]) - 1)] == key)
            if buckets:
                key, h = cols
                return _packed(np.where(h & 1 == 1, key ^ h, key), key, h, buckets)
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

        for batch in batches:
            for piece in _pieces(batch) if whole else range(batch.num_rows):
                arrays = make(piece if whole else {name: batch.column(name)[piece] for name in batch.schema.names})
                if len(arrays[0]):
                    parts.append(arrays)
                    size += len(arrays[0])
                if size >= (PACKED if buckets else BATCH):
                    yield out()
                    size = 0
        if parts:
            yield out()

    return frame.mapInArrow(run, "bucket long, packed binary" if buckets else schema)


def _twice(keys: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Indices of the first two of each key (in each text, numbered in order): enough to tell that it repeats, however repetitive a text is."""
    if len(keys) < 3:
        return np.arange(len(keys))
    order = np.argsort(keys)
    ordered = keys[order]
    third = ordered[2:] == ordered[:-2]
    if not third.any():
        return np.arange(len(keys))
    many = np.zeros(len(keys), dtype=bool)  # of keys that are there three times or oftener
    for k in range(3):
        many[k : len(keys) - 2 + k] |= third
    at = np.sort(order[many])
    order, own = np.argsort(keys[at], kind="stable"), order[~many]
    at = at[order]
    new = np.concatenate([[True], keys[at[1:]] != keys[at[:-1]]])
    if text is not None:
        new[1:] |= text[at[1:]] != text[at[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return np.sort(np.concatenate([own, at[np.arange(len(at)) - first < 2]]))


def _data(row) -> bytes:
    return row["text"].as_buffer().to_pybytes()


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PIECE_BYTES of text, one text at least."""
    if batch.num_rows:
        ends = _laid(batch.column("text"))[1]
        firsts = np.flatnonzero(np.diff(ends // PIECE_BYTES, prepend=-1)).tolist()
        for a, b in zip(firsts, [*firsts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, end to end as they lie in its buffer, and where each text ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def repeated_windows(texts: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """(h, spans) of the texts, rows (h, text) that differ and have even h, in which a string of ``kind`` starts that starts elsewhere too.

    ``spans`` is an array of flat pairs (first window, last window), all of whose windows are such.
    """
    small_batches(texts.sparkSession)
    texts = texts.where(F.octet_length("text") >= kind.least_bytes)

    def sample(batch):
        symbols, ends = kind.symbols(*_laid(batch.column("text")), False)
        names = Names(symbols)
        at, text = kind.sampled_in(ends)
        name = names.of(at, at + kind.prefix)
        two = _twice(name, text)
        return name[two], batch.column("h").to_numpy()[text[two]]

    def recur(row):
        names = kind.names(row, both=False)
        at = kind.sampled(names.n)
        name, *_ = kind.ranges(names, at[np.isin(names.of(at, at + kind.prefix), keys_of(row))])
        name = name[_twice(name)]
        return name, np.full(len(name), row["h"].as_py())

    spark = texts.sparkSession
    keys_of = lambda row: row["keys"].values.to_numpy()

    def with_keys(frame: DataFrame, make, name: str, whole: bool = False) -> DataFrame:
        """The texts that have repeated names, with these."""
        by_text = cut(repeated_names(frame, make, whole), name)
        release(spark)
        own = texts.join(broadcast_if_small(by_text.select("h"), 8), "h", "left_semi")
        return own.join(by_text, "h").select("h", "text", "keys")

    held = cut(with_keys(with_keys(texts, sample, "suffix-names", whole=True), recur, "suffix-long-names"), "suffix-texts")
    release(spark)

    def stretch(row):
        """The first two stretches of each name, which tell that it repeats; the spans of further ones are sure, and have no name."""
        names, h = kind.names(row), row["h"].as_py()
        first, last = kind.stretches(names, kind.candidates(names, keys_of(row)))
        k1, k2 = names.of(first, last + kind.length), names.of(first, last + kind.length, 1)
        two = _twice(k1)
        often = np.ones(len(k1), dtype=bool)
        often[two] = False
        low, high = first[often], last[often]
        new = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.empty(0, dtype=bool)
        low, high = low[new], high[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(high) - 1]])] if len(low) else high
        none = np.zeros(len(low), dtype=np.int64)
        parts = zip((k1[two], k2[two], np.full(len(two), h), first[two], last[two]), (none, none, none + (h | 1), low, high))
        return tuple(np.concatenate(p) for p in parts)

    found = cut(repeated(held, "k1 long, k2 long, h long, first long, last long", stretch, ["k1", "k2"]), "suffix-stretches")
    speaks = found.where("k1 <> 0 or k2 <> 0").groupBy("k1", "k2").agg(F.min(F.struct("h", "first")).alias("one")).select("one.h", "one.first", F.lit(True).alias("speaks"))
    settled = found.select("h", "first", "last").join(speaks.distinct(), ["h", "first"], "left")
    settled = cut(settled.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("first", "last", F.coalesce("speaks", F.lit(False)).cast("long").alias("speaks")))).alias("s")).select("h", F.flatten(F.transform("s", lambda x: F.array(x["first"], x["last"], x["speaks"]))).alias("settled")), "suffix-settled")

    def window(row):
        """What is not settled, and for the text that speaks for a class also what is: its place is all ones."""
        names = kind.names(row)
        windows = kind.candidates(names, keys_of(row))
        ends = row["settled"].values.to_numpy().reshape(-1, 3) if row["settled"].is_valid else np.empty((0, 3), dtype=np.int64)
        done, said = np.zeros(names.n + 2, dtype=np.int64), np.zeros(names.n + 2, dtype=np.int64)
        for marks, e in ((done, ends), (said, ends[ends[:, 2] == 1])):
            np.add.at(marks, e[:, 0], 1)
            np.add.at(marks, e[:, 1] + 1, -1)
        done, said = np.cumsum(done)[windows] > 0, np.cumsum(said)[windows] > 0
        windows, done = windows[~done | said], done[~done | said]
        second = names.of(windows, windows + kind.length, 1) & ~np.int64(0xFFFFFFFF)
        return names.of(windows, windows + kind.length), second | np.where(done, 0xFFFFFFFF, windows), np.where(done, 0, row["h"].as_py())

    release(spark)
    ends = repeated(held.join(settled, "h", "left"), "k1 long, k2at long, h long", window, ["k1"], "k2at").select("h", F.col("k2at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"))
    ends = ends.where(F.col("at") != 0xFFFFFFFF).groupBy("h").agg(F.collect_list("at").alias("ends"))
    joined = settled.join(ends, "h", "full")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for a, b in zip(batch.column("settled"), batch.column("ends")):
                pairs = [a.values.to_numpy().reshape(-1, 3)[:, :2]] if a.is_valid else []
                if b.is_valid:
                    w = np.sort(b.values.to_numpy()).astype(np.int64)
                    new = np.flatnonzero(np.diff(w) > 1)
                    pairs.append(np.stack([w[np.concatenate([[0], new + 1])], w[np.concatenate([new, [len(w) - 1]])]], axis=1))
                spans.append(np.concatenate(pairs).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(spans, type=pa.list_(pa.int64()))], names=["h", "spans"])

    return joined.mapInArrow(merge, "h long, spans array<long>")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept (binary) and n_passage_words.

    A text is its UTF-8 bytes, a null one is empty.  A byte goes if a string of 400 bytes over
    it also starts anywhere else in the input, in the same row or another; overlapping occurrences
    count, all occurrences go, and matches never cross rows.  So rows with equal texts of at least
    400 bytes lose them whole.  n_passage_words counts the words of the text within passages of 51
    words that also start anywhere else, whatever lies between their words; it says what repeats
    and removes nothing.  Columns of ``docs`` with the new names are replaced; others may have any name.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "n_passage_words")
    text = F.coalesce("text", F.lit(""))
    least = min(BYTES.least_bytes, WORDS.least_bytes)
    classes, salt, even = None, 0, F.lit(-2)
    while classes is None or classes.groupBy("h").count().where("count > 1").limit(1).count():  # two texts of one hash
        salt += 1
        classes = cut(docs.select(text.alias("t")).where(F.octet_length("t") >= least).select(F.xxhash64(F.lit(salt), "t").bitwiseAND(even).alias("h"), F.xxhash64("t", F.lit(-salt)).alias("h2")).groupBy("h", "h2").agg(F.count("*").alias("copies")), "suffix-classes")
    hashed = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.xxhash64(F.lit(salt), text).bitwiseAND(even).alias("h"))
    copied = classes.where("copies > 1").select("h")
    long = hashed.select("h", "text").where(F.octet_length("text") >= least)
    copied = broadcast_if_small(cut(copied, "suffix-copied"), 8)
    single = long.join(copied, "h", "left_anti")
    once = cut(long.join(copied, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")), "suffix-once")
    texts = single.unionByName(once)
    spans = cut(repeated_windows(texts, BYTES), "suffix-bytes")
    release(docs.sparkSession)
    passages = cut(repeated_windows(texts, WORDS).withColumnRenamed("spans", "passages"), "suffix-words")
    release(docs.sparkSession)
    whole = copied.select("h", F.lit(True).alias("whole"))
    marks = spans.join(passages, "h", "full").join(whole, "h", "full")
    marks = cut(marks.select(F.col("h").alias("mark"), "spans", "passages", F.coalesce("whole", F.lit(False)).alias("whole")), "suffix-marks")

    listed = broadcast_if_small(marks.select(F.col("mark").alias("h")), 8)
    none = F.lit(0).cast("long")
    clean = hashed.join(listed, "h", "left_anti")
    clean = clean.select("row.*", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"), none.alias("n_passage_words"))
    marked = hashed.join(listed, "h", "left_semi").join(marks, F.col("h") == F.col("mark")).select("row", "text", "spans", "passages", "whole")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
    def cut_out(texts, spans, passages, whole):
        import pandas as pd

        def covered(n: int, windows, length: int) -> np.ndarray:
            s = np.asarray([] if windows is None else windows, dtype=np.int64).reshape(-1, 2)
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, s[:, 0], 1)
            np.add.at(edge, s[:, 1] + length, -1)
            return np.cumsum(edge[:-1]) > 0

        rows = []
        for t, s, p, all_of_it in zip(texts, spans, passages, whole):
            data = t.encode("utf-8", "surrogatepass")
            x = np.frombuffer(data, dtype=np.uint8)
            n_words = len(word_bounds(x, np.array([len(x)]))[0])
            gone, told = covered(len(data), s, BYTES.length), covered(n_words, p, WORDS.length)
            if all_of_it:
                gone |= len(data) >= BYTES.length
                told |= n_words >= WORDS.length
            starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(data), int(gone.sum()), starts, x[~gone].tobytes(), int(told.sum())))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    marked = marked.withColumn("out", cut_out("text", "spans", "passages", "whole")).select("row.*", "out.*")
    return clean.unionByName(marked)


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_words of all documents."""
    from cubeflow.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")
