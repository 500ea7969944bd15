"""Exact threshold pairs of vectors by cover trees and dual traversal.

Unit vectors are compared by chord length, a metric; a cosine of at least c is a chord of at most
sqrt(2 - 2c).  The top of the tree is a bounded set of pivots in farthest-first order, so that its
prefixes are nested nets of shrinking radius; every vector belongs to its nearest pivot.  Below a
pivot, blocks of bounded size carry cover trees of nested levels with halving radii.  The traversal
takes pairs of nodes from the top down and prunes a pair whose centres are farther apart than both
covering radii and the threshold together, or whose distances to their pivots, or the wall between
the pivots' cells, keep them apart; that loses no pair.

Blocks are written once, a file each in the shared folder, and only their numbers go to tasks.  A
task meets two groups of blocks, reads each of them once and returns, for each vector with links,
their number and one vector that it is connected to, never the pairs themselves.  So what is
shuffled or stored grows with the vectors, not with the pairs of blocks.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeflow.llm.common import connected_components, cut, discard, release, remove, shared_path

COSINE = 0.95
#: Vectors in a block, about; pivots at most, and vectors that they are chosen from at most.
BLOCK = 4096
MOST_PIVOTS = 4096
SAMPLE = 16384
#: Chord radii of the levels within a block.
RADII = (0.5, 0.25, 0.125)
#: Pairs whose distances are taken at once.
STEP = 1 << 18
#: Node pairs below the first level with so many pairs of vectors are compared by one matrix product.
DENSE = 256
#: Single-precision chords may be off by so much; the last test is in double precision.
SLACK = 2e-3
#: Components along the sample's main axes that bound a product before it is taken, in vectors at least twice as wide.
HEAD = 16
#: Shells by distance to the pivot that the vectors of a block without near neighbours are met in, and vectors in one at least.
SHELLS, LEAST_SHELL = 4, 128
#: Groups of blocks aimed at; blocks in a group at most, and bytes of their vectors.
GROUPS = 160
MOST_HELD = 32
HELD_BYTES = 64 << 20


class Tree:
    """Levels of a block: centres (indices of vectors), covering radii and children, down to the vectors."""

    def __init__(self, vectors: np.ndarray, built: bytes | None = None, axes: np.ndarray | None = None, pivot: np.ndarray | None = None) -> None:
        """``axes`` bound products before they are taken; ``pivot``, a unit vector, is the one of all pivots that is nearest to each vector."""
        self.raw = vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
        self.unit = (vectors / self.norm[:, None]).astype(np.float32)
        if built is not None:
            self.levels, self.order, self.starts = pickle.loads(zlib.decompress(built))
        else:
            self._build()
        centres, covers = self.levels[0][:2]
        # shells: first nodes of one vector by distance to the pivot, then all others, as (start, stop, farthest angle)
        single, others = np.flatnonzero(covers == 0), np.flatnonzero(covers > 0)
        self.pivot, self.shells = pivot, []
        dot = np.zeros(len(centres)) if pivot is None else self.unit[centres] @ pivot
        single = single[np.argsort(-dot[single], kind="stable")]
        self.first = np.concatenate([single, others])
        self.cover = covers[self.first]
        self.angle = _angle(self.cover)
        away = np.full(len(centres), np.pi) if pivot is None else np.arccos(np.clip(dot[self.first], -1, 1)) + self.angle
        cuts = np.linspace(0, len(single), 1 + (1 if pivot is None else min(SHELLS, max(1, len(single) // LEAST_SHELL)))).astype(int).tolist()
        self.shells = [(lo, hi, float(away[lo:hi].max())) for lo, hi in [*zip(cuts, cuts[1:]), (len(single), len(centres))] if lo < hi]
        self.top = self.unit[centres[self.first]]
        self.head = self.top
        if axes is not None:
            # x . y is at most the product along some axes plus that of the lengths of what is left
            along = self.top @ axes.astype(np.float32)
            rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", along, along), 0))
            self.head = np.hstack([along, rest[:, None]])

    def _build(self) -> None:
        groups = [np.arange(len(self.raw), dtype=np.int32)]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for radius in RADII:
            centres, covers, starts, below = [], [], [0], []
            for group in groups:
                first = len(below)
                for c, members, reach in self._net(group, radius):
                    centres.append(c)
                    covers.append(reach)
                    below.append(members)
                starts.append(starts[-1] + len(below) - first)
            # starts: for each group of the level above, where its centres begin
            self.levels.append((np.array(centres, dtype=np.int32), np.array(covers, dtype=np.float32), np.array(starts, dtype=np.int32), np.array([len(m) for m in below], dtype=np.int32)))
            groups = below
        self.order = np.concatenate(groups)
        self.starts = np.concatenate([[0], np.cumsum(self.levels[-1][3])]).astype(np.int32)

    def built(self) -> bytes:
        return zlib.compress(pickle.dumps((self.levels, self.order, self.starts)), 1)

    def _net(self, group: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, float]]:
        if len(group) == 1:
            yield int(group[0]), group, 0.0
            return
        x = self.unit[group]
        step = max(1, STEP // len(group))
        near = np.concatenate([x[lo : lo + step] @ x.T >= 1 - radius * radius / 2 for lo in range(0, len(group), step)])
        near[np.arange(len(group)), np.arange(len(group))] = True
        single = near.sum(1) == 1
        free = np.ones(len(group), dtype=bool)
        for k in range(len(group)):
            if single[k]:
                yield int(group[k]), group[k : k + 1], 0.0
            elif free[k]:
                own = np.flatnonzero(near[k] & free)
                free[own] = False
                reach = float(chords(x[own] @ x[k])[own != k].max()) if len(own) > 1 else 0.0
                yield int(group[k]), group[own], reach

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) of the nodes' children among the centres of the next level, or the vectors."""
        starts = self.levels[level + 1][2] if level + 1 < len(RADII) else self.starts
        return starts[nodes], starts[nodes + 1] - starts[nodes]

    def spans(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of the nodes' vectors in ``order``."""
        start, stop = nodes, nodes + 1
        for k in range(level + 1, len(RADII)):
            start, stop = self.levels[k][2][start], self.levels[k][2][stop]
        return self.starts[start], self.starts[stop]


def chords(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


def _product(i, j, si, ni, sj, nj) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The children pairs of node pairs, in steps of about STEP."""
    n = ni.astype(np.int64) * nj
    at = 0
    while at < len(n):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(n[at:]), STEP)))
        k = np.repeat(np.arange(at, stop), n[at:stop])
        offset = np.arange(len(k)) - np.repeat(np.cumsum(n[at:stop]) - n[at:stop], n[at:stop])
        yield si[k] + offset // nj[k], sj[k] + offset % nj[k]
        at = stop


def dual(a: Tree, b: Tree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), vectors of a and b with at least the cosine, in parts."""
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    most, near_a, near_b = math.pi, None, None
    if a.pivot is not None and b.pivot is not None:
        # linked vectors' angles to any pivot differ by at most that between them
        most = _angle(reach)
        near_a, near_b = _nearest_angles(a, b.pivot, reach), _nearest_angles(b, a.pivot, reach)
    for lo_a, hi_a, far_a in a.shells:
        for lo_b, hi_b, far_b in b.shells:
            of_a, of_b = np.arange(lo_a, hi_a), np.arange(lo_b, hi_b)
            if near_a is not None:
                of_a, of_b = of_a[near_a[lo_a:hi_a] <= far_b + most], of_b[near_b[lo_b:hi_b] <= far_a + most]
            if not len(of_a) or not len(of_b):
                continue
            right, full = np.ascontiguousarray(b.head[of_b].T), None
            # a chord of at most r is a dot product of at least 1 - r^2 / 2; nodes of one vector share one bound
            bound, alike = np.float32(1 - reach * reach / 2), not a.cover[lo_a] and not b.cover[lo_b]
            step = max(1, STEP // len(of_b)) * 2
            for lo in range(0, len(of_a), step):
                rows = of_a[lo : lo + step]
                if not alike:
                    bound = 1 - (a.cover[rows, None] + b.cover[None, of_b] + np.float32(reach)) ** 2 / 2
                at = np.flatnonzero(a.head[rows] @ right >= bound)
                if a.head is not a.top and len(at) > len(rows) * len(of_b) // 32:
                    full = b.top[of_b].T if full is None else full
                    at = np.flatnonzero(a.top[rows] @ full >= bound)
                i, j = rows[at // len(of_b)], of_b[at % len(of_b)]
                if a.head is not a.top and len(at):
                    near = np.einsum("ij,ij->i", a.top[i], b.top[j]) >= (bound if alike else bound.ravel()[at])
                    i, j = i[near], j[near]
                yield from _descend(a, b, 0, a.first[i], b.first[j], cosine, reach)


def _angle(chord):
    """The angle of a chord of the unit sphere."""
    return 2 * np.arcsin(np.minimum(np.asarray(chord) / 2, 1))


def _nearest_angles(tree: Tree, pivot: np.ndarray, reach: float) -> np.ndarray:
    """The least angle between the vectors of each first node and another tree's pivot; infinite if the wall between both pivots' cells keeps it from all of that tree's."""
    dot = tree.top @ pivot
    out = np.arccos(np.clip(dot, -1, 1)) - tree.angle
    gap = tree.pivot.astype(np.float64) - pivot
    width = float(np.linalg.norm(gap))
    if width > 0.1:
        out[tree.top @ (gap / width).astype(np.float32) - tree.cover > reach] = np.inf
    return out


def _descend(a: Tree, b: Tree, level: int, i, j, cosine: float, reach: float):
    if not len(i):
        return
    if level:
        (si, ti), (sj, tj) = a.spans(level, i), b.spans(level, j)
        dense = (ti - si).astype(np.int64) * (tj - sj) >= DENSE
        for k in np.flatnonzero(dense):
            yield from _compare(a, b, a.order[si[k] : ti[k]], b.order[sj[k] : tj[k]], cosine)
        i, j = i[~dense], j[~dense]
    for p, q in _product(i, j, *a.children(level, i), *b.children(level, j)):
        if level + 1 == len(RADII):
            p, q = a.order[p], b.order[q]
            linked = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= cosine - SLACK
            p, q = p[linked], q[linked]
            exact = np.einsum("ij,ij->i", a.raw[p], b.raw[q], dtype=np.float64) / (a.norm[p] * b.norm[q]) >= cosine
            yield p[exact], q[exact]
            continue
        ca, ra, *_ = a.levels[level + 1]
        cb, rb, *_ = b.levels[level + 1]
        gap = chords(np.einsum("ij,ij->i", a.unit[ca[p]], b.unit[cb[q]]))
        near = gap <= ra[p] + rb[q] + reach
        yield from _descend(a, b, level + 1, p[near], q[near], cosine, reach)


def _compare(a: Tree, b: Tree, p: np.ndarray, q: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links among all pairs of p and q, by products in double precision."""
    right, norm = b.raw[q].astype(np.float64).T, b.norm[q]
    step = max(1, STEP // len(q))
    for lo in range(0, len(p), step):
        rows = p[lo : lo + step]
        i, j = np.nonzero(a.raw[rows].astype(np.float64) @ right / (a.norm[rows, None] * norm) >= cosine)
        yield rows[i], q[j]


class Pivots:
    """The tree's top: pivots and the main axes of each width, and where vectors and blocks lie among them."""

    def __init__(self, sample: list[np.ndarray], n: int) -> None:
        self.own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.axes: dict[int, np.ndarray] = {}
        pivots = farthest_first(sample, min(MOST_PIVOTS, -(-n // BLOCK))) if sample else []
        self.unit = [v / np.linalg.norm(v) for v in pivots]
        for w in {len(v) for v in pivots}:
            numbers = np.array([k for k, v in enumerate(pivots) if len(v) == w])
            self.own[w] = numbers, np.stack([self.unit[k] for k in numbers])
            if w >= 2 * HEAD:
                x = np.stack([v / np.linalg.norm(v) for v in sample if len(v) == w])
                self.axes[w] = np.linalg.eigh(x.T @ x)[1][:, -HEAD:]

    def nearest(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot among those of the vector's width, and how far; a width without any is a pivot of its own, numbered below 0."""
        where, away = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
        widths = np.array([len(v) for v in vectors], dtype=np.int64)
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            if w not in self.own:
                where[at], away[at] = -1 - w, 2.0
                continue
            numbers, unit = self.own[w]
            for lo in range(0, len(at), 1024):
                part = at[lo : lo + 1024]
                x = np.stack([vectors[k] for k in part])
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                dot = x @ unit.T
                best = dot.argmax(1)
                where[part], away[part] = numbers[best], chords(dot[np.arange(len(part)), best])
        return where, away

    def may_meet(self, i: int, j: int, radii: float, cosine: float) -> bool:
        """Whether links can join vectors about pivots i and j (of one width) whose radii add up to ``radii``."""
        if i == j or i < 0 or j < 0:
            return True
        return math.dist(self.unit[i], self.unit[j]) <= radii + math.sqrt(2 - 2 * cosine) + SLACK

    def of(self, i: int) -> np.ndarray | None:
        """Pivot i, or none of a width without pivots."""
        return self.unit[i].astype(np.float32) if i >= 0 else None


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists without nulls, in double precision."""
    values, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy().tolist()
    return [values[lo:hi] for lo, hi in zip(ends, ends[1:])]


def farthest_first(sample: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Up to ``n`` vectors, each the farthest from those before it; of each width in turn, the first one."""
    out = []
    widths = sorted({len(v) for v in sample})
    for w in widths:
        own = np.stack([v for v in sample if len(v) == w])
        unit = own / np.linalg.norm(own, axis=1)[:, None]
        pick, gap = 0, np.full(len(own), np.inf)
        for _ in range(max(1, n // len(widths))):
            out.append(own[pick])
            gap = np.minimum(gap, 2 - 2 * (unit @ unit[pick]))
            pick = int(gap.argmax())
            if gap[pick] <= 1e-12:
                break
    return out


class Links:
    """Numbers of links and connected vectors of a task's blocks, each at an offset."""

    def __init__(self, n: int) -> None:
        self.ids, self.count, self.label = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)

    def meet(self, a: Tree, at_a: int, copies_a: np.ndarray, b: Tree, at_b: int, copies_b: np.ndarray, cosine: float) -> None:
        """Adds the links between two blocks, or those within one block."""
        same, na, nb = at_a == at_b, len(copies_a), len(copies_b)
        label = np.arange(na if same else na + nb)
        for p, q in dual(a, b, cosine):
            if same:
                p, q = p[p != q], q[p != q]
            if not len(p):
                continue
            self.count[at_a : at_a + na] += np.bincount(p, copies_b[q], na).astype(np.int64)
            if not same:
                self.count[at_b : at_b + nb] += np.bincount(q, copies_a[p], nb).astype(np.int64)
            join(label, p, q if same else q.astype(np.int64) + na)
        v = np.flatnonzero(label != np.arange(len(label)))
        if len(v):
            at = np.concatenate([np.arange(na) + at_a, np.arange(nb) + at_b])
            join(self.label, at[v], at[label[v]])

    def frame(self) -> pd.DataFrame:
        hit = self.count > 0
        return pd.DataFrame({"cid": self.ids[hit], "links": self.count[hit], "other": self.ids[self.label[hit]]})


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merges the classes of x and of y, pair by pair; a label is the smallest place in its class."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def linked_classes(placed: DataFrame, pivots: Pivots, cosine: float = COSINE) -> DataFrame:
    """(cid, links, other): rows for vectors with links, from (cid, copies, embedding, pivot, away) of distinct valid vectors.

    ``links`` counts linked vectors, copies included, of some other classes; summed over a cid's
    rows it counts all.  (cid, other) are edges that connect whatever links connect.  ``placed``
    is a cut; it is discarded as soon as the blocks are written.
    """
    spark = placed.sparkSession
    kind = "<f4" if dict(placed.dtypes)["embedding"] == "array<float>" else "<f8"
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()  # at most MOST_PIVOTS and one for each other width
    counts = spark.createDataFrame([(r.pivot, -(-r.n // BLOCK)) for r in sizes] or [(0, 1)], "pivot long, parts long")
    members = placed.select("cid", "copies", "embedding", "pivot", "away").join(F.broadcast(counts), "pivot")
    members = members.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).drop("parts")
    folder = shared_path(spark, "tree-blocks")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        """Writes a block; only files that successful attempts report are read."""
        frame = frame.sort_values("cid")
        vectors = np.stack(frame["embedding"]).astype(kind)
        block = frame["cid"].to_numpy("<i8"), frame["copies"].to_numpy("<i8"), vectors, Tree(vectors).built()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(pickle.dumps(block))
        return pd.DataFrame({"pivot": frame["pivot"].iloc[:1], "part": frame["part"].iloc[:1], "n": [len(frame)], "width": [vectors.shape[1]], "radius": [frame["away"].max()], "name": [name]})

    # a row for each block, some thousandth of a vector's bytes for each vector
    blocks = sorted(members.groupBy("pivot", "part").applyInPandas(pack, "pivot long, part long, n long, width long, radius double, name string").collect())
    del members
    discard(placed)
    release(spark)
    bytes_each = max((r.n * r.width * (4 + int(kind[2])) for r in blocks), default=1)
    held = max(1, min(MOST_HELD, HELD_BYTES // bytes_each, -(-len(blocks) // GROUPS)))
    groups = -(-len(blocks) // held)
    n_tasks = groups * (groups + 1) // 2

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The links between blocks of two groups; each unordered pair of blocks meets in one task."""
        store, root = fs.FileSystem.from_uri(folder)

        def read(k: int) -> tuple[Tree, np.ndarray, np.ndarray]:
            with store.open_input_stream(f"{root}/{blocks[k].name}", compression=None) as file:
                ids, copies, vectors, tree = pickle.loads(file.read())
            return Tree(vectors, tree, pivots.axes.get(blocks[k].width), pivots.of(blocks[k].pivot)), ids, copies

        for task in (int(t) for frame in frames for t in frame["id"]):
            g = (math.isqrt(8 * task + 1) - 1) // 2
            left, right = (range(k * held, min(len(blocks), (k + 1) * held)) for k in (task - g * (g + 1) // 2, g))
            both = sorted({*left, *right})
            at = dict(zip(both, np.cumsum([0, *(blocks[k].n for k in both)]).tolist()))
            links = Links(sum(blocks[k].n for k in both))
            kept: dict[int, tuple[Tree, np.ndarray, np.ndarray]] = {}
            for j in right:
                b = blocks[j]
                near = [i for i in left if i <= j and blocks[i].width == b.width and pivots.may_meet(blocks[i].pivot, b.pivot, blocks[i].radius + b.radius, cosine)]
                for i in near:
                    if i not in kept:
                        kept[i] = read(i)
                if not near:
                    continue
                other = kept.get(j) or read(j)
                for i in near:
                    for k, (_, ids, _) in ((i, kept[i]), (j, other)):
                        links.ids[at[k] : at[k] + len(ids)] = ids
                    links.meet(kept[i][0], at[i], kept[i][2], other[0], at[j], other[2], cosine)
            yield links.frame()

    found = cut(spark.range(0, n_tasks, 1, max(1, min(n_tasks, 20000))).mapInPandas(meet, "cid long, links long, other long"), "vector-links")
    remove(spark, folder)
    return found


def _key(embedding):
    return F.xxhash64(embedding)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): a row for every row of ``vectors``.

    Vectors are compared in double precision.  Null or empty vectors, zero vectors and those with
    null or non-finite components link with nothing; vectors of different widths do not link.
    Equal vectors are one class and link with each other.  component_id is the smallest id
    reachable; a null id is no id, so its row has the smallest of the others', or null.  Rows that
    repeat an id are vectors each.
    """
    spark = vectors.sparkSession
    e = F.col(column)
    if vectors.schema[column].dataType.simpleString() == "array<double>":
        # squares of very large or small components leave a double's range; a power of two scales exactly
        top = F.array_max(F.transform(F.col(column), F.abs))
        e = F.when(F.coalesce((top > 0) & (top < float("inf")), F.lit(False)), F.transform(e, lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(top))))).otherwise(e)
    rows = vectors.select(F.col(id_col).alias("id"), e.alias("embedding"))
    e = F.col("embedding")
    wide = F.transform(e, lambda x: x.cast("double"))
    square = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)
    valid = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (square > 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    good = rows.where("valid")
    n = good.count()
    # a random sample, whatever the order of rows, that copies of a vector do not fill; rows beyond it by far stay where they are
    luck = F.xxhash64("id", "embedding")
    sample = good.where(F.pmod(luck, F.lit(max(n, 1))) < 2 * SAMPLE).orderBy(luck, "id", "embedding").limit(SAMPLE if n > BLOCK else 1).select("embedding").toArrow()
    pivots = Pivots(list({v.tobytes(): v for v in _arrays(sample["embedding"].combine_chunks())}.values()), n)
    classes = good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("id").alias("low")).withColumn("cid", F.monotonically_increasing_id())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, away = pivots.nearest(_arrays(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where), pa.array(away)], names=[*batch.schema.names, "pivot", "away"])

    kinds = dict(classes.dtypes)
    placed = cut(classes.mapInArrow(assign, f"embedding {kinds['embedding']}, copies long, low {kinds['low']}, cid long, pivot long, away double"), "tree-placed")
    del classes
    release(spark)
    # rows find their class by a hash of the vector where no two classes share one, which is checked, else by the vector
    key = _key(F.col("embedding"))
    if placed.select(key.alias("key")).groupBy("key").count().where("count > 1").limit(1).count():
        key = F.col("embedding")
    classes = cut(placed.select("cid", "copies", "low", key.alias("key")), "vector-classes")
    found = linked_classes(placed, pivots, cosine)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    lows = parts.join(classes, parts.node == classes.cid).groupBy("component").agg(F.min("low").alias("component_low"))
    of_class = parts.join(lows, "component").select(F.col("node").alias("cid"), "component_low")
    named = classes.join(links, "cid", "left").join(of_class, "cid", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"))
    linked_rows = good.select("id", key.alias("key")).join(named, "key").select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_covertree(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings."""
    from cubeflow.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95),
r AS (SELECT a AS n, a AS m FROM l UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN d ON v.vec_id = d.a LEFT JOIN c ON v.vec_id = c.n
"""
