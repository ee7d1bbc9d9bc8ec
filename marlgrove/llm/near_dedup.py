"""Near-duplicate documents by a chosen-path similarity join of shingle sets.

A document's set has the hashes of its distinct five-word shingles. Equal sets are one class, of
which one representative goes on. In each of several independent trees, a class goes to the node
of its ``FIRST`` minwise tokens: similar sets choose the same token with a probability of their
similarity. Pairs at or above the threshold s miss each other with probability (1 - s**3)**trees, 2.4e-7
at 0.85, and the sketches drop them with as little. Trees and the sketches' cut follow from the threshold
(``Join``); at 0.80 there are 22 trees, at 0.85 there are 16.

Nodes of at most ``NODE`` classes are compared exhaustively by sketches. One of more than ``BRANCH`` times
as many branches again, by ``NEXT`` further tokens in so many independent forks that a pair at the
threshold misses them all with as little, wherever the children's pairs, all forks together, are fewer
than its own; so do the children. Others are compared in pairs of blocks, so that each two classes of
such a node are compared at any size.

Nodes emit only star edges of what the sketches link, whose components (a superset of the true ones)
bring the full sets together: there all links are confirmed on the sets, component by component,
without listing pairs. A component of more than ``BLOCK`` classes is confirmed in pairs of blocks,
each a task of its own, so no task holds an unbounded group.

Defined results: null and empty texts and those without words have an empty set and are linked with
nothing; rows that are equal are of one component, and rows of one doc_id count as one document; a
document without doc_id is in the component of those with an equal set, or else alone and kept; texts
are read whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal, flat, fold_case, gram_hashes, group_bounds, groups, mix, powers, scratch, slices, word_hashes, words
from .components import components

#: Probability with which the trees, and that with which the sketches, lose a pair at the threshold.
MISS = 2.5e-7
#: Minwise tokens of a tree's nodes.
FIRST = 3
#: Times NODE from which a node branches again, and the minwise tokens of such a branch.
BRANCH = 16
NEXT = 2
#: Values of a sketch, unless the trees need more tokens.
VALUES = 128
#: Classes that a task compares by sketches at once.
NODE = 4096
#: Classes that a task confirms at once.
BLOCK = 8192
WORDS = 5
#: op6's links: 100 * intersection >= PERCENT * union.
PERCENT = 85


@dataclass(frozen=True)
class Join:
    """A join at 100 * intersection >= percent * union, from 1 to 100."""

    percent: int

    @property
    def trees(self) -> int:
        together = (self.percent / 100) ** FIRST
        return 1 if together == 1 else math.ceil(math.log(MISS) / math.log1p(-together))

    @property
    def forks(self) -> int:
        """Independent branchings of a large node."""
        together = (self.percent / 100) ** NEXT
        return 1 if together == 1 else math.ceil(math.log(MISS) / math.log1p(-together))

    @property
    def levels(self) -> int:
        """How often a node can branch again by values that no branch before it used."""
        return max(0, (self.tokens - self.trees * FIRST) // (NEXT * self.forks))

    @property
    def tokens(self) -> int:
        return max(VALUES, self.trees * FIRST)

    @property
    def least(self) -> int:
        """Equal sketch values that a candidate has: fewer have a probability of at most MISS at the threshold."""
        n, s = self.tokens, self.percent / 100
        below, k = 0.0, 0
        while k < n and (below := below + math.comb(n, k) * s**k * (1 - s) ** (n - k)) <= MISS:
            k += 1
        return k


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data = fold_case(data)
    starts, ends, row = words(data, at)
    h = word_hashes(data, starts, ends)
    grams = gram_hashes(h, WORDS)
    first = np.searchsorted(row, np.arange(at.size))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((h[a:b] * powers(WORDS + 1)[1 : b - a + 1]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def profile(docs: DataFrame, join: Join = Join(PERCENT)) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, the nodes and the sketch of every document."""
    trees, tokens_ = join.trees, join.tokens
    seeds = mix(np.arange(1, tokens_ + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*flat(batch.column("text")))
            size = np.array([s.size for s in sets])
            full = np.flatnonzero(size)
            low, high = np.zeros(size.size, np.uint64), np.zeros(size.size, np.uint64)
            least = np.zeros((size.size, tokens_), np.uint64)
            if full.size:
                tokens = np.concatenate([sets[i] for i in full])
                begin = np.cumsum(size[full]) - size[full]
                low[full] = np.add.reduceat(mix(tokens), begin)
                high[full] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), begin)
                for k, seed in enumerate(seeds):
                    x = (tokens ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xC4CEB9FE1A85EC53)
                    least[full, k] = np.minimum.reduceat(x, begin)
            least = mix(least)
            own = least[:, : trees * FIRST].reshape(-1, trees, FIRST)
            path = np.zeros((size.size, trees), np.uint64)
            for level in range(FIRST):
                path = mix(path + own[:, :, level] + np.arange(trees, dtype=np.uint64))
            sketch = (least & np.uint64(0xFFFF)).astype("<u2")
            width = tokens_ * 2
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(size, pa.int64()),
                    "low": pa.array(low.view(np.int64)),
                    "high": pa.array(high.view(np.int64)),
                    "paths": pa.ListArray.from_arrays(pa.array(np.arange(0, trees * size.size + 1, trees), pa.int32()), pa.array(path.reshape(-1).view(np.int64))),
                    "sketch": pa.Array.from_buffers(pa.binary(width), size.size, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, low long, high long, paths array<long>, sketch binary")


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """Star edges (first member, member) of the components of n items; linked(i, rest) says which of rest i is linked with."""
    rest, edges = np.arange(1, n), []
    root, queue = 0, [0]
    while True:
        while queue and rest.size:
            hit = linked(queue.pop(), rest)
            found = rest[hit]
            if found.size:
                edges += [(root, int(x)) for x in found]
                queue += found.tolist()
                rest = rest[~hit]
        if not rest.size:
            return edges
        root, rest = int(rest[0]), rest[1:]
        queue = [root]


def node_edges(join: Join):
    """Star edges of the classes that the sketches link within a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, percent = join.least, join.percent
        for part in groups(batches, "node"):
            cut = group_bounds(part.column("node").to_numpy())
            ids, size = part.column("rep").to_numpy(), part.column("n_shingles").to_numpy()
            data, _ = flat(part.column("sketch").chunk(0))
            sketch = data.view("<u2").reshape(ids.size, -1)
            a, b = [], []
            for begin, end in zip(cut.tolist(), cut[1:].tolist()):
                if end - begin < 2:
                    continue
                own, n = sketch[begin:end], size[begin:end]

                def linked(i: int, rest: np.ndarray) -> np.ndarray:
                    hit = (np.minimum(n[rest], n[i]) * 100 >= percent * np.maximum(n[rest], n[i]))
                    near = np.flatnonzero(hit)
                    hit[near] = (own[rest[near]] == own[i]).sum(axis=1) >= least
                    return hit

                for i, j in _forest(end - begin, linked):
                    a.append(ids[begin + i])
                    b.append(ids[begin + j])
            if a:
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def set_edges(join: Join):
    """Star edges of the classes whose full sets are linked, group by group of ``task``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        percent = join.percent
        for part in groups(batches, "task", rows=2000):
            cut = group_bounds(part.column("task").to_numpy())
            ids = part.column("rep").to_numpy()
            data, at = flat(part.column("shingles").chunk(0))
            tokens, at = data.view("<u8"), at // 8
            a, b = [], []
            for begin, end in zip(cut.tolist(), cut[1:].tolist()):
                if end - begin < 2:
                    continue
                start = at[begin : end + 1] - at[begin]
                _, own = np.unique(tokens[at[begin] : at[end]], return_inverse=True)
                n = np.diff(start)
                member = np.zeros(own.max() + 1, np.int64)

                def linked(i: int, rest: np.ndarray) -> np.ndarray:
                    hit = (np.minimum(n[rest], n[i]) * 100 >= percent * np.maximum(n[rest], n[i]))
                    near = rest[hit]
                    if near.size:
                        member[own[start[i] : start[i + 1]]] = 1
                        sizes = n[near]
                        first = np.cumsum(sizes) - sizes
                        place = np.arange(int(sizes.sum())) + np.repeat(start[near] - first, sizes)
                        both = np.add.reduceat(member[own[place]], first)
                        hit[hit] = 100 * both >= percent * (sizes + n[i] - both)
                        member[own[start[i] : start[i + 1]]] = 0
                    return hit

                for i, j in _forest(end - begin, linked):
                    a.append(ids[begin + i])
                    b.append(ids[begin + j])
            if a:
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(rows: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """Rows dealt over tasks: a key of more than ``most`` rows is cut in blocks, and each two blocks meet in one task."""
    n = F.ceil(F.col(count) / F.lit(most)).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(7)), n).cast("int")
    other = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    met = rows.withColumn("__block", block).withColumn("__other", F.explode(other))
    task = F.when(n > 1, F.xxhash64(key, F.least("__block", "__other"), F.greatest("__block", "__other"))).otherwise(F.col(key))
    return met.withColumn("task", task).drop("__block", "__other")


def branched(nodes: DataFrame, reps: DataFrame, join: Join, level: int) -> DataFrame:
    """The nodes (rep, node, members, whole), those that are large replaced by their children where these have fewer pairs, else ``whole``."""
    large = nodes.filter((F.col("members") > BRANCH * NODE) & ~F.col("whole"))
    first = join.trees * FIRST + level * NEXT * join.forks
    fork = lambda i: F.xxhash64("node", F.lit(i), F.substring("sketch", 2 * (first + NEXT * i) + 1, 2 * NEXT))
    forked = large.join(reps.select("rep", "sketch"), "rep").select("rep", "node", "members", F.explode(F.array(*[fork(i) for i in range(join.forks)])).alias("child"))
    sizes = forked.groupBy("node", "members", "child").agg(F.count("*").alias("n"))
    square = F.col("n").cast("double") * F.col("n")
    better = sizes.groupBy("node", "members").agg(F.sum(square).alias("pairs")).filter(F.col("pairs") < F.col("members").cast("double") * F.col("members")).select("node")
    split = sizes.join(better, "node", "left_semi").filter("n > 1").select("child", "n")
    children = forked.select("rep", "child").join(split, "child").select("rep", F.col("child").alias("node"), F.col("n").alias("members"), F.lit(False).alias("whole"))
    kept = large.join(better, "node", "left_anti").select("rep", "node", "members", F.lit(True).alias("whole"))
    return nodes.filter((F.col("members") <= BRANCH * NODE) | F.col("whole")).unionByName(kept).unionByName(children)


def candidate_edges(reps: DataFrame, at: str, join: Join) -> DataFrame:
    """Edges between classes that the sketches link in some node of some tree."""
    spark = reps.sparkSession
    rows = reps.select("rep", F.explode("paths").alias("node"))
    shared = rows.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1")
    rows.join(shared, "node").withColumn("whole", F.lit(False)).write.parquet(f"{at}/nodes")
    nodes = spark.read.parquet(f"{at}/nodes")
    for level in range(join.levels):
        if nodes.filter((F.col("members") > BRANCH * NODE) & ~F.col("whole")).isEmpty():
            break
        branched(nodes, reps, join, level).write.parquet(f"{at}/nodes-{level}")
        nodes = spark.read.parquet(f"{at}/nodes-{level}")
    met = _blocks(nodes, "node", "members", NODE).select("rep", F.col("task").alias("node"))
    full = met.join(reps.select("rep", "n_shingles", "sketch"), "rep")
    return deal(full, "node").sortWithinPartitions("node", "rep").mapInArrow(node_edges(join), "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(*flat(batch.column("text")))
        yield pa.record_batch({"rep": batch.column("rep"), "cluster": batch.column("cluster"), "members": batch.column("members"), "shingles": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (its least doc_id), kept of every document; links from ``percent`` of the union."""
    spark, at, join = docs.sparkSession, scratch(docs.sparkSession), Join(percent)
    profile(docs, join).write.parquet(f"{at}/profiles")
    profiles = spark.read.parquet(f"{at}/profiles")
    # Equal sets have equal paths and sketches.
    classes = profiles.filter("n_shingles > 0").groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    classes.write.parquet(f"{at}/classes")
    classes = spark.read.parquet(f"{at}/classes")
    clusters = components(candidate_edges(classes.filter("rep is not null"), at, join))
    members = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).union(clusters.select("root", "root").distinct())
    sized = members.join(members.groupBy("cluster").agg(F.count("*").alias("members")), "cluster").checkpoint()
    texts_ = docs.select(F.col("doc_id").alias("rep"), "text").join(sized, "rep")
    met = _blocks(texts_.mapInArrow(_sets, "rep long, cluster long, members long, shingles binary"), "cluster", "members", BLOCK)
    edges = deal(met.select("task", "rep", "shingles"), "task").sortWithinPartitions("task", "rep").mapInArrow(set_edges(join), "a long, b long").checkpoint()
    if sized.filter(F.col("members") > BLOCK).isEmpty():  # each component was confirmed in one task, from its least member
        roots = edges.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("root"))
    else:
        roots = components(edges).select(F.col("node").alias("rep"), "root")
    named = classes.select("low", "high", "n_shingles", "rep").join(roots, "rep", "left").select("low", "high", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    out = profiles.select("doc_id", "n_shingles", "low", "high").join(named, ["low", "high", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def filter_docs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns."""
    kept = near_duplicates(docs, percent).filter("kept").select(F.col("doc_id").alias("__kept_doc_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_doc_id"]), "left_semi")
