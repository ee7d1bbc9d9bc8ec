"""Nearest neighbours by largest inner product through multi-index hashing.

Vectors are lengthened by one coordinate that gives all the same norm (so the largest inner product is
the smallest angle), projected on their principal components, rotated so that signs lose least, and
coded as the signs. The rotation is fitted on at most ``SAMPLE`` vectors; the search radius is that
within which the share ``TARGET`` of the true neighbours, among all rows, of ``ASKED`` queries lies, so
it shrinks as more rows bring neighbours closer.

Codes are cut in ``PARTS`` substrings. A vector is posted once for each, under the key of its substring
and the first bits of the substring's value; a query goes to the keys that hold values within the
substring's share of the radius, and to no other. If two codes differ in at most r bits, some substring
differs in at most its share of r, so every code within r is met. Where a query meets a key's vectors,
those in buckets within its reach are retrieved; one that an earlier substring retrieves too is left to
that, so each is tested once. Codes within r of the query's are then scored on the vectors, and the k
best pass on. Keys of more than ``BLOCK`` vectors are split by the vectors' ids, and the queries go to all
their splits. Where there are several keys a substring, queries first visit the ``HOME`` keys that their own
values have, and take the k-th best score from there to the others, which pass on nothing below it; so
what passes on doesn't grow with the number of keys. Queries that find fewer than k are asked again of all rows, in blocks, which is exact.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those whose
number of components isn't the most frequent one, take no part, neither do rows without an id; equal
scores go to the smaller id; rows that share a query's id are no candidates of it; rows that share an id
are one query, whose results are the best of theirs, and rows of equal id and score one result; a table
without queries or candidates gives no rows; columns besides the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, tasks_for

SAMPLE = 4096
#: Queries that the radius is fitted on.
ASKED = 256
TARGET = 0.95
PARTS = 4
#: Substrings by which queries are asked first.
HOME = 2
#: Vectors of a key that a task holds at once.
BLOCK = 8192
#: Queries that a row carries, and queries that are probed at once.
QUERIES = 512
PROBED = 64
_ROUNDS = 30


class Coder:
    """Codes of up to 64 bits."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7):
        self.longest = longest
        data = self.lengthen(sample)
        self.mean = data.mean(axis=0)
        centred = data - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        self.bits = min(64, sample.shape[1])
        self.axes = axes[:, ::-1][:, : self.bits]
        flat = centred @ self.axes
        turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))
        for _ in range(_ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.axes = self.axes @ turn
        self.width = -(-self.bits // PARTS)
        self.parts = -(-self.bits // self.width)

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.column_stack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))))

    def _code(self, x: np.ndarray) -> np.ndarray:
        on = np.zeros((x.shape[0], 64), np.uint8)
        on[:, : self.bits] = (x - self.mean) @ self.axes >= 0
        return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self._code(self.lengthen(x))

    def query_codes(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._code(np.column_stack((x, np.zeros(x.shape[0]))))

    def value(self, codes: np.ndarray, part: int) -> np.ndarray:
        """The codes' substring of that number."""
        return (codes >> np.uint64(part * self.width)) & np.uint64((1 << self.width) - 1)

    def reach(self, radius: int) -> list[int]:
        """For each substring the bits it may differ in: shares that, each one more, add up to more than the radius."""
        share, rest = divmod(radius, self.parts)
        return [share if p <= rest else share - 1 for p in range(self.parts)]


class Block:
    """Vectors of a key, and the buckets of their substring's values; part None: all vectors are candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder, part: int | None, radius: int):
        self.ids, self.vectors, self.coder, self.part, self.radius = ids, vectors.astype(np.float64), coder, part, radius
        self.codes = coder.codes(self.vectors)
        self.reach = coder.reach(radius)
        if part is not None:
            value = coder.value(self.codes, part)
            self.order = np.argsort(value, kind="stable")
            self.values, self.begin, self.size = np.unique(value[self.order], return_index=True, return_counts=True)

    def retrieve(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector of each pair within the substring's reach."""
        if self.part is None:
            return np.repeat(np.arange(codes.size), self.ids.size), np.tile(np.arange(self.ids.size), codes.size)
        near = np.bitwise_count(self.coder.value(codes, self.part)[:, None] ^ self.values[None, :]) <= self.reach[self.part]
        query, bucket = np.nonzero(near)
        n = self.size[bucket]
        place = np.repeat(self.begin[bucket] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(query, n), self.order[place]

    def probe(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs retrieved here and by no earlier substring, those whose codes are within the radius."""
        query, at = self.retrieve(codes)
        if self.part is None:
            return query, at
        apart = codes[query] ^ self.codes[at]
        keep = np.bitwise_count(apart) <= self.radius
        query, at, apart = query[keep], at[keep], apart[keep]
        keep = np.ones(query.size, bool)
        for p in range(self.part):
            keep &= np.bitwise_count(self.coder.value(apart, p)) > self.reach[p]
        return query[keep], at[keep]

    def search(self, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Query number, id and score of each query's k best here, of those of at least the query's least score."""
        codes = self.coder.query_codes(vectors)
        for begin in range(0, ids.size, PROBED):
            query, at = self.probe(codes[begin : begin + PROBED])
            query += begin
            other = self.ids[at] != ids[query]
            query, at = query[other], at[other]
            score = np.empty(query.size)
            for a in range(0, query.size, 100_000):
                score[a : a + 100_000] = (vectors[query[a : a + 100_000]] * self.vectors[at[a : a + 100_000]]).sum(axis=1)
            enough = score >= least[query]
            yield best(query[enough], self.ids[at[enough]], score[enough], k)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of each query with the largest score, then the smallest id; equal rows once."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    if query.size:
        new = np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])))
        query, ids, score = query[new], ids[new], score[new]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(query.size) - first < k
    return query[keep], ids[keep], score[keep]


def valid_vectors(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (floats as they are, else doubles) of the rows that take part."""
    v = F.col(vector)
    kind = df.schema[vector].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        v = v.cast("array<double>")
    rows = df.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


RESULT = "query_id long, vec_id long, score double"
_BLOCK = "key long, asks int, ids binary, vectors binary, least binary"


class Index:
    """How vectors and queries are dealt over keys: substring, first bits of its value, split."""

    def __init__(self, coder: Coder, radius: int, n: int):
        self.coder, self.radius = coder, radius
        self.reach = coder.reach(radius)
        self.bits = min(coder.width, max(0, (-(-n // BLOCK) - 1).bit_length()))
        self.splits: dict[int, np.ndarray] = {}

    def group(self, codes: np.ndarray, part: int) -> np.ndarray:
        return (self.coder.value(codes, part) >> np.uint64(self.coder.width - self.bits)).astype(np.int64)

    def key(self, part: int, group, split):
        return (part << 58) | (group << 40) | split

    def split(self, sizes: dict[int, int]) -> None:
        """Splits keys of more than two blocks; sizes: vectors by key."""
        for key, n in sizes.items():
            p, group = key >> 58, key >> 40 & 0x3FFFF
            self.splits.setdefault(p, np.ones(1 << self.bits, np.int64))[group] = -(-n // BLOCK)

    def parts(self) -> list[int]:
        return [p for p in range(self.coder.parts) if self.reach[p] >= 0]

    def posted(self, ids: np.ndarray, vectors: np.ndarray, parts: int = PARTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of all vectors, for each of the first so many substrings, and the vectors' numbers."""
        codes = self.coder.codes(vectors.astype(np.float64))
        for p in self.parts()[:parts]:
            group = self.group(codes, p)
            split = (ids * 0x9E3779B1 >> 7) % self.splits[p][group] if p in self.splits else 0 * ids
            yield self.key(p, group, split), np.arange(ids.size)

    def asked(self, ids: np.ndarray, vectors: np.ndarray, home: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys that queries visit first (home) or then, and the queries' numbers."""
        codes = self.coder.query_codes(vectors.astype(np.float64))
        groups = np.arange(1 << self.bits)
        for k, p in enumerate(self.parts()):
            for begin in range(0, ids.size, PROBED):
                apart = np.bitwise_count(self.group(codes[begin : begin + PROBED], p)[:, None] ^ groups[None, :])
                query, group = np.nonzero((apart <= self.reach[p]) & (((apart == 0) & (k < HOME or not self.bits)) == home))
                n = self.splits[p][group] if p in self.splits else np.ones(group.size, np.int64)
                split = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield self.key(p, np.repeat(group, n), split), np.repeat(query + begin, n)


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dims)


def _dealt(rows: DataFrame, keys, asks: int, dims: int) -> DataFrame:
    """Rows packed by key; keys(ids, vectors): arrays of keys and of the rows' numbers; queries with their ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = _vectors(batch, dims)
            least = batch.column("least").to_numpy() if asks else None
            for key, at in keys(ids, values):
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [key.size])).tolist() if key.size else [0]
                own = [at[a:b][c : c + QUERIES] for a, b in zip(cut, cut[1:]) for c in range(0, b - a, QUERIES)]
                of = [key[a] for a, b in zip(cut, cut[1:]) for _ in range(0, b - a, QUERIES)]
                yield pa.record_batch({"key": pa.array(of, pa.int64()), "asks": pa.array([asks] * len(of), pa.int32()), "ids": pa.array([ids[x].astype("<i8").tobytes() for x in own], pa.binary()), "vectors": pa.array([values[x].tobytes() for x in own], pa.binary()), "least": pa.array([least[x].astype("<f8").tobytes() if asks else None for x in own], pa.binary())})

    return rows.mapInArrow(run, _BLOCK)


def _met(held: DataFrame, asked: DataFrame, sent, k: int, dims: int, kind: str, tasks: int, exact: bool) -> DataFrame:
    """The k best of each query at each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, parts, block = sent.value, None, [], None
        for batch in batches:
            for key, asks, ids, vectors, least in zip(*(batch.column(c).to_pylist() for c in ("key", "asks", "ids", "vectors", "least"))):
                ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(-1, dims)
                if key != now:
                    now, parts, block = key, [], None
                if not asks:
                    parts.append((ids, vectors))
                    continue
                if not parts and block is None:
                    continue
                if block is None:  # a key's vectors come before its queries
                    block = Block(*(np.concatenate(x) for x in zip(*parts)), index.coder, None if exact else key >> 58, index.radius)
                    parts = []
                for query, near, score in block.search(ids, vectors.astype(np.float64), np.frombuffer(least, "<f8"), k):
                    yield pa.record_batch({"query_id": pa.array(ids[query]), "vec_id": pa.array(near), "score": pa.array(score)})

    return held.union(asked).repartition(tasks, "key").sortWithinPartitions("key", "asks").mapInArrow(run, RESULT)


def _top(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k).groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))


def fit_radius(rows: DataFrame, asked: DataFrame, coder: Coder, k: int, dims: int) -> int:
    """The distance of codes within which the share TARGET of the k nearest of the asked (some hundred rows) lie."""
    picked = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(ASKED).collect()
    ids, vectors = np.array([r["vec_id"] for r in picked]), np.array([r["v"] for r in picked], np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((coder, ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ids, vectors = sent.value
        codes = coder.query_codes(vectors)
        for batch in batches:
            own, values = _vectors(batch, dims)
            values = values.astype(np.float64)
            score = vectors @ values.T
            score[ids[:, None] == own[None, :]] = -np.inf
            near = np.argpartition(-score, min(k, own.size) - 1, axis=1)[:, :k]
            query = np.repeat(np.arange(ids.size), near.shape[1])
            near = near.reshape(-1)
            apart = np.bitwise_count(codes[query] ^ coder.codes(values)[near])
            there = np.isfinite(score[query, near])
            yield pa.record_batch({"query_id": pa.array(query[there]), "vec_id": pa.array(apart[there].astype(np.int64)), "score": pa.array(score[query, near][there])})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    found = rows.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("vec_id").count().collect()
    apart = np.repeat([r["vec_id"] for r in found], [r["count"] for r in found]) if found else np.array([coder.bits])
    return int(np.quantile(apart, TARGET, method="higher"))


def nearest(df: DataFrame, queries, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; queries: a condition on vec_id."""
    spark = df.sparkSession
    rows = valid_vectors(df)
    asked = rows.filter(queries)
    n, longest, asks = rows.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + double(x) * double(x)))")), F.count_if(F.expr(queries))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not asks:
        return spark.createDataFrame([], schema)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], np.float64)
    dims, tasks = sample.shape[1], tasks_for(df)
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    coder = Coder(sample, longest)
    index = Index(coder, fit_radius(rows, asked, coder, k, dims), n)
    plain = index.posted

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, _ in plain(*_vectors(batch, dims)):
                key, n = np.unique(key, return_counts=True)  # a key without splits stands for its group
                yield pa.record_batch({"key": pa.array(key), "n": pa.array(n)})

    if index.bits:  # several keys a substring
        counted = rows.mapInArrow(sizes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * BLOCK)
        index.split({r["key"]: r["n"] for r in counted.collect()})  # PARTS * 2**(64 / PARTS) rows at most
    sent = spark.sparkContext.broadcast(index)
    lowest = F.lit(float("-inf"))
    at, asked = scratch(spark), asked.withColumn("least", lowest)
    held = _dealt(rows, lambda *x: sent.value.posted(*x, HOME if index.bits else PARTS), 0, dims)
    first = _met(held, _dealt(asked, lambda *x: sent.value.asked(*x, True), 1, dims), sent, k, dims, kind, tasks, exact=False)
    if index.bits:
        _top(first, k).write.parquet(f"{at}/first")
        near = spark.read.parquet(f"{at}/first")
        bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("__least"))
        known = asked.join(bound, "vec_id", "left").select("vec_id", "v", F.coalesce("__least", lowest).alias("least"))
        every_part = _dealt(rows, lambda *x: sent.value.posted(*x), 0, dims)
        then = _met(every_part, _dealt(known, lambda *x: sent.value.asked(*x, False), 1, dims), sent, k, dims, kind, tasks, exact=False)
        first = near.select("query_id", "vec_id", "score").union(then)
    _top(first, k).write.parquet(f"{at}/found")
    found = spark.read.parquet(f"{at}/found")
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    few = asked.join(full, "vec_id", "left_anti")
    shards = max(1, -(-n // BLOCK))
    if few.isEmpty():
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    every = np.arange(shards)
    by_id = _dealt(rows, lambda ids, _: [((ids * 0x9E3779B1 >> 7) % shards, np.arange(ids.size))], 0, dims)
    to_all = _dealt(few, lambda ids, _: [(np.repeat(every, ids.size), np.tile(np.arange(ids.size), shards))], 1, dims)
    rest = _top(_met(by_id, to_all, sent, k, dims, kind, tasks, exact=True), k)
    return found.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi").unionByName(rest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
