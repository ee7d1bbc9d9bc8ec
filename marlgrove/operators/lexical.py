"""Lexical scores of all chunks for a batch of queries, without a row for each chunk and query.

Chunks are counted in one pass, which needs no shuffle; scores of a stretch of chunks for all queries lie in one
array, and a task passes on the best of each query alone, however many chunks it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores of chunks for queries that a task holds at once, and candidates that it gathers before it keeps the best.
CELLS, GATHERED = 2_000_000, 200_000
#: Two scores as far apart as this may be equal once they are rounded.
NEAR = 1.1e-6


def counted(chunks: DataFrame, terms: pa.Array) -> DataFrame:
    """chunk_id, dl (its tokens), terms (places in the list of terms), tfs of each chunk (chunk_id, ts: its tokens)."""
    sent = chunks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, n = batch.column("ts"), batch.num_rows
            lengths = pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(ts.flatten(), value_set=sent.value), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lengths)
            key, tf = np.unique((row * len(sent.value) + at)[at >= 0], return_counts=True)
            row, at = np.divmod(key, len(sent.value))
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(lengths), listed(at), listed(tf)], ["chunk_id", "dl", "terms", "tfs"])

    return chunks.select(F.col("chunk_id").cast("long"), "ts").mapInArrow(run, "chunk_id long, dl long, terms array<int>, tfs array<int>")


class Best:
    """The k best chunks of each query so far; of equal scores those of the least numbers."""

    def __init__(self, queries: int, k: int, gathered: int):
        self.k, self.gathered, self.least, self.size = k, gathered, np.full(queries, -np.inf), 0
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        """score: a row for each chunk, a column for each query; 0 where they have no term in common."""
        cut = self.least
        if len(ids) > self.k and not np.isfinite(cut).all():
            cut = np.maximum(cut, np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, query = np.nonzero((score > 0) & (score >= cut - NEAR))
        self.held.append((query, ids[row], np.floor(score[row, query] * 1e6 + 0.5) / 1e6))
        self.size += row.size
        if self.size > self.gathered:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(query.size) - np.searchsorted(query, query)
        self.least[query[place == self.k - 1]] = score[place == self.k - 1]
        kept = place < self.k
        self.held, self.size = [(query[kept], ids[kept], score[kept])], 0
        return self.held[0]


Weights = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def dealt(asked: pa.Table, terms: pa.Array, weight: np.ndarray) -> Weights:
    """The weights of asked (query_id, term) by term: where each term's begin and end, places of queries, weights, and the queries by place."""
    at = pc.index_in(asked.column("term"), value_set=terms).to_numpy()
    names, of = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    return np.searchsorted(at[order], np.arange(len(terms) + 1)), of[order], weight[order], names.astype(np.int64)


def added(rows: int, row: np.ndarray, term: np.ndarray, part: np.ndarray, weights: Weights) -> np.ndarray:
    """A score for each row and query: the parts of the row's terms by their weights in the query. A row has a term once."""
    bounds, of, weight, names = weights
    score = np.zeros((rows, names.size))
    order = np.argsort(term, kind="stable")
    starts = np.flatnonzero(np.diff(term[order], prepend=-1))
    for start, end in zip(starts, [*starts[1:], order.size]):
        own = order[start:end]
        left, right = bounds[term[own[0]]], bounds[term[own[0]] + 1]
        score[row[own][:, None], of[left:right]] += part[own][:, None] * weight[left:right]
    return score


def passed_on(found: Best, names: np.ndarray) -> pa.RecordBatch:
    query, ids, score = found.cut()
    return pa.record_batch({"query_id": pa.array(names[query], pa.int64()), "chunk_id": pa.array(ids, pa.int64()), "score": pa.array(score)})


def best(met: DataFrame, weights: Weights, avgdl: float, k: int, k1: float, b: float) -> DataFrame:
    """query_id, chunk_id, score: of each task's chunks (as ``counted`` has them) the k best of each query."""
    sent = met.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value[-1]
        found, step = Best(names.size, k, GATHERED), max(1, CELLS // max(1, names.size))
        for batch in batches:
            ids, dl = batch.column("chunk_id").to_numpy(), batch.column("dl").to_numpy()
            norm = k1 * (1 - b + b * np.maximum(dl, 1) / avgdl)
            lists = batch.column("terms")
            row = np.repeat(np.arange(ids.size), pc.list_value_length(lists).to_numpy())
            term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            part = tf * (k1 + 1) / (tf + norm[row])
            for begin in range(0, ids.size, step):
                low, high = np.searchsorted(row, [begin, begin + step])
                own = slice(low, high)
                found.add(ids[begin : begin + step], added(min(step, ids.size - begin), row[own] - begin, term[own], part[own], sent.value))
        yield passed_on(found, names)

    return met.select("chunk_id", "dl", "terms", "tfs").mapInArrow(run, "query_id long, chunk_id long, score double")
