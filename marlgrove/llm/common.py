"""What the operators share: reading tables, the shared scratch folder, and vectorised text primitives.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` of a UTF-8 text, which is the
same as the pattern ``[^\\x20\\x09-\\x0D]+`` on its characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once in a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
#: Most bytes of a record batch that Spark collects for a Python worker where ``small_batches`` is asked for.
ARROW_BYTES = 4_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Documents that are scanned in fewer tasks than the cluster runs at once (a small table of one file) are dealt over all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name == "documents" and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores, "doc_id")
    return df


#: Scratch folders of this driver that ``sweep`` hasn't removed.
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share."""
    _MADE.append(f"{shared_dir(spark)}/marlgrove-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many scratch folders are there; ``sweep`` takes it to spare them."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Removes the scratch folders made after the first ``since``. Results that are not written yet may still read theirs."""
    while len(_MADE) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, one below /tmp if all tasks run on this machine (tests); else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/marlgrove"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's record batches to ``ARROW_BYTES``, unless it has a lower bound; a longer row is a batch of its own.

    Spark's own bound of 64 MB lies in the JVM's buffers, which double as they grow, and again in the worker, for
    each task, beside the next batch. Results don't depend on it. As they are lazy, the setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def tasks_for(df: DataFrame, least: int = 1) -> int:
    """The shuffle partitions the session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def boxed(docs: DataFrame, name: str = "doc") -> Column:
    """All columns as one struct, so that no other column can clash with them; ``unboxed`` undoes it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unboxed(df: DataFrame, columns: list[str], name: str = "doc") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`") for c in columns])


def deal(df: DataFrame, *cols: str, times: int = 1) -> DataFrame:
    """Deals rows out by the hash of cols over the session's number of shuffle partitions."""
    return df.repartition(times * tasks_for(df), *cols)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the column ``text`` (or a struct's field, as in "doc.text") has about ``limit`` bytes at most, but at least one row."""
    name, _, field = text.partition(".")
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(name)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column.field(field) if field else column), 0), dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column (null: empty) and the offsets of its rows in them."""
    column = pa.compute.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes; null is empty."""
    data, at = flat(column)
    whole, cut = data.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(cut, cut[1:])]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z only."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word, in text order."""
    if not data.size:
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[at] = True
    before = np.empty(data.size, dtype=bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(data.size, dtype=bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


_POWERS = {"p": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    have = _POWERS["p"]
    if have.size < n:
        size = max(n, 1024)
        step = np.full(size, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 1 << 16:
            _POWERS["p"] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = data[within + np.repeat(starts, sizes)].astype(np.uint64) + _U(1)
    letters *= powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h; runs across rows are the caller's to leave out."""
    if h.size < k:
        return np.zeros(0, np.uint64)
    n = h.size - k + 1
    total, p = np.zeros(n, np.uint64), powers(k + 1)
    for j in range(k):
        total += h[j : j + n] * p[j + 1]
    return mix(total)


def runs_to_spans(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index of each maximal run of True."""
    step = np.diff(np.concatenate(([0], keep.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where any of the half-open ranges covers an index below n."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 50_000) -> Iterator[pa.Table]:
    """Whole groups of rows that lie next to each other with one key, about ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key)
        last = keys[whole.num_rows - 1].as_py()
        first = pa.compute.index(keys, value=last).as_py()
        if first:
            yield whole.slice(0, first).combine_chunks()
            held = whole.slice(first).combine_chunks().to_batches()
            size = whole.num_rows - first
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys, and the number of rows."""
    if not keys.size:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [keys.size]))
