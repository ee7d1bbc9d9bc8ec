"""Finding repeated windows of a fixed length through anchors, for bytes as for words.

Each window's anchor is its k-gram of least hash (the leftmost of equals), a function of the window's
content alone, so equal windows have equal anchors at equal places. Consecutive windows of one anchor
place are a run. Only runs whose anchor occurs at two places or more can hold a repeated window; a
first pass counts anchors, and a filter of at most ``FILTER_BITS`` bits tells the second pass which
runs to send (it may send too many, never too few). Where there are more repeated anchors than that
filter can tell apart, each text's runs are marked by a join with them instead. Runs are dealt by their
anchors' hash over buckets of about ``BUCKET_BYTES``, packed into one row for each bucket and batch of
texts. A text is named by its doc_id and a hash of it, so that equal rows share a name and a result.

An anchor of more than ``HOT`` places (a passage that a great share of all texts have) would bring all of
its distinct runs to one task. Its runs go out window by window instead, each window under its own
hash: those that batches share are joined there, and the rest spread over all buckets. Which anchors
are hot is told by a second filter of at most ``HOT_BITS`` bits; as it depends on the anchor alone, one
that it takes for hot by mistake is dealt by window from everywhere, which gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal, group_bounds, groups, mix, slices, tasks_for

#: Text bytes handled at once; numbers of eight bytes stand beside each byte.
BATCH_BYTES = 1_000_000
#: Most bits of the filter that is sent to all tasks: 16 MB.
FILTER_BITS = 1 << 27
_PAGE = 1 << 18
#: Buckets for each shuffle partition.
BUCKETS = 8
#: Bytes of runs that a bucket is meant to hold.
BUCKET_BYTES = 4_000_000
#: Bits of the filter for each repeated anchor below which runs are marked by a join.
CROWDED = 4
#: Places beyond which an anchor's runs are dealt window by window, whatever the size of the data.
HOT = 4_000
#: Most bits of the filter of hot anchors: 1 MB.
HOT_BITS = 1 << 23
#: Bytes that stand for a window of a hot anchor; no other body has as many.
NAMED = 17
_PLACE = np.uint64((1 << 30) - 1)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and the name (key_id, key_hash) of each row."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key_id"), F.xxhash64("text").alias("key_hash"))


def anchored_runs(h: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window start, number of windows, anchor hash and anchor place of each run.

    h: hashes of the k-grams that start at each letter of all rows; at: the rows' first letters."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    span = window - gram + 1
    n = h.size - span + 1
    if n <= 0:
        return none
    key = (h & ~_PLACE) | np.arange(h.size, dtype=np.uint64)
    size = -(-h.size // span) * span
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: h.size] = key
    grid = padded.reshape(-1, span)
    upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(onward[:n], upto[span - 1 : span - 1 + n])
    starts = [np.arange(a, b - window + 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b - a >= window]
    if not starts:
        return none
    start = np.concatenate(starts)
    place = (least[start] & _PLACE).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
    count = np.diff(np.append(begin, start.size))
    first = start[begin]
    return np.searchsorted(at, first, side="right") - 1, first, count, h[place[begin]], place[begin]


def repeated_anchors(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """h, n of anchors that occur at two places or more; hashes: the anchors of a batch of texts, one a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES):
            h, n = np.unique(hashes(batch), return_counts=True)
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())})

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(8 * bits.size - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Filter:
    """Which anchors may be repeated (all, where ``bits`` is None) and which are hot; places: those of all repeated anchors."""

    def __init__(self, bits: np.ndarray | None, hot: np.ndarray | None, places: int):
        self.bits, self.hot, self.places = bits, hot, places

    def is_hot(self, h: np.ndarray) -> np.ndarray:
        return np.zeros(h.size, bool) if self.hot is None else _holds(self.hot, h)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        return np.ones(h.size, bool) if self.bits is None else _holds(self.bits, h)


def _bits(hashes: DataFrame, size: int) -> np.ndarray:
    """A filter of size bits in which those of all hashes are on; made in pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "page"):
            page = part.column("page").to_numpy()
            place = part.column("place").to_numpy()
            cut = group_bounds(page).tolist()
            bits = []
            for a, b in zip(cut, cut[1:]):
                on = np.zeros(_PAGE, np.uint8)
                on[place[a:b]] = 1
                bits.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.record_batch({"page": pa.array(page[cut[:-1]]), "bits": pa.array(bits, pa.binary())})

    place = F.expr(f"h & {size - 1}L")
    pages = deal(hashes.select(F.shiftright(place, _PAGE.bit_length() - 1).alias("page"), place.bitwiseAND(F.lit(_PAGE - 1)).alias("place")).distinct(), "page").sortWithinPartitions("page")
    out = np.zeros(size // 8, np.uint8)
    for page, some in pages.mapInArrow(run, "page long, bits binary").collect():  # size / 8 bytes at most
        out[page * _PAGE // 8 : (page + 1) * _PAGE // 8] = np.frombuffer(some, np.uint8)
    return out


def filter_of(anchors: DataFrame) -> Filter:
    """anchors: h, n of a written table, so that reading them again costs little."""
    hot = F.col("n") > HOT
    found, places, hots = anchors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(hot)).first()

    def size(least: int, most: int) -> int:
        return min(most, max(_PAGE, 1 << max(0, least - 1).bit_length()))

    bits = None if CROWDED * found > FILTER_BITS else _bits(anchors, size(16 * found, FILTER_BITS))
    return Filter(bits, _bits(anchors.filter(hot), size(64 * hots, HOT_BITS)) if hots else None, places)


#: A row of a bucket: for each run its text's name, first window, windows and what ``pack`` made of it.
BLOCK = "bucket long, key_id binary, key_hash binary, first binary, windows binary, hash binary, body binary, size binary, twice binary"
#: Spans of a text, as pairs of 32-bit numbers.
SPANS = "key_id long, key_hash long, spans binary"


def spans_rows(key_id: np.ndarray, key_hash: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each text that occurs among the spans."""
    order = np.lexsort((begin, key_hash, key_id))
    key_id, key_hash = key_id[order], key_hash[order]
    pairs = np.ascontiguousarray(np.stack((begin[order], end[order]), axis=1).astype("<i4"))
    cut = np.flatnonzero(np.concatenate(([True], (key_id[1:] != key_id[:-1]) | (key_hash[1:] != key_hash[:-1])))) if order.size else np.zeros(0, int)
    return pa.record_batch({"key_id": pa.array(key_id[cut], pa.int64()), "key_hash": pa.array(key_hash[cut], pa.int64()), "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), order.size])], pa.binary())})


def pack_blocks(buckets: int, key_id: np.ndarray, key_hash: np.ndarray, first: np.ndarray, windows: np.ndarray, h: np.ndarray, bodies: list[bytes], twice: np.ndarray) -> pa.RecordBatch:
    """Runs packed by bucket; bodies: what tells the windows of each run apart; twice: whether the run stands for two or more."""
    bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = group_bounds(bucket[order]).tolist()
    size = np.array([len(b) for b in bodies], np.int64)
    pick = lambda x, kind: [x[order[a:b]].astype(kind).tobytes() for a, b in zip(cut, cut[1:])]
    return pa.record_batch(
        {
            "bucket": pa.array(bucket[order][cut[:-1]] if order.size else bucket, pa.int64()),
            "key_id": pa.array(pick(key_id, "<i8"), pa.binary()),
            "key_hash": pa.array(pick(key_hash, "<i8"), pa.binary()),
            "first": pa.array(pick(first, "<i4"), pa.binary()),
            "windows": pa.array(pick(windows, "<i4"), pa.binary()),
            "hash": pa.array(pick(h, "<u8"), pa.binary()),
            "body": pa.array([b"".join([bodies[i] for i in order[a:b].tolist()]) for a, b in zip(cut, cut[1:])], pa.binary()),
            "size": pa.array(pick(size, "<i4"), pa.binary()),
            "twice": pa.array(pick(twice, "u1"), pa.binary()),
        }
    )


def unpack_blocks(part: pa.Table) -> dict[str, np.ndarray]:
    """The runs of a bucket's rows, end to end."""
    kinds = {"key_id": "<i8", "key_hash": "<i8", "first": "<i4", "windows": "<i4", "hash": "<u8", "size": "<i4", "twice": "u1", "body": "u1"}
    return {k: np.frombuffer(b"".join(part.column(k).to_pylist()), kind) for k, kind in kinds.items()}


def one_of_each(h: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For runs of equal anchors and bodies: the number of the first of them, and whether there are more."""
    seen: dict[tuple[int, bytes], int] = {}
    to = np.empty(h.size, np.int64)
    for i, key in enumerate(zip(h.tolist(), bodies)):
        to[i] = seen.setdefault(key, i)
    return to, np.bincount(to, minlength=h.size)[to] > 1


def by_window(hot: np.ndarray, row: np.ndarray, first: np.ndarray, count: np.ndarray, key: np.ndarray, bodies: list[bytes], names: Callable[[np.ndarray], np.ndarray]) -> tuple:
    """The runs, with each hot one replaced by its windows; names(start): 128 bits of each window's content, as two columns."""
    if not hot.any():
        return row, first, count, key, bodies
    cold, n = np.flatnonzero(~hot), count[hot]
    start = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    name = np.ascontiguousarray(names(start), dtype=np.uint64)
    data = name.tobytes()
    return (
        np.concatenate((row[cold], np.repeat(row[hot], n))),
        np.concatenate((first[cold], start)),
        np.concatenate((count[cold], np.ones(start.size, count.dtype))),
        np.concatenate((key[cold], mix(name[:, 0] ^ np.uint64(0x94D049BB133111EB)))),
        [bodies[i] for i in cold.tolist()] + [b"w" + data[k : k + 16] for k in range(0, 16 * start.size, 16)],
    )


def marked(docs: DataFrame, anchors: DataFrame, runs: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """docs (named) with the list of first windows of their runs whose anchors are repeated, as pieces of 32-bit numbers.

    runs(batch): row, first window in its row, and anchor hash of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES):
            row, first, h = runs(batch)
            yield pa.record_batch({"h": pa.array(h.view(np.int64)), "key_id": batch.column("key_id").take(pa.array(row)), "key_hash": batch.column("key_hash").take(pa.array(row)), "first": pa.array(first.astype(np.int32))})

    places = docs.select("key_id", "key_hash", "text").mapInArrow(run, "h long, key_id long, key_hash long, first int").join(anchors.select("h"), "h", "left_semi")
    listed = places.groupBy("key_id", "key_hash").agg(F.collect_set("first").alias("__marks"))
    return docs.join(listed, ["key_id", "key_hash"], "left")


def repeated_spans(docs: DataFrame, at: str, runs, send, meet, window: int, body: int) -> DataFrame:
    """Names of texts (docs: named) with the spans of letters that repeated windows cover; at: a folder for the anchors.

    runs(batch): row, first window in its row, and anchor hash of each run of a batch. send(batch, may, hot): row,
    first window, windows, anchor hash and body (of some ``body`` bytes) of each run for which
    may(row, first, hash) holds, those for which hot(hash) does by window. meet(runs): of a bucket's distinct runs,
    the run and first and last window of each stretch of windows that are equal to windows of others."""
    spark = docs.sparkSession
    repeated_anchors(docs, lambda batch: runs(batch)[2]).write.parquet(f"{at}/anchors")
    anchors = spark.read.parquet(f"{at}/anchors")
    known = filter_of(anchors)
    sent = spark.sparkContext.broadcast(known)
    by_join = known.bits is None
    docs = (marked(docs, anchors, runs) if by_join else docs).select("key_id", "key_hash", "text", *["__marks"] * by_join)
    buckets = max(BUCKETS * tasks_for(docs), known.places * (body + 40) // BUCKET_BYTES)

    def may_of(batch: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        if not by_join:
            return lambda row, first, h: sent.value.may_hold(h)
        listed = batch.column("__marks")
        own = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(listed), 0)))
        on = (own << 32) | listed.flatten().to_numpy().astype(np.int64)
        return lambda row, first, h: np.isin((row.astype(np.int64) << 32) | first, on)

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=BATCH_BYTES):
            row, first, windows, h, bodies = send(batch, may_of(batch), sent.value.is_hot)
            if not h.size:
                continue
            key_id, key_hash = batch.column("key_id").to_numpy()[row], batch.column("key_hash").to_numpy()[row]
            to, more = one_of_each(h, bodies)
            # Runs that are equal within the batch are known to repeat: one goes on in their name.
            alone = to == np.arange(h.size)
            keep = np.flatnonzero(alone)
            if more.any():
                sure = spans_rows(key_id[more], key_hash[more], first[more], first[more] + windows[more] + window - 1)
                blank = pa.array([None] * sure.num_rows, pa.binary())
                yield pa.record_batch({"bucket": pa.array(-1 - (sure.column("key_hash").to_numpy() & 0xFFFF)), "key_id": pa.array([x.tobytes() for x in sure.column("key_id").to_numpy()], pa.binary()), "key_hash": pa.array([x.tobytes() for x in sure.column("key_hash").to_numpy()], pa.binary()), **dict.fromkeys(("first", "windows", "hash"), blank), "body": sure.column("spans"), "size": blank, "twice": blank})
            yield pack_blocks(buckets, key_id[keep], key_hash[keep], first[keep], windows[keep], h[keep], [bodies[i] for i in keep.tolist()], more[keep])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "bucket", rows=1):
            bucket = part.column("bucket").to_numpy()
            cut = group_bounds(bucket).tolist()
            for a, b in zip(cut, cut[1:]):
                rows = part.slice(a, b - a)
                if bucket[a] < 0:
                    ids = np.frombuffer(b"".join(rows.column("key_id").to_pylist()), "<i8")
                    hashes = np.frombuffer(b"".join(rows.column("key_hash").to_pylist()), "<i8")
                    yield pa.record_batch({"key_id": pa.array(ids), "key_hash": pa.array(hashes), "spans": rows.column("body").combine_chunks()})
                    continue
                runs = unpack_blocks(rows)
                ends = np.cumsum(runs["size"].astype(np.int64))
                body = runs["body"].tobytes()
                bodies = [body[x:y] for x, y in zip((ends - runs["size"]).tolist(), ends.tolist())]
                to, more = one_of_each(runs["hash"], bodies)
                more |= np.bincount(to, weights=runs["twice"], minlength=to.size)[to] > 0
                all_ = np.arange(to.size)
                whole = more & (runs["windows"] > 0)
                run, begin, last = [all_[whole]], [np.zeros(int(whole.sum()), np.int64)], [runs["windows"][whole].astype(np.int64) - 1]
                # Distinct runs of one anchor are compared window by window.
                keep = np.flatnonzero(to == all_)
                _, which, n = np.unique(runs["hash"][keep], return_inverse=True, return_counts=True)
                keep = keep[(n[which] > 1) & (runs["size"][keep] != NAMED)]
                if keep.size:
                    of, lo, hi = meet({"hash": runs["hash"][keep], "windows": runs["windows"][keep].astype(np.int64)}, [bodies[i] for i in keep.tolist()])
                    # What holds for a run holds for those equal to it.
                    order = np.argsort(to, kind="stable")
                    start = np.searchsorted(to[order], keep[of])
                    n = np.searchsorted(to[order], keep[of], side="right") - start
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    run.append(order[np.repeat(start, n) + step])
                    begin.append(np.repeat(lo, n))
                    last.append(np.repeat(hi, n))
                run, begin, last = np.concatenate(run), np.concatenate(begin), np.concatenate(last)
                first = runs["first"][run].astype(np.int64)
                yield spans_rows(runs["key_id"][run], runs["key_hash"][run], first + begin, first + last + window)

    blocks = docs.mapInArrow(deal_out, BLOCK)
    return deal(blocks, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, SPANS)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (named) with the list of their spans, null where they have none. Equal rows' equal spans count once."""
    listed = spans.groupBy("key_id", "key_hash").agg(F.collect_set("spans").alias("__spans"))
    return docs.join(listed, ["key_id", "key_hash"], "left")


def spans_of(listed: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each span in a row's list."""
    pairs = np.frombuffer(b"".join(listed or []), "<i4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def stretches(run: np.ndarray, window: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first and last window of each stretch of hits; run and window of all windows, in order."""
    run, window = run[hit], window[hit]
    if not run.size:
        return run, window, window
    new = np.concatenate(([True], (run[1:] != run[:-1]) | (window[1:] != window[:-1] + 1)))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], run.size) - 1
    return run[begin], window[begin], window[end]
