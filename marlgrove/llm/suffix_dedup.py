"""Removal of byte strings that occur elsewhere, by suffix arrays built with difference covers.

Two suffixes can share a prefix of ``window`` bytes only if the anchor of that prefix is the same (see
``windows``), so suffixes are dealt by anchor over buckets, and each bucket's suffixes are sorted by
the difference-cover algorithm: suffixes at places 1 and 2 modulo 3 are named by their sorted triples,
names are recursed on until they are unique or stand for ``window`` bytes, the remaining suffixes are
sorted by a letter and the name behind it, and both are merged. Adjacent suffixes are then compared
in their first ``window`` bytes. One recursion over the whole corpus would move every suffix, some
sixteen times the text, at each level; dealt by anchors, only stretches around possible repeats move.
Stretches that are equal as a whole are joined before and after they are dealt out.

Defined results: null text is empty; matches stay within a text and count the same text's own other
places, overlaps included; equal rows are repeats of each other; bytes are removed wherever covered,
so a character may lose some of its bytes (``kept_text`` leaves out what is no character then); rows
keep their doc_id, null included; texts are read whole; an empty table gives no rows; columns besides
doc_id and text are carried by ``clean_docs`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, boxed, flat, mix, scratch, slices
from .windows import anchored_runs, by_window, named, repeated_spans, spans_of, stretches, with_spans

#: Bytes of an anchor.
GRAM = 32
#: Bytes sorted at once, unless one anchor has more.
SORT_BYTES = 500_000


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.zeros(data.size + 8, np.uint8)
    padded[: data.size] = data
    return np.ndarray(data.size, dtype="<u8", buffer=padded.data, strides=(1,))


def _anchors(batch: pa.RecordBatch, window: int) -> tuple:
    data, at = flat(batch.column("text"))
    n = data.size - GRAM + 1
    if n <= 0:
        return data, at, anchored_runs(np.zeros(0, np.uint64), at, window, GRAM)
    eights = _eights(data)
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h += eights[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        h ^= h >> np.uint64(29)
    return data, at, anchored_runs(mix(h), at, window, GRAM)


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of triples among the distinct ones, and how many these are."""
    top = int(max(a.max(), b.max(), c.max())) + 1
    if top <= 1 << 21:
        key = (a * top + b) * top + c
    else:
        _, pair = np.unique(a * top + b, return_inverse=True)
        key = pair * top + c
    found, rank = np.unique(key, return_inverse=True)
    return rank, found.size


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of s (integers from 0) in the order of their first ``depth`` letters; order beyond that is open."""
    n = s.size
    if n < 4 or depth <= 0:
        if depth <= 0:
            return np.argsort(s, kind="stable")
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 4, np.int64)
    t[:n] = s + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    name, distinct = _names(t[sample], t[sample + 1], t[sample + 2])
    if distinct < sample.size and depth > 3:
        order = suffix_order(name, -(-depth // 3))
    else:
        order = np.argsort(name, kind="stable")
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, sample.size + 1)
    sample = sample[order]
    sample = sample[sample < n]
    wide = np.int64(n + 4)
    zero = np.arange(0, n, 3)
    key = t[zero] * wide + rank[zero + 1]
    order = np.argsort(key, kind="stable")
    zero, key = zero[order], key[order]
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[ones] * wide + rank[ones + 1], key)
    # Letter pairs are named first, so that pair and rank fit in one number.
    both = np.concatenate((zero, twos))
    _, pair = np.unique(t[both] * (int(t.max()) + 1) + t[both + 1], return_inverse=True)
    long_ = pair * wide + rank[both + 2]
    before += np.searchsorted(long_[zero.size :], long_[: zero.size])
    out = np.empty(n, np.int64)
    place = np.arange(zero.size) + np.maximum.accumulate(before)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = sample
    return out


def equal_windows(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each start equals one at another start."""
    owned = np.full(data.size, -1, np.int64)
    owned[starts] = np.arange(starts.size)
    order = suffix_order(data.astype(np.int64), window)
    order = order[owned[order] >= 0]
    eights = _eights(data)
    left = np.arange(order.size - 1)
    for k in [*range(0, window - 7, 8), window - 8]:
        left = left[eights[order[left] + k] == eights[order[left + 1] + k]]
    hit = np.zeros(starts.size, bool)
    hit[owned[order[left]]] = True
    hit[owned[order[left + 1]]] = True
    return hit


def window_names(data: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """128 bits of each window's bytes, in two columns."""
    eights, out = _eights(data), np.zeros((start.size, 2), np.uint64)
    for k in [*range(0, window - 7, 8), window - 8]:
        word = eights[start + k]
        out[:, 0] = mix(out[:, 0] + word)
        out[:, 1] = mix((out[:, 1] ^ word) * np.uint64(0x9E3779B97F4A7C15))
    return out


def find_spans(docs: DataFrame, window: int, at: str) -> DataFrame:
    """Names of texts with spans of bytes to remove; docs: named."""
    if window < GRAM:
        raise ValueError(f"windows have {GRAM} bytes at least")

    def runs(batch: pa.RecordBatch) -> tuple:
        _, begin, (row, first, _, key, _) = _anchors(batch, window)
        return row, first - begin[row], key

    def send(batch: pa.RecordBatch, may, hot) -> tuple:
        data, begin, (row, first, count, key, _) = _anchors(batch, window)
        picked = may(row, first - begin[row], key)
        row, first, count, key = row[picked], first[picked], count[picked], key[picked]
        text = data.tobytes()
        bodies = [text[a : a + n + window - 1] for a, n in zip(first.tolist(), count.tolist())]
        row, first, count, key, bodies = by_window(hot(key), row, first, count, key, bodies, lambda start: window_names(data, start, window))
        return row, first - begin[row], count, key, bodies

    def meet(runs: dict[str, np.ndarray], bodies: list[bytes]) -> tuple:
        order = np.argsort(runs["hash"], kind="stable")
        keys, size = runs["hash"][order], np.array([len(bodies[i]) for i in order], np.int64)
        found, begin = [], 0
        while begin < order.size:
            end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), SORT_BYTES)))
            while end < order.size and keys[end] == keys[end - 1]:  # an anchor's stretches stay together
                end += 1
            some = order[begin:end]
            n = runs["windows"][some]
            base = np.cumsum(size[begin:end]) - size[begin:end]
            run = np.repeat(np.arange(some.size), n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = equal_windows(np.frombuffer(b"".join([bodies[i] for i in some.tolist()]), np.uint8), base[run] + within, window)
            of, lo, hi = stretches(run, within, hit)
            found.append((some[of], lo, hi))
            begin = end
        return tuple(np.concatenate(x) for x in zip(*found))

    return repeated_spans(docs, at, runs, send, meet, window, body=window + (window - GRAM) // 2)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover, in order."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new], end[np.append(new[1:], begin.size) - 1]


def _n_words(data: np.ndarray) -> int:
    inside = ~_SPACE[data]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def _rest(column: pa.Array, listed: list, least_words: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """Bytes, removed bytes, removed spans and what is left of each text; spans of fewer words than asked for stay."""
    data, at = flat(column)
    for a, b, spans in zip(at.tolist(), at[1:].tolist(), listed):
        if not spans:
            yield b - a, 0, 0, data[a:b].tobytes()
            continue
        runs = [(first, end) for first, end in zip(*(x.tolist() for x in merged(*spans_of(spans)))) if not least_words or _n_words(data[a + first : a + end]) >= least_words]
        cut = [0, *(x for run in runs for x in run), b - a]
        left = b"".join([data[a + x : a + y].tobytes() for x, y in zip(cut[::2], cut[1::2])])
        yield b - a, b - a - len(left), len(runs), left


def repeat_digests(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, removed, spans, kept = zip(*_rest(batch.column("text"), batch.column("__spans").to_pylist()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    rows = named(docs)
    found = with_spans(rows, find_spans(rows, window, scratch(docs.sparkSession)))
    return found.select("doc_id", "text", "__spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean_docs(docs: DataFrame, window: int = 400, least_words: int = 0) -> DataFrame:
    """The documents without their repeated bytes, with all their columns; n_chars, if there, follows the text.

    least_words: only removed runs of as many words (parts of words at their ends count) go."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "doc.text"):
            doc = batch.column("doc")
            left = [k.decode(errors="ignore") for *_, k in _rest(doc.field("text"), batch.column("__spans").to_pylist(), least_words)]
            new = {"text": pa.array(left, pa.string())} | ({"n_chars": pa.array([len(x) for x in left], pa.int64())} if "n_chars" in names else {})
            yield pa.RecordBatch.from_arrays([new.get(k, doc.field(i)) for i, k in enumerate(names)], names)

    keyed = docs.select(boxed(docs), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key_id"), F.xxhash64("text").alias("key_hash"))
    found = with_spans(keyed, find_spans(named(docs), window, scratch(docs.sparkSession)))
    return found.select("doc", "__spans").mapInArrow(run, docs.schema)
