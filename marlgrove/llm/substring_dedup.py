"""Removal of word sequences that occur elsewhere, by seeds and their extensions.

Seeds are winnowed anchors: of each window of ``window`` words the eight-word gram of least hash.
Seeds of equal hash, wherever they are, meet in one bucket. Each extends both ways: for every split
of the window's words to the left and right of the seed it carries one hash of both extensions, so
seeds match at a split if and only if their texts do for all ``window`` words, and matching splits
that follow each other are one maximal repeat. Seeds whose extensions are all equal are joined before
and after they are dealt out, so a passage that a third of all documents share comes from each batch of
texts once.

Defined results: null and empty texts have no words, and their rest is empty; white space between kept
words becomes one space; overlapping and repeated windows are all removed, in every text they are in,
equal rows included; rows keep their doc_id, null included; texts are read whole; an empty table gives
no rows; columns besides doc_id and text are carried by ``filter_docs`` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cover, flat, gram_hashes, mix, powers, scratch, slices, texts, word_hashes, words
from .windows import anchored_runs, by_window, named, repeated_spans, spans_of, stretches, with_spans

GRAM = 8
_BACK = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _seeds(batch: pa.RecordBatch, window: int) -> tuple:
    """The words' hashes, and row, first window, windows, hash and place of each seed, places in the batch."""
    data, at = flat(batch.column("text"))
    starts, ends, row = words(data, at)
    h = word_hashes(data, starts, ends)
    first = np.searchsorted(row, np.arange(at.size))
    return h, first, anchored_runs(gram_hashes(h, GRAM), first, window, GRAM)


def extensions(h: np.ndarray, start: np.ndarray, seed: np.ndarray, window: int) -> np.ndarray:
    """A hash of the words from each start to its seed and on to the window's end."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(h.size + 1)[:-1], dtype=np.uint64)))
    back = np.full(h.size + 1, _BACK)
    back[0] = 1
    back = np.multiply.accumulate(back)
    left = (upto[seed] - upto[start]) * back[start]
    right = (upto[start + window] - upto[seed]) * back[seed]
    return mix(mix(left + (seed - start).astype(np.uint64)) + right * np.uint64(0xD6E8FEB86659FD93))


def window_names(h: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """128 bits of each window's words, in two columns."""
    out = np.zeros((start.size, 2), np.uint64)
    for k in range(window):
        out[:, 0] = mix(out[:, 0] + h[start + k])
        out[:, 1] = mix((out[:, 1] ^ h[start + k]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def find_spans(docs: DataFrame, window: int, at: str) -> DataFrame:
    """Names of texts with spans of words to remove; docs: named."""

    def runs(batch: pa.RecordBatch) -> tuple:
        _, begin, (row, first, _, key, _) = _seeds(batch, window)
        return row, first - begin[row], key

    def send(batch: pa.RecordBatch, may, hot) -> tuple:
        h, begin, (row, first, count, key, place) = _seeds(batch, window)
        picked = may(row, first - begin[row], key)
        row, first, count, key, place = row[picked], first[picked], count[picked], key[picked], place[picked]
        ends = np.cumsum(count)
        start = np.repeat(first - (ends - count), count) + np.arange(int(count.sum()))
        data = extensions(h, start, np.repeat(place, count), window).astype("<u8").tobytes() if key.size else b""
        bodies = [data[8 * a : 8 * b] for a, b in zip((ends - count).tolist(), ends.tolist())]
        row, first, count, key, bodies = by_window(hot(key), row, first, count, key, bodies, lambda start: window_names(h, start, window))
        return row, first - begin[row], count, key, bodies

    def meet(runs: dict[str, np.ndarray], bodies: list[bytes]) -> tuple:
        n = runs["windows"]
        run = np.repeat(np.arange(n.size), n)
        window_ = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        _, which, times = np.unique(mix(np.frombuffer(b"".join(bodies), "<u8") + runs["hash"][run]), return_inverse=True, return_counts=True)
        return stretches(run, window_, times[which] > 1)

    return repeated_spans(docs, at, runs, send, meet, window, body=4 * window)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, removed, kept = [], [], []
            for text, listed in zip(texts(batch.column("text")), batch.column("__spans").to_pylist()):
                split = text.split()
                n.append(len(split))
                if listed:
                    gone = cover(len(split), *spans_of(listed))
                    split = [w for w, x in zip(split, gone.tolist()) if not x]
                removed.append(n[-1] - len(split))
                kept.append(b" ".join(split))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept_text": pa.array([k.decode() for k in kept], pa.string())})

    rows = named(docs)
    found = with_spans(rows, find_spans(rows, window, scratch(docs.sparkSession)))
    return found.select("doc_id", "text", "__spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def repeat_digests(docs: DataFrame, window: int = 35) -> DataFrame:
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.col("kept_sha256"))
