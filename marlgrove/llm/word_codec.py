"""Encoding with the word-level BPE file, chunk by chunk.

The file's patterns never match white space, its normaliser composes and lower-cases character by
character, and white space is dropped, so the ids of a text are those of its runs between ASCII white
space, in order. Each Python worker keeps a bounded table of the runs it has met.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat, fold_case

#: Runs a worker's table holds before it starts anew.
TABLE_ROWS = 1_200_000
#: Runs that the library encodes as one text, with MARK between them.
JOINED = 500
#: A run that the file encodes as one id.
MARK = b"\x01"
#: How the strings of the file's special tokens begin.
SPECIAL = b"<|"

_LETTER, _POINT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_POINT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def loosen(column: pa.Array) -> pa.Array:
    """The texts in lower case with a space between each ASCII letter and a mark beside it."""
    data, at = flat(column)
    if not data.size or SPECIAL in data.tobytes():
        return column
    letter, point = _LETTER[data], _POINT[data]
    apart = (letter[:-1] & point[1:]) | (point[:-1] & letter[1:])
    apart[at[(at > 0) & (at < data.size)] - 1] = False
    shift = np.append(0, np.cumsum(apart))
    out = np.full(data.size + int(shift[-1]), 32, np.uint8)
    out[np.arange(data.size) + shift] = fold_case(data)
    ends = at + shift[np.maximum(at - 1, 0)]
    ends[0] = 0
    return pa.LargeStringArray.from_buffers(at.size - 1, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(out))


class WordTable:
    """Little-endian 32-bit ids of runs without white space, each encoded once by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.rows: dict[bytes, bytes] = {}
        got = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = got[0] if len(got) == 1 else None

    def _fill(self, words: set[bytes]) -> None:
        rows = self.rows
        if len(rows) + len(words) > TABLE_ROWS:
            rows.clear()
        plain = [w for w in words if self.mark is not None and MARK not in w]
        between = b" " + MARK + b" "
        for begin in range(0, len(plain), 20 * JOINED):
            some = plain[begin : begin + 20 * JOINED]
            joined = [between.join(some[k : k + JOINED]).decode() for k in range(0, len(some), JOINED)]
            k = 0
            for got in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(got.ids, "<u4")
                data, last = ids.tobytes(), 0
                for end in [*np.flatnonzero(ids == self.mark).tolist(), ids.size]:
                    rows[some[k]] = data[4 * last : 4 * end]
                    last, k = end + 1, k + 1
        for word in words if self.mark is None else [w for w in words if MARK in w]:
            rows[word] = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column (null: empty), each followed by end_id, and the rows' first places.

        Arrow splits the texts and numbers their distinct runs, so the table is asked once for each."""
        split = pc.ascii_split_whitespace(loosen(pc.fill_null(column, "")))
        coded = split.flatten().dictionary_encode()
        met = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.rows.get, met))
        new = {w for w, x in zip(met, found) if x is None}
        if new:
            self._fill(new)  # it may clear the table, but then holds all of new
            found = [self.rows[w] if x is None else x for w, x in zip(met, found)]
        which = coded.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, count=len(found)) // 4
        place = np.cumsum(size) - size
        known = np.frombuffer(b"".join(found), "<u4")
        words = np.append(0, np.cumsum(size[which]))
        at = words[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids = known[np.arange(words[-1]) + np.repeat(place[which] - words[:-1], size[which])]
        rows = at.size - 1
        out = np.empty(ids.size + rows, "<u4")
        ends = at[1:] + np.arange(rows)
        inside = np.ones(out.size, bool)
        inside[ends] = False
        out[ends] = end_id
        out[inside] = ids
        return out, at + np.arange(rows + 1)


@lru_cache(maxsize=2)
def word_table(path: str) -> WordTable:
    return WordTable(path)
