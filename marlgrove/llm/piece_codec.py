"""SentencePiece encoding and decoding through a table of distinct marked words.

A piece of the model never has a whitespace marker behind another character (``check_model`` tests
it), so no merge crosses the place before a marker run: a text is segmented chunk by chunk, a chunk
being a run of spaces with the characters up to the next space. Each Python worker keeps a table of
the distinct chunks it has met, segments each new one once with the library, and joins ids back by
position. The table holds ``TABLE_ROWS`` chunks at most, after which it starts anew; a global table,
joined by a shuffle, would move every word of the corpus (some five times the input) instead.

Defined results: null text counts as empty; an empty text is the end id alone and decodes to an empty
text; repeated rows give repeated results; rows keep their doc_id, null included; texts of any length
are encoded whole; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices, texts

#: Chunks a worker's table holds before it starts anew.
TABLE_ROWS = 300_000

MARK = "▁"
_MARK_BYTES = MARK.encode()
_CHUNK = re.compile(rb" *[^ ]+| +$")


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Fails if a piece could cross the place before a whitespace marker."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a whitespace marker")


class ChunkTable:
    """Ids (decimal, joined by one space) and decoded bytes of chunks, each segmented once."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        self.ids: dict[bytes, bytes] = {}
        #: Only of chunks that don't decode to themselves.
        self.decoded: dict[bytes, bytes] = {}
        self.end = b"%d" % self.model.eos_id()

    def fill(self, chunks: set[bytes]) -> None:
        """chunks: without one leading marker, which the library puts in front itself."""
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > TABLE_ROWS:
            self.ids.clear()
            self.decoded.clear()
            new = list(chunks)
        plain = [c for c in new if c]
        for chunk, got in zip(plain, self.model.encode([c.decode() for c in plain], num_threads=1)):
            self._put(chunk, got)
        if b"" in new:
            self._put(b"", [self.model.piece_to_id(MARK)])

    def _put(self, chunk: bytes, got: list[int]) -> None:
        self.ids[chunk] = b" ".join(b"%d" % i for i in got)
        back = self.model.decode(got).encode() if chunk else b""
        if back != chunk:
            self.decoded[chunk] = back

    def encode(self, split: list[bytes]) -> bytes:
        if not split:
            return self.end
        return b" ".join(map(self.ids.__getitem__, split)) + b" " + self.end

    def decode(self, split: list[bytes]) -> bytes:
        if self.decoded and not self.decoded.keys().isdisjoint(split):
            other = self.decoded
            return b" ".join([other.get(c, c) for c in split])
        return b" ".join(split)


def split_chunks(text: bytes) -> list[bytes]:
    """The chunks of a text, each without its first marker; the model puts a marker before the text."""
    if not text:
        return []
    if _MARK_BYTES in text:  # the model reads its own marker as a space
        text = text.replace(_MARK_BYTES, b" ")
    if b"  " not in text and text[:1] != b" ":
        return text.split(b" ")
    return [c[1:] for c in _CHUNK.findall(b" " + text)]


@lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _table(path)
        for batch in slices(batches):
            split = [split_chunks(t) for t in texts(batch.column("text"))]
            chunks.fill(set().union(*split))
            ids = [chunks.encode(s) for s in split]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([i.count(b" ") + 1 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(chunks.decode(s)).hexdigest() for s in split], pa.string()),
                }
            )

    return run


def pieces(path: str):
    """The same with the ids and the decoded text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _table(path)
        for batch in slices(batches):
            split = [split_chunks(t) for t in texts(batch.column("text"))]
            chunks.fill(set().union(*split))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.array([[int(i) for i in chunks.encode(s).split()] for s in split], pa.list_(pa.int32())),
                    "decoded": pa.array([chunks.decode(s).decode() for s in split], pa.string()),
                }
            )

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every document."""
    return docs.select("doc_id", "text").mapInArrow(pieces(path), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, by one pass without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(encoder(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
