"""Token ids in files of compressed bit or byte planes, with a chunk index, and back.

A file holds, all numbers little-endian:

    8 bytes   magic
    planes    of each block of BLOCK ids: 4 byte planes or 32 bit planes, each by zstandard
    documents doc_id (8 bytes each), whether it is there (1), ids (8), by zstandard
    index     for each block: ids, then place and size of each plane (8 bytes each)
    56 bytes  place and size of the documents, place of the index, blocks, documents, planes, magic

Documents lie in ascending doc_id order over the files and within each (null first; equal doc_id in
the order of a hash of their texts, by which and by chance such rows are dealt too). A task writes its
range of documents to files of about ``FILE_IDS`` ids, ``FILE_DOCS`` documents at most, and holds a block of
ids and one file's list of documents. A file is written under a name of its own try and listed only if
its task succeeded, so a lost executor leaves no half file in the list. The list is a table beside the
files; the driver holds the number of ids of each task's range.

Defined results: null text counts as empty, so its document is the end id alone; repeated rows are
repeated documents; texts of any length are encoded whole; an empty table has no files and no rows;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deal, scratch, slices, tasks_for
from .word_codec import word_table

MAGIC = b"MGPLANE1"
#: Ids in a block.
BLOCK = 1 << 16
#: Ids after which a task begins a new file, documents of a file, and documents that a reader returns at once.
FILE_IDS = 1 << 24
FILE_DOCS = 1 << 16
READ_DOCS = 1 << 13
LEVEL = 3
_FOOT = struct.Struct("<6q8s")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of 32-bit ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, stream, kind: str = "byte", block: int = BLOCK):
        import zstandard

        self.stream, self.kind, self.block = stream, kind, block
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.index, self.rest = 0, [], bytearray()
        self.docs, self.there, self.sizes = [], [], []
        self._write(MAGIC)

    def _write(self, data: bytes) -> tuple[int, int]:
        place = self.at
        self.stream.write(data)
        self.at += len(data)
        return place, len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, at: np.ndarray) -> None:
        """Documents with their ids end to end; at: where each begins, and the end."""
        self.docs += [d or 0 for d in doc_ids]
        self.there += [d is not None for d in doc_ids]
        self.sizes += np.diff(at).tolist()
        self.rest += ids.astype("<u4").tobytes()
        while len(self.rest) >= 4 * self.block:
            self._flush(4 * self.block)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.rest[:size]), "<u4")
        del self.rest[:size]
        self.index.append((ids.size, [self._write(self.press.compress(p)) for p in to_planes(ids, self.kind)]))

    def close(self) -> None:
        if self.rest:
            self._flush(len(self.rest))
        docs = self.press.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.there, np.uint8).tobytes() + np.array(self.sizes, "<i8").tobytes())
        place, size = self._write(docs)
        index, _ = self._write(np.array([x for n, planes in self.index for x in (n, *(v for p in planes for v in p))], "<i8").tobytes())
        self._write(_FOOT.pack(place, size, index, len(self.index), len(self.docs), 4 if self.kind == "byte" else 32, MAGIC))


class ShardReader:
    """Random access to blocks and documents of a shard."""

    def __init__(self, file):
        import zstandard

        self.file, self.open = file, zstandard.ZstdDecompressor()
        end = file.size()
        place, size, index, blocks, docs, self.planes, magic = _FOOT.unpack(self._read(end - _FOOT.size, _FOOT.size))
        if magic != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("no shard of this format")
        raw = self.open.decompress(self._read(place, size)) if docs else b""
        self.docs = np.frombuffer(raw, "<i8", docs)
        self.there = np.frombuffer(raw, np.uint8, docs, 8 * docs).astype(bool) if docs else np.zeros(0, bool)
        self.sizes = np.frombuffer(raw, "<i8", docs, 9 * docs) if docs else np.zeros(0, "<i8")
        wide = 1 + 2 * self.planes
        self.index = np.frombuffer(self._read(index, 8 * wide * blocks), "<i8").reshape(blocks, wide)

    def _read(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def block(self, k: int) -> np.ndarray:
        n, *at = self.index[k].tolist()
        return from_planes([self.open.decompress(self._read(at[2 * j], at[2 * j + 1])) for j in range(self.planes)], n)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """doc_id, number of ids, and the ids in parts, four bytes each, of one document after the other; parts are read in order."""
        rest, k, begin = b"", 0, 0

        def parts(need: int) -> Iterator[bytes]:
            nonlocal rest, k, begin
            while need:
                if begin == len(rest):
                    rest, k, begin = self.block(k).tobytes(), k + 1, 0
                part = rest[begin : begin + need]
                begin, need = begin + len(part), need - len(part)
                yield part

        for doc, there, size in zip(self.docs.tolist(), self.there.tolist(), self.sizes.tolist()):
            yield doc if there else None, size, parts(4 * size)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, path: str, end_id: int, to: str, kind: str = "byte", shards: int | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the ids of all documents below the folder ``to``; shard, file, name, n_docs, n_ids of each file, in a table there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        files, folder = _files(to)
        files.create_dir(folder, recursive=True)
        shard, written, writer, n = TaskContext.get().partitionId(), 0, None, 0

        def done() -> pa.RecordBatch:
            nonlocal written, writer
            writer.close()
            stream.close()
            row = pa.record_batch({"shard": pa.array([shard], pa.int64()), "file": pa.array([written], pa.int64()), "name": pa.array([name]), "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([n], pa.int64())})
            written, writer = written + 1, None
            return row

        for batch in slices(batches):
            ids, at = table.encode(batch.column("text"), end_id)
            doc_ids = batch.column("doc_id").to_pylist()
            begin = 0
            while begin < len(doc_ids):
                if writer is None:
                    name, n = f"{shard:08d}-{written:06d}-{uuid.uuid4().hex}.planes", 0
                    stream = files.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(stream, kind)
                # As many documents as the file takes, and one at least.
                end = int(np.searchsorted(at, at[begin] + file_ids - n, side="right")) - 1
                end = max(begin + 1, min(end, begin + file_docs - len(writer.docs), len(doc_ids)))
                writer.add(doc_ids[begin:end], ids[at[begin] : at[end]], at[begin : end + 1])
                n += int(at[end] - at[begin])
                begin = end
                if n >= file_ids or len(writer.docs) >= file_docs:
                    yield done()
        if writer is not None:
            yield done()

    keys = ("doc_id", "__text", "__chance")
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"), F.rand(7).alias("__chance")).repartitionByRange(shards or tasks_for(docs), *keys).sortWithinPartitions("doc_id", "__text")
    ordered.select("doc_id", "text").mapInArrow(run, "shard long, file long, name string, n_docs long, n_ids long").write.parquet(f"{to}/list")
    return docs.sparkSession.read.parquet(f"{to}/list")


def read_files(listed: DataFrame, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files of a folder."""
    totals = listed.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row a task that wrote
    ends = np.cumsum([0] + [r["n"] for r in totals]).tolist()
    bases = listed.sparkSession.createDataFrame([(r["shard"], e) for r, e in zip(totals, ends)], "shard long, base long")
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = listed.withColumn("within", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(F.broadcast(bases), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(at)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(f"{folder}/{name}") as file:
                    shard = ShardReader(file)
                    starts = start + np.cumsum(shard.sizes) - shard.sizes
                    documents = shard.documents()
                    for a in range(0, shard.docs.size, READ_DOCS):
                        b = min(a + READ_DOCS, shard.docs.size)
                        crcs = np.zeros(b - a, np.int64)
                        for i, (_, _, parts) in zip(range(b - a), documents):
                            crc = 0
                            for part in parts:
                                crc = zlib.crc32(part, crc)
                            crcs[i] = crc
                        yield pa.record_batch({"doc_id": pa.array(shard.docs[a:b], pa.int64(), mask=~shard.there[a:b]), "start": pa.array(starts[a:b], pa.int64()), "n_tokens": pa.array(shard.sizes[a:b], pa.int64()), "ids_crc32": pa.array(crcs)})

    names = placed.select("name", (F.col("base") + F.col("within")).alias("start"))
    return deal(names, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, kind: str = "byte", **sizes: int) -> DataFrame:
    """Writes all documents to files below the shared folder and reads them back; sizes: those of ``write_files``."""
    to = scratch(docs.sparkSession)
    return read_files(write_files(docs, path, end_id, to, kind, **sizes), to)
