"""Packing of documents into sequences of a fixed number of tokens by bin completion.

Documents are encoded, an end id is appended, and only documents longer than a sequence are cut. The
pieces are dealt over groups of about ``GROUP_DOCS`` documents by a hash, rows that are equal throughout
by their number among their like in a batch too, so that no group grows with the data. Within a group, a
best-fit-decreasing packing is the first incumbent. If it has more sequences than the lower bound,
branch and bound looks for a packing with fewer: among the pieces of the sequences with the most room,
twice as many each time and at last of all, it completes one sequence at a time. Around the largest piece
left it enumerates the undominated fillings, those with no waste first, and goes no further than the
waste that fewer sequences than the incumbent's allow. A filling is dominated if a piece left out fits in
place of one or more of its pieces and the room it leaves. What bounds the work is ``NODES`` steps for each
sequence of the group, not the number of fillings; without that bound the search is exact. Sequences
that the groups leave with much room are packed once more together.

Defined results: null text counts as empty, so its document is the end id alone; texts are encoded
whole; repeated rows are packed as often as they occur; an empty table gives no rows; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, scratch, slices
from .word_codec import word_table

#: Documents in a group.
GROUP_DOCS = 65_536
#: Steps of branch and bound for each sequence of a group, and for a group at least.
NODES = 50
LEAST_NODES = 200_000
#: A sequence with this share of its room left is packed again with those of other groups.
OPEN = 1 / 16


def lower_bound(counts: np.ndarray, room: int) -> int:
    """No packing has fewer sequences: large pieces can't share, and what fits beside them is limited."""
    sizes = np.arange(room + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(s[-1]) // room)
    half = room // 2
    for k in np.flatnonzero(counts[: half + 1]):
        alone = int(n[room] - n[room - k])
        n2, s2 = int(n[room - k] - n[half]), int(s[room - k] - s[half])
        s3 = int(s[half] - (s[k - 1] if k else 0))
        best = max(best, alone + n2 + max(0, -(-(s3 - (n2 * room - s2)) // room)))
    return best


def best_fit(counts: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing; sequences as lists of sizes."""
    out: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    bits = 0
    for size in range(room, -1, -1):
        for _ in range(int(counts[size])):
            fit = bits >> size
            if size and fit:
                left = size + (fit & -fit).bit_length() - 1
                k = open_at[left].pop()
                if not open_at[left]:
                    bits &= ~(1 << left)
                out[k].append(size)
            else:
                left, k = room, len(out)
                out.append([size])
            left -= size
            if left:
                open_at.setdefault(left, []).append(k)
                bits |= 1 << left
    return out


class _Steps:
    """Steps left."""

    def __init__(self, n: int):
        self.left = n


def _spread(bits: int, by: int) -> int:
    """The bits and the next ``by`` ones above each."""
    have = 0
    while have < by:
        step = min(have + 1, by - have)
        bits |= bits << step
        have += step
    return bits


def dominated(filling: list[int], free: int, rest: int) -> bool:
    """Whether a size of the set ``rest`` (bits) could take the place of some pieces of a filling that leaves ``free``."""
    sums, several = 1, 0
    for size in filling:
        several |= (sums & ~1) << size | several << size
        sums |= sums << size
    sums &= ~1
    return bool(several & rest) or (free > 0 and bool(_spread(sums << 1, free - 1) & rest))


def fillings(left: list[int], bits: int, room: int, waste: int, steps: _Steps):
    """All undominated fillings of a room that waste at most so much, those with less waste first, each with its waste.

    left: pieces of each size; bits: the sizes that are left."""
    for free in range(min(waste, room) + 1):
        chosen: list[int] = []
        most, need = room, room - free
        while steps.left > 0:
            steps.left -= 1
            size = (bits & ((2 << min(most, need)) - 1)).bit_length() - 1 if need > 0 else 0
            if need == 0:
                rest = bits
                if not dominated(chosen, free, rest):
                    yield chosen, free
            if size > 0:
                chosen.append(size)
                left[size] -= 1
                if not left[size]:
                    bits &= ~(1 << size)
                need -= size
                most = size
                continue
            if not chosen:
                break
            size = chosen.pop()  # the next smaller size in its place
            left[size] += 1
            bits |= 1 << size
            need += size
            most = size - 1
        for size in chosen:
            left[size] += 1
            bits |= 1 << size


def complete(sizes: list[int], room: int, most: int, steps: _Steps) -> list[list[int]] | None:
    """The sizes in at most so many sequences, or None if there is no such packing or no steps are left."""
    left = [0] * (room + 1)
    for size in sizes:
        left[size] += 1
    bits = sum(1 << s for s, c in enumerate(left) if c)
    waste = most * room - sum(sizes)
    path: list[list[int]] = []
    stack: list[tuple] = []  # largest piece, its fillings, waste before

    def put(size: int, n: int) -> None:
        nonlocal bits
        left[size] += n
        bits = bits | 1 << size if left[size] else bits & ~(1 << size)

    def branch() -> None:
        top = bits.bit_length() - 1
        put(top, -1)
        # The generator works on its own copy, as deeper ones change what is left.
        stack.append((top, fillings(left.copy(), bits, room - top, waste, steps), waste))

    if waste < 0:
        return None
    if not bits:
        return []
    branch()
    while stack:
        top, options, before = stack[-1]
        if len(path) == len(stack):  # undo the filling before
            for size in path.pop()[1:]:
                put(size, 1)
        waste = before
        found = next(options, None)
        if found is None:
            put(top, 1)
            stack.pop()
            continue
        filling, free = found
        path.append([top, *filling])
        for size in filling:
            put(size, -1)
        waste = before - free
        if not bits:
            return path
        if len(path) < most:
            branch()
    return None


def improve(bins: list[list[int]], room: int, bound: int, steps: int | None = None) -> list[list[int]]:
    """The bins, or a packing of the same sizes in fewer: the emptiest bins are packed anew first, then more of them."""
    left = _Steps(max(LEAST_NODES, NODES * len(bins)) if steps is None else steps)
    while len(bins) > bound and left.left > 0:
        bins = sorted(bins, key=lambda b: (sum(b), b))
        n, better = 2, None
        while better is None and left.left > 0:
            n = min(n, len(bins))  # of the bins that have most room
            part = [size for b in bins[:n] for size in b]
            if sum(part) <= (n - 1) * room:
                # A part takes half of the steps at most, so that larger parts have theirs.
                own = _Steps(left.left if n == len(bins) else left.left // 2)
                before = own.left
                better = complete(part, room, n - 1, own)
                left.left -= before - own.left
            if better is not None:
                bins = better + bins[n:]
            elif n == len(bins):
                return bins
            n *= 2
    return bins


def pack(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it for each size; sizes are from 0 to room."""
    counts = np.bincount(sizes, minlength=room + 1)
    nothing, counts[0] = int(counts[0]), 0
    bins = improve(best_fit(counts, room), room, lower_bound(counts, room))
    if nothing:  # pieces of no length go anywhere
        bins = bins or [[]]
        bins[0] = [*bins[0], *[0] * nothing]
        counts[0] = nothing
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(counts)
    seq, at = np.empty(sizes.size, np.int64), np.empty(sizes.size, np.int64)
    for k, members in enumerate(bins):
        place = 0
        for size in members:
            ends[size] -= 1
            i = order[ends[size]]
            seq[i], at[i] = k, place
            place += size
    return seq, at


def cut_documents(docs: DataFrame, path: str, end_id: int, room: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces, and a hash to deal them by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in slices(batches):
            ids, at = table.encode(batch.column("text"), end_id)
            data, total = memoryview(ids).cast("B"), np.diff(at)
            n = -(-total // room)
            row = np.repeat(np.arange(n.size), n)
            piece = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
            start = piece * room
            size = np.minimum(room, total[row] - start)
            begin = (at[row] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * size).tolist())]
            doc = batch.column("doc_id").take(pa.array(row))
            key = mix(np.asarray(pa.compute.fill_null(doc, -1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(piece.astype(np.uint64) << np.uint64(32) | np.array(crc, np.uint64)))
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if key.size else key
            times = np.empty(key.size, np.uint64)  # how many equal ones are before it
            times[order] = np.arange(key.size) - np.repeat(new, np.diff(np.append(new, key.size)))
            yield pa.record_batch({"doc_id": doc, "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(crc, pa.int64()), "deal": pa.array(mix(key + times).view(np.int64))})

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECE}, deal long")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_groups(pieces: DataFrame, room: int, groups: int, again: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset, and whether their sequence has much room left; dealt over groups by ``deal``."""

    def run(group: tuple, part: pa.Table) -> pa.Table:
        size = part.column("length").to_numpy()
        seq, at = pack(size, room)
        free = room - np.bincount(seq, weights=size)
        names = seq * groups + group[0].as_py()
        part = part.select(["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
        columns = {"sequence_id": pa.array(-1 - names if again else names), "offset": pa.array(at), "open": pa.array(free[seq] >= OPEN * room)}
        for name, values in columns.items():
            part = part.append_column(name, values)
        return part

    keyed = pieces.withColumn("packed_in", F.pmod(F.col("deal"), F.lit(groups)))
    return keyed.groupBy("packed_in").applyInArrow(run, f"{PIECE}, deal long, sequence_id long, offset long, open boolean")


def pack_documents(docs: DataFrame, path: str, end_id: int, room: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark, pieces = docs.sparkSession, cut_documents(docs, path, end_id, room)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    groups = max(1, round(docs.select("doc_id").count() / GROUP_DOCS))
    if groups == 1:
        return pack_groups(pieces, room, 1).select(*columns)
    at = scratch(spark)
    pack_groups(pieces, room, groups).write.parquet(f"{at}/packed")
    packed = spark.read.parquet(f"{at}/packed")
    rest = packed.filter("open")
    anew = pack_groups(rest.select("doc_id", "piece", "start", "length", "ids_crc32", "deal"), room, max(1, round(rest.count() / GROUP_DOCS)), again=True)
    return packed.filter("not open").select(*columns).unionByName(anew.select(*columns))
