"""Ops 2, 5, 8 and 10 against the libraries on whole texts, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlgrove.llm import packing, piece_codec, queries, token_count, token_files, word_codec
from marlgrove.llm.common import flat

from .conftest import rows, texts

WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
CRC = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_texts():
    rnd = random.Random(1)
    alphabet = "abst'rev lmd\n\t  12.!?é ñ日▁<|>́ "
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(spark, awkward):
    more = spark.createDataFrame(list(enumerate(odd_texts(), 100)), "doc_id long, text string")
    return awkward.select("doc_id", "text").union(more)


def test_piece_codec(odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = []
    for d, text in texts(odd):
        ids = sp.encode(text or "") + [sp.eos_id()]
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows(piece_codec.encode_digests(odd, PIECE)) == sorted(want)
    got = {(r.ids[0] if r.ids else None, r.decoded) for r in piece_codec.encode(odd.limit(3), PIECE).collect()}
    assert got


def test_token_count(odd):
    lib = Tokenizer.from_file(BYTE)
    want = sorted((d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in texts(odd))
    assert rows(token_count.count_tokens(odd, BYTE)) == want


def test_fit_is_the_definition():
    m, rnd = token_count.ByteMachine(BYTE), random.Random(2)
    tokens = [t for t in m.tokens if t.isalpha() and len(t) < 4 and m.merged(t) == [t]]
    for _ in range(3000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert m._fit(a, b) == (m.merged(a + b) == [a, b])


def test_tables_that_start_anew(monkeypatch):
    """Each worker's table overflows at every batch; results stay those of the libraries."""
    monkeypatch.setattr(piece_codec, "TABLE_ROWS", 5)
    monkeypatch.setattr(word_codec, "TABLE_ROWS", 5)
    monkeypatch.setattr(token_count, "TABLE_ROWS", 5)
    monkeypatch.setattr(token_count, "EDGES", 40)
    sp, lib, byte = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    chunks, words, counter = piece_codec.ChunkTable(PIECE), word_codec.WordTable(WORD), token_count.Counter(BYTE)
    odd = odd_texts()
    for k in range(0, len(odd), 7):
        some = odd[k : k + 7]
        split = [piece_codec.split_chunks(t.encode()) for t in some]
        chunks.fill(set().union(*split))
        for t, s in zip(some, split):
            ids = sp.encode(t) + [sp.eos_id()]
            assert chunks.encode(s).decode() == " ".join(map(str, ids)) and chunks.decode(s).decode() == sp.decode(ids)
        ids, at = words.encode(pa.array(some), 2)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [lib.encode(t, add_special_tokens=False).ids + [2] for t in some]
        data, at = flat(pa.array(some))
        assert counter.counts(data, at).tolist() == [len(byte.encode(t, add_special_tokens=False).ids) for t in some]


def word_ids(df, end):
    lib = Tokenizer.from_file(WORD)
    return sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in texts(df))


@pytest.mark.parametrize("kind, sizes", [("byte", {}), ("bit", {}), ("byte", {"file_ids": 500, "shards": 3}), ("byte", {"file_docs": 7})])
def test_token_files(odd, kind, sizes):
    got = rows(token_files.token_files(odd, WORD, 2, kind, **sizes))
    want = word_ids(odd, 2)
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((d, len(i), CRC(i)) for d, i in want)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == sorted(r[0] for r in got)
    assert [r[1] for r in by_start] == np.cumsum([0, *[r[2] for r in by_start]])[:-1].tolist()


def test_files_are_cut_by_ids_and_hot_ids_dealt(spark, tmp_path):
    """A third of all rows have no doc_id; they lie in several tasks' ranges, and no file passes its sizes by more than a document."""
    made = [(None if k % 3 == 0 else k, "some words of one text" if k % 2 else f"w{k}") for k in range(3000)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    listed = token_files.write_files(df, WORD, 2, f"file://{tmp_path}", shards=8, file_ids=400, file_docs=50).collect()
    assert sum(r.n_docs for r in listed) == 3000 and max(r.n_docs for r in listed) <= 50 and max(r.n_ids for r in listed) <= 420
    by_shard = {}
    for r in listed:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.n_docs
    assert len(by_shard) == 8 and max(by_shard.values()) < 900


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1001, dtype=np.uint32)
    for kind in ("byte", "bit"):
        assert (token_files.from_planes(token_files.to_planes(ids, kind), ids.size) == ids).all()


def test_packing(odd):
    got, room = rows(packing.pack_documents(odd, WORD, 1, 64)), 64
    want = sorted((d, k, k * room, len(ids[k * room : (k + 1) * room]), CRC(ids[k * room : (k + 1) * room])) for d, ids in word_ids(odd, 1) for k in range(-(-len(ids) // room)))
    assert [r[:5] for r in got] == want
    fill = {}
    for *_, length, _, seq, at in sorted(got, key=lambda r: (r[5], r[6], r[3])):
        assert at == fill.get(seq, 0)
        fill[seq] = at + length
    assert max(fill.values()) <= room and len(fill) <= -(-sum(fill.values()) // room) + 1


def fewest(sizes, room):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= room:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(4)
    for _ in range(400):
        room = rnd.choice([10, 20, 50, 1000])
        sizes = sorted((rnd.randint(0 if rnd.random() < 0.1 else 1, rnd.choice([room, room // 2])) for _ in range(rnd.randint(1, 12))), reverse=True)
        seq, at = packing.pack(np.array(sizes), room)
        assert len(set(seq.tolist())) == fewest([x for x in sizes if x] or [0], room)
        assert packing.lower_bound(np.bincount(sizes, minlength=room + 1), room) <= fewest(sizes, room)


def test_completion_where_best_fit_misses_the_bound():
    """Triples that fill their sequences exactly: best fit needs more, completion finds them, alone and among full sequences."""
    rnd, missed = random.Random(8), 0
    for full in (0, 0, 0, 300, 300):
        sizes = [1000] * full
        for _ in range(7):
            a, b = rnd.randint(260, 480), rnd.randint(260, 330)
            sizes += [a, b, 1000 - a - b]
        counts = np.bincount(sizes, minlength=1001)
        bound = packing.lower_bound(counts, 1000)
        missed += len(packing.best_fit(counts, 1000)) > bound
        seq, at = packing.pack(np.array(sizes), 1000)
        assert len(set(seq.tolist())) == bound == full + 7
        assert np.bincount(seq, weights=sizes).max() <= 1000
    assert missed == 5


def test_fillings_are_those_undominated():
    """Against the definition: no other set of what is there has pieces that the filling's pieces fit in."""
    rnd = random.Random(3)

    def fits(small, large):
        if not small:
            return True
        return any(fits(small[1:], large[:k] + [large[k] - small[0]] + large[k + 1 :]) for k in range(len(large)) if large[k] >= small[0])

    for _ in range(120):
        room = rnd.randint(5, 20)
        items = sorted((rnd.randint(1, 12) for _ in range(rnd.randint(1, 6))), reverse=True)
        sets = {tuple(x for k, x in enumerate(items) if mask >> k & 1) for mask in range(1 << len(items))}
        sets = {s for s in sets if sum(s) <= room}
        left = [items.count(k) for k in range(room + 1)]
        got = [(tuple(f), free) for f, free in ((list(f), free) for f, free in packing.fillings(left, sum(1 << k for k, n in enumerate(left) if n), room, room, packing._Steps(10**6)))]
        assert len(set(got)) == len(got) and all(sum(f) + free == room for f, free in got)
        want = {s for s in sets if not any(t != s and fits(sorted(s, reverse=True), list(t)) and not fits(list(t), list(s)) for t in sets)}
        # Every filling that nothing dominates is there, and what is there is feasible and maximal.
        assert want <= {f for f, _ in got} <= sets


def test_groups_of_equal_rows_and_their_rest(spark, monkeypatch):
    """Equal rows are dealt over groups, and what groups leave open is packed together."""
    monkeypatch.setattr(packing, "GROUP_DOCS", 40)
    df = spark.createDataFrame([(None, "the same words again")] * 300 + [(k, "one two three " * (k % 9)) for k in range(100)], "doc_id long, text string").coalesce(1)
    pieces = packing.cut_documents(df, WORD, 1, 64)
    sizes = [r.n for r in pieces.selectExpr("pmod(deal, 10) as g").groupBy("g").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 80
    got = packing.pack_documents(df, WORD, 1, 64).toPandas()
    assert len(got) == 400
    total = got.groupby("sequence_id").length.sum()
    assert total.max() <= 64 and len(total) <= -(-int(got.length.sum()) // 64) + 1


def test_empty_tables(nothing):
    assert not packing.pack_documents(nothing, WORD, 1).collect()
    assert not token_files.token_files(nothing, WORD, 2).collect()
    assert not piece_codec.encode_digests(nothing, PIECE).collect()
    assert not token_count.count_tokens(nothing, BYTE).collect()


def test_queries_cover_all_documents(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op5_piece_codec", "op8_token_count", "op10_token_files"):
        assert queries.QUERIES[name](spark, sf).count() == n
