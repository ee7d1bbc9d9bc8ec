"""Token counts by finite-state transducers.

Two deterministic machines are compiled from the tokenizer's file. The first reads character classes
and marks where a pre-token starts; it is run over all chunks of a batch at once, from every state,
which gives each chunk a map of states; maps compose, so a prefix scan over the chunks yields every
chunk's true first state. The second reads the bytes of a pre-token; its transitions carry how many
tokens more (or fewer) the text so far has. Its states are the last bytes that a coming token may
still take in, with the last token at each place among them; they are made when first met, as is
the table of distinct pre-tokens with their counts.

The byte machine rests on a property of byte-pair encoding: a sequence of tokens is the encoding of
its text if each two neighbours are the encoding of theirs, and the encoding without its last token
is the encoding of the shorter text. So the last token at each place is the only one that fits the
last token where it starts.

Defined results: null text counts as empty, with 0 bytes and tokens; a special token's string in a
text is one token, as the library takes it; rows keep their doc_id, null included; texts of any
length are counted whole; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, slices

#: Pre-tokens, and transitions, that a worker keeps before it starts anew.
TABLE_ROWS = 800_000
EDGES = 500_000
#: Characters after which a chunk's map of states is tested for being constant.
SETTLED = 4
#: Characters of a chunk.
CHUNK = 64

# Classes of characters; a lower half of the states stands for "the pre-token so far is ...".
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE1, QUOTE2 = range(7)
# SPACE: ' ' before a character that is no white space; it joins that one's pre-token.
# BLANK: other white space; QUOTE1 and QUOTE2: an apostrophe before s t m d, or re ve ll.
(S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_BLANK, S_ONE, S_TWO, S_LAST, S_EDGE) = range(9)
_N_STATES = 9
#: White space that ends before its last character, or that isn't ' ', starts its own pre-token.
BLANK_LONE = 7
_N_CLASSES = 8


def _compile_classes() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and starts[state, class]: whether a pre-token starts at the character read."""
    step = np.zeros((_N_STATES, _N_CLASSES), dtype=np.uint8)
    mark = np.ones((_N_STATES, _N_CLASSES), dtype=bool)
    plain = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SPACE, BLANK: S_BLANK, BLANK_LONE: S_EDGE, QUOTE1: S_ONE, QUOTE2: S_TWO}
    for state in range(_N_STATES):
        for kind, to in plain.items():
            step[state, kind] = to
    for state, kind in ((S_LETTER, LETTER), (S_NUMBER, NUMBER), (S_OTHER, OTHER), (S_BLANK, BLANK)):
        mark[state, kind] = False
    # After ' ' any run joins it; an apostrophe is then no contraction, nor is one within a run of others.
    for state in (S_SPACE, S_OTHER):
        for kind in (QUOTE1, QUOTE2):
            step[state, kind], mark[state, kind] = S_OTHER, False
    for kind in (LETTER, NUMBER, OTHER):
        mark[S_SPACE, kind] = False
    # Within a contraction its letters start nothing; behind it everything does.
    step[S_ONE, :], mark[S_ONE, :] = S_EDGE, False
    step[S_TWO, :], mark[S_TWO, :] = S_LAST, False
    step[S_LAST, :], mark[S_LAST, :] = S_EDGE, False
    return step, mark


_STEP, _MARK = _compile_classes()


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteMachine:
    """The transducer over a pre-token's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_names()
        spell = lambda s: bytes(byte[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[spell(a), spell(b)] = i
        self.tokens = {spell(t) for t in model["vocab"]}
        self.made = {a + b: (a, b, i) for (a, b), i in reversed(self.rank.items())}
        self.ends: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.heads = {t[:k] for t in self.tokens for k in range(len(t))}
        self._forget()

    def _forget(self) -> None:
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        #: By 256 * state + byte: 64 * next state + 32 + tokens more.
        self.edges: dict[int, int] = {}
        self._number(b"", (b"",), (0,))  # state 0: a pre-token's start

    def merged(self, text: bytes) -> list[bytes]:
        """Byte-pair encoding by its definition, for the strings of two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _edge_of(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's left (0) or right (1) end while it is merged: each part, and the rank of the merge that takes it in."""
        got = self.ends.get((token, side))
        if got is None:
            got, until, part = [], 1 << 60, token
            while True:
                got.append((part, until))
                if part not in self.made:
                    break
                until, part = self.made[part][2], self.made[part][side]
            self.ends[token, side] = got
        return got

    def _fit(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a and b together is a, b.

        Merges go by rank, and a part's rank is above those of its own parts. So one crosses the border
        if its rank comes before both ends are taken in; of equal ranks the leftmost goes first."""
        got = self.fits.get((a, b))
        if got is None:
            if not a:
                got = self.merged(b) == [b]
            else:
                rank, far = self.rank.get, 1 << 60
                got = True
                for x, x_until in self._edge_of(a, 1):
                    for y, y_until in self._edge_of(b, 0):
                        r = rank((x, y), far)
                        if r < x_until and r <= y_until and r < far:
                            got = False
                            break
                    if not got:
                        break
            self.fits[a, b] = got
        return got

    def _number(self, tail: bytes, last: tuple, lead: tuple) -> int:
        """tail: the bytes that a token may still take in; last[j]: the token that ends before tail[j:]
        (empty at the pre-token's start); lead[j]: tokens up to there less those up to the end."""
        key = (tail, last, lead)
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.states)
            self.states.append(key)
        return got

    def _edge(self, state: int, byte: int) -> int:
        tail, last, lead = self.states[state]
        tail = tail + bytes((byte,))
        for j in range(len(tail)):
            token = tail[j:]
            if token in self.tokens and self._fit(last[j], token):
                break
        else:
            raise ValueError(f"no token ends {tail!r}")
        more = lead[j] + 1
        if not -32 <= more < 32:
            raise ValueError(f"{more} tokens more at once")
        last, lead = (*last, token), (*(x - more for x in lead), 0)
        keep = next(j for j in range(len(tail) + 1) if tail[j:] in self.heads)
        edge = self.edges[state << 8 | byte] = self._number(tail[keep:], last[keep:], lead[keep:]) << 6 | more + 32
        return edge

    def count(self, text: bytes) -> int:
        if len(self.edges) > EDGES:
            self._forget()
        state, total, get = 0, 0, self.edges.get
        for byte in text:
            edge = get(state << 8 | byte)
            if edge is None:
                edge = self._edge(state, byte)
            state = edge >> 6
            total += (edge & 63) - 32
        return total


class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.machine = ByteMachine(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError("only a byte-level file without normaliser can be compiled")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.known: dict[bytes, int] = {}
        self.kinds = np.full(0x110000, 255, dtype=np.uint8)
        for c in range(128):
            self.kinds[c] = LETTER if chr(c).isalpha() else NUMBER if chr(c).isdigit() else OTHER
        self.kinds[[9, 10, 11, 12, 13, 32]] = BLANK

    def _class_of(self, point: int) -> int:
        """A character's class, as the library's own pre-tokenizer treats it."""
        char, cut = chr(point), self.library.pre_tokenizer.pre_tokenize_str
        for probe, kind in (("x", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(cut(probe + char)) == 1:
                return kind
        return BLANK

    def classes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and first byte of every character, and whether it is the first of its row."""
        first = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[first].astype(np.int32)
        points = lead.copy()
        wide = np.flatnonzero(lead >= 0x80)
        if wide.size:
            p, b = first[wide], lead[wide]  # of characters of several bytes
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            value = np.where(size == 2, b & 0x1F, np.where(size == 3, b & 0x0F, b & 0x07))
            for k in (1, 2, 3):
                more = size > k
                nxt = data[np.minimum(p + k, data.size - 1)].astype(np.int64) & 0x3F
                value = np.where(more, (value << 6) | nxt, value)
            points[wide] = value
            for c in np.unique(value):
                if self.kinds[c] == 255:
                    self.kinds[c] = self._class_of(int(c))
        kind = self.kinds[points]
        n = kind.size
        new = np.zeros(n + 1, dtype=bool)
        new[np.searchsorted(first, at)] = True
        new, last = new[:-1], np.append(new[1:n], True)
        blank = kind == BLANK
        follows = np.zeros(n, dtype=bool)  # a character of the same row that is no white space
        follows[:-1] = ~last[:-1] & ~blank[1:]
        kind[blank & follows] = BLANK_LONE
        kind[blank & follows & (points == 32)] = SPACE
        quote = np.flatnonzero((points == 39) & ~last)
        if quote.size:
            one = points[quote + 1]
            two = np.where(last[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
            kind[quote[np.isin(one, [115, 116, 109, 100])]] = QUOTE1
            kind[quote[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]] = QUOTE2
        return kind, first, new

    def starts(self, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each character: chunk maps, their prefix scan, then one run."""
        n = kind.size
        lanes = -(-n // CHUNK)
        grid = np.full(lanes * CHUNK, LETTER, dtype=np.uint8)
        grid[:n] = kind
        new = np.zeros(lanes * CHUNK, dtype=bool)
        new[:n] = first
        grid, new = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T), np.ascontiguousarray(new.reshape(lanes, CHUNK).T)
        step, mark = _STEP.reshape(-1), _MARK.reshape(-1)
        maps = np.tile(np.arange(_N_STATES, dtype=np.uint8), (lanes, 1))
        for t in range(SETTLED):
            maps[new[t]] = S_EDGE
            maps = step.take(maps << 3 | grid[t][:, None])
        # Where all states have met, one is followed; the few other chunks follow all of them.
        met = (maps == maps[:, :1]).all(axis=1)
        one, rest = maps[:, 0].copy(), np.flatnonzero(~met)
        some = maps[rest]
        for t in range(SETTLED, CHUNK):
            one[new[t]] = S_EDGE
            one = step.take(one << 3 | grid[t])
            if rest.size:
                some[new[t][rest]] = S_EDGE
                some = step.take(some << 3 | grid[t][rest][:, None])
        maps[:] = one[:, None]
        maps[rest] = some
        hop = 1  # afterwards maps[i] is the composition of all chunks up to i
        while hop < lanes:
            maps[hop:] = np.take_along_axis(maps[hop:], maps[:-hop].copy(), axis=1)
            hop *= 2
        state = np.full(lanes, S_EDGE, dtype=np.uint8)
        state[1:] = maps[:-1, S_EDGE]
        out = np.empty((CHUNK, lanes), dtype=bool)
        for t in range(CHUNK):
            state[new[t]] = S_EDGE
            at = state << 3 | grid[t]
            out[t] = mark.take(at) | new[t]
            state = step.take(at)
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    def counts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        rows = at.size - 1
        total = np.zeros(rows, dtype=np.int64)
        if not data.size:
            return total
        whole, owner = data, None
        text = data.tobytes()
        if any(s in text for s in self.special):
            cut = at.tolist()
            spans, owner = [], []
            for r in range(rows):
                rest = [(cut[r], text[cut[r] : cut[r + 1]])]
                for s in self.special:
                    split = []
                    for begin, part in rest:
                        bits = part.split(s)
                        total[r] += len(bits) - 1
                        for bit in bits:
                            split.append((begin, bit))
                            begin += len(bit) + len(s)
                    rest = split
                spans += [bit for _, bit in rest]
                owner += [r] * len(rest)
            text = b"".join(spans)
            whole = np.frombuffer(text, dtype=np.uint8)
            at = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int64)
            if not whole.size:
                return total
        kind, first, new = self.classes(whole, at)
        begin = np.flatnonzero(self.starts(kind, new))
        cut = first[begin]
        row = np.flatnonzero(np.diff(at))[np.cumsum(new[begin]) - 1]
        ends = [*cut[1:].tolist(), whole.size]
        tokens = [text[a:b] for a, b in zip(cut.tolist(), ends)]
        known, count = self.known, self.machine.count
        found = list(map(known.get, tokens))
        if None in found:
            fresh = {t for t, x in zip(tokens, found) if x is None}
            if len(known) + len(fresh) > TABLE_ROWS:
                known.clear()
            known.update((t, count(t)) for t in fresh)
            found = [known[t] if x is None else x for t, x in zip(tokens, found)]
        each = np.array(found, dtype=np.int64)
        if owner is not None:
            row = np.asarray(owner)[row]
        return total + np.bincount(row, weights=each, minlength=rows).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, by one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in slices(batches):
            data, at = flat(batch.column("text"))
            n = machine.counts(data, at)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit, pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
