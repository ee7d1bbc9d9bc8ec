"""Language identification of texts that may mix languages.

Learning counts hashed byte n-grams of the words of labelled documents per language. A word's scores
are its n-grams' log-likelihoods; the scripts of its letters, by ranges of code points, first narrow
its candidates to languages written in them. Viterbi over a text's words, with a penalty for each
switch of language, labels spans; a text's language is that of most of its letters.

A text whose best single language is no worse than any labelling with switches is found without
Viterbi: if no run of words favours another language by more than the penalty, and no first and last
part do together, no switch can pay.
All texts of a batch are tested at once, and the others are labelled at once, word by word.

Learning uses about ``SAMPLE_DOCS`` labelled documents, chosen by a hash, in whole; all of them if
there are no more. Each language has an equal share of them or, if it has fewer, all it has, and
``LANG_DOCS`` of them at least, so that a rare one doesn't vanish. All languages that are labelled are
learned. The model has ``CELLS`` scores, as n-gram buckets by languages, up to 4 * CELLS bytes; beyond
CELLS / LEAST_BUCKETS languages it grows with their number alone.

Defined results: null text and texts without a letter are ``und`` with score 0, as is every text if
nothing is labelled; ties go to the first language in order of its name; repeated rows are labelled
alike; rows keep their doc_id, null included; texts of any length are labelled whole; other columns
than doc_id, text and (in learning) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, slices, texts

#: Text bytes that ``filter_docs`` labels at once; some hundred bytes of scores stand beside each word.
FILTER_BYTES = 1_000_000
SAMPLE_DOCS = 20_000
LANG_DOCS = 50
#: Most n-gram buckets, fewest, and buckets times languages.
BUCKETS = 1 << 15
LEAST_BUCKETS = 1 << 11
CELLS = 1 << 23
#: Sizes of the n-grams, in bytes.
GRAMS = (2, 3, 4)
#: Log-likelihood that a switch of language must win.
SWITCH = 12.0
#: Words whose scores a worker keeps before it starts anew.
TABLE_ROWS = 300_000
#: A language counts as written in a script that has this share of its letters.
SCRIPT_SHARE = 0.01
_OUTSIDE = -50.0

#: First and last code point of each script, fixed values of the Unicode standard.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)),
}
_EDGES = sorted((a, b, 1 << k) for k, spans in enumerate(SCRIPTS.values()) for a, b in spans)
_OTHER = 1 << len(SCRIPTS)


def script_of(point: int) -> int:
    """The bit of a letter's script."""
    for a, b, bit in _EDGES:
        if a <= point <= b:
            return bit
    return _OTHER


def letters_of(word: bytes) -> tuple[bytes, int, int]:
    """A word's letters in lower case, how many, and the bits of their scripts."""
    text = word.decode().lower()
    if not text.isalpha():
        text = "".join([c for c in text if c.isalpha()])
    bits = 1 if text.isascii() and text else 0
    if not bits:
        for c in text:
            bits |= script_of(ord(c))
    return text.encode(), len(text), bits


def gram_buckets(words: list[bytes], n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (a power of 2) of all n-grams of ' word ' and, for each, the word's number; words are not empty."""
    data = np.frombuffer(b"".join([b" " + w + b" " for w in words]), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    p, buckets, owners = powers(max(GRAMS) + 2), [], []
    for k in GRAMS:
        n = data.size - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h += data[j : j + n] * p[j + 1]
        whole = owner[:n] == owner[k - 1 :]
        buckets.append((mix(h) & np.uint64(n_buckets - 1)).astype(np.int64)[whole])
        owners.append(owner[:n][whole])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """langs, the log-likelihood of each bucket per language, and each language's scripts."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table.astype(np.float32), scripts


def share_of(sizes: list[int], most: int) -> int:
    """The documents a language may give, so that all give about ``most`` together; LANG_DOCS at least."""
    left = most
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(LANG_DOCS, left // (len(sizes) - k))
        left -= n
    return max([LANG_DOCS, *sizes])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """From documents whose lang isn't null; callers leave out those held out."""
    labelled = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    number = {name: k for k, name in enumerate(langs)}
    share = share_of(list(sizes.values()), sample_docs)
    n_buckets = BUCKETS
    while n_buckets > LEAST_BUCKETS and n_buckets * len(langs) > CELLS:
        n_buckets //= 2
    if any(n > share for n in sizes.values()):
        rates = docs.sparkSession.createDataFrame([(k, int((1 << 30) * min(1.0, share / n))) for k, n in sizes.items()], "lang string, __rate long")
        labelled = labelled.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(1 << 30)) < F.col("__rate")).drop("__rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), n_buckets + _OTHER.bit_length()), np.int64)
        for batch in slices(batches):
            count: dict[int, dict[bytes, int]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
                if lang in number:
                    own = count.setdefault(number[lang], {})
                    for w in text.split():
                        own[w] = own.get(w, 0) + 1
            for lang, own in count.items():
                known = [(*letters_of(w), n) for w, n in own.items()]
                known = [x for x in known if x[1]]
                if known:
                    buckets, owner = gram_buckets([x[0] for x in known], n_buckets)
                    times = np.array([x[3] for x in known])
                    total[lang, :n_buckets] += np.bincount(buckets, weights=times[owner], minlength=n_buckets).astype(np.int64)
                    for _, size, bits, n in known:
                        for k in range(_OTHER.bit_length()):
                            if bits >> k & 1:
                                total[lang, n_buckets + k] += n * size
        lang, cell = np.nonzero(total)
        yield pa.record_batch({"lang": pa.array(lang.astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "n": pa.array(total[lang, cell])})

    cells = labelled.mapInArrow(run, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas() if langs else None
    total = np.zeros((len(langs), n_buckets + _OTHER.bit_length()))
    if langs:
        total[cells["lang"].to_numpy(), cells["cell"].to_numpy()] = cells["n"].to_numpy()
    grams, letters = total[:, :n_buckets] + 0.5, total[:, n_buckets:]
    share = letters / np.maximum(1, letters.sum(axis=1, keepdims=True))
    scripts = ((share >= SCRIPT_SHARE) * (1 << np.arange(_OTHER.bit_length()))).sum(axis=1)
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)).T, scripts)


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[bytes, int] = {}
        self.size = 0
        self.scores = np.zeros((1024, len(model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def fill(self, met: set[bytes]) -> None:
        new = [w for w in met if w not in self.rows]
        if self.size + len(new) > TABLE_ROWS:
            self.rows.clear()
            self.size, new = 0, list(met)
        if not new:
            return
        end = self.size + len(new)
        if end > self.letters.size:
            room = max(end, min(2 * self.letters.size, TABLE_ROWS))
            self.scores = np.concatenate((self.scores[: self.size], np.zeros((room - self.size, self.scores.shape[1]), np.float32)))
            self.letters = np.concatenate((self.letters[: self.size], np.zeros(room - self.size, np.int64)))
        known = [letters_of(w) for w in new]
        size = np.array([x[1] for x in known])
        bits = np.array([x[2] for x in known])
        part = np.zeros((len(new), len(self.model.langs)), np.float32)
        full = np.flatnonzero(size)
        if full.size:
            for begin in range(0, full.size, 20_000):
                some = full[begin : begin + 20_000]
                buckets, owner = gram_buckets([known[i][0] for i in some], self.model.table.shape[0])
                for lang in range(part.shape[1]):
                    part[some, lang] = np.bincount(owner, weights=self.model.table[buckets, lang], minlength=some.size)
            fits = (bits[:, None] & self.model.scripts[None, :]) != 0
            part[~fits & fits.any(axis=1)[:, None]] += _OUTSIDE
        self.scores[self.size : end], self.letters[self.size : end] = part, size
        self.rows.update(zip(new, range(self.size, end)))
        self.size = end

    def label(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number of each word, its letters, and the first word of each text (and the end)."""
        self.fill(set().union(*split))
        get = self.rows.__getitem__
        at = np.concatenate(([0], np.cumsum([len(s) for s in split])))
        rows = np.fromiter((r for s in split for r in map(get, s)), np.int64, count=int(at[-1]))
        scores, letters = self.scores[rows].astype(np.float64), self.letters[rows]
        n, langs = at.size - 1, scores.shape[1]
        owner = np.repeat(np.arange(n), np.diff(at))
        total = np.stack([np.bincount(owner, weights=scores[:, k], minlength=n) for k in range(langs)], axis=1)
        best = total.argmax(axis=1)
        out = best[owner]
        if not rows.size or langs == 1:
            return out, letters, at
        gain = scores - scores[np.arange(rows.size), out][:, None]
        run = np.cumsum(gain, axis=0)
        # What a text's sums have fallen to so far, 0 before its first word; each text lies below the one
        # before it, so that one running minimum serves all.
        begin = np.concatenate((np.zeros((1, langs)), run))[at[:-1]]
        run -= begin[owner]
        shift = (2 * np.abs(run).max() + 1) * owner[:, None]
        rise = run - np.minimum(np.minimum.accumulate(run - shift, axis=0) + shift, 0)
        # A path pays with a run of over SWITCH; or, if it never is in the best language, with a first and a
        # last part of over SWITCH together, as each part between them costs a switch of its own.
        full = np.flatnonzero(np.diff(at))
        first = np.maximum.reduceat(run.max(axis=1), at[full])
        last = np.maximum.reduceat((run[at[full + 1] - 1][np.repeat(np.arange(full.size), np.diff(at)[full])] - run).max(axis=1), at[full])
        most = np.maximum.reduceat(rise.max(axis=1), at[full])
        mixed = full[(most > SWITCH) | (first + last > SWITCH)]
        if mixed.size:
            self._viterbi(scores, at, mixed, out)
        return out, letters, at

    @staticmethod
    def _viterbi(scores: np.ndarray, at: np.ndarray, mixed: np.ndarray, out: np.ndarray) -> None:
        """Labels the texts ``mixed`` in out, all at once, the longest first so that ended ones fall away."""
        mixed = mixed[np.argsort(-(at[mixed + 1] - at[mixed]), kind="stable")]
        first, size = at[mixed], at[mixed + 1] - at[mixed]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t
        value = scores[first].copy()
        came = np.empty((int(size.sum()), scores.shape[1]), np.int16)
        begin, places = 0, []
        own = np.arange(scores.shape[1], dtype=np.int16)[None, :]
        for t in range(1, int(size[0])):
            k = int(alive[t])
            v = value[:k]
            top = v.argmax(axis=1)
            high = v[np.arange(k), top][:, None] - SWITCH
            came[begin : begin + k] = np.where(v >= high, own, top[:, None])
            places.append(begin)
            begin += k
            value[:k] = np.maximum(v, high) + scores[first[:k] + t]
        label = value.argmax(axis=1)
        out[first + size - 1] = label
        for t in range(int(size[0]) - 1, 0, -1):
            k = int(alive[t])
            label[:k] = came[places[t - 1] : places[t - 1] + k][np.arange(k), label[:k]]
            out[first[:k] + t - 1] = label[:k]


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of each document; with its spans (language, first and end word) if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        labeller = Labeller(model)
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in slices(batches):
            split = [t.split() for t in texts(batch.column("text"))]
            n, langs = len(split), len(model.langs)
            if langs:
                label, letters, at = labeller.label(split)
            else:
                label, letters, at = np.zeros(0, int), np.zeros(0, int), np.zeros(n + 1, int)
            owner = np.repeat(np.arange(n), np.diff(at))
            share = np.bincount(owner * langs + label, weights=letters, minlength=n * langs).reshape(n, langs) if langs else np.zeros((n, 0))
            all_ = share.sum(axis=1)
            best = np.where(all_ > 0, share.argmax(axis=1) if langs else 0, langs)
            score = np.where(all_ > 0, (share.max(axis=1) if langs else 0) / np.maximum(all_, 1), 0.0)
            columns = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score, pa.float64())}
            if spans:
                found = []
                for a, b in zip(at.tolist(), at[1:].tolist()):
                    cut = [0, *(np.flatnonzero(np.diff(label[a:b])) + 1).tolist(), b - a] if b > a else []
                    found.append([{"lang": names[label[a + s]], "first": s, "end": e} for s, e in zip(cut, cut[1:])])
                columns["spans"] = pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch(columns)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang: string, first: long, end: long>>" * spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    model = learn(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def filter_docs(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents of which one learned language has at least the share ``least``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        langs = len(sent.value.langs)
        for batch in slices(batches, limit=FILTER_BYTES):
            if not langs:
                continue
            split = [t.split() for t in texts(batch.column("text"))]
            label, letters, at = labeller.label(split)
            owner = np.repeat(np.arange(len(split)), np.diff(at))
            share = np.bincount(owner * langs + label, weights=letters, minlength=len(split) * langs).reshape(-1, langs)
            whole = share.sum(axis=1)
            yield batch.filter(pa.array((whole > 0) & (share.max(axis=1) >= least * whole)))

    return docs.mapInArrow(run, docs.schema)
