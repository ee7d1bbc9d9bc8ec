"""Ops 3, 7 and 9, and the pipeline."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlgrove.llm import hash_index, language_id, quality_rules, queries

from .conftest import id_, rows, texts

SPACE = r"[^\x20\x09-\x0D]+"


def test_recall_of_the_index(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = collections.defaultdict(list)
    for r in sorted(queries.QUERIES["op3_hash_index"](spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        order = np.lexsort((ids, -score))[:20]
        own = got[ids[q]]
        assert len(own) == 20 and own == sorted(own, key=lambda v: (-v[1], v[0]))
        for v, s in own:
            assert abs(s - x[ids == v][0] @ x[q]) < 1e-12
        hit += len({v for v, _ in own} & set(ids[order]))
    assert hit >= 0.9 * 20 * len(got)


def test_awkward_vectors(spark):
    rows_ = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (40, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in hash_index.nearest(df, "vec_id % 20 = 0", 20).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 7, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 7, 0.0)]
    assert not hash_index.nearest(df.limit(0), "vec_id % 20 = 0", 20).collect()


def test_probing_finds_every_code_within_the_radius_once():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(500, 30))
    coder = hash_index.Coder(data, np.linalg.norm(data, axis=1).max())
    codes = coder.query_codes(data[:20])
    for radius in (0, 3, 7, 12):
        apart = np.bitwise_count(codes[:, None] ^ coder.codes(data)[None, :])
        index = hash_index.Index(coder, radius, 500)
        found = collections.Counter()
        for p in index.parts():
            found.update(zip(*(x.tolist() for x in hash_index.Block(np.arange(500), data, coder, p, radius).probe(codes))))
        assert found == collections.Counter(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))


def exact_nearest(x, ids, q, k=20):
    score = x @ x[q]
    score[ids == ids[q]] = -np.inf
    return np.lexsort((ids, -score))[:k]


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "norms"])
@pytest.mark.parametrize("block", [8192, 100])
def test_recall_over_keys_and_splits(spark, monkeypatch, kind, block):
    """Vectors without structure, in tight clusters (one of a third of all), and of norms that differ; small keys and splits too."""
    monkeypatch.setattr(hash_index, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    if kind == "clustered":
        x = rng.normal(size=(40, 24))[np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 40, 1500))] + 0.1 * x
    if kind == "norms":
        x *= rng.lognormal(0, 0.5, 1500)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(hash_index.nearest(df, "vec_id % 20 = 0", 20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == list(range(0, 1500, 20)) and all(len(v) == 20 for v in got.values())
    hit = sum(len(set(v) & set(exact_nearest(x, np.arange(1500), q).tolist())) for q, v in got.items())
    assert hit >= 0.9 * 20 * len(got)


def test_queries_far_from_all_are_asked_of_all_rows(spark):
    """A query whose neighbours' codes are beyond the radius gets its exact neighbours."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, 2000)] + 0.02 * rng.normal(size=(2000, 16))
    x[0] = rng.normal(size=16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in sorted(hash_index.nearest(df, "vec_id % 20 = 0", 20).filter("query_id = 0").collect(), key=lambda r: r["rank"])]
    assert got == exact_nearest(x, np.arange(2000), 0).tolist()


def test_repeated_ids_of_vectors(spark):
    """Rows of one id are one query; equal rows are one result."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.2, 3.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in hash_index.nearest(df, "vec_id % 20 = 0", 2).collect())
    assert got == [(0, 1, 2, 3.0), (0, 2, 1, 1.0)]


def viterbi(scores):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        top = value.argmax()
        back.append(np.where(value >= value[top] - language_id.SWITCH, np.arange(value.size), top))
        value = np.maximum(value, value[top] - language_id.SWITCH) + s
    return value.max()


def test_labels_are_the_best():
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.BUCKETS, 3)), np.ones(3, int))
    own, n = language_id.Labeller(model), 3000
    own.scores = rng.normal(0, 3, (n, 3)).astype(np.float32)
    for i in range(0, n, 100):
        own.scores[i : i + rng.integers(3, 90), rng.integers(3)] += 3
    own.letters, own.rows, own.size = np.ones(n, int), {b"%d" % i: i for i in range(n)}, n
    split = [[b"%d" % j for j in range(a, a + rng.integers(0, 150))] for a in rng.integers(0, n - 150, 150)]
    label, _, at = own.label(split)
    for s, a, b in zip(split, at, at[1:]):
        if s:
            scores = own.scores[[int(x) for x in s]].astype(float)
            path = label[a:b]
            got = scores[np.arange(b - a), path].sum() - language_id.SWITCH * (path[1:] != path[:-1]).sum()
            assert abs(got - viterbi(scores)) < 1e-6


def test_word_scores_that_start_anew(monkeypatch):
    """A labeller whose table overflows labels as one that holds all words."""
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], rng.normal(-8, 1, (language_id.BUCKETS, 2)), np.ones(2, int))
    batches = [[[b"w%d" % rng.integers(200) for _ in range(rng.integers(0, 30))] for _ in range(5)] for _ in range(20)]
    whole = language_id.Labeller(model)
    want = [whole.label(b)[0].tolist() for b in batches]
    monkeypatch.setattr(language_id, "TABLE_ROWS", 20)
    small = language_id.Labeller(model)
    assert [small.label(b)[0].tolist() for b in batches] == want


def test_halves_in_two_languages_neither_the_best():
    """Each half gains 10 over the best single language, under SWITCH, and both together 20."""
    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.BUCKETS, 3)), np.ones(3, int))
    own = language_id.Labeller(model)
    own.scores = np.array([[0, 10, -20], [0, -20, 10]], np.float32)
    own.letters, own.rows, own.size = np.ones(2, int), {b"0": 0, b"1": 1}, 2
    label, _, at = own.label([[b"0", b"1"], [], [b"0"], [b"1", b"0"]])
    assert label.tolist() == [1, 2, 1, 2, 1] and at.tolist() == [0, 2, 2, 3, 5]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_rare_and_many_languages_are_learned(spark, monkeypatch):
    """Of 300 languages, one with a third of all documents, each is learned from a small sample and found again; buckets give way to languages."""
    monkeypatch.setattr(language_id, "CELLS", 1 << 21)
    words = [[f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("orn", "ilt", "esk", "abu", "oth")] for k in range(300)]
    docs = [(10_000 * k + i, " ".join(words[k]), f"l{k}") for k in range(300) for i in range(1500 if k == 7 else 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.learn(df, sample_docs=1000)
    assert len(model.langs) == 300 and model.table.shape == (4096, 300)
    got = language_id.identify(df.dropDuplicates(["lang"]), model).join(df, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


def test_share_of_languages():
    assert language_id.share_of([], 100) == language_id.LANG_DOCS
    assert language_id.share_of([10, 2000, 3000], 2000) == 995
    assert language_id.share_of([10, 20], 2000) == 50


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    en, de = (docs.filter(f"lang = '{x}' and n_chars between 600 and 3000").orderBy("doc_id").first().text for x in ("en", "de"))
    df = spark.createDataFrame([(1, en + " " + de), (2, None), (3, "12 !!"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(df, model, spans=True).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and abs(got[1].spans[0].end - len(en.split())) < 12
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (2, 3, 4))


def test_language_of_awkward_rows(awkward, nothing):
    got = language_id.identify_held_out(awkward).collect()
    assert len(got) == awkward.count() and all(r.held_out is not None for r in got)
    assert not language_id.identify_held_out(nothing).collect()
    assert {r.lang_pred for r in language_id.identify_held_out(awkward.filter("lang is null")).collect()} == {"und"}


def measures(text):
    w = re.findall(SPACE, text or "")
    ls = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(hit)


def test_measures(awkward):
    got = sorted((r[:7] for r in rows(quality_rules.judge(awkward))))
    want = []
    for d, t in texts(awkward):
        m = measures(t)
        want.append((d, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want)


def test_quantiles_of_the_sketch(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(1, 1000, 5000)
    df = spark.createDataFrame([("en", "s", 100, int(v), 0, 1, 0, 0, 0) for v in values], "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_echo_words long")
    r = quality_rules.quantiles(quality_rules.sketches(df), ["lang"]).filter("measure = 'word_length'").first()
    for got, q in ((r.mid, 0.5), (r.high, quality_rules.UPPER), (r.low, quality_rules.LOWER)):
        assert abs(got / np.quantile(values / 100, q, method="inverted_cdf") - 1) < 0.011


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = quality_rules.judge(docs).join(labels, "doc_id").toPandas()
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.1
    kept = quality_rules.filter_docs(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.judge(docs).filter("kept").count()


def test_junk_does_not_set_its_own_threshold(spark, sf):
    """Of two sources one is a third junk and one mostly junk; clean documents of both stay, and of a source that is alike throughout."""
    import corpus_pipeline

    def text(i, symbols):
        return " ".join(f"{i}w{k}{'#' if k < symbols else 'x'}" for k in range(100))

    made = [(f"clean-{s}", s, 2 + i % 3) for s, n in (("a", 300), ("b", 100), ("c", 900)) for i in range(n)]
    made += [(f"junk-{s}", s, 40) for s, n in (("a", 150), ("b", 200)) for i in range(n)]
    df = spark.createDataFrame([(i, text(i, n), "en", s, kind) for i, (kind, s, n) in enumerate(made)], "doc_id long, text string, lang string, source string, kind string")
    got = {r.kind: r["count"] for r in corpus_pipeline.apply_quality_rules(spark, df, sf).groupBy("kind").count().collect()}
    assert got == {"clean-a": 300, "clean-b": 100, "clean-c": 900}


def test_quality_of_no_rows(nothing):
    assert not quality_rules.judge(nothing).collect() and not quality_rules.filter_docs(nothing).collect()


def test_pipeline(spark, sf, awkward, nothing):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0.3 * before < docs.count() <= before
        before = docs.count()
    packed = c.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == {id_(r.doc_id) for r in docs.collect()}
    for _, stage in c.STAGES[:-1]:
        for df in (awkward, nothing):
            assert stage(spark, df, sf).columns == df.columns


def test_pipeline_bounds_record_batches(spark, sf, awkward):
    """After any stage 20 MB of rows reach a worker in batches of 4 MB at most, a lower bound stays, and results don't depend on it."""
    import pyarrow as pa
    import corpus_pipeline as c
    from marlgrove.llm.common import ARROW_BYTES, sweep

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": [b.num_rows], "bytes": [b.nbytes]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    wide = spark.range(0, 20_000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    try:
        found = {}
        for bound in ("64m", "2k"):
            for k, (stage, f) in enumerate(c.STAGES):
                spark.conf.set(name, bound)
                got = rows(f(spark, awkward, sf).select("doc_id", *["piece", "length", "ids_crc32"] * (stage == "best_fit_packing"), *["text"] * (stage != "best_fit_packing")).na.fill({"text": "-"} if stage != "best_fit_packing" else {}))
                assert found.setdefault(stage, got) == got
                if bound == "2k":
                    assert spark.conf.get(name) in ("2k", "2048b")
                elif k in (0, 4):
                    met = wide.mapInArrow(sizes, "n long, bytes long").collect()
                    assert sum(r.n for r in met) == 20_000 and max(r["bytes"] for r in met) <= 1.01 * ARROW_BYTES
                else:
                    assert spark.conf.get(name) == str(ARROW_BYTES)
    finally:
        spark.conf.set(name, before)
        sweep(spark)
