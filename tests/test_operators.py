"""Expressions and folds on small hand-made cases with known values."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlgrove.functions import text as t
from marlgrove.functions import udfs
from marlgrove.operators import agentic, answer, chunker, compose, driver, evaluate, layout, report, rescue, search, writer
from marlgrove.sources import artefacts, manifest


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


RAG = "The policy gradient improves the reward. The policy is stable."
TABLE = "model a 71.2 80.1 65.0\nmodel b 70.0 79.9 64.1\nplain text line\nplain text line"


def test_scores(spark):
    assert one(spark, t.token_estimate, "", "a b c", "one two three four") == [1, 3, 5]
    assert one(spark, t.density_quality, RAG, TABLE) == [0.560556, 0.483519]
    assert one(spark, t.language_entropy, "aabb", "aaab", RAG, "aaa", "") == [1.0, 0.811278, 0.941145, 0.0, 0.0]
    assert one(spark, t.table_probability, TABLE) == [0.375]
    assert one(spark, t.benchmark_probability, TABLE) == [0.225]
    assert one(spark, t.duplicate_line_ratio, TABLE) == [0.25]
    assert one(spark, t.malformed_structure, TABLE) == [0.225]
    assert one(spark, t.numeric_ratio, TABLE) == [0.233766]
    assert one(spark, t.alphabetic_ratio, TABLE) == [0.493506]
    assert one(spark, t.average_sentence_length, TABLE) == [16.0]
    df = spark.createDataFrame([(TABLE,)], "x string").withColumns(t.quality_columns(F.col("x"))).withColumn("noise_score", t.noise_score()).withColumn("retrieval_quality_score", t.chunk_quality())
    assert df.select("noise_score", "retrieval_quality_score").first() == (0.375911, 0.597191)


def test_long_lines_do_not_overflow(spark):
    line = " ".join(["w"] * 50_000) + " 1 2 3"
    assert one(spark, t.table_probability, line) == [0.5]


def test_table_rows(spark):
    row = re.compile(r"^\s*(?:[\w\-\+/\.]+\s+){2,}[\d\.%]+(?:\s+[\d\.%]+){2,}\s*$")
    rnd = random.Random(3)
    lines = [" ".join(rnd.choice(["a", "b.c", "1", "2.5", "5%", "x-y", "(", "é"]) for _ in range(rnd.randint(1, 8))) for _ in range(500)]
    assert one(spark, t.table_row, *lines) == [bool(row.match(x)) for x in lines]


def bm25(spark, docs, query):
    chunks = spark.createDataFrame(docs, "chunk_id long, chunk_text string")
    return {r.chunk_id: r.score for r in search.bm25(chunks, spark.createDataFrame([(0, query)], "query_id long, text string")).collect()}


def test_bm25(spark):
    docs = [(1, "policy gradient policy"), (2, "policy reward"), (3, "table of results")]
    assert bm25(spark, docs, "policy") == {1: 0.624307, 2: 0.523548}
    assert bm25(spark, docs, "policy policy") == {1: 1.248613, 2: 1.047097}
    assert bm25(spark, docs, "policy reward") == {1: 0.624307, 2: 1.616118}


def test_fusion(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")
    dense, sparse = lists([(0, "a", 1.0, 1), (0, "b", 0.5, 2)]), lists([(0, "c", 7.0, 1), (0, "a", 3.0, 2)])
    got = {r.chunk_id: round(r.fused_score, 6) for r in search.rrf(dense, sparse).collect()}
    assert got == {"a": 0.032522, "c": 0.016393, "b": 0.016129}
    scaled = {r.chunk_id: round(r.fused_score, 6) for r in search.rrf(dense.withColumn("score", F.col("score") * 9), sparse).collect()}
    assert scaled == got
    got = {r.chunk_id: r.fused_score for r in search.weighted(dense, lists([(0, "c", 7.0, 1)])).collect()}
    assert got == {"a": 0.55, "b": 0.0, "c": 0.25}


def test_final_score(spark):
    row = spark.range(1).select(search.final_score(F.lit(1 / 61 + 1 / 62), F.lit(1.2), None, F.lit(0.05) + F.lit(0.08)))
    assert row.first()[0] == 0.195027


def test_citations(spark):
    text = "As shown [1, 2] and by Smith et al. (2020)."
    row = udfs.with_citations(spark.createDataFrame([(text,), ("",)], "text string")).orderBy(F.desc("text")).first()
    assert [(s.start, s.end, s.kind) for s in row.spans] == [(9, 15, "numeric"), (23, 42, "author_year_inline")]
    assert row.citation_density == 0.1667 and row.spans[1].year == 2020


def test_nfkc_and_registry(spark):
    assert one(spark, udfs.nfkc, "ﬁne ²") == ["fine 2"]
    assert one(spark, lambda c: udfs.call("token_estimate", c), "a b c") == [3]
    with pytest.raises(ValueError):
        udfs.register("dot", t.dot)


def test_grounding(spark):
    df = spark.createDataFrame([("Policy gradient improves reward. Whales swim through oceans.", "policy gradient improves reward on benchmark tasks")], "a string, e string")
    row = df.select(answer.grounding(F.col("a"), F.col("e"), F.lit(1), F.lit(1)).alias("g")).first().g
    assert (row.n_claims, row.unsupported_ratio, row.score) == (2, 0.5, 0.5)
    assert spark.range(1).select(answer.hallucination(F.lit(0.5), F.lit(0.5), F.lit(1), F.lit(1))).first()[0] == 0.4


def test_intents(spark):
    assert one(spark, answer.intent, "Compare A versus B", "recent benchmark results survey", "hello") == ["comparison", "benchmark_performance", "definition"]
    assert "ppo" in one(spark, answer.topics, "support vectors")[0]
    assert one(spark, answer.expanded, "GRPO results") == [["Group Relative Policy Optimization", "RLHF GRPO", "findings", "outcomes", "reinforcement learning optimization"]]


def test_keep_all_if_none_passes(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.05), (2, 0.2), (2, 0.05)], "query_id long, answerability double")
    assert sorted((r.query_id, r.answerability) for r in answer.keep_answerable(df).collect()) == [(1, 0.05), (1, 0.1), (2, 0.2)]


def test_sections(spark):
    assert one(spark, t.section_label, "Introduction", "METHODS:", "Ablation studies", "Something") == ["introduction", "methodology", "results", "body"]


def test_paragraph_joins(spark):
    df = spark.createDataFrame([(1, 0, "This is hyphen-"), (1, 1, "ated text that goes"), (1, 2, "on."), (1, 3, "New one."), (2, 0, "x")], "paper_id long, ord int, line string")
    assert sorted((r.paper_id, r.text) for r in layout.paragraphs(df).collect()) == [(1, "New one."), (1, "This is hyphenated text that goes on."), (2, "x")]


def test_context_windows_stay_in_their_paper(spark):
    df = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "y"), (3, "b", 3, "z")], "chunk_id long, paper_id string, chunk_index long, chunk_text string")
    got = {r.chunk_id: (r.before, r.after, r.context) for r in search.context_windows(df).collect()}
    assert got == {1: ("", "2", "x\n\ny"), 2: ("1", "", "x\n\ny"), 3: ("", "", "z")}


def test_long_papers_are_ordered_in_stretches(spark, monkeypatch):
    """Links and windows across stretches, some of them empty, are those of the whole paper."""
    monkeypatch.setattr(search, "STRETCH", 4)
    rnd = random.Random(4)
    rows = [(i, p, n, f"t{i}") for p in ("a", None, "b") for i, n in ((hash_, hash_ % 1000) for hash_ in rnd.sample(range(1000 * "ab".find(p or "z") + 1000, 1000 * "ab".find(p or "z") + 2000), 30))]
    df = spark.createDataFrame(rows, "chunk_id long, paper_id string, chunk_index long, chunk_text string")
    got = {r.chunk_id: (r.previous_chunk_id, r.next_chunk_id) for r in search.links(df).collect()}
    for p in ("a", None, "b"):
        own = [i for i, q, n, _ in sorted(rows, key=lambda r: r[2]) if q == p]
        for k, i in enumerate(own):
            assert got[i] == (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None)
    wide = {r.chunk_id: r.context for r in search.context_windows(df, radius=2).collect()}
    own = [t_ for _, q, n, t_ in sorted(rows, key=lambda r: r[2]) if q == "a"]
    assert wide[int(own[5][1:])] == "\n\n".join(own[3:8]) and len(wide) == 90


def test_section_filter_comes_after_the_cut(spark):
    docs = [(i, "p", i, "term " * (30 - i) + "x", "methodology" if i == 25 else "body") for i in range(30)]
    chunks = spark.createDataFrame(docs, "chunk_id long, paper_id string, chunk_index long, chunk_text string, label string")
    vectors = spark.createDataFrame([(i, [float(30 - i), 0.0]) for i in range(30)], "chunk_id long, v array<double>")
    q = spark.createDataFrame([(0, "term", [1.0, 0.0])], "query_id long, text string, v array<double>")
    assert search.hybrid(chunks, vectors, q, section="methodology").count() == 0
    assert search.hybrid(chunks, vectors, q).count() == 10


def test_chunker(spark):
    rows = [(1, i, "Word " * 100 + "end.", "") for i in range(12)] + [(2, 0, "short", "")]
    got = chunker.chunk(spark.createDataFrame(rows, "paper_id long, ord long, text string, role string")).orderBy("paper_id", "chunk_index").collect()
    assert [r.paragraph_ids for r in got if r.paper_id == 2] == [[0]]
    ids = [r.paragraph_ids for r in got if r.paper_id == 1]
    assert [i for i in ids[0]] == [0, 1, 2] and all(a[-1] == b[0] for a, b in zip(ids, ids[1:])) and ids[-1][-1] == 11


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab. A", min_size=1, max_size=12), st.sampled_from(["", "list_item"])), min_size=1, max_size=12))
def test_every_paragraph_is_in_a_chunk(rows):
    import pandas as pd

    paper = pd.DataFrame([(1, i, x, r) for i, (x, r) in enumerate(rows)], columns=["paper_id", "ord", "text", "role"])
    assert sorted({i for ids in chunker.fold(paper)["paragraph_ids"] for i in ids}) == list(range(len(rows)))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_folds_against_plain_python(spark):
    rnd = random.Random(2)
    rows = [(g, i, " ".join(rnd.choice(["red", "blue", "green", "black", "white"]) for _ in range(rnd.randint(1, 4)))) for g in range(6) for i in range(9)]
    df = spark.createDataFrame(rows, "group_id long, place int, sentence string")
    clusters = {(r.group_id, r.place): r.cluster for r in report.clusters(df).collect()}
    kept = {(r.group_id, r.place) for r in report.novel(df).collect()}
    for g in range(6):
        anchors, accepted = [], []
        for _, place, s in (r for r in rows if r[0] == g):
            w = set(s.split())
            hit = next((k for k, a in enumerate(anchors) if jaccard(a, w) >= 0.32), None)
            if hit is None:
                anchors.append(w)
                hit = len(anchors) - 1
            assert clusters[g, place] == hit + 1
            new = 1 - max((jaccard(a, w) for a in accepted), default=0.0) >= 0.28
            if new:
                accepted.append(w)
            assert ((g, place) in kept) == new


def test_compress_against_plain_python(spark):
    rnd = random.Random(5)
    rows = [(q, r, 10 * q + r, rnd.random(), " ".join(rnd.choice(["red", "blue", "green", "black"]) for _ in range(5))) for q in range(4) for r in range(1, 9)]
    got = {}
    for x in sorted(answer.compress(spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, score double, chunk_text string")).collect(), key=lambda x: x.place):
        got.setdefault(x.query_id, []).append(x.chunk_id)
    for q in range(4):
        kept = []
        for _, _, c, score, text in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2])):
            w = set(text.split())
            alike = max((jaccard(w, v) for _, v in kept), default=0.0)
            if not kept or (alike <= 0.72 and 0.7 * score - 0.3 * alike >= 0):
                kept.append((c, w))
        assert got.get(q, []) == [c for c, _ in kept][: max(1, 4)]


def test_lexical_rescue_by_parts_of_words(spark):
    """Terms of several words weigh twice; a term may lie within a word or in the section's name."""
    chunks = spark.createDataFrame([(1, "about support", "results"), (2, "Proximal Policy Optimization", "body"), (3, "nothing", "body"), (4, None, "body")], "chunk_id long, chunk_text string, label string")
    queries = spark.createDataFrame([(7, "ppo results")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in rescue.lexical_rescue(chunks, queries).collect()}
    assert got == {(7, 1): round(0.9 + 0.15 * (0.5 + 0.5), 6), (7, 2): round(0.9 + 0.15 * 1.0, 6)}
    find = rescue.matcher(["he", "she", "hers"])
    assert sorted(find("ushers")) == ["he", "hers", "she"]


def test_entity_links_are_all_counted(spark):
    """Against all pairs; a hot entity's chunks are few classes, and no pair of chunks is listed."""
    rnd = random.Random(3)
    rows = [(i, "hot") for i in range(400)] + [(i, f"e{rnd.randint(0, 5)}") for i in range(100)] + [(500, "lone")]
    df = spark.createDataFrame(rows, "chunk_id long, entity string")
    have = {}
    for i, x in rows:
        have.setdefault(i, set()).add(x)
    want = {i: sum(1 for j in have if j != i and have[i] & have[j]) for i in have}
    assert {r.chunk_id: r.links for r in evaluate.entity_links(df).collect()} == want
    members, links = evaluate.entity_groups(df)
    assert links.count() <= 21
    group = {}
    for r in members.collect():
        group.setdefault(r["class"], []).append(r.chunk_id)
    pairs = {(i, j) for m in group.values() for i in m for j in m if i != j and have[i] & have[j]}
    pairs |= {p for r in links.collect() for i in group[r["class"]] for j in group[r.other] for p in ((i, j), (j, i))}
    assert len(pairs) == sum(want.values())


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    items = spark.createDataFrame([("a",), ("b",)], "entry_id string")
    manifest.append(items, path, "seen")
    manifest.append(items.limit(1), path, "done")
    latest = {r.entry_id: r.status for r in manifest.latest(spark.read.parquet(path)).collect()}
    assert latest == {"a": "done", "b": "seen"}


def test_artefacts(spark, tmp_path):
    at = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(json.dumps({"paper_id": "p", "chunks": [{"chunk_id": "c1", "paper_id": "p", "chunk_index": 0, "chunk_text": "x"}]}, indent=2))
    got = artefacts.read_chunks(spark, f"{at}/in")
    assert [(r.chunk_id, r.chunk_text) for r in got.collect()] == [("c1", "x")]
    artefacts.write_chunks(got.drop("file"), f"{at}/out")
    assert spark.read.json(f"{at}/out").select(F.explode("chunks.chunk_id")).collect()[0][0] == "c1"
    artefacts.save_vectors(spark.createDataFrame([(2, [1.0]), (1, [0.5])], "chunk_id long, v array<double>"), f"{at}/v")
    assert artefacts.load_vectors(spark, f"{at}/v").count() == 2 and artefacts.load_vectors(spark, f"{at}/v", "other").count() == 0
    assert artefacts.read_or(spark, f"{at}/none", "a string").count() == 0
    assert artefacts.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_feed_and_pdf(spark, tmp_path):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/2401.00001v2</id><title>A\n title</title><summary>s</summary><updated>2024-01-02T00:00:00Z</updated><published>2024-01-01T00:00:00Z</published><author><name>Ann</name></author><author><name>Bo</name></author><category term="cs.CL"/></entry></feed>'
    row = artefacts.atom_entries(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (row.arxiv_id, row.title, row.authors, row.categories) == ("2401.00001", "A title", ["Ann", "Bo"], ["cs.CL"])
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    good, bad = artefacts.quarantine(artefacts.pdf_pages(spark, f"file://{tmp_path}"))
    assert good.count() == 0 and bad.count() == 1


def test_command_line(sf, tmp_path, spark):
    from marlgrove.__main__ import main

    main(["value_counts", sf, "--out", f"file://{tmp_path}/o"])
    assert spark.read.parquet(f"file://{tmp_path}/o").count() == 4
    main(["build", sf, "--out", f"file://{tmp_path}/b"])
    assert driver.read(spark, f"file://{tmp_path}/b", "chunks").count() > 0
    with pytest.raises(SystemExit):
        main(["build", sf])


def test_answers_are_refined(spark):
    """The second of two equal paragraphs goes, and a caution comes where sources conflict."""
    df = spark.createDataFrame([("A b.\n\na  B.\n\nC.", 0.5), ("A.", 0.0)], "x string, c double")
    got = [r[0] for r in df.select(compose.refined(F.col("x"), F.col("c"))).collect()]
    assert got[0].startswith("A b.\n\nC.\n\nCaution") and got[1] == "A."


def test_revision_against_plain_python(spark):
    texts = ["One two. Three four.\n\nOne  TWO. Five six seven.", "", "Alpha beta.\n\n" + "word " * 20 + "end.\n\nShort one.", "Same. Same.\n\nSame."]

    def sentences(p):
        return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", p)) if s]

    def paragraphs(x):
        return [p.strip() for p in x.split("\n\n") if p.strip()]

    def once(x):
        seen, out = set(), []
        for p in paragraphs(x):
            kept = []
            for s in sentences(p):
                key = re.sub(r"\s+", " ", s.lower())
                if key not in seen:
                    seen.add(key)
                    kept.append(s)
            if kept:
                out.append(" ".join(kept))
        return "\n\n".join(out)

    def joined(x):
        out = []
        for p in paragraphs(x):
            if out and len(p.split()) < writer.SHORT:
                out[-1] += " " + p
            else:
                out.append(p)
        return "\n\n".join(out)

    assert one(spark, writer.without_repeats, *texts) == [once(x) for x in texts]
    assert one(spark, writer.joined_short, *texts) == [joined(x) for x in texts]
    evidence = F.lit("three four five six seven words")
    assert one(spark, lambda c: writer.without_unsupported(c, evidence), "Three four.\n\nWhales swim.") == ["Three four."]


def test_anchors_against_plain_python(spark):
    rnd = random.Random(9)
    words = ["red", "blue", "green", "black", "white", "gold"]
    rows = [(g, i, i % 5 + 1, " ".join(rnd.sample(words, 3)), rnd.choice([0.1, 0.2, 0.3])) for g in range(5) for i in range(12)]
    got = {}
    for r in writer.anchors(spark.createDataFrame(rows, "group_id long, place int, cluster int, sentence string, score double")).collect():
        got.setdefault(r.group_id, []).append((r.place, r.cluster, r.anchor, r.members))
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        made = []
        for k in range(1, 6):
            part = [r for r in own if r[2] == k]
            made.append((-max(r[4] for r in part), -len(part), k, part[0][3]))
        kept = []
        for score, n, k, anchor in sorted(made):
            if all(jaccard(set(anchor.split()), set(a.split())) < 0.55 for _, a, _ in kept):
                kept.append((k, anchor, -n))
        assert sorted(got[g]) == [(i, k, a, n) for i, (k, a, n) in enumerate(kept[:8])]


def test_writer_memory(spark):
    claim = "array<struct<claim:string,mark:string>>"
    rows = [(1, 0, "A", [("c1", "[p §x]"), ("c2", "[q §x]")], ["Term", "Other"], ["weak support"], 0.5, 1.0, 0.4, 0.0, 3), (1, 1, "B", [("c3", "[p §x]"), ("c1", "[p §x]")], ["term"], ["weak support", "sources differ"], 0.7, 0.5, 0.6, 0.1, 2)]
    df = spark.createDataFrame(rows, f"query_id long, place int, title string, claims {claim}, terms array<string>, gaps array<string>, quality double, coverage double, coherence double, gain double, pieces int")
    r = writer.memory(df, claims=2).first()
    assert r.claim_memory == ["c2", "c3"] and r.citation_reuse == {"[p §x]": 3, "[q §x]": 1}
    assert r.terminology == {"term": "Term", "other": "Other"} and r.unresolved_gaps == ["weak support", "sources differ"]
    assert r.section_quality == {0: 0.5, 1: 0.7} and r.section_pieces == {0: 3, 1: 2}


def loop_search(spark, answers):
    """A search whose results are given by the text of the query."""
    rows = [(text, rank, chunk, f"p{chunk}", "body", 1.0 / rank, f"chunk {chunk} {words}") for text, found in answers.items() for rank, (chunk, words) in enumerate(found, 1)]
    table = spark.createDataFrame(rows, "text string, rank int, chunk_id long, paper_id string, label string, score double, chunk_text string")
    return lambda asked: asked.select("query_id", "text").join(table, "text").select("query_id", "rank", "chunk_id", "paper_id", "label", "score", "chunk_text", "text")


def test_retrieval_loop_stops_where_enough_is_covered(spark):
    q = spark.createDataFrame([(3, "Alpha gradient policy", [1.0])], "query_id long, text string, v array<double>")
    forms = q.select(agentic.reformulations(F.col("text"))).first()[0]
    assert forms == ["Alpha gradient policy", "Alpha", "alpha gradient policy"]
    found = {forms[0]: [(1, "none"), (2, "none")], forms[1]: [(3, "policy"), (4, "none")], forms[2]: [(5, "gradient"), (6, "policy")]}
    hits, report = agentic.retrieval_loop(loop_search(spark, found), q)
    assert tuple(report.first()) == (3, 2, 2, 1.0, "covered") and sorted(r.chunk_id for r in hits.collect()) == [5, 6]
    del found[forms[2]]
    found[forms[0]] = [(1, "policy"), (2, "none")]
    hits, report = agentic.retrieval_loop(loop_search(spark, found), q)
    assert tuple(report.first()) == (3, 1, 2, 0.5, "no_more_forms") and sorted(r.chunk_id for r in hits.collect()) == [3, 4]


def test_multi_hop_keeps_the_first_score(spark):
    q = spark.createDataFrame([(3, "Alpha gradient policy", [1.0])], "query_id long, text string, v array<double>")
    found = {"Alpha gradient policy": [(1, "x"), (2, "y")], "Alpha gradient policy Alpha": [(2, "y"), (7, "z")], "Alpha gradient policy alpha": [(8, "w")]}
    got = {r.chunk_id: (r.score, r.from_set) for r in agentic.multi_hop(loop_search(spark, found), q).collect()}
    assert got == {1: (1.0, 0), 2: (0.5, 0), 7: (0.5, 1), 8: (1.0, 2)}


def test_post_processing_judges_again(spark):
    ev = spark.createDataFrame([(1, 1, 10, "p", "body", 0.9, "Policy gradient works. However it fails.", "policy"), (1, 2, 11, "q", "body", 0.8, "Policy gradient is stable.", "policy")], "query_id long, rank int, chunk_id long, paper_id string, label string, score double, chunk_text string, text string")
    out = agentic.post_process(agentic.judged(answer.structured_answers(ev)), ev).first()
    assert out.edges == 1 and out.contradiction == 0.5 and "Caution" in out.answer and "expand_retrieval" in out.actions


def test_driver_takes_up_what_is_new(spark, tmp_path):
    at = f"file://{tmp_path}/build"
    lines = spark.createDataFrame([(p, i, x) for p, text in ((1, "Introduction\nFirst words here.\nx = y + z"), (2, "Other text that goes on."), (3, " \n ")) for i, x in enumerate(text.split("\n"))], "paper_id long, ord int, line string")
    assert driver.run(lines.filter("paper_id = 1"), at) == {"processed": 1, "failed": 0, "skipped": 0}
    assert driver.run(lines, at) == {"processed": 1, "failed": 1, "skipped": 1}
    assert driver.run(lines, at, force=True, mode="skip_repair") == {"processed": 2, "failed": 1, "skipped": 0}
    assert {r.paper_id for r in driver.read(spark, at, "paragraphs").collect()} == {1, 2}
    assert driver.read(spark, at, "equations").count() == 0 and spark.read.parquet(f"{at}/equations").count() == 1
    assert spark.read.json(f"{at}/failures").count() == 2
    with pytest.raises(ValueError):
        driver.artefacts(lines, "other")
    assert set(driver.artefacts(lines, "repair_only")) == {"paragraphs", "sections", "headings", "chunks", "equations", "regions", "excluded"}


def test_plain_pdf_round_trip(spark, tmp_path):
    pages = ["a (b) \\ c\n\nline é", "two"]
    (tmp_path / "x.pdf").write_bytes(artefacts.plain_pdf(pages))
    got = sorted((r.page_no, r.text, r.backend) for r in artefacts.pdf_pages(spark, f"file://{tmp_path}").collect())
    assert got == [(0, pages[0], "plain"), (1, pages[1], "plain")]


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert artefacts.with_retries(call, sleep=waits.append) == 7 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        artefacts.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_cache_computes_what_is_new_once(spark, tmp_path):
    at, met = f"file://{tmp_path}/cache", []

    def compute(rows):
        met.append(sorted(r.key for r in rows.collect()))
        return rows.select("key", F.upper("key").alias("up"))

    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, n long")
    assert artefacts.cached(df.filter("key = 'a'"), "key", at, compute).count() == 2
    assert sorted((r.n, r.up) for r in artefacts.cached(df, "key", at, compute).collect()) == [(1, "A"), (2, "B"), (3, "A")]
    assert met == [["a"], ["b"]]


def test_engine(spark):
    """All modes, a section, contexts, answers and reports on a small corpus."""
    from marlgrove.api import Engine

    rows = [(i, "ab"[i % 2], i, f"Policy gradient {i} improves the reward of agents in every run. Word{i} word{i} is stable.", ("results", "methodology")[i % 2]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id long, paper_id string, chunk_index long, chunk_text string, label string")
    vectors = spark.createDataFrame([(i, [1.0, i / 12]) for i in range(12)], "chunk_id long, v array<double>")
    q = spark.createDataFrame([(1, "policy gradient word3", [1.0, 0.0])], "query_id long, text string, v array<double>")
    engine = Engine(chunks, vectors)
    for mode in ("hybrid", "dense", "sparse"):
        hits = engine.search(q, 5, mode, context=True).collect()
        assert len(hits) == 5 and all(h.chunk_text in h.context for h in hits)
    assert {h.label for h in engine.search(q, section="results").collect()} == {"results"}
    assert engine.search(q, 1, "sparse").first().chunk_id == 3
    with pytest.raises(ValueError):
        engine.search(q, mode="other")
    for agentic_ in (False, True):
        got = engine.answer(q, agentic_).collect()
        assert len(got) == 1 and got[0].citations >= 1 and 0 <= got[0].confidence <= 1
    assert {r.chunk_id for r in engine.multi_hop(q).collect()} <= set(range(12))
    report = engine.report(q, passes=1).first()
    assert report.sections == len(writer.r.OUTLINES["technical-summary"]) and "## " in report.markdown
