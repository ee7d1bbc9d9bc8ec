"""Sections of reports: plans, evidence, claims, drafts, revision and what a report remembers.

All reports and sections of a batch go through each stage together. What depends on the sections before (claims that
were made, terms that were named) is a fold over a report's few sections, inside one row's arrays. The wording is this
library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.scratch import written
from . import answer as a
from . import report as r
from .agentic import Search

#: Kinds of sections by words of their titles, the first that applies; a comparing intent makes any other section a comparison.
SECTION_KINDS = (("introduction", ("introduction", "background", "overview", "scope", "questions")), ("methods", ("method", "approach", "algorithm", "how it works")), ("comparison", ("comparison", "versus", "side by side", "differ")), ("limitations", ("limitation", "open", "risk", "limits")), ("conclusion", ("conclusion", "future", "outlook", "when to use")))
#: What the paragraphs of each kind are for.
ROLES = {
    "introduction": ("frame", "motivate", "set the question"),
    "methods": ("ground", "walk through", "explain why"),
    "comparison": ("common ground", "differences", "trade-offs"),
    "limitations": ("bounds", "doubts", "cautions"),
    "conclusion": ("sum up", "take away", "look ahead"),
    "analysis": ("claim", "evidence", "reading"),
}
# What marks a formula, and words that mark a table.
FORMULA = r"(?i)(?:[A-Za-z_]+\([^)]*\)|[A-Za-z][A-Za-z0-9_]*\s*=\s*[^.]{4,}|\\[a-zA-Z]+|theta|lambda|kl)"
TABLE = r"(?i)\b(?:table|row|column|header|metric|dataset)\b"
DIGITS = 0.22
#: What stands for a formula or a table in prose.
SAID_FORMULA, SAID_OBJECTIVE = "The source states this as a formula.", "The source states an objective that is optimised."
SAID_TABLE, SAID_RESULTS = "The source lists this in a table.", "The source compares results in a table."
#: Openings that a paraphrase replaces, in order.
LEADS = (("in this paper", "this study"), ("in this work", "this study"), ("we propose", "its authors propose"), ("we present", "its authors present"), ("our method", "the method"), ("results show that", "reported results indicate that"))
MILD = ((r"\bcan be seen\b", "is seen"), (r"\bshows?\b", "indicates"), (r"\bvery\b", ""))
#: Notes that revision adds.
UNSURE = "Note: the sources do not agree on all of this."
GAPS = "Note: the sources cover this only in part."
#: A paragraph of fewer words joins the one before it; as much of a section's terms must be found.
SHORT, COVERED, GROUNDED = 18, 0.6, 0.5


def section_kind(title: Column, intent: Column) -> Column:
    low, out = F.lower(title), None
    for name, marks in SECTION_KINDS:
        test = a.any_of(low, marks) | (intent == "comparison") if name == "comparison" else a.any_of(low, marks)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("analysis")


def roles(kind: Column) -> Column:
    listed = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.element_at(listed, kind)


def artefact(sentence: Column) -> Column:
    """formula, table or broken, or null for prose."""
    s = t.strip(F.regexp_replace(sentence, r"\s+", " "))
    dense = t.count(s, r"\d") / F.greatest(F.length(s), F.lit(1)) > DIGITS
    return F.when(s == "", "broken").when(s.rlike(FORMULA), "formula").when(s.rlike(TABLE) | dense, "table").when((t.count(s, r"\|") >= 2) | (t.count(s, r"\.\.\.") >= 2), "broken")


def normalised(sentence: Column) -> Column:
    """The sentence in prose: formulas and tables by what they are, nothing for broken pieces."""
    s, kind = t.strip(F.regexp_replace(sentence, r"\s+", " ")), artefact(sentence)
    low = F.lower(s)
    formula = F.when(a.any_of(low, ("loss", "objective", "optimiz")), SAID_OBJECTIVE).otherwise(SAID_FORMULA)
    table = F.when(a.any_of(low, ("benchmark", "dataset", "accuracy", "reward", "score")), SAID_RESULTS).otherwise(SAID_TABLE)
    return F.when(kind == "formula", formula).when(kind == "table", table).when(kind == "broken", "").otherwise(s)


def paraphrased(sentence: Column) -> Column:
    """Without citations, with plainer openings and verbs, and a full stop."""
    out = F.regexp_replace(sentence, r"\[[^\]]+\]", "")
    out = F.regexp_replace(out, r"\(\s*[A-Z][A-Za-z]+(?:\s+et al\.)?,?\s*\d{4}[a-z]?\s*\)", "")
    for old, new in (*((f"(?i){x}", y) for x, y in LEADS), *((f"(?i){x}", y) for x, y in MILD)):
        out = F.regexp_replace(out, old, new)
    out = F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" ,;"))
    return F.when((out == "") | out.rlike(r"[.!?]$"), out).otherwise(F.concat(out, F.lit(".")))


def plans(queries: DataFrame) -> DataFrame:
    """query_id, place, title, kind, section_query, terms, text, v of each section of each query's report (query_id, text, v)."""
    q = F.col("text")
    listed = queries.select("query_id", "text", "v", F.posexplode(r.outline(r.report_kind(a.intent(q)))).alias("place", "title"))
    return listed.withColumns({"kind": section_kind(F.col("title"), a.intent(q)), "section_query": F.concat("title", F.lit(" "), q), "terms": F.slice(F.array_distinct(F.concat(a.entities(q), a.topics(q))), 1, 6)})


def section_evidence(search: Search, sections: DataFrame, most: int = 8) -> DataFrame:
    """The best chunks of each section: by its query, and by its title before each of the first sub-queries of the topic; a chunk keeps its best score.

    Adds coverage (the share of the section's terms that its first six chunks hold) and conflict (pairs of these from two papers, one marking a contrast, a chunk)."""
    forms = F.array_distinct(F.concat(F.array("section_query"), F.transform(F.slice(a.sub_queries(F.col("text")), 1, 3), lambda x: F.concat("title", F.lit(" "), x))))
    key = F.col("query_id") * 10 + F.col("place")
    asked = sections.select(key.alias("section"), "v", F.posexplode(forms).alias("form", "text"))
    hits = search(asked.select((F.col("section") * 10 + F.col("form")).alias("query_id"), "text", "v")).withColumn("section", F.floor(F.col("query_id") / 10).cast("long"))
    best = hits.groupBy("section", "chunk_id").agg(F.max("score").alias("score"), F.first("paper_id").alias("paper_id"), F.first("label").alias("label"), F.first("chunk_text").alias("chunk_text"))
    order = Window.partitionBy("section").orderBy(F.desc("score"), "chunk_id")
    top = best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= most)
    listed = top.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "paper_id", "label", "score", "chunk_text"))).alias("hits"))
    six = F.transform(F.slice("hits", 1, 6), lambda h: F.struct(h["paper_id"].alias("paper"), F.lower(F.concat(h["label"], F.lit(" "), h["chunk_text"])).alias("body"), a.any_of(F.lower(h["chunk_text"]), a.CONTRAST).alias("contrast")))
    met = sections.withColumn("section", key).join(listed, "section").withColumn("six", six)
    covered = F.size(F.filter("terms", lambda x: F.exists("six", lambda h: F.contains(h["body"], F.lower(x))))) / F.greatest(F.size("terms"), F.lit(1))
    pairs = F.aggregate(F.transform("six", lambda h, i: F.size(F.filter("six", lambda g, j: (j > i) & (g["paper"] != h["paper"]) & (g["contrast"] | h["contrast"])))), F.lit(0), lambda s, n: s + n)
    return met.withColumns({"coverage": t.rounded(F.when(F.size("terms") > 0, covered).otherwise(0.0), 6), "conflict": t.rounded(F.least(pairs / F.greatest(F.size("six"), F.lit(1)), F.lit(1.0)), 6)}).drop("six")


def anchors(clusters: DataFrame, most: int = 8, alike: float = 0.55) -> DataFrame:
    """group_id, cluster, anchor, members of the clusters whose anchor isn't too like a kept one, best first.

    clusters: group_id, place, cluster, sentence, score. Clusters go by their best score, then by size, then by number."""
    one = clusters.groupBy("group_id", "cluster").agg(F.min_by("sentence", "place").alias("anchor"), F.max("score").alias("score"), F.count("*").alias("members"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), (-F.col("members")).alias("size"), "cluster", "anchor", r.word_set(F.col("anchor")).alias("w"))))
    listed = one.groupBy("group_id").agg(rows.alias("rows"))
    kind = "array<struct<cluster:int,anchor:string,members:bigint,w:array<string>>>"

    def step(kept, x):
        near = F.exists(kept, lambda k: t.jaccard(k["w"], x["w"]) >= alike)
        own = F.struct(x["cluster"].cast("int").alias("cluster"), x["anchor"].alias("anchor"), (-x["size"]).alias("members"), x["w"].alias("w"))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(own))).cast(kind)

    kept = F.slice(F.aggregate("rows", F.array().cast(kind), step), 1, most)
    return listed.select("group_id", F.posexplode(kept).alias("place", "k")).select("group_id", "place", "k.cluster", "k.anchor", "k.members")


def drafts(evidence: DataFrame) -> DataFrame:
    """Each section's claims with citations as paragraphs, its evidence, citations, pieces, and the gaps that are left.

    Claims are the anchors of clusters of its evidence sentences, normalised and paraphrased, without those that an earlier
    section of the report made."""
    evidence = written(evidence)  # read for sentences and for sections
    hits = evidence.select("section", F.explode("hits").alias("h")).select("section", "h.*")
    found = r.evidence_sentences(hits.select(F.struct("section", "rank", "chunk_id", "paper_id", "label", "score").alias("chunk_id"), "chunk_text"))
    lines = written(found.select(F.col("chunk_id.section").alias("group_id"), (F.col("chunk_id.rank") * 10 + F.col("place")).alias("place"), "sentence", F.col("chunk_id.score").alias("score"), a.citation_label(F.col("chunk_id.paper_id"), F.col("chunk_id.label")).alias("mark")))
    grouped = written(r.clusters(lines.select("group_id", "place", "sentence")).join(lines, ["group_id", "place"]))
    marks = grouped.groupBy("group_id", "cluster").agg(F.min_by("mark", "place").alias("mark"))
    said = paraphrased(normalised(F.col("anchor")))
    claims = anchors(grouped).join(marks, ["group_id", "cluster"]).withColumn("claim", said).filter("claim <> ''")
    listed = claims.groupBy(F.col("group_id").alias("section")).agg(F.array_sort(F.collect_list(F.struct("place", "claim", "mark"))).alias("claims"))
    rows = evidence.join(listed, "section", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<struct<place:int,claim:string,mark:string>>")))
    earlier = F.flatten(F.collect_list(F.transform("claims", lambda c: F.lower(c["claim"]))).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("earlier", F.coalesce(earlier, F.array().cast("array<string>"))).withColumn("claims", F.filter("claims", lambda c: ~F.array_contains("earlier", F.lower(c["claim"]))))
    content = F.array_join(F.transform("claims", lambda c: F.concat(c["claim"], F.lit(" "), c["mark"])), "\n\n")
    quotes = F.array_join(F.transform("hits", lambda h: F.substring(h["chunk_text"], 1, 900)), "\n")
    out = rows.select("query_id", "place", "title", "kind", "terms", "coverage", "conflict", "claims", content.alias("answer"), quotes.alias("evidence"), F.size(F.array_distinct(F.transform("claims", lambda c: c["mark"]))).cast("long").alias("citations"), F.size("hits").cast("long").alias("pieces"))
    scored = a.with_grounding(out)
    gaps = F.array_compact(F.array(F.when(F.col("coverage") < COVERED, "partial coverage"), F.when(F.col("unsupported_ratio") > 1 - GROUNDED, "weak support"), F.when(F.col("conflict") > 0, "sources differ")))
    return scored.withColumns({"gaps": gaps, "quality": a.answer_quality(F.col("answer"), F.col("citations"), F.col("score"), F.col("unsupported_ratio"))["overall"]})


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), t.strip), lambda x: x != "")


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", " "))


def without_repeats(content: Column) -> Column:
    """Sentences once each over all paragraphs, the first place counts."""
    marked = F.flatten(F.transform(paragraphs(content), lambda p, i: F.transform(a.claims(p), lambda s: F.struct(i.alias("i"), s.alias("s"), _plain(s).alias("key")))))

    def body(all_: Column) -> Column:
        keys = F.transform(all_, lambda x: x["key"])
        kept = F.filter(all_, lambda x, k: F.array_position(keys, x["key"]) == k + 1)
        return t.let(kept, _by_paragraph)

    return t.let(marked, body)


def _by_paragraph(kept: Column) -> Column:
    places = F.array_distinct(F.transform(kept, lambda x: x["i"]))
    return F.array_join(F.transform(places, lambda i: F.array_join(F.transform(F.filter(kept, lambda x: x["i"] == i), lambda x: x["s"]), " ")), "\n\n")


def without_unsupported(content: Column, evidence: Column) -> Column:
    """The content without the sentences that the evidence doesn't support."""
    marked = F.flatten(F.transform(paragraphs(content), lambda p, i: F.transform(a.claims(p), lambda s: F.struct(i.alias("i"), s.alias("s")))))
    return t.let(F.lower(evidence), lambda e: t.let(F.filter(marked, lambda x: a.supported(x["s"], e)), _by_paragraph))


def joined_short(content: Column, short: int = SHORT) -> Column:
    """Paragraphs of few words join the one before."""

    def step(done: Column, p: Column) -> Column:
        few = (F.size(done) > 0) & (t.count(p, r"\S+") < short)
        last = F.element_at(done, -1)
        return F.when(few, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), p)))).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(paragraphs(content), F.array().cast("array<string>"), step), "\n\n")


def revise(drafted: DataFrame, passes: int = 2) -> DataFrame:
    """Drafts after each pass of revision: without repeats and unsupported sentences, with notes of conflicts and gaps, short
    paragraphs joined, judged anew; gain is that of the last pass, coherence that of the result."""
    rows = drafted.withColumn("quality_before", F.col("quality"))
    for _ in range(passes):
        text = without_unsupported(without_repeats(F.col("answer")), F.col("evidence"))
        note = lambda c, test, words: F.when(test & ~F.contains(c, F.lit(words)), F.concat(c, F.lit("\n\n"), F.lit(words))).otherwise(c)
        noted = rows.withColumn("answer", text).withColumn("answer", note(F.col("answer"), F.col("conflict") > 0, UNSURE)).withColumn("answer", note(F.col("answer"), F.col("coverage") < COVERED, GAPS))
        noted = noted.withColumn("answer", t.strip(joined_short(F.col("answer")))).withColumn("quality_before", F.col("quality")).drop("n_claims", "unsupported_ratio", "score")
        scored = a.with_grounding(noted.drop("coverage_").withColumnRenamed("coverage", "found"))
        rows = scored.drop("coverage").withColumnRenamed("found", "coverage").withColumn("quality", a.answer_quality(F.col("answer"), F.col("citations"), F.col("score"), F.col("unsupported_ratio"))["overall"])
    words = t.found(F.lower("answer"), r"[a-z][a-z0-9\-]{3,}")
    before = F.flatten(F.collect_list(words).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.array_distinct(words)
    overlap = F.size(F.array_intersect(own, F.coalesce(before, F.array().cast("array<string>")))) / F.greatest(F.size(own), F.lit(1))
    rows = rows.withColumn("overlap", t.rounded(overlap, 6)).withColumn("diversity", r.repetition(F.col("answer"))["diversity"])
    redundancy = a.answer_quality(F.col("answer"), F.col("citations"), F.col("score"), F.col("unsupported_ratio"))["redundancy"]
    return rows.withColumns({"redundancy": redundancy, "gain": t.rounded(F.col("quality") - F.col("quality_before"), 6)}).withColumn("coherence", r.coherence(F.col("score"), F.col("diversity"), F.col("redundancy"), F.col("overlap")))


def memory(revised: DataFrame, claims: int = 40) -> DataFrame:
    """Of each report: its latest claims once each, how often each source is cited, its terms as first written, its gaps, and maps of measures by section."""
    rows = revised.withColumn("s", F.struct("place", "title", "claims", "terms", "gaps", "quality", "coverage", "coherence", "gain", "pieces"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    all_ = F.array_distinct(F.flatten(F.transform("s", lambda x: F.transform(x["claims"], lambda c: c["claim"]))))
    latest = F.when(F.size(all_) > claims, F.slice(all_, -claims, claims)).otherwise(all_)
    marks = F.flatten(F.transform("s", lambda x: F.transform(x["claims"], lambda c: c["mark"])))
    reuse = t.let(marks, lambda m: F.map_from_entries(F.transform(F.array_distinct(m), lambda k: F.struct(k, F.size(F.filter(m, lambda y: y == k))))))
    terms = F.flatten(F.transform("s", lambda x: x["terms"]))
    lower = F.transform(terms, F.lower)
    first = F.map_from_entries(F.transform(F.array_distinct(lower), lambda k: F.struct(k, F.element_at(terms, F.array_position(lower, k).cast("int")))))
    by = lambda name: F.map_from_entries(F.transform("s", lambda x: F.struct(x["place"], x[name])))
    return listed.select("query_id", latest.alias("claim_memory"), reuse.alias("citation_reuse"), first.alias("terminology"), F.array_distinct(F.flatten(F.transform("s", lambda x: x["gaps"]))).alias("unresolved_gaps"), *[by(k).alias(f"section_{k}") for k in ("quality", "coverage", "coherence", "gain", "pieces")])


def assembled(revised: DataFrame) -> DataFrame:
    """report_id, title, abstract, markdown, sections: the sections in order, an abstract of their beginnings, and what is left open."""
    listed = revised.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", "answer", "gaps"))).alias("s"))
    starts = F.transform(F.slice("s", 1, 3), lambda x: F.substring(F.coalesce(F.element_at(paragraphs(x["answer"]), 1), F.lit("")), 1, 280))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["answer"])), "\n\n")
    gaps = F.array_join(F.array_distinct(F.flatten(F.transform("s", lambda x: x["gaps"]))), "; ")
    summary = t.strip(F.substring(F.array_join(F.filter(starts, lambda x: x != ""), " "), 1, 650))
    return listed.select(F.col("query_id").alias("report_id"), summary.alias("abstract"), F.concat(body, F.lit("\n\n## Open\n\n"), gaps, F.lit("\n")).alias("markdown"), F.size("s").alias("sections"))
