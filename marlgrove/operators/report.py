"""Reports: outlines, evidence sentences, clusters, novelty, measures of drafts.

The wording of outlines is this library's own. Folds run over a section's few sentences, inside one row's
array or one small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Sections of each kind of report.
OUTLINES = {
    "technical-summary": ("Scope", "How it works", "What was measured", "Limits", "Outlook"),
    "comparison": ("What is compared", "Side by side", "Where they differ", "When to use which"),
    "literature-review": ("Field and questions", "Lines of work", "Where results agree", "Open questions"),
}
KIND_OF = {"comparison": "comparison", "literature_review": "literature-review"}


def outline(kind: Column) -> Column:
    """Titles of the report's sections."""
    listed = F.create_map(*[x for k, v in OUTLINES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.element_at(listed, kind)


def report_kind(intent: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    return F.coalesce(F.element_at(names, intent), F.lit("technical-summary"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), t.strip), lambda x: x != "")


def is_evidence(s: Column) -> Column:
    """Sentences that say something: long enough, no formula, figure or table, few digits."""
    return (F.length(s) >= 40) & (t.count(s, "=") < 2) & ~s.rlike(r"[{}]") & ~s.rlike(r"(?i)\b(figure|table)\s+\d") & ~s.rlike(r"\(\d+\)\s*$") & (t.count(s, r"\p{Nd}") <= F.greatest(F.floor(F.length(s) / 5), F.lit(12))) & (t.count(s, "  ") <= 2)


def evidence_sentences(chunks: DataFrame, most: int = 4) -> DataFrame:
    """chunk_id, place, sentence: the first few of each chunk."""
    good = F.slice(F.filter(sentences(F.col("chunk_text")), is_evidence), 1, most)
    return chunks.select("chunk_id", F.posexplode(good).alias("place", "sentence"))


def word_set(c: Column) -> Column:
    return F.array_distinct(t.found(F.lower(c), "[a-z]{3,}"))


def clusters(items: DataFrame, least: float = 0.32) -> DataFrame:
    """group_id, place, cluster: each sentence joins the first cluster whose anchor is like it, in order of place."""
    listed = items.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", word_set(F.col("sentence")).alias("w")))).alias("rows"))
    kinds = "struct<anchors:array<array<string>>,of:array<int>>"
    start = F.struct(F.array().cast("array<array<string>>").alias("anchors"), F.array().cast("array<int>").alias("of")).cast(kinds)

    def step(s, r):
        hit = F.array_position(F.transform(s["anchors"], lambda a: t.jaccard(a, r["w"]) >= least), True).cast("int")
        return F.when(hit > 0, F.struct(s["anchors"].alias("anchors"), F.concat(s["of"], F.array(hit)).alias("of"))).otherwise(F.struct(F.concat(s["anchors"], F.array(r["w"])).alias("anchors"), F.concat(s["of"], F.array(F.size(s["anchors"]) + 1)).alias("of"))).cast(kinds)

    of = F.aggregate("rows", start, step)["of"]
    return listed.select("group_id", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["place"]).alias("place"), of.alias("cluster"))).alias("z")).select("group_id", "z.place", "z.cluster")


def novel(items: DataFrame, least: float = 0.28) -> DataFrame:
    """group_id, place of the sentences that differ enough from all those accepted before."""
    listed = items.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", word_set(F.col("sentence")).alias("w")))).alias("rows"))
    kind = "array<struct<place:int,w:array<string>>>"

    def step(kept, r):
        alike = F.aggregate(kept, F.lit(0.0), lambda m, k: F.greatest(m, t.jaccard(k["w"], r["w"])))
        return F.when(1 - alike < least, kept).otherwise(F.concat(kept, F.array(F.struct(r["place"].cast("int").alias("place"), r["w"].alias("w"))))).cast(kind)

    kept = F.aggregate("rows", F.array().cast(kind), step)
    return listed.select("group_id", F.explode(F.transform(kept, lambda k: k["place"])).alias("place"))


def repetition(c: Column, n: int = 4) -> dict[str, Column]:
    """repeated: n-grams beyond their first place; diversity: distinct over all words."""
    words = F.transform(t.found(c, t.WORD), F.lower)
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))).otherwise(F.array().cast("array<string>"))
    return {"repeated": t.let(words, lambda w: t.let(grams(w), lambda g: F.size(g) - F.size(F.array_distinct(g)))), "diversity": t.let(words, lambda w: t.rounded(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)), 6))}


def readability(c: Column) -> Column:
    per = t.count(c, t.WORD) / F.greatest(t.count(c, r"[.!?]+"), F.lit(1))
    return F.when(per <= 10, 0.55).when(per <= 24, 0.9).when(per <= 34, 0.75).otherwise(0.6)


def citation_numbers(cites: DataFrame) -> DataFrame:
    """report_id, paper_id, number: papers numbered as they are first cited (report_id, place, paper_id)."""
    first = cites.groupBy("report_id", "paper_id").agg(F.min("place").alias("first"))
    return first.select("report_id", "paper_id", F.row_number().over(Window.partitionBy("report_id").orderBy("first", "paper_id")).alias("number"))


def coherence(grounding: Column, diversity: Column, redundancy: Column, overlap: Column) -> Column:
    return t.rounded(grounding * 0.45 + diversity * 0.25 + (1 - redundancy) * 0.15 + (1 - overlap) * 0.15, 6)


def draft(evidence: DataFrame) -> DataFrame:
    """report_id, markdown: the novel sentences of each report in order, with their papers' numbers. evidence: report_id, place, paper_id, sentence."""
    numbers = citation_numbers(evidence)
    lines = evidence.join(numbers, ["report_id", "paper_id"]).groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence", "number"))).alias("ls"), F.array_sort(F.collect_set(F.struct("number", "paper_id"))).alias("refs"))
    body = F.array_join(F.transform("ls", lambda x: F.concat(x["sentence"], F.lit(" ["), x["number"], F.lit("]"))), "\n\n")
    refs = F.array_join(F.transform("refs", lambda x: F.concat(F.lit("["), x["number"], F.lit("] "), x["paper_id"])), "\n")
    return lines.select("report_id", F.concat(F.lit("## Evidence\n\n"), body, F.lit("\n\n## References\n\n"), refs, F.lit("\n")).alias("markdown"))
