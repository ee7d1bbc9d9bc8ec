"""What stands between results and reports: eligibility, probes, plans, cited answers, reflection, traces, section plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import answer as a


def embedding_eligible(include_flagged: bool = False, filter_noise: bool = True) -> Column:
    """Over retrieval_quality_score, flagged_for_review, retrieval_excluded, noise_score."""
    out = F.col("retrieval_quality_score") >= 0.55
    if not include_flagged:
        out = out & ~F.col("flagged_for_review")
    return out & ~F.col("retrieval_excluded") & (F.col("noise_score") <= 0.60) if filter_noise else out


def flag_for_review(retrieval: Column, noise: Column, integrity: Column, anomaly: Column) -> Column:
    return (retrieval < 0.52) | (noise > 0.28) | (integrity < 0.62) | (anomaly > 0.4)


def structure(text: Column) -> dict[str, Column]:
    """coherence, noise and integrity of a chunk that nothing was repaired in."""
    length = t.token_estimate(text) / F.greatest(F.lit(1), t.count(text, r"[.!?]"))
    coherence = t.unit(1 - F.abs(length - 24) / 32, 4)
    noise = t.unit(t.count(text, r"[^\p{L}\p{N}_\s.,;:()\-]") / F.greatest(F.length(text), F.lit(1)) * 4, 4)
    return {"coherence": coherence, "noise": noise, "integrity": t.unit(F.lit(0.45) + (1 - noise) * 0.3 + coherence * 0.25, 4)}


def strong_boundary(before: Column, now: Column) -> Column:
    return before.rlike(r"[.!?]$") & now.rlike(r"^\p{Lu}")


def transitions(parts: DataFrame) -> DataFrame:
    """group_id, paragraphs, transition_quality, boundary, continuity from (group_id, place, text); one part alone scores .92, .9, .94."""
    w = Window.partitionBy("group_id").orderBy("place")
    before = F.lag("text").over(w)
    marked = parts.withColumns({"strong": strong_boundary(before, F.col("text")), "goes_on": before.rlike(r"[^.!?:;]$") & F.col("text").rlike(r"^\p{Ll}")})
    sums = marked.groupBy("group_id").agg(F.count("*").alias("paragraphs"), F.avg(F.col("strong").cast("int")).alias("b"), F.avg(F.col("goes_on").cast("int")).alias("c"))
    alone = F.col("paragraphs") <= 1
    score = lambda x, single: F.when(alone, single).otherwise(t.rounded(F.least(F.lit(1.0), x), 4))
    return sums.select("group_id", "paragraphs", score(F.col("b") * 0.35 + 0.55, 0.92).alias("transition_quality"), score(F.col("b") * 0.4 + 0.45, 0.9).alias("boundary"), score(F.col("c") * 0.35 + 0.5 + 0.1, 0.94).alias("continuity"))


def anomaly(noise: Column, integrity: Column, transition: Column, continuity: Column) -> Column:
    zero = F.lit(0.0)
    return t.unit(noise * 0.45 + (1 - integrity) * 0.25 + F.greatest(zero, 0.7 - transition) * 0.2 + F.greatest(zero, 0.7 - continuity) * 0.1, 4)


def front_matter(lines: DataFrame, first: int = 25) -> DataFrame:
    """paper_id, emails, links of the first lines of each paper, sorted."""
    head = lines.filter(F.col("ord") < first)
    found = head.select("paper_id", t.found(F.col("line"), t.ARTEFACTS[2][1]).alias("e"), t.found(F.col("line"), r"https?://[^\s]+").alias("l"))
    sorted_ = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), "|")
    return found.groupBy("paper_id").agg(sorted_("e").alias("emails"), sorted_("l").alias("links"))


def probes(chunks: DataFrame, topics: DataFrame, least: float = 0.65) -> DataFrame:
    """probe_id, query, chunk_id: a known-item query of each good chunk from its label and first four topics.

    chunks: chunk_id, label, retrieval_quality_score; topics: chunk_id, topics."""
    text = F.btrim(F.concat(F.col("label"), F.lit(" "), F.array_join(F.slice("topics", 1, 4), " ")))
    good = chunks.filter(F.col("retrieval_quality_score") >= least).join(topics, "chunk_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return good.select(F.substring(F.sha2(F.concat("chunk_id", F.lit(":"), text), 256), 1, 16).alias("probe_id"), text.alias("query"), "chunk_id")


#: Retrieval strategies of the subtasks of each kind of intent.
PLANS = {"comparison": ("hybrid_comparison", "hybrid_comparison", "cross_paper_comparison"), "broad": ("broad_synthesis", "cross_paper_validation"), "direct": ("direct_lookup", "supporting_context")}
BROAD = ("contradiction_analysis", "timeline_history", "literature_review")


def plan(intent: Column) -> Column:
    lists = {k: F.array(*[F.lit(x) for x in v]) for k, v in PLANS.items()}
    return F.when(intent == "comparison", lists["comparison"]).when(intent.isin(*BROAD), lists["broad"]).otherwise(lists["direct"])


def generated(context: Column, max_tokens: int = 160) -> Column:
    """The first twelve lines of the context that aren't blank, joined and cut."""
    return F.substring(F.array_join(F.slice(t.lines(context), 1, 12), " "), 1, max_tokens * 6)


def cited(text: Column, labels: Column) -> Column:
    """Each sentence with the label of its place; the last label serves the rest."""
    listed = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), t.strip), lambda x: x != "")
    mark = lambda s, i: t.let(F.element_at(labels, F.least(i + 1, F.size(labels))), lambda m: F.when(F.contains(s, m), s).otherwise(F.concat(s, F.lit(" "), m)))
    return F.when((F.size(labels) == 0) | (text == ""), text).otherwise(F.array_join(F.transform(listed, mark), " "))


def reflection(unsupported: Column, pieces: Column, contradiction: Column) -> Column:
    """What to do about an answer, in order."""
    steps = (("retry_retrieval", unsupported > 0), ("expand_retrieval", pieces < 3), ("inspect_contradictions", contradiction > 0.1))
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in steps]))


#: What a refined answer ends with where its sources conflict.
CAUTION = "Caution: the sources do not all agree on this."


def refined(text: Column, contradiction: Column) -> Column:
    """Paragraphs once each, in order, with a caution if the evidence conflicts."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), t.strip), lambda x: x != "")
    keep = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda q: F.lower(F.regexp_replace(q, r"\s+", " ")) == F.lower(F.regexp_replace(p, r"\s+", " "))))
    caution = F.when(contradiction > 0, F.array(F.lit(CAUTION))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(t.let(parts, keep), caution), "\n\n")


def trace(answers: DataFrame) -> DataFrame:
    """Observability columns of answers with score, unsupported_ratio, hallucination, used, offered."""
    use = t.share(F.col("used"), F.col("offered"))
    return answers.select("query_id", t.rounded(F.greatest(F.lit(0.0), 1 - F.col("score")), 6).alias("retrieval_drift"), t.rounded(use, 6).alias("chunk_utilization"), t.rounded(1 - use, 6).alias("context_waste"), F.col("hallucination").alias("hotspot"), F.col("unsupported_ratio").alias("unsupported_frequency"))


def writing_plan(outlines: DataFrame, most: int = 10) -> DataFrame:
    """report_id, place, title, depends_on, sufficiency of each section in order (report_id, titles)."""
    rows = outlines.select("report_id", F.posexplode(F.slice("titles", 1, most)).alias("place", "title"))
    low = F.lower("title")
    enough = F.when(low.contains("introduction") | low.contains("overview"), 0.55).when(low.contains("comparison") | low.contains("analysis"), 0.72).when(low.contains("limitations") | low.contains("open"), 0.62).otherwise(0.66)
    return rows.withColumn("depends_on", F.lag("place").over(Window.partitionBy("report_id").orderBy("place"))).withColumn("sufficiency", enough)


def sentence_citations(sentences: DataFrame, results: DataFrame, most: int = 2) -> DataFrame:
    """group_id, place, chunk_id, weight: each sentence's best results by shared words and a tenth of their score."""
    words = lambda c: F.array_distinct(t.found(F.lower(c), r"[a-z][a-z0-9\-]{2,}"))
    met = sentences.select("group_id", "place", words("sentence").alias("w")).join(results.select("group_id", "chunk_id", "score", words("chunk_text").alias("c")), "group_id")
    weight = F.size(F.array_intersect("w", "c")) / F.greatest(F.size("w"), F.lit(1)) + F.col("score") * 0.1
    order = Window.partitionBy("group_id", "place").orderBy(F.desc("weight"), "chunk_id")
    return met.withColumn("weight", t.rounded(weight, 6)).filter("weight > 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("group_id", "place", "chunk_id", "weight")


def abstract(summaries: Column, most: int = 650) -> Column:
    return t.strip(F.substring(F.array_join(F.slice(F.filter(summaries, lambda s: s != ""), 1, 3), " "), 1, most))


def least_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The n rows of least order of each group; cut before and after the shuffle, so a large group is no large task."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__r") <= n).drop("__r")


def column_spread(blocks: DataFrame, most: float = 120.0) -> DataFrame:
    """paper_id, page_no, multi_column of pages by the spread of their blocks' left edges (paper_id, page_no, x0)."""
    return blocks.groupBy("paper_id", "page_no").agg(((F.count("*") >= 2) & (F.max("x0") - F.min("x0") > most)).alias("multi_column"))


def review_sample(chunks: DataFrame, n: int, least: float = 0.0, seed: int = 7) -> DataFrame:
    """n chunks of at least that quality, in an order that a hash gives."""
    return chunks.filter(F.col("retrieval_quality_score") >= least).orderBy(F.sha2(F.concat("chunk_id", F.lit(f"-{seed}")), 256), "chunk_id").limit(n)
