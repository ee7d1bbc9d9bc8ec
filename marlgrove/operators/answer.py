"""Query understanding, routing, grounding and answer scores, all as expressions over batches of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Intents by the strings that mark them, first match wins; otherwise definition.
INTENTS = (
    ("comparison", ("compare", "difference", "versus", "vs", "better than")),
    ("definition", ("what is", "define", "meaning of")),
    ("summarization", ("summarize", "summary", "overview of")),
    ("contradiction_analysis", ("contradiction", "conflict", "disagree", "inconsistent")),
    ("methodology_explanation", ("how does", "method", "approach", "algorithm")),
    ("benchmark_performance", ("benchmark", "performance", "result", "accuracy", "pass@")),
    ("citation_lookup", ("cite", "citation", "who said")),
    ("literature_review", ("literature review", "survey", "recent work", "papers on")),
    ("timeline_history", ("timeline", "history", "evolution", "chronology")),
)
# Acronyms, where they are anywhere in the query, and what they stand for.
ACRONYMS = {
    "grpo": ("Group Relative Policy Optimization", "policy optimization methods", "RLVR"),
    "ppo": ("Proximal Policy Optimization", "policy gradient optimization"),
    "rlvr": ("reinforcement learning with verifiable rewards",),
    "rlhf": ("reinforcement learning from human feedback",),
    "llm": ("large language model",),
}
# Words that aren't topics.
NO_TOPIC = ("what", "which", "when", "where", "why", "how", "compare", "summarize", "define", "explain")
# How much each section helps each intent.
PRIORS = {
    "definition": {"abstract": 0.20, "introduction": 0.18, "methodology": 0.12, "methods": 0.12},
    "comparison": {"results": 0.20, "experiments": 0.18, "discussion": 0.16, "methodology": 0.10},
    "summarization": {"abstract": 0.18, "introduction": 0.14, "conclusion": 0.14},
    "contradiction_analysis": {"results": 0.18, "discussion": 0.16, "related_work": 0.10},
    "methodology_explanation": {"methodology": 0.22, "methods": 0.22, "introduction": 0.10},
    "benchmark_performance": {"results": 0.22, "discussion": 0.16, "abstract": 0.08},
    "citation_lookup": {"related_work": 0.16, "introduction": 0.12},
    "literature_review": {"related_work": 0.20, "introduction": 0.12, "discussion": 0.08},
    "timeline_history": {"related_work": 0.18, "introduction": 0.14, "conclusion": 0.08},
}
DEPTHS = {"definition": 8, "comparison": 10, "literature_review": 12}
# Expansions and synonyms of basic query expansion.
EXPANSIONS = {
    "grpo": ("Group Relative Policy Optimization", "RLHF GRPO", "reinforcement learning optimization"),
    "rag": ("retrieval augmented generation", "retrieval-augmented generation"),
    "llm": ("large language model", "large language models"),
    "rlhf": ("reinforcement learning from human feedback",),
}
SYNONYMS = {"methodology": ("method", "approach"), "results": ("findings", "outcomes"), "benchmark": ("evaluation", "leaderboard")}
CLAIM_WORD = OVERLAP_WORD = r"[a-z0-9][a-z0-9\-]+"


def any_of(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def normal_query(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"(?i)\b\d{4}\.\d{5}(?:v\d+)?\b", ""), r"\s+", " "))


def intent(c: Column) -> Column:
    q, out = F.lower(c), None
    for name, marks in INTENTS:
        out = F.when(any_of(q, marks), name) if out is None else out.when(any_of(q, marks), name)
    return out.otherwise("definition")


def topics(c: Column) -> Column:
    """At most twelve: acronyms with what they stand for, then words."""
    q = F.lower(c)
    known = F.flatten(F.array(*[F.when(q.contains(k), F.array(*[F.lit(x) for x in (k, *v)])).otherwise(F.array().cast("array<string>")) for k, v in ACRONYMS.items()]))
    return F.slice(F.array_distinct(F.concat(known, F.filter(t.found(q, r"[a-z][a-z0-9\-]{3,}"), lambda x: ~x.isin(*NO_TOPIC)))), 1, 12)


def entities(c: Column) -> Column:
    found = F.array_distinct(t.found(c, r"\b(?:[A-Z]{2,}|[A-Z][a-zA-Z0-9\-]+(?:\s+[A-Z][a-zA-Z0-9\-]+)*)\b"))
    plain = F.transform(found, lambda x: F.btrim(F.regexp_replace(x, r"(?i)^(?:compare|define|explain|summarize)\s+", "")))
    return F.filter(plain, lambda x: (x != "") & ~F.lower(x).isin(*NO_TOPIC))


def expanded(c: Column) -> Column:
    """Sorted expansion terms that the query doesn't hold yet."""
    q = F.lower(c)
    words = F.transform(t.found(c, r"[A-Za-z][A-Za-z0-9\-]+"), F.lower)
    terms = [F.when(F.array_contains(words, k) | F.array_contains(words, k + "s"), F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>")) for k, v in EXPANSIONS.items()]
    terms += [F.when(F.arrays_overlap(words, F.array(*[F.lit(x) for x in (k, *v)])), F.array(*[F.lit(x) for x in (k, *v)])).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()]
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*terms)), lambda x: ~F.contains(q, F.lower(x)))))


def rewritten(c: Column) -> Column:
    return F.when(F.size(expanded(c)) == 0, c).otherwise(F.concat(c, F.lit(" "), F.array_join(expanded(c), " ")))


def sub_queries(c: Column) -> Column:
    """The query, the query with each of its first four expansion terms, and its entities with the first two; once each."""
    terms, named = expanded(c), F.array_join(entities(c), " ")
    more = F.concat(F.transform(F.slice(terms, 1, 4), lambda x: F.concat(c, F.lit(" "), x)), F.when(named != "", F.transform(F.slice(terms, 1, 2), lambda x: F.concat(named, F.lit(" "), x))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.array(c), more))


def depth(intent_: Column, default: int = 10) -> Column:
    out = None
    for k, v in DEPTHS.items():
        out = F.when(intent_ == k, v) if out is None else out.when(intent_ == k, v)
    return out.otherwise(default)


def section_prior(intent_: Column, label: Column) -> Column:
    table = F.create_map(*[x for i, p in PRIORS.items() for k, v in p.items() for x in (F.lit(f"{i}/{k}"), F.lit(v))])
    return F.coalesce(F.element_at(table, F.concat(intent_, F.lit("/"), F.lower(label))), F.lit(0.0))


def answerability(query: Column, intent_: Column, text: Column, section: Column, named: Column) -> Column:
    """named: the query's entities."""
    body = F.lower(text)
    asked = F.array_distinct(t.found(F.lower(query), OVERLAP_WORD))
    share = F.size(F.array_intersect(asked, t.found(body, OVERLAP_WORD))) / F.greatest(F.size(asked), F.lit(1))
    add = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        share
        + add((intent_ == "definition") & any_of(body, (" is ", " refers to ", " framework", " optimization")), 0.12)
        + add((intent_ == "comparison") & any_of(body, ("however", "whereas", "compared", "in contrast")), 0.10)
        + add((intent_ == "methodology_explanation") & section.isin("methods", "methodology"), 0.10)
        + add(F.exists(F.slice(named, 1, 3), lambda e: F.contains(body, F.lower(e))), 0.08)
        + add((intent_ == "definition") & section.isin("abstract", "introduction"), 0.08)
        + add(intent_.isin("comparison", "benchmark_performance") & section.isin("results", "discussion", "experiments"), 0.08)
    )
    return t.rounded(F.least(F.lit(1.0), score), 6)


def precision_bonus(intent_: Column, label: Column, on_topic: Column, density: Column) -> Column:
    fits = (intent_.isin("definition", "methodology_explanation") & label.isin("abstract", "introduction", "methodology", "methods")) | (intent_.isin("comparison", "benchmark_performance") & label.isin("results", "discussion"))
    return F.least(density * 10, F.lit(1.0)) * 0.10 + F.when(fits, 0.15).otherwise(0.0) + F.when(on_topic, 0.20).otherwise(0.0)


def on_topic(topics_: Column, text: Column) -> Column:
    body = F.lower(text)
    return F.exists(F.slice(topics_, 1, 6), lambda x: F.contains(body, F.lower(x)))


def with_answerability(df: DataFrame) -> DataFrame:
    """Ranked chunks (text of the query, chunk_text, label) with their answerability."""
    q = F.col("text")
    return df.withColumn("answerability", answerability(q, intent(q), F.col("chunk_text"), F.col("label"), entities(q)))


def with_precision(df: DataFrame) -> DataFrame:
    """The same with precision_score: their score, answerability, and what section, topics and citations add."""
    q, body = F.col("text"), F.col("chunk_text")
    bonus = precision_bonus(intent(q), F.col("label"), on_topic(topics(q), body), t.citation_density_quality(body))
    return df.withColumn("precision_score", t.rounded(F.col("score") + F.col("answerability") * 0.30 + bonus, 6))


def keep_answerable(df: DataFrame, score: str = "answerability", least: float = 0.15) -> DataFrame:
    """Rows at or above the threshold; all of a query's rows if none is."""
    return df.withColumn("__top", F.max(score).over(Window.partitionBy("query_id"))).filter((F.col(score) >= least) | (F.col("__top") < least)).drop("__top")


def max_merge(sets: list[DataFrame]) -> DataFrame:
    """query_id, chunk_id with its best score over all sets; of equal scores the earliest set's."""
    tagged = [df.select("query_id", "chunk_id", "score").withColumn("set", F.lit(k)) for k, df in enumerate(sets)]
    return reduce(DataFrame.unionByName, tagged).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("set", F.struct(F.col("score"), -F.col("set"))).alias("from_set"))


def first_merge(sets: list[DataFrame]) -> DataFrame:
    tagged = [df.select("query_id", "chunk_id", "score").withColumn("set", F.lit(k)) for k, df in enumerate(sets)]
    return reduce(DataFrame.unionByName, tagged).groupBy("query_id", "chunk_id").agg(F.min_by("score", "set").alias("score"), F.min("set").alias("from_set"))


def best_sentence(text: Column, query: Column) -> Column:
    """The sentence with the most distinct words of the query; of equals the longest, then the first."""
    asked = F.array_distinct(t.found(F.lower(query), OVERLAP_WORD))
    all_ = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), t.strip), lambda x: x != "")
    scored = F.transform(all_, lambda s, i: F.struct(F.size(F.array_intersect(asked, t.found(F.lower(s), OVERLAP_WORD))).alias("hits"), F.length(s).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.array_max(scored)["s"]


def citation_label(paper: Column, section: Column) -> Column:
    return F.concat(F.lit("["), paper, F.lit(" §"), section, F.lit("]"))


def structured_answers(df: DataFrame, cited: int = 4, quote: int = 900) -> DataFrame:
    """query_id, answer, evidence, citations, pieces, chunk_ids of ranked chunks (query_id, rank, chunk_id, paper_id, label, chunk_text, text).

    The answer has the best sentence of each of the first chunks with its citation; the evidence is the beginning
    of every chunk."""
    label = citation_label(F.col("paper_id"), F.col("label"))
    rows = df.withColumns({"said": F.when(F.col("rank") <= cited, F.concat(best_sentence(F.col("chunk_text"), F.col("text")), F.lit(" "), label)), "cited": F.when(F.col("rank") <= cited, label), "quote": F.substring("chunk_text", 1, quote)})
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "said", "cited", "quote"))).alias("rows"))
    pick = lambda name: F.filter(F.transform("rows", lambda r: r[name]), lambda x: x.isNotNull())
    return listed.select("query_id", F.array_join(pick("said"), " ").alias("answer"), F.array_join(pick("quote"), "\n").alias("evidence"), F.size(F.array_distinct(F.transform(F.filter("rows", lambda r: r["said"].isNotNull()), lambda r: r["cited"]))).cast("long").alias("citations"), F.size("rows").cast("long").alias("pieces"), pick("chunk_id").alias("chunk_ids"))


def with_grounding(df: DataFrame) -> DataFrame:
    """Answers with n_claims, unsupported_ratio, score and the coverage of their claims by citations."""
    out = df.withColumn("g", grounding(F.col("answer"), F.col("evidence"), F.col("citations"), F.col("pieces")))
    out = out.select(*df.columns, "g.*")
    return out.withColumn("coverage", F.least(F.col("citations") / F.greatest(F.col("n_claims"), F.lit(1)), F.lit(1.0)))


def claims(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), t.strip), lambda x: x != "")


def supported(claim: Column, evidence: Column) -> Column:
    """Whether 35 % of a claim's distinct words of over three characters are somewhere in the evidence (in lower case)."""
    words = F.filter(F.array_distinct(t.found(F.lower(claim), CLAIM_WORD)), lambda w: F.length(w) > 3)
    share = F.size(F.filter(words, lambda w: F.contains(evidence, w))) / F.greatest(F.size(words), F.lit(1))
    return share >= 0.35


def grounding(answer: Column, evidence: Column, citations: Column, pieces: Column) -> Column:
    """Struct of n_claims, unsupported_ratio and score."""

    def body(all_: Column) -> Column:
        n = F.size(all_)
        good = F.size(F.filter(all_, lambda c: supported(c, F.lower(evidence))))
        share = good / F.greatest(n, F.lit(1))
        score = share * 0.55 + F.least(citations / F.greatest(n, F.lit(1)), F.lit(1.0)) * 0.25 + F.least(pieces / F.greatest(n, F.lit(1)), F.lit(1.0)) * 0.20
        return F.struct(n.alias("n_claims"), t.rounded(1 - share, 6).alias("unsupported_ratio"), t.rounded(score, 6).alias("score"))

    return t.let(claims(answer), body)


def contrast_share(answer: Column) -> Column:
    """The share of an answer's claims that mark a contrast."""
    marks = ("however", "in contrast", "whereas", "but")
    return t.let(claims(answer), lambda all_: t.rounded(F.least(F.size(F.filter(all_, lambda x: any_of(F.lower(x), marks))) / F.greatest(F.size(all_), F.lit(1)), F.lit(1.0)), 6))


def hallucination(unsupported: Column, coverage: Column, citations: Column, pieces: Column) -> Column:
    return t.rounded(F.least(F.lit(1.0), unsupported * 0.55 + (1 - coverage) * 0.25 + (1 - F.least(citations / F.greatest(pieces, F.lit(1)), F.lit(1.0))) * 0.20), 6)


def answer_quality(answer: Column, citations: Column, grounding_: Column, unsupported: Column) -> dict[str, Column]:
    words = F.transform(t.found(answer, t.WORD), F.lower)
    n = F.greatest(F.size(words), F.lit(1))
    redundancy = F.greatest(F.lit(0.0), 1 - F.size(F.array_distinct(words)) / n)
    density, complete, fact = citations / n, F.least(F.size(words) / 120.0, F.lit(1.0)), F.greatest(F.lit(0.0), 1 - unsupported)
    synthesis = complete * 0.4 + (1 - redundancy) * 0.2 + density * 10 * 0.2 + fact * 0.2
    overall = density * 6 * 0.1 + grounding_ * 0.30 + complete * 0.15 + (1 - redundancy) * 0.15 + fact * 0.25 + grounding_ * 0.20 + synthesis * 0.05
    return {"redundancy": t.rounded(redundancy, 6), "completeness": t.rounded(complete, 6), "synthesis": t.rounded(F.least(synthesis, F.lit(1.0)), 6), "overall": t.rounded(F.least(overall, F.lit(1.0)), 6)}


def pack_prompts(blocks: DataFrame, budget: int = 16_000) -> DataFrame:
    """Rows of (query_id, rank, text) up to the budget of characters; the first is always kept."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("chars", F.sum(F.length("text")).over(w)).filter((F.col("rank") == 1) | (F.col("chars") <= budget))


def evidence_pairs(df: DataFrame) -> DataFrame:
    """query_id, a, b, relation, weight of each two of a query's ranked chunks (rank, chunk_id, paper_id); ranks bound a query's rows."""
    b = df.select("query_id", F.col("rank").alias("b_rank"), F.col("chunk_id").alias("b"), F.col("paper_id").alias("b_paper"))
    met = df.select("query_id", "rank", F.col("chunk_id").alias("a"), "paper_id").join(b, "query_id").filter("rank < b_rank")
    same = F.col("paper_id") == F.col("b_paper")
    return met.select("query_id", "a", "b", F.when(same, "same_paper").otherwise("cross_paper").alias("relation"), F.when(same, 0.8).otherwise(0.5).alias("weight"))


# Words that mark a contrast.
CONTRAST = ("however", "whereas", "in contrast", "but", "although")


def contradictions(df: DataFrame) -> DataFrame:
    """query_id, a, b: of different papers, with a word of four letters in common, one of them holding a contrast."""
    own = df.select("query_id", "rank", "chunk_id", "paper_id", F.array_distinct(t.found(F.lower("chunk_text"), "[a-z]{4,}")).alias("w"), any_of(F.lower("chunk_text"), CONTRAST).alias("contrast"))
    b = own.select("query_id", *[F.col(c).alias(f"b_{c}") for c in own.columns[1:]])
    met = own.join(b, "query_id").filter((F.col("rank") < F.col("b_rank")) & (F.col("paper_id") != F.col("b_paper_id")) & (F.col("contrast") | F.col("b_contrast")) & F.arrays_overlap("w", "b_w"))
    return met.select("query_id", F.col("chunk_id").alias("a"), F.col("b_chunk_id").alias("b"))


def compress(df: DataFrame, most_alike: float = 0.72, share: float = 0.5, most_sentences: int = 2) -> DataFrame:
    """query_id, place, chunk_id of the chunks that a greedy choice keeps: each query's rows by score, the first in any case; one too
    like a kept one, or whose trade of score against likeness is negative, is dropped; at most half are kept. Likeness is
    of the chunks' first sentences. Folded inside the group's array."""
    head = F.array_join(F.slice(claims(F.col("chunk_text")), 1, most_sentences), " ")
    toks = F.array_distinct(t.found(F.lower(head), OVERLAP_WORD))
    listed = df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "chunk_id", "score", toks.alias("w")))).alias("rows"))
    kept0 = F.array().cast("array<struct<chunk_id:bigint,w:array<string>>>")

    def step(kept, r):
        alike = F.aggregate(kept, F.lit(0.0), lambda m, k: F.greatest(m, t.jaccard(k["w"], r["w"])))
        drop = (F.size(kept) > 0) & ((alike > most_alike) | (r["score"] * 0.7 - alike * 0.3 < 0))
        return F.when(drop, kept).otherwise(F.concat(kept, F.array(F.struct(r["chunk_id"].alias("chunk_id"), r["w"].alias("w")))))

    kept = F.aggregate("rows", kept0, step, lambda k: F.transform(k, lambda x: x["chunk_id"]))
    return listed.select("query_id", F.posexplode(F.slice(kept, 1, F.greatest(F.lit(1), F.floor(F.size("rows") * share).cast("int")))).alias("place", "chunk_id"))


def sessions(turns: DataFrame, last: int = 20) -> DataFrame:
    """conv_id, turns, topics: per conversation its latest user texts' topics, first seen first."""
    own = turns.filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", topics(F.col("text")).alias("topics")))).alias("all"))
    recent = F.when(F.size("all") > last, F.slice("all", -last, last)).otherwise(F.col("all"))
    return own.select("conv_id", "turns", F.slice(F.array_distinct(F.flatten(F.transform(recent, lambda x: x["topics"]))), 1, 12).alias("topics"))
