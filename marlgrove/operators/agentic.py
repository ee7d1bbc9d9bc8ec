"""Retrieval in several rounds, and answers by the whole chain of stages, for batches of queries.

Each function takes ``search``, which returns the ranked chunks (query_id, rank, chunk_id, paper_id, label, score,
chunk_text, text) of a batch of queries (query_id, text, v). Rounds are bounded in number, and each is one search for
all queries; a query's forms are queries of their own, numbered within it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import answer as a
from . import compose as c
from .rescue import lexical_rescue
from .search import ENTITY

Search = Callable[[DataFrame], DataFrame]
#: Forms of a query are numbered within it up to this.
FORMS = 10
#: Share of the first results that must hold a topic or an entity for a round to be the last.
ENOUGH = 0.6
HIT = ("chunk_id", "paper_id", "label", "chunk_text")


def reformulations(query: Column) -> Column:
    """The query, the query with expansion terms, its first entities, its first topics; once each, none empty."""
    more = F.slice(a.expanded(query), 1, 4)
    forms = F.array(query, F.when(F.size(more) > 0, F.concat(query, F.lit(" "), F.array_join(more, " "))), F.array_join(F.slice(a.entities(query), 1, 2), " "), F.array_join(F.slice(a.topics(query), 1, 4), " "))
    return F.array_distinct(F.filter(F.transform(F.array_compact(forms), F.btrim), lambda x: x != ""))


def search_forms(search: Search, queries: DataFrame, forms: Column) -> DataFrame:
    """The results of all forms of each query, with query_id, place (of the form) and form instead of text."""
    listed = queries.select(F.col("query_id"), "v", F.posexplode(forms).alias("place", "form"))
    hits = search(listed.select((F.col("query_id") * FORMS + F.col("place")).alias("query_id"), F.col("form").alias("text"), "v"))
    return hits.withColumns({"place": F.pmod("query_id", F.lit(FORMS)).cast("int"), "query_id": F.floor(F.col("query_id") / FORMS).cast("long")}).withColumnRenamed("text", "form")


def retrieval_loop(search: Search, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of each query's best form, and a report: query_id, attempt, retries, coverage, stopped.

    Forms are tried in order until one covers enough: the share of its five best chunks that hold a topic or an entity of the
    query. If none does the best is taken, of equals the later. All forms are searched at once."""
    q = F.col("text")
    asked = queries.select("query_id", F.concat(F.slice(a.topics(q), 1, 6), F.slice(a.entities(q), 1, 3)).alias("targets"), F.size(reformulations(q)).alias("forms"))
    hits = search_forms(search, queries, reformulations(q))
    body = F.lower(F.concat("label", F.lit(" "), "chunk_text"))
    held = hits.filter("rank <= 5").join(asked, "query_id").withColumn("held", F.exists("targets", lambda x: F.contains(body, F.lower(x))))
    covered = held.groupBy("query_id", "place").agg(F.avg(F.col("held").cast("int")).alias("coverage"), F.first("forms").alias("forms"))
    enough = F.col("coverage") >= ENOUGH
    order = Window.partitionBy("query_id").orderBy(F.desc(enough), F.when(enough, F.col("place")), F.desc("coverage"), F.desc("place"))
    best = covered.withColumn("r", F.row_number().over(order)).filter("r = 1")
    report = best.select("query_id", F.col("place").alias("attempt"), F.when(enough, F.col("place")).otherwise(F.col("forms") - 1).cast("int").alias("retries"), t.rounded(F.col("coverage"), 6).alias("coverage"), F.when(enough, "covered").otherwise("no_more_forms").alias("stopped"))
    return hits.join(best.select("query_id", "place"), ["query_id", "place"], "left_semi"), report


def signatures(chunks: DataFrame, n: int = 6) -> DataFrame:
    """chunk_id, topics: each chunk's most frequent words, of equals the one first met."""
    tokens = chunks.select("chunk_id", F.posexplode(F.transform(t.found(F.col("chunk_text"), r"[A-Za-z][A-Za-z0-9_\-]{2,}"), F.lower)).alias("pos", "tok")).filter(~F.col("tok").isin(t.STOP_CHUNK))
    counted = tokens.groupBy("chunk_id", "tok").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("n"), "first"))).filter(F.col("r") <= n)
    return top.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tok"))), lambda x: x["tok"]).alias("topics"))


def multi_hop(search: Search, queries: DataFrame, follow_ups: int = 2, top: int = 6) -> DataFrame:
    """query_id, chunk_id, score, from_set, rank: the results, and those of follow-up queries that add a term of the query or of its first results.

    A chunk keeps the score of the first search that found it."""
    first = search(queries)
    heads = first.filter(F.col("rank") <= follow_ups)
    signed = heads.join(signatures(heads.select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"])), "chunk_id", "left")
    named = F.slice(t.found(F.col("chunk_text"), ENTITY), 1, 1)
    terms = F.concat(named, F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 2))
    more = signed.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", terms.alias("terms")))), lambda x: x["terms"])).alias("more"))
    q = F.col("text")
    own = F.concat(F.slice(a.entities(q), 1, 2), F.slice(a.topics(q), 1, 4), F.coalesce("more", F.array().cast("array<string>")))
    asked = queries.join(more, "query_id", "left").withColumn("terms", F.slice(F.array_distinct(F.filter(own, lambda x: x != "")), 1, follow_ups))
    then = search_forms(search, asked, F.transform("terms", lambda x: F.concat(q, F.lit(" "), x))).filter(F.col("rank") <= top)
    hops = first.select("query_id", "chunk_id", "score", F.lit(0).alias("set")).union(then.select("query_id", "chunk_id", "score", F.col("place") + 1))
    merged = hops.groupBy("query_id", "chunk_id").agg(F.min_by("score", "set").alias("score"), F.min("set").alias("from_set"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(order).cast("int"))


def gathered(search: Search, chunks: DataFrame, queries: DataFrame, forms: int = 4) -> DataFrame:
    """The ranked chunks of each query from its first sub-queries and from lexical rescue, each chunk with its best score, as many as its intent needs."""
    q = F.col("text")
    found = search_forms(search, queries, F.slice(a.sub_queries(q), 1, forms)).select("query_id", "chunk_id", "score")
    rescued = lexical_rescue(chunks, queries.select("query_id", "text")).select("query_id", "chunk_id", "score")
    best = found.union(rescued).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    asked = queries.select("query_id", "text", F.greatest(a.depth(a.intent(q)), F.lit(10)).alias("depth"))
    kept = best.withColumn("rank", F.row_number().over(order).cast("int")).join(asked, "query_id").filter("rank <= depth").drop("depth")
    return kept.join(chunks.select(*HIT), "chunk_id")


def routed(hits: DataFrame, near: int = 8) -> DataFrame:
    """The hits with what their section, topics and paper add to their score."""
    q = F.col("text")
    papers = F.sum((F.col("rank") <= near).cast("int")).over(Window.partitionBy("query_id", "paper_id"))
    about = a.on_topic(a.topics(q), F.concat("chunk_text", F.lit(" "), "label"))
    heavy = (a.intent(q) == "benchmark_performance") & (t.benchmark_probability(F.col("chunk_text")) > 0.2)
    bonus = a.section_prior(a.intent(q), F.col("label")) + F.when(about, 0.08).otherwise(0.0) + F.when(heavy, 0.06).otherwise(0.0) + F.least(papers, F.lit(3)) * 0.01
    return hits.withColumn("score", t.rounded(F.col("score") + bonus, 6))


def evidence(hits: DataFrame, budget: int = 16_000) -> DataFrame:
    """What a prompt holds: the hits by score, answerable ones alone if there are any, compressed, one of each text, up to a budget of characters."""
    scored = a.keep_answerable(a.with_precision(a.with_answerability(routed(hits))))
    scored = scored.withColumn("score", t.rounded(F.col("precision_score") + F.col("answerability"), 6))
    kept = scored.join(a.compress(scored).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    same = Window.partitionBy("query_id", F.sha2("chunk_text", 256)).orderBy(F.desc("score"), "chunk_id")
    once = kept.withColumn("__same", F.row_number().over(same)).filter("__same = 1").drop("__same")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ordered = once.withColumn("rank", F.row_number().over(order).cast("int"))
    return a.pack_prompts(ordered.withColumn("text_", F.col("text")).withColumn("text", F.concat(a.citation_label(F.col("paper_id"), F.col("label")), F.lit("\n"), t.strip(F.col("chunk_text")))), budget).withColumn("text", F.col("text_")).drop("text_", "chars")


def judged(answers: DataFrame) -> DataFrame:
    """Answers with grounding, hallucination, quality and confidence."""
    out = a.with_grounding(answers)
    out = out.withColumn("hallucination", a.hallucination(F.col("unsupported_ratio"), F.col("coverage"), F.col("citations"), F.col("pieces")))
    out = out.withColumn("quality", a.answer_quality(F.col("answer"), F.col("citations"), F.col("score"), F.col("unsupported_ratio"))["overall"])
    return out.withColumn("confidence", t.rounded(F.col("score") * F.col("quality"), 6))


def respond(search: Search, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, answer, citations, pieces, chunk_ids, n_claims, score, hallucination, quality, confidence of each query."""
    return judged(a.structured_answers(evidence(gathered(search, chunks, queries))))


def post_process(answers: DataFrame, evidence_: DataFrame) -> DataFrame:
    """Answers refined and judged again: paragraphs once each, a caution where sources conflict; with what reflection asks for and what it gained."""
    pairs = a.contradictions(evidence_).groupBy("query_id").agg(F.count("*").alias("pairs"))
    edges = a.evidence_pairs(evidence_).groupBy("query_id").agg(F.count("*").alias("edges"))
    met = answers.join(pairs, "query_id", "left").join(edges, "query_id", "left").withColumns({"pairs": F.coalesce("pairs", F.lit(0)), "edges": F.coalesce("edges", F.lit(0))})
    conflict = t.rounded(F.least(F.col("pairs") / F.greatest(F.col("pieces"), F.lit(1)), F.lit(1.0)), 6)
    before = met.withColumns({"contradiction": conflict, "actions": F.array_join(c.reflection(F.col("unsupported_ratio"), F.col("pieces"), a.contrast_share(F.col("answer"))), "|"), "quality_before": F.col("quality")})
    again = before.select("query_id", c.refined(F.col("answer"), F.col("contradiction")).alias("answer"), "evidence", "citations", "pieces", "contradiction", "actions", "edges", "quality_before")
    return judged(again).withColumn("gain", t.rounded(F.col("quality") - F.col("quality_before"), 6))


def union_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sets)
