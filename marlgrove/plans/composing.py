"""Queries of what stands between results and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answer as a
from ..operators import compose as c
from ..operators import report as r
from ..sources.tables import CHUNKS_SQL, LINES_SQL, chunks, lines, table
from ..sources import manifest
from .rag import ANSWERS_, HALLUCINATION_, INTENT_, MARKED_, PRECISE_, RANKED_, answers_sql, compressed_sql, grounded, ranked, recursive_
from .registry import query
from .scores import QUALITY_CTE, TOPICS_, n_, quality, topic_signature

SENTS_ = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


_b = "avg((regexp_matches(b, '[.!?]$') AND regexp_matches(line, '^\\p{Lu}'))::INT)"
_c = "avg((regexp_matches(b, '[^.!?:;]$') AND regexp_matches(line, '^\\p{Ll}'))::INT)"


def _score(x: str, single: float) -> str:
    return f"CASE WHEN n <= 1 THEN {single}::DOUBLE ELSE floor(least(1.0::DOUBLE, {x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END"


@query(f"WITH {LINES_SQL}, l AS (SELECT *, lag(line) OVER (PARTITION BY paper_id ORDER BY ord) AS b FROM lines), s AS (SELECT paper_id, count(*) AS n, {_b} AS b, {_c} AS c FROM l GROUP BY 1) SELECT paper_id AS group_id, n AS paragraphs, {_score('b * 0.35::DOUBLE + 0.55::DOUBLE', 0.92)} AS transition_quality, {_score('b * 0.4::DOUBLE + 0.45::DOUBLE', 0.9)} AS boundary, {_score('c * 0.35::DOUBLE + 0.5::DOUBLE + 0.1::DOUBLE', 0.94)} AS continuity FROM s")
def transition_scores(spark, sf_dir):
    return c.transitions(lines(spark, sf_dir).select(F.col("paper_id").alias("group_id"), F.col("ord").alias("place"), F.col("line").alias("text")))


_r4 = "floor(({}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"
_unit4 = lambda x: _r4.format(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))")
#: Of each document as a chunk: coherence, noise, integrity and the anomaly that follows from them and from its lines' transitions.
STRUCTURE_ = f"""tr AS (SELECT group_id AS doc_id, transition_quality, continuity FROM (WITH {LINES_SQL}, l AS (SELECT *, lag(line) OVER (PARTITION BY paper_id ORDER BY ord) AS b FROM lines), s AS (SELECT paper_id, count(*) AS n, {_b} AS b, {_c} AS c FROM l GROUP BY 1) SELECT paper_id AS group_id, {_score('b * 0.35::DOUBLE + 0.55::DOUBLE', 0.92)} AS transition_quality, {_score('c * 0.35::DOUBLE + 0.5::DOUBLE + 0.1::DOUBLE', 0.94)} AS continuity FROM s)),
co AS (SELECT doc_id, {_unit4(f"1 - abs(greatest(1, floor({n_(chr(92) + 'S+')} * 1.25::DOUBLE)) / greatest(1, {n_('[.!?]')}) - 24) / 32")} AS coherence, {_unit4(f"{n_('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's.,;:()' + chr(92) + '-]')}::DOUBLE / greatest(length(text), 1) * 4")} AS noise FROM documents),
st AS (SELECT *, {_unit4('0.45::DOUBLE + (1 - noise) * 0.3::DOUBLE + coherence * 0.25::DOUBLE')} AS integrity FROM co JOIN tr USING (doc_id)),
flag AS (SELECT doc_id, integrity, anomaly, (retrieval_quality_score < 0.52::DOUBLE OR noise > 0.28::DOUBLE OR integrity < 0.62::DOUBLE OR anomaly > 0.4::DOUBLE) AS flagged_for_review FROM (SELECT *, {_unit4('noise * 0.45::DOUBLE + (1 - integrity) * 0.25::DOUBLE + greatest(0.0::DOUBLE, 0.7 - transition_quality) * 0.2::DOUBLE + greatest(0.0::DOUBLE, 0.7 - continuity) * 0.1::DOUBLE')} AS anomaly FROM st) JOIN judged USING (doc_id))"""


def flagged(spark, sf_dir):
    """Every document's quality columns with integrity, anomaly and flagged_for_review."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *[x.alias(k) for k, x in c.structure(F.col("text")).items()])
    moves = transition_scores(spark, sf_dir).select(F.col("group_id").alias("doc_id"), "transition_quality", "continuity")
    met = quality(spark, sf_dir).join(docs, "doc_id").join(moves, "doc_id")
    met = met.withColumn("anomaly", c.anomaly(F.col("noise"), F.col("integrity"), F.col("transition_quality"), F.col("continuity")))
    return met.withColumn("flagged_for_review", c.flag_for_review(F.col("retrieval_quality_score"), F.col("noise"), F.col("integrity"), F.col("anomaly")))


@query(f"WITH {QUALITY_CTE}, {STRUCTURE_} SELECT doc_id, integrity, anomaly, flagged_for_review FROM flag")
def review_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", "integrity", "anomaly", "flagged_for_review")


@query(f"WITH {QUALITY_CTE}, {STRUCTURE_} SELECT doc_id FROM judged JOIN flag USING (doc_id) WHERE retrieval_quality_score >= 0.55::DOUBLE AND NOT flagged_for_review AND NOT retrieval_excluded AND noise_score <= 0.60::DOUBLE")
def embedding_eligibility(spark, sf_dir):
    return flagged(spark, sf_dir).filter(c.embedding_eligible()).select("doc_id")


@query(f"WITH {QUALITY_CTE} SELECT doc_id, retrieval_quality_score FROM judged WHERE retrieval_quality_score >= 0.6::DOUBLE ORDER BY sha256(doc_id || '-7'), doc_id LIMIT 25")
def review_sample(spark, sf_dir):
    """Twenty-five good documents for a reader, by a hash."""
    return c.review_sample(quality(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), 25, 0.6).select(F.col("chunk_id").alias("doc_id"), "retrieval_quality_score")


@query(f"WITH {LINES_SQL}, h AS (SELECT * FROM lines WHERE ord < 25), e AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(line, '{t.ARTEFACTS[2][1]}')) AS e FROM h), l AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(line, 'https?://[^\\s]+')) AS l FROM h) SELECT p.paper_id, coalesce((SELECT string_agg(e, '|' ORDER BY e) FROM e WHERE e.paper_id = p.paper_id), '') AS emails, coalesce((SELECT string_agg(l, '|' ORDER BY l) FROM l WHERE l.paper_id = p.paper_id), '') AS links FROM (SELECT DISTINCT paper_id FROM h) p")
def front_matter(spark, sf_dir):
    return c.front_matter(lines(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL}, {QUALITY_CTE}, tp AS ({TOPICS_}), q AS (SELECT chunk_id, trim(label || ' ' || coalesce(array_to_string(string_split(topics, '|')[1:4], ' '), '')) AS query FROM chunks JOIN judged ON doc_id = chunk_id LEFT JOIN tp ON tp.doc_id = chunk_id WHERE retrieval_quality_score >= 0.65::DOUBLE) SELECT substr(sha256(chunk_id || ':' || query), 1, 16) AS probe_id, query, chunk_id FROM q")
def probe_builder(spark, sf_dir):
    good = chunks(spark, sf_dir).select("chunk_id", "label").join(quality(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "retrieval_quality_score"), "chunk_id")
    topics = topic_signature(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.split("topics", r"\|").alias("topics"))
    return c.probes(good, topics)


@query(f"SELECT conv_id, turn, CASE WHEN k = 'comparison' THEN 3 ELSE 2 END::INT AS subtasks, CASE WHEN k = 'comparison' THEN 'hybrid_comparison' WHEN k IN ('contradiction_analysis', 'timeline_history', 'literature_review') THEN 'broad_synthesis' ELSE 'direct_lookup' END AS first_strategy FROM (SELECT *, {INTENT_.format(q='text')} AS k FROM conversations)")
def agentic_plan(spark, sf_dir):
    steps = c.plan(a.intent(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(steps).alias("subtasks"), F.element_at(steps, 1).alias("first_strategy"))


@query("SELECT doc_id, substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')[1:12], ' '), 1, 960) AS generated FROM documents")
def heuristic_generation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", c.generated(F.col("text")).alias("generated"))


@query(RANKED_ + f", l AS (SELECT query_id, list('[' || paper_id || ' §' || label || ']' ORDER BY rank) AS labels, arg_min(chunk_text, rank) AS body FROM res GROUP BY 1), s AS (SELECT query_id, labels, {SENTS_.format('body')} AS ss FROM l) SELECT query_id, md5(array_to_string(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN contains(ss[i], labels[least(i, len(labels))]) THEN ss[i] ELSE ss[i] || ' ' || labels[least(i, len(labels))] END), ' ')) AS cited_md5 FROM s")
def cited_answers(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("m", a.citation_label(F.col("paper_id"), F.col("label")))
    one = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "m"))), lambda x: x["m"]).alias("labels"), F.min_by("chunk_text", "rank").alias("body"))
    return one.select("query_id", F.md5(c.cited(F.col("body"), F.col("labels"))).alias("cited_md5"))


_hits = f"len(list_intersect(list_distinct(regexp_extract_all(lower(text), '{a.OVERLAP_WORD}')), regexp_extract_all(lower(s), '{a.OVERLAP_WORD}')))"


@query(RANKED_ + f", s AS (SELECT query_id, text, unnest(range(len({SENTS_.format('chunk_text')}))) AS i, unnest({SENTS_.format('chunk_text')}) AS s FROM res WHERE rank = 1) SELECT query_id, s AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_hits} DESC, length(s) DESC, i) AS r FROM s) WHERE r = 1")
def best_sentences(spark, sf_dir):
    return ranked(spark, sf_dir).filter("rank = 1").select("query_id", a.best_sentence(F.col("chunk_text"), F.col("text")).alias("best"))


@query(f"{ANSWERS_}, {MARKED_} SELECT query_id, contradiction, array_to_string(list_filter([CASE WHEN unsupported_ratio > 0 THEN 'retry_retrieval' END, CASE WHEN pieces < 3 THEN 'expand_retrieval' END, CASE WHEN contradiction > 0.1::DOUBLE THEN 'inspect_contradictions' END], lambda x: x IS NOT NULL), '|') AS actions FROM gr JOIN mark USING (query_id)")
def reflection(spark, sf_dir):
    rows = grounded(spark, sf_dir).withColumn("contradiction", a.contrast_share(F.col("answer")))
    return rows.select("query_id", "contradiction", F.array_join(c.reflection(F.col("unsupported_ratio"), F.col("pieces"), F.col("contradiction")), "|").alias("actions"))


_r6 = "floor(({}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


@query(recursive_(f"{PRECISE_}, {compressed_sql('prec', 'precision_score')}, {answers_sql('res')} SELECT query_id, {_r6.format('greatest(0.0::DOUBLE, 1 - score)')} AS retrieval_drift, {_r6.format('used::DOUBLE / pieces')} AS chunk_utilization, {_r6.format('1 - used::DOUBLE / pieces')} AS context_waste, {HALLUCINATION_} AS hotspot, unsupported_ratio AS unsupported_frequency FROM gr JOIN (SELECT query_id, count(*) AS used FROM mkept GROUP BY 1) USING (query_id)"))
def rag_observability(spark, sf_dir):
    """Of each answer, with the share of its chunks that compression keeps."""
    hits = a.with_precision(a.with_answerability(ranked(spark, sf_dir))).drop("score").withColumnRenamed("precision_score", "score")
    used = a.compress(hits).groupBy("query_id").agg(F.count("*").alias("used"))
    rows = grounded(spark, sf_dir).withColumn("hallucination", a.hallucination(F.col("unsupported_ratio"), F.col("coverage"), F.col("citations"), F.col("pieces"))).join(used, "query_id")
    return c.trace(rows.withColumn("offered", F.col("pieces")))


@query(ANSWERS_ + " SELECT count(*) AS answers, round(avg(score), 6) AS mean_grounding, round(avg(unsupported_ratio), 6) AS mean_unsupported, round(avg(n_claims), 6) AS mean_claims FROM gr")
def rag_eval_means(spark, sf_dir):
    return grounded(spark, sf_dir).agg(F.count("*").alias("answers"), F.round(F.avg("score"), 6).alias("mean_grounding"), F.round(F.avg("unsupported_ratio"), 6).alias("mean_unsupported"), F.round(F.avg("n_claims"), 6).alias("mean_claims"))


@query("SELECT kind AS report_id, i::INT AS place, title, CASE WHEN i > 0 THEN (i - 1)::INT END AS depends_on, CASE WHEN contains(lower(title), 'introduction') OR contains(lower(title), 'overview') THEN 0.55::DOUBLE WHEN contains(lower(title), 'comparison') OR contains(lower(title), 'analysis') THEN 0.72::DOUBLE WHEN contains(lower(title), 'limitations') OR contains(lower(title), 'open') THEN 0.62::DOUBLE ELSE 0.66::DOUBLE END AS sufficiency FROM (SELECT kind, unnest(range(len(ts))) AS i, unnest(ts) AS title FROM (VALUES " + ", ".join("('" + k + "', ['" + "', '".join(v) + "'])" for k, v in r.OUTLINES.items()) + ") AS o(kind, ts))")
def writing_plan(spark, sf_dir):
    rows = spark.createDataFrame([(k, list(v)) for k, v in r.OUTLINES.items()], "report_id string, titles array<string>")
    return c.writing_plan(rows)


_wd = "list_distinct(regexp_extract_all(lower({}), '[a-z][a-z0-9\\-]{{2,}}'))"


@query(RANKED_ + f", s AS (SELECT query_id, unnest(range(len({SENTS_.format('chunk_text')}))) AS place, unnest({SENTS_.format('chunk_text')}) AS s FROM res WHERE rank = 1), w AS (SELECT s.query_id, place, r.chunk_id, {_r6.format(f'''len(list_intersect({_wd.format('s')}, {_wd.format('r.chunk_text')}))::DOUBLE / greatest(len({_wd.format('s')}), 1) + score * 0.1::DOUBLE''')} AS weight FROM s JOIN res r USING (query_id)) SELECT query_id AS group_id, place::INT AS place, chunk_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY weight DESC, chunk_id) AS k FROM w WHERE weight > 0) WHERE k <= 2")
def sentence_citations(spark, sf_dir):
    hits = ranked(spark, sf_dir).withColumnRenamed("query_id", "group_id")
    best = hits.filter("rank = 1").select("group_id", F.posexplode(r.sentences(F.col("chunk_text"))).alias("place", "sentence"))
    return c.sentence_citations(best, hits)


@query(f"WITH d AS (SELECT source, doc_id, {SENTS_.format('text')} AS ss FROM documents), f AS (SELECT source, doc_id, array_to_string(ss[1:2], ' ') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM d WHERE array_to_string(ss[1:2], ' ') <> '') SELECT source, trim(substr(string_agg(s, ' ' ORDER BY r), 1, 650), ' ' || chr(10) || chr(9) || chr(13)) AS abstract FROM f WHERE r <= 3 GROUP BY 1")
def report_abstracts(spark, sf_dir):
    """A report a source: the first sentences of its first three texts that have any, joined and cut."""
    said = F.array_join(F.slice(r.sentences(F.col("text")), 1, 2), " ")
    first = table(spark, sf_dir, "documents").select("source", "doc_id", said.alias("s")).filter("s <> ''")
    top = c.least_rows(first, "source", "doc_id", 3)
    return top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]).alias("ss")).select("source", c.abstract(F.col("ss")).alias("abstract"))


@query("SELECT max(ts) AS watermark, count(*) AS entries FROM events WHERE event_type <> 'error'")
def watermark_advance(spark, sf_dir):
    """The watermark after a run: the latest time of all entries that didn't fail."""
    return manifest.watermark(table(spark, sf_dir, "events").select("ts", (F.col("event_type") == "error").alias("failed")))
