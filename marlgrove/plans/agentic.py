"""Retrieval in rounds, and answers by the whole chain, of all benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import agentic as g
from ..operators import answer as a
from ..operators import compose as c
from ..operators import search as s
from ..sources.scratch import written
from ..sources.tables import chunks
from .rag import _prior, _w, EXPANDED_, HALLUCINATION_, QUALITY_, RANKED_, RESCUE_, ans_sql, answers_sql, compressed_sql, first_, judged_sql, MARKED_, prec_sql, quality_sql, ranked, recursive_, understood_
from .registry import query
from .retrieval import questions, search_sql, vectors
from .scores import BENCH_, TOPICS_

#: Queries with their terms, and the forms that the loop tries.
_u = f"u AS (SELECT *, {EXPANDED_} AS terms FROM (SELECT *, {_w} AS w FROM {understood_('qs')}))"
LOOP_ = f"""{_u}, fl AS (SELECT query_id AS q, base, topics, ents, list_filter(list_transform([text, CASE WHEN len(terms) > 0 THEN text || ' ' || array_to_string(terms[1:4], ' ') END, array_to_string(ents[1:2], ' '), array_to_string(topics[1:4], ' ')], lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS l FROM u),
ff AS (SELECT *, {first_('l')} AS forms FROM fl), qsl AS (SELECT q * 10 + i AS query_id, base, f AS text FROM (SELECT q, base, unnest(range(len(forms))) AS i, unnest(forms) AS f FROM ff)),
{search_sql('l')},
covl AS (SELECT ff.q, r.query_id % 10 AS place, any_value(len(forms)) AS n, avg((len(list_filter(list_concat(topics[1:6], ents[1:3]), lambda x: contains(lower(label || ' ' || chunk_text), lower(x)))) > 0)::INT) AS coverage FROM resl r JOIN ff ON ff.q = r.query_id // 10 WHERE rank <= 5 GROUP BY 1, 2),
loop AS (SELECT * FROM covl QUALIFY row_number() OVER (PARTITION BY q ORDER BY coverage >= 0.6 DESC, CASE WHEN coverage >= 0.6 THEN place END, coverage DESC, place DESC) = 1)"""


def searcher(spark, sf_dir):
    """Hybrid search over all chunks, for batches of queries that bring their vectors."""
    return lambda asked: s.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), asked, texts=True)


@query(f"{RANKED_}, {LOOP_} SELECT q AS query_id, place::INT AS attempt, CASE WHEN coverage >= 0.6 THEN place ELSE n - 1 END::INT AS retries, floor(coverage * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS coverage, CASE WHEN coverage >= 0.6 THEN 'covered' ELSE 'no_more_forms' END AS stopped FROM loop")
def coverage_loop(spark, sf_dir):
    return g.retrieval_loop(searcher(spark, sf_dir), questions(spark, sf_dir))[1]


@query(f"{RANKED_}, {LOOP_} SELECT q AS query_id, r.chunk_id, r.rank, r.score FROM resl r JOIN loop ON loop.q = r.query_id // 10 AND loop.place = r.query_id % 10")
def loop_results(spark, sf_dir):
    return g.retrieval_loop(searcher(spark, sf_dir), questions(spark, sf_dir))[0].select("query_id", "chunk_id", "rank", "score")


HOPS_ = f"""tp AS ({TOPICS_}), heads AS (SELECT query_id, rank, list_concat(regexp_extract_all(chunk_text, '{s.ENTITY}')[1:1], coalesce(string_split(tp.topics, '|')[1:2], []::VARCHAR[])) AS terms FROM res LEFT JOIN tp ON tp.doc_id = chunk_id WHERE rank <= 2),
more AS (SELECT query_id, flatten(list(terms ORDER BY rank)) AS more FROM heads GROUP BY 1),
hl AS (SELECT x.query_id, base, text, list_filter(list_concat(ents[1:2], topics[1:4], coalesce(more, []::VARCHAR[])), lambda x: x <> '') AS l FROM {understood_('qs')} x LEFT JOIN more ON more.query_id = x.query_id),
qsh AS (SELECT query_id * 10 + i AS query_id, base, text || ' ' || f AS text FROM (SELECT query_id, base, text, unnest(range(least(2, len({first_('l')})))) AS i, unnest(({first_('l')})[1:2]) AS f FROM hl)),
{search_sql('h', 6)},
hops AS (SELECT query_id, chunk_id, score, 0 AS s FROM res UNION ALL SELECT query_id // 10, chunk_id, score, query_id % 10 + 1 FROM resh)"""


@query(f"{RANKED_}, {HOPS_} SELECT query_id, chunk_id, score, from_set, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM (SELECT query_id, chunk_id, arg_min(score, s) AS score, min(s)::INT AS from_set FROM hops GROUP BY 1, 2)")
def multi_hop(spark, sf_dir):
    return g.multi_hop(searcher(spark, sf_dir), questions(spark, sf_dir))


_near = "list_filter(topics[1:6], lambda x: contains(lower(chunk_text || ' ' || label), lower(x)))"
GATHERED_ = f"""{RESCUE_}, {_u}, ml AS (SELECT query_id, base, list_concat([text], list_transform(terms[1:4], lambda x: text || ' ' || x), CASE WHEN len(ents) > 0 THEN list_transform(terms[1:2], lambda x: array_to_string(ents, ' ') || ' ' || x) ELSE []::VARCHAR[] END) AS l FROM u),
qsm AS (SELECT query_id * 10 + i AS query_id, base, f AS text FROM (SELECT query_id, base, unnest(range(least(4, len({first_('l')})))) AS i, unnest(({first_('l')})[1:4]) AS f FROM ml)),
{search_sql('m')},
both_ AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id // 10 AS query_id, chunk_id, score FROM resm UNION ALL SELECT query_id, chunk_id, score FROM resc) GROUP BY 1, 2),
gat AS (SELECT * FROM (SELECT b.*, q.text, (row_number() OVER (PARTITION BY b.query_id ORDER BY score DESC, b.chunk_id))::INT AS rank, CASE q.k WHEN 'literature_review' THEN 12 ELSE 10 END AS depth, q.k AS kind FROM both_ b JOIN u q USING (query_id)) JOIN chunks USING (chunk_id) WHERE rank <= depth)"""
ROUTED_ = f"""bench AS ({BENCH_}), rou AS (SELECT * REPLACE (floor((score + ({_prior} + CASE WHEN len({_near}) > 0 THEN 0.08::DOUBLE ELSE 0.0 END + CASE WHEN k = 'benchmark_performance' AND benchmark_probability > 0.2 THEN 0.06::DOUBLE ELSE 0.0 END + least(papers, 3) * 0.01::DOUBLE)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score) FROM (SELECT x.*, benchmark_probability, (count(*) FILTER (rank <= 8) OVER (PARTITION BY query_id, paper_id)) AS papers FROM {understood_('gat')} x JOIN bench ON doc_id = chunk_id))"""
EVIDENCE_ = f"""{ans_sql('rou', 'e', known=True)}, {prec_sql('e')}, sco AS (SELECT * REPLACE (floor((precision_score + answerability) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score) FROM (SELECT *, max(answerability) OVER (PARTITION BY query_id) AS top FROM prece) WHERE answerability >= 0.15::DOUBLE OR top < 0.15::DOUBLE),
{compressed_sql('sco', 'score')},
once AS (SELECT * FROM sco SEMI JOIN mkept USING (query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, sha256(chunk_text) ORDER BY score DESC, chunk_id) = 1),
ord AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank) FROM once),
evi AS (SELECT * FROM (SELECT *, sum(length('[' || paper_id || ' §' || label || ']' || chr(10) || trim(chunk_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) OVER (PARTITION BY query_id ORDER BY rank) AS chars FROM ord) WHERE rank = 1 OR chars <= 16000)"""
_conf = "floor(score * overall * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"
RESPONSES_ = recursive_(f"{RANKED_}, {GATHERED_}, {ROUTED_}, {EVIDENCE_}, {answers_sql('evi')}, {QUALITY_}")


@query(recursive_(f"{RANKED_}, {GATHERED_} SELECT query_id, chunk_id, rank, score FROM gat"))
def gathered_results(spark, sf_dir):
    return g.gathered(searcher(spark, sf_dir), chunks(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "chunk_id", "rank", "score")


def _evidence(spark, sf_dir):
    return g.evidence(g.gathered(searcher(spark, sf_dir), chunks(spark, sf_dir), questions(spark, sf_dir)))


@query(recursive_(f"{RANKED_}, {GATHERED_}, {ROUTED_}, {EVIDENCE_} SELECT query_id, chunk_id, rank, score FROM evi"))
def prompt_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("query_id", "chunk_id", "rank", "score")


@query(f"{RESPONSES_} SELECT query_id, md5(answer) AS answer_md5, citations, pieces, n_claims, score AS grounding, {HALLUCINATION_} AS hallucination, overall AS quality, {_conf} AS confidence FROM qual")
def rag_answers(spark, sf_dir):
    """The whole chain: sub-queries, rescue, merge, routing, precision, answerability, compression, prompt, cited answer, grounding, quality."""
    out = g.respond(searcher(spark, sf_dir), chunks(spark, sf_dir), questions(spark, sf_dir))
    return out.select("query_id", F.md5("answer").alias("answer_md5"), "citations", "pieces", "n_claims", F.col("score").alias("grounding"), "hallucination", "quality", "confidence")


_c = "(" + " OR ".join(f"contains(lower({{0}}.chunk_text), '{k}')" for k in a.CONTRAST) + ")"
_set = "regexp_extract_all(lower({0}.chunk_text), '[a-z]{{4,}}')"
_r6 = "floor(({}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"
_strip = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_keys = "list_transform(ps, lambda p: lower(regexp_replace(p, '\\s+', ' ', 'g')))"
REFINED_ = f"""conf AS (SELECT x.query_id, count(*) FILTER (x.paper_id <> y.paper_id AND ({_c.format('x')} OR {_c.format('y')}) AND len(list_intersect({_set.format('x')}, {_set.format('y')})) > 0) AS pairs, count(*) AS edges FROM evi x JOIN evi y ON x.query_id = y.query_id AND x.rank < y.rank GROUP BY 1),
{MARKED_}, before AS (SELECT q.query_id, q.answer, p.evidence, q.citations AS cites, q.pieces, coalesce(edges, 0)::BIGINT AS edges, overall AS was, {_r6.format('least(coalesce(pairs, 0)::DOUBLE / greatest(q.pieces, 1), 1.0::DOUBLE)')} AS contradiction,
array_to_string(list_filter([CASE WHEN unsupported_ratio > 0 THEN 'retry_retrieval' END, CASE WHEN q.pieces < 3 THEN 'expand_retrieval' END, CASE WHEN m.contradiction > 0.1::DOUBLE THEN 'inspect_contradictions' END], lambda x: x IS NOT NULL), '|') AS actions FROM qual q JOIN pairs p USING (query_id) JOIN mark m USING (query_id) LEFT JOIN conf USING (query_id)),
ref AS (SELECT * REPLACE (array_to_string(list_concat(list_filter(ps, lambda p, i: list_position({_keys}, {_keys}[i]) = i), CASE WHEN contradiction > 0 THEN ['{c.CAUTION}'] ELSE []::VARCHAR[] END), chr(10) || chr(10)) AS answer) FROM (SELECT *, list_filter(list_transform(string_split(answer, chr(10) || chr(10)), lambda p: {_strip.format('p')}), lambda p: p <> '') AS ps FROM before)),
{judged_sql('ref', '2')}, {quality_sql('2')}"""


@query(f"{RESPONSES_}, {REFINED_} SELECT query_id, md5(q.answer) AS answer_md5, actions, edges, contradiction, q.score AS grounding, {HALLUCINATION_.replace('citations', 'q.citations').replace('pieces', 'q.pieces')} AS hallucination, q.overall AS quality, {_conf.replace('score', 'q.score')} AS confidence, {_r6.format('q.overall - was')} AS gain FROM qual2 q JOIN ref USING (query_id)")
def agentic_answers(spark, sf_dir):
    """Those answers after reflection, the evidence's graph, its contradictions and refinement, judged again."""
    held = written(_evidence(spark, sf_dir))  # read for answers, graph and contradictions
    out = g.post_process(g.judged(a.structured_answers(held)), held)
    return out.select("query_id", F.md5("answer").alias("answer_md5"), "actions", F.col("edges").cast("long").alias("edges"), "contradiction", F.col("score").alias("grounding"), "hallucination", "quality", "confidence", "gain")


@query(RANKED_ + " SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(trim(chunk_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) ORDER BY score DESC, chunk_id) AS same FROM res) WHERE same = 1")
def result_dedup(spark, sf_dir):
    """Each query's results without those whose text a better one has."""
    from pyspark.sql import Window

    same = Window.partitionBy("query_id", t.text_hash(F.col("chunk_text"))).orderBy(F.desc("score"), "chunk_id")
    once = ranked(spark, sf_dir).withColumn("same", F.row_number().over(same)).filter("same = 1")
    return once.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("int").alias("rank"))
