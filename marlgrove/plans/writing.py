"""Report queries: sentences of all documents, and reports for all benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answer as a
from ..operators import report as r
from ..sources.tables import CHUNKS_SQL, chunks, table
from .rag import INTENT_
from .registry import query
from .scores import n_

SENT_ = "list_filter(list_transform(string_split(regexp_replace(chunk_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
GOOD_ = f"length(x) >= 40 AND {n_('=', 'x')} < 2 AND NOT regexp_matches(x, '[{{}}]') AND NOT regexp_matches(x, '(?i)\\b(figure|table)\\s+\\d') AND NOT regexp_matches(x, '\\(\\d+\\)\\s*$') AND {n_(chr(92) + 'p{Nd}', 'x')} <= greatest(floor(length(x) / 5.0::DOUBLE), 12) AND {n_('  ', 'x')} <= 2"


@query(f"WITH {CHUNKS_SQL}, g AS (SELECT chunk_id, list_filter({SENT_}, lambda x: {GOOD_})[1:4] AS s FROM chunks) SELECT chunk_id, unnest(range(len(s)))::INT AS place, unnest(s) AS sentence FROM g")
def evidence_sentences(spark, sf_dir):
    return r.evidence_sentences(chunks(spark, sf_dir))


_ws = f"list_transform(regexp_extract_all(text, '{t.WORD}'), lambda x: lower(x))"


@query(f"SELECT doc_id, (len(g) - len(list_distinct(g)))::INT AS repeated, floor(len(list_distinct(w))::DOUBLE / greatest(len(w), 1) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS diversity FROM (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 2, 1)), lambda k: array_to_string(w[k:k + 3], ' ')) AS g FROM (SELECT doc_id, {_ws} AS w FROM documents))")
def redundancy_metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in r.repetition(F.col("text")).items()])


@query(f"SELECT doc_id, CASE WHEN p <= 10 THEN 0.55::DOUBLE WHEN p <= 24 THEN 0.9::DOUBLE WHEN p <= 34 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS readability FROM (SELECT doc_id, {n_(t.WORD)}::DOUBLE / greatest({n_('[.!?]+')}, 1) AS p FROM documents)")
def readability(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r.readability(F.col("text")).alias("readability"))


@query(f"SELECT conv_id, turn, CASE {INTENT_.format(q='text')} WHEN 'comparison' THEN 'comparison' WHEN 'literature_review' THEN 'literature-review' ELSE 'technical-summary' END AS kind, CASE {INTENT_.format(q='text')} WHEN 'comparison' THEN {len(r.OUTLINES['comparison'])} WHEN 'literature_review' THEN {len(r.OUTLINES['literature-review'])} ELSE {len(r.OUTLINES['technical-summary'])} END::INT AS sections FROM conversations WHERE role = 'user'")
def outline(spark, sf_dir):
    kind = r.report_kind(a.intent(F.col("text")))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", kind.alias("kind"), F.size(r.outline(kind)).alias("sections"))


@query("WITH f AS (SELECT user_id AS report_id, event_type AS paper_id, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT report_id, paper_id, (row_number() OVER (PARTITION BY report_id ORDER BY first, paper_id))::INT AS number FROM f")
def citation_numbers(spark, sf_dir):
    return r.citation_numbers(table(spark, sf_dir, "events").select(F.col("user_id").alias("report_id"), F.col("event_id").alias("place"), F.col("event_type").alias("paper_id")))


@query("WITH w AS (SELECT DISTINCT source, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), n AS (SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY 1) SELECT source, count(*) AS shared_terms FROM (SELECT source, term, count(*) AS k FROM w GROUP BY 1, 2) JOIN n USING (source) WHERE k = n GROUP BY 1")
def shared_terminology(spark, sf_dir):
    """Terms that every language of a source uses."""
    d = table(spark, sf_dir, "documents")
    terms = d.select("source", "lang", F.explode(F.array_distinct(t.found(F.lower("text"), "[a-z]{4,}"))).alias("term")).distinct().groupBy("source", "term").agg(F.count("*").alias("k"))
    sizes = d.groupBy("source").agg(F.countDistinct("lang").alias("n"))
    return terms.join(sizes, "source").filter("k = n").groupBy("source").agg(F.count("*").alias("shared_terms"))
