"""Queries of answering: over all conversation turns, or over the ranked chunks of all benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answer as a
from ..operators import rescue
from ..operators import search as s
from ..sources.tables import CHUNKS_SQL, chunks, table
from .registry import query
from .retrieval import ALL_, HYBRID_, bm25_topk, dense_topk, questions, results_sql, vectors
from .scores import n_


def like_(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"


def list_(parts) -> str:
    return "[" + ", ".join(f"'{p}'" for p in parts) + "]"


INTENT_ = "CASE " + " ".join(f"WHEN {like_('lower({q})', m)} THEN '{k}'" for k, m in a.INTENTS) + " ELSE 'definition' END"
_words = "list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{3,}'), lambda x: x NOT IN ('" + "','".join(a.NO_TOPIC) + "'))"


def first_(listed: str) -> str:
    """SQL: a list's items once each, in order; listed names a column."""
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


#: All topics and entities of a text, in order, some of them several times.
TOPIC_LIST_ = "list_concat(" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {list_((k, *v))} ELSE []::VARCHAR[] END" for k, v in a.ACRONYMS.items()) + f", {_words})"
ENTITY_LIST_ = "regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b(?:[A-Z]{2,}|[A-Z][a-zA-Z0-9\\-]+(?:\\s+[A-Z][a-zA-Z0-9\\-]+)*)\\b')"


def understood_(source: str) -> str:
    """SQL: the source's rows with the intent k, the topics and the entities of their text."""
    ents = f"list_filter(list_transform({first_('el')}, lambda x: trim(regexp_replace(x, '(?i)^(?:compare|define|explain|summarize)\\s+', ''))), lambda x: x <> '' AND lower(x) NOT IN ('" + "','".join(a.NO_TOPIC) + "'))"
    return f"(SELECT *, {INTENT_.format(q='text')} AS k, ({first_('tl')})[1:12] AS topics, {ents} AS ents FROM (SELECT *, {TOPIC_LIST_} AS tl, {ENTITY_LIST_} AS el FROM {source}))"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query(f"SELECT conv_id, turn, {INTENT_.format(q='text')} AS intent, CASE {INTENT_.format(q='text')} WHEN 'definition' THEN 8 WHEN 'comparison' THEN 10 WHEN 'literature_review' THEN 12 ELSE 10 END::INT AS depth FROM conversations")
def query_intent(spark, sf_dir):
    kind = a.intent(F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", kind.alias("intent"), a.depth(kind).alias("depth"))


@query(f"SELECT conv_id, turn, array_to_string(topics, '|') AS topics FROM {understood_('conversations')}")
def query_topics(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(a.topics(F.col("text")), "|").alias("topics"))


@query(f"SELECT conv_id, turn, array_to_string(ents, '|') AS entities FROM {understood_('conversations')}")
def query_entities(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(a.entities(F.col("text")), "|").alias("entities"))


_w = "list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]+'), lambda x: lower(x))"
_terms = "list_concat(" + ", ".join([f"CASE WHEN list_contains(w, '{k}') OR list_contains(w, '{k}s') THEN {list_(v)} ELSE [] END" for k, v in a.EXPANSIONS.items()] + [f"CASE WHEN list_has_any(w, {list_((k, *v))}) THEN {list_((k, *v))} ELSE [] END" for k, v in a.SYNONYMS.items()]) + ")"


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({_terms}, lambda x: NOT contains(lower(text), lower(x))))), '|') AS terms FROM (SELECT *, {_w} AS w FROM conversations)")
def query_expansion(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(a.expanded(F.col("text")), "|").alias("terms"))


EXPANDED_ = f"list_sort(list_distinct(list_filter({_terms}, lambda x: NOT contains(lower(text), lower(x)))))"


@query(f"WITH u AS (SELECT *, {EXPANDED_} AS terms FROM (SELECT *, {_w} AS w FROM {understood_('conversations')})), l AS (SELECT conv_id, turn, list_concat([text], list_transform(terms[1:4], lambda x: text || ' ' || x), CASE WHEN len(ents) > 0 THEN list_transform(terms[1:2], lambda x: array_to_string(ents, ' ') || ' ' || x) ELSE []::VARCHAR[] END) AS l FROM u), f AS (SELECT conv_id, turn, {first_('l')} AS l FROM l) SELECT conv_id, turn, unnest(range(len(l)))::INT AS place, unnest(l) AS sub_query FROM f")
def multi_query(spark, sf_dir):
    """The query itself, with each of its first four expansion terms, and its entities with the first two."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(a.sub_queries(F.col("text"))).alias("place", "sub_query"))


MERGE_ = "u AS (SELECT query_id, chunk_id, score, 0 AS s FROM dense UNION ALL SELECT query_id, chunk_id, score, 1 FROM sparse)"


@query(f"{ALL_}, {MERGE_} SELECT query_id, chunk_id, max(score) AS score, (arg_max(s, score - s * 1e-9))::INT AS from_set FROM u GROUP BY 1, 2")
def max_merge(spark, sf_dir):
    return a.max_merge([dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir)])


@query(f"{ALL_}, {MERGE_} SELECT query_id, chunk_id, arg_min(score, s) AS score, min(s)::INT AS from_set FROM u GROUP BY 1, 2")
def first_wins_merge(spark, sf_dir):
    return a.first_merge([dense_topk(spark, sf_dir), bm25_topk(spark, sf_dir)])


_prior = "CASE " + " ".join(f"WHEN {INTENT_.format(q='text')} = '{i}' AND label = '{k}' THEN {v}::DOUBLE" for i, p in a.PRIORS.items() for k, v in p.items()) + " ELSE 0.0 END"
RANKED_ = f"{HYBRID_}, {results_sql()}"


def ranked(spark, sf_dir):
    """The hybrid results of all benchmark queries with both texts."""
    hits = s.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), texts=True)
    return hits.select("query_id", "rank", "chunk_id", "paper_id", "label", "score", "chunk_text", "text")


@query(RANKED_ + f" SELECT query_id, chunk_id, {_prior} AS section_bonus, least((count(*) FILTER (rank <= 8) OVER (PARTITION BY query_id, paper_id)), 3) * 0.01::DOUBLE AS paper_bonus FROM res")
def section_routing(spark, sf_dir):
    from pyspark.sql import Window

    near = F.sum((F.col("rank") <= 8).cast("int")).over(Window.partitionBy("query_id", "paper_id"))
    return ranked(spark, sf_dir).select("query_id", "chunk_id", a.section_prior(a.intent(F.col("text")), F.col("label")).alias("section_bonus"), (F.least(near, F.lit(3)) * 0.01).alias("paper_bonus"))


_share = "len(list_intersect(regexp_extract_all(lower(text), '{p}'), regexp_extract_all(lower(chunk_text), '{p}')))::DOUBLE / greatest(len(list_distinct(regexp_extract_all(lower(text), '{p}'))), 1)".format(p=a.OVERLAP_WORD)
_add = " + ".join(
    [
        f"CASE WHEN k = 'definition' AND {like_('lower(chunk_text)', (' is ', ' refers to ', ' framework', ' optimization'))} THEN 0.12::DOUBLE ELSE 0 END",
        f"CASE WHEN k = 'comparison' AND {like_('lower(chunk_text)', ('however', 'whereas', 'compared', 'in contrast'))} THEN 0.10::DOUBLE ELSE 0 END",
        "CASE WHEN k = 'methodology_explanation' AND label IN ('methods', 'methodology') THEN 0.10::DOUBLE ELSE 0 END",
        "CASE WHEN len(list_filter(ents[1:3], lambda x: contains(lower(chunk_text), lower(x)))) > 0 THEN 0.08::DOUBLE ELSE 0 END",
        "CASE WHEN k = 'definition' AND label IN ('abstract', 'introduction') THEN 0.08::DOUBLE ELSE 0 END",
        "CASE WHEN k IN ('comparison', 'benchmark_performance') AND label IN ('results', 'discussion', 'experiments') THEN 0.08::DOUBLE ELSE 0 END",
    ]
)


def ans_sql(source: str, x: str = "", known: bool = False) -> str:
    """SQL: the rows of source with their answerability, as ans with the ending x; known: source has intents, topics and entities."""
    return f"ans{x} AS (SELECT *, floor(least(1.0::DOUBLE, {_share} + {_add}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS answerability FROM {source if known else understood_(source)})"


ANSWERABLE_ = f"{RANKED_}, {ans_sql('res')}"


def answerable(spark, sf_dir):
    return a.with_answerability(ranked(spark, sf_dir))


@query(ANSWERABLE_ + " SELECT query_id, chunk_id, answerability FROM ans")
def answerability(spark, sf_dir):
    return answerable(spark, sf_dir).select("query_id", "chunk_id", "answerability")


@query(ANSWERABLE_ + " SELECT query_id, chunk_id FROM (SELECT *, max(answerability) OVER (PARTITION BY query_id) AS top FROM ans) WHERE answerability >= 0.15::DOUBLE OR top < 0.15::DOUBLE")
def answerability_filter(spark, sf_dir):
    return a.keep_answerable(answerable(spark, sf_dir)).select("query_id", "chunk_id")


_fits = "CASE WHEN (k IN ('definition', 'methodology_explanation') AND label IN ('abstract', 'introduction', 'methodology', 'methods')) OR (k IN ('comparison', 'benchmark_performance') AND label IN ('results', 'discussion')) THEN 0.15::DOUBLE ELSE 0.0 END"


_cites = f"least(round({n_(t.CITATION_MARK, 'chunk_text')}::DOUBLE / greatest({n_(t.WORD, 'chunk_text')}, 1), 6) * 10, 1.0::DOUBLE) * 0.10::DOUBLE"
_bonus = f"({_cites} + {_fits} + CASE WHEN len(list_filter(topics[1:6], lambda x: contains(lower(chunk_text), lower(x)))) > 0 THEN 0.20::DOUBLE ELSE 0.0 END)"


def prec_sql(x: str = "") -> str:
    return f"prec{x} AS (SELECT *, floor((score + answerability * 0.30::DOUBLE + {_bonus}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS precision_score FROM ans{x})"


PRECISE_ = f"{ANSWERABLE_}, {prec_sql()}"


@query(PRECISE_ + " SELECT query_id, chunk_id, precision_score FROM prec")
def precision_rerank(spark, sf_dir):
    return a.with_precision(answerable(spark, sf_dir)).select("query_id", "chunk_id", "precision_score")


RESCUE_ = f"resc AS (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM (SELECT query_id, chunk_id, floor((0.9::DOUBLE + 0.15::DOUBLE * sum(w)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM (SELECT query_id, term, CASE WHEN contains(term, ' ') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM (SELECT query_id, unnest(list_transform(list_concat(ents, {EXPANDED_}, topics), lambda x: lower(trim(x)))) AS term FROM (SELECT *, {_w} AS w FROM {understood_('qs')})) WHERE term <> '') JOIN (SELECT chunk_id, lower(label || chr(10) || chunk_text) AS body FROM chunks) ON contains(body, term) GROUP BY 1, 2) QUALIFY rank <= 10)"


@query(f"WITH {CHUNKS_SQL}, qs AS (SELECT item_id AS query_id, text FROM benchmark), {RESCUE_} SELECT query_id, chunk_id, score, rank FROM resc")
def lexical_rescue(spark, sf_dir):
    """Each query's best chunks by the entities, expansion terms and topics that section and text hold somewhere."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rescue.lexical_rescue(chunks(spark, sf_dir), asked)


def answers(spark, sf_dir):
    """query_id, answer, evidence, citations, pieces: each query's best sentences of its first chunks, cited, and what all its chunks say."""
    return a.structured_answers(ranked(spark, sf_dir))


_cl = f"list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_ws = f"list_filter(list_distinct(regexp_extract_all(lower(c), '{a.CLAIM_WORD}')), lambda x: length(x) > 3)"
_sn = "list_filter(list_transform(string_split(regexp_replace(chunk_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_hits = f"len(list_intersect(list_distinct(regexp_extract_all(lower(text), '{a.OVERLAP_WORD}')), regexp_extract_all(lower(s), '{a.OVERLAP_WORD}')))"


def answers_sql(source: str) -> str:
    """Answers from the ranked chunks of the table source, their claims, and grounding, in the tables bs, pairs, cl, sup, g and gr."""
    return f"""bs AS (SELECT * FROM (SELECT query_id, rank, paper_id, label, text, unnest(range(len({_sn}))) AS i, unnest({_sn}) AS s FROM {source} WHERE rank <= 4) QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY {_hits} DESC, length(s) DESC, i) = 1),
pairs AS (SELECT * FROM (SELECT query_id, string_agg(s || ' [' || paper_id || ' §' || label || ']', ' ' ORDER BY rank) AS answer, count(DISTINCT paper_id || ' §' || label) AS cites FROM bs GROUP BY 1) JOIN (SELECT query_id, string_agg(substr(chunk_text, 1, 900), chr(10) ORDER BY rank) AS evidence, count(*) AS pieces FROM {source} GROUP BY 1) USING (query_id))""" + ", " + judged_sql()


def judged_sql(source: str = "pairs", x: str = "") -> str:
    """Claims and grounding of the answers in the table source, in the tables cl, sup, g and gr with the ending x."""
    return f"""cl{x} AS (SELECT query_id, answer, cites, pieces, lower(evidence) AS ev, len({_cl}) AS n, unnest({_cl}) AS c FROM {source}), sup{x} AS (SELECT query_id, answer, cites, pieces, n, len(list_filter({_ws}, lambda w: contains(ev, w)))::DOUBLE / greatest(len({_ws}), 1) >= 0.35::DOUBLE AS ok FROM cl{x}),
g{x} AS (SELECT query_id, any_value(answer) AS answer, any_value(cites) AS cites, any_value(pieces) AS pieces, any_value(n) AS n, sum(ok::INT)::DOUBLE / greatest(any_value(n), 1) AS share FROM sup{x} GROUP BY 1),
gr{x} AS (SELECT query_id, answer, cites::BIGINT AS citations, pieces::BIGINT AS pieces, n::INT AS n_claims, least(cites::DOUBLE / greatest(n, 1), 1.0::DOUBLE) AS coverage, floor((1 - share) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS unsupported_ratio, floor((share * 0.55::DOUBLE + least(cites::DOUBLE / greatest(n, 1), 1.0::DOUBLE) * 0.25::DOUBLE + least(pieces::DOUBLE / greatest(n, 1), 1.0::DOUBLE) * 0.20::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS score FROM g{x})"""


ANSWERS_ = f"{RANKED_}, {answers_sql('res')}"


#: The share of an answer's claims that mark a contrast.
MARKED_ = "mark AS (SELECT query_id, floor(least(sum((contains(lower(c), 'however') OR contains(lower(c), 'in contrast') OR contains(lower(c), 'whereas') OR contains(lower(c), 'but'))::INT)::DOUBLE / greatest(any_value(n), 1), 1.0::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS contradiction FROM cl GROUP BY 1)"


def grounded(spark, sf_dir):
    return a.with_grounding(answers(spark, sf_dir))


@query(ANSWERS_ + " SELECT query_id, n_claims, unsupported_ratio, score FROM gr")
def grounding(spark, sf_dir):
    return grounded(spark, sf_dir).select("query_id", "n_claims", "unsupported_ratio", "score")


HALLUCINATION_ = "floor(least(1.0::DOUBLE, unsupported_ratio * 0.55::DOUBLE + (1 - coverage) * 0.25::DOUBLE + (1 - least(citations::DOUBLE / greatest(pieces, 1), 1.0::DOUBLE)) * 0.20::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


@query(ANSWERS_ + f" SELECT query_id, {HALLUCINATION_} AS hallucination FROM gr")
def hallucination(spark, sf_dir):
    return grounded(spark, sf_dir).select("query_id", a.hallucination(F.col("unsupported_ratio"), F.col("coverage"), F.col("citations"), F.col("pieces")).alias("hallucination"))


_r6 = "floor(({}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def quality_sql(x: str = "") -> str:
    """The quality of the grounded answers in gr with the ending x, in the tables w, v, y and qual."""
    return f"""w{x} AS (SELECT *, list_transform(regexp_extract_all(answer, '{t.WORD}'), lambda x: lower(x)) AS ws FROM gr{x}), v{x} AS (SELECT *, greatest(0.0::DOUBLE, 1 - len(list_distinct(ws))::DOUBLE / greatest(len(ws), 1)) AS red, least(len(ws) / 120.0::DOUBLE, 1.0::DOUBLE) AS comp, greatest(0.0::DOUBLE, 1 - unsupported_ratio) AS fact, citations::DOUBLE / greatest(len(ws), 1) AS dens FROM w{x}), y{x} AS (SELECT *, comp * 0.4::DOUBLE + (1 - red) * 0.2::DOUBLE + dens * 10 * 0.2::DOUBLE + fact * 0.2::DOUBLE AS syn FROM v{x}),
qual{x} AS (SELECT *, {_r6.format('red')} AS redundancy, {_r6.format('comp')} AS completeness, {_r6.format('least(syn, 1.0::DOUBLE)')} AS synthesis, {_r6.format('least(dens * 6 * 0.1::DOUBLE + score * 0.30::DOUBLE + comp * 0.15::DOUBLE + (1 - red) * 0.15::DOUBLE + fact * 0.25::DOUBLE + score * 0.20::DOUBLE + syn * 0.05::DOUBLE, 1.0::DOUBLE)')} AS overall FROM y{x})"""


QUALITY_ = quality_sql()


@query(f"{ANSWERS_}, {QUALITY_} SELECT query_id, redundancy, completeness, synthesis, overall FROM qual")
def answer_quality(spark, sf_dir):
    return grounded(spark, sf_dir).select("query_id", *[c.alias(k) for k, c in a.answer_quality(F.col("answer"), F.col("citations"), F.col("score"), F.col("unsupported_ratio")).items()])


@query(RANKED_ + " SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, CASE WHEN x.paper_id = y.paper_id THEN 'same_paper' ELSE 'cross_paper' END AS relation, CASE WHEN x.paper_id = y.paper_id THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM res x JOIN res y ON x.query_id = y.query_id AND x.rank < y.rank")
def evidence_pairs(spark, sf_dir):
    return a.evidence_pairs(ranked(spark, sf_dir))


_c = like_("lower({}.chunk_text)", a.CONTRAST)


@query(RANKED_ + f" SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b FROM res x JOIN res y ON x.query_id = y.query_id AND x.rank < y.rank WHERE x.paper_id <> y.paper_id AND ({_c.replace('{}', 'x')} OR {_c.replace('{}', 'y')}) AND len(list_intersect(regexp_extract_all(lower(x.chunk_text), '[a-z]{{4,}}'), regexp_extract_all(lower(y.chunk_text), '[a-z]{{4,}}'))) > 0")
def contradictions(spark, sf_dir):
    return a.contradictions(ranked(spark, sf_dir))


@query(RANKED_ + " SELECT query_id, chunk_id, chars FROM (SELECT *, sum(length(chunk_text)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS chars FROM res) WHERE rank = 1 OR chars <= 16000")
def prompt_packing(spark, sf_dir):
    return a.pack_prompts(ranked(spark, sf_dir).select("query_id", "rank", "chunk_id", F.col("chunk_text").alias("text"))).select("query_id", "chunk_id", "chars")


_two = f"array_to_string(({_sn})[1:2], ' ')"


def compressed_sql(source: str, score: str) -> str:
    """The greedy choice among each query's rows of the table source by score, in the tables mrows, mfold and mkept (query_id, place, chunk_id)."""
    alike = "coalesce(list_max(list_transform(ktoks, lambda k: CASE WHEN len(k) = 0 OR len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(k, w))::DOUBLE / len(list_distinct(list_concat(k, w))) END)), 0.0::DOUBLE)"
    drop = f"(f.r > 0 AND ({alike} > 0.72::DOUBLE OR m.score * 0.7::DOUBLE - {alike} * 0.3::DOUBLE < 0))"
    return f"""mrows AS (SELECT query_id, chunk_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS r, count(*) OVER (PARTITION BY query_id) AS size, list_distinct(regexp_extract_all(lower({_two}), '{a.OVERLAP_WORD}')) AS w FROM {source}),
mfold AS (SELECT DISTINCT query_id, size, 0::BIGINT AS r, []::BIGINT[] AS kept, []::VARCHAR[][] AS ktoks FROM mrows UNION ALL SELECT f.query_id, f.size, m.r, CASE WHEN {drop} THEN kept ELSE list_append(kept, m.chunk_id) END, CASE WHEN {drop} THEN ktoks ELSE list_append(ktoks, w) END FROM mfold f JOIN mrows m ON m.query_id = f.query_id AND m.r = f.r + 1),
mkept AS (SELECT query_id, unnest(range(len(k)))::INT AS place, unnest(k) AS chunk_id FROM (SELECT query_id, kept[1:greatest(1, floor(size * 0.5::DOUBLE)::BIGINT)] AS k FROM mfold WHERE r = size))"""


def recursive_(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive_(f"{PRECISE_}, {compressed_sql('prec', 'precision_score')} SELECT query_id, place, chunk_id FROM mkept"))
def mmr_compress(spark, sf_dir):
    return a.compress(a.with_precision(answerable(spark, sf_dir)).withColumn("score", F.col("precision_score")))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY 1")
def session_rollup(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    last = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return a.sessions(turns).select("conv_id", "turns").join(last, "conv_id")


@query(f"""WITH u AS (SELECT conv_id, turn, topics, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS turns FROM {understood_("(SELECT * FROM conversations WHERE role = 'user')")}),
l AS (SELECT conv_id, any_value(turns) AS turns, flatten(list(topics ORDER BY turn)) AS l FROM u WHERE back <= 20 GROUP BY 1) SELECT conv_id, turns, array_to_string(({first_('l')})[1:12], '|') AS topics FROM l""")
def session_topics(spark, sf_dir):
    return a.sessions(_turns(spark, sf_dir)).select("conv_id", "turns", F.array_join("topics", "|").alias("topics"))
