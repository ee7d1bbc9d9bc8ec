"""Queries of writing: sentences of all documents made fit for prose, and reports on all benchmark passages section by section."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answer as a
from ..operators import report as r
from ..operators import writer as w
from ..sources.tables import CHUNKS_SQL, chunks, table
from .agentic import searcher
from .rag import _w, EXPANDED_, INTENT_, RANKED_, first_, like_, list_, ranked, recursive_, understood_
from .registry import query
from .retrieval import questions, search_sql
from .scores import n_
from .writing import GOOD_, SENT_

_kind = "CASE " + " ".join(f"WHEN {like_('lower(title)', marks)}{' OR k = ' + repr('comparison') if name == 'comparison' else ''} THEN '{name}'" for name, marks in w.SECTION_KINDS) + " ELSE 'analysis' END"
_roles = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in w.ROLES.items()) + " END"
_titles = f"CASE k WHEN 'comparison' THEN {list_(r.OUTLINES['comparison'])} WHEN 'literature_review' THEN {list_(r.OUTLINES['literature-review'])} ELSE {list_(r.OUTLINES['technical-summary'])} END"


@query(f"SELECT *, {_roles} AS roles FROM (SELECT conv_id, turn, place, title, {_kind} AS kind FROM (SELECT conv_id, turn, k, unnest(range(len(ts)))::INT AS place, unnest(ts) AS title FROM (SELECT *, {_titles} AS ts FROM (SELECT conv_id, turn, {INTENT_.format(q='text')} AS k FROM conversations WHERE role = 'user'))))")
def rhetorical_plan(spark, sf_dir):
    intent = a.intent(F.col("text"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", intent.alias("k"), F.posexplode(r.outline(r.report_kind(intent))).alias("place", "title"))
    return turns.select("conv_id", "turn", "place", "title", w.section_kind(F.col("title"), F.col("k")).alias("kind"), F.array_join(w.roles(w.section_kind(F.col("title"), F.col("k"))), "|").alias("roles"))


_flat = "trim(regexp_replace(sentence, '\\s+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_art = f"CASE WHEN s = '' THEN 'broken' WHEN regexp_matches(s, '{w.FORMULA}') THEN 'formula' WHEN regexp_matches(s, '{w.TABLE}') OR {n_(chr(92) + 'd', 's')}::DOUBLE / greatest(length(s), 1) > {w.DIGITS}::DOUBLE THEN 'table' WHEN {n_(chr(92) + '|', 's')} >= 2 OR {n_(chr(92) + '.' + chr(92) + '.' + chr(92) + '.', 's')} >= 2 THEN 'broken' END"
_prose = f"CASE kind WHEN 'formula' THEN CASE WHEN {like_('lower(s)', ('loss', 'objective', 'optimiz'))} THEN '{w.SAID_OBJECTIVE}' ELSE '{w.SAID_FORMULA}' END WHEN 'table' THEN CASE WHEN {like_('lower(s)', ('benchmark', 'dataset', 'accuracy', 'reward', 'score'))} THEN '{w.SAID_RESULTS}' ELSE '{w.SAID_TABLE}' END WHEN 'broken' THEN '' ELSE s END"
_plain = "regexp_replace(regexp_replace(prose, '\\[[^\\]]+\\]', '', 'g'), '\\(\\s*[A-Z][A-Za-z]+(?:\\s+et al\\.)?,?\\s*\\d{4}[a-z]?\\s*\\)', '', 'g')"
for _old, _new in (*w.LEADS, *w.MILD):
    _plain = f"regexp_replace({_plain}, '(?i){_old}', '{_new}', 'g')"
_plain = f"trim(regexp_replace({_plain}, '\\s+', ' ', 'g'), ' ,;')"
PROSE_ = f"WITH {CHUNKS_SQL}, g AS (SELECT chunk_id, list_filter({SENT_}, lambda x: {GOOD_})[1:4] AS s FROM chunks), e AS (SELECT chunk_id, unnest(range(len(s)))::INT AS place, unnest(s) AS sentence FROM g), f AS (SELECT *, {_art} AS kind FROM (SELECT *, {_flat} AS s FROM e)), p AS (SELECT *, {_prose} AS prose FROM f)"


@query(f"{PROSE_} SELECT chunk_id, place, coalesce(kind, 'prose') AS kind, prose FROM p")
def normalised_sentences(spark, sf_dir):
    s = F.col("sentence")
    return r.evidence_sentences(chunks(spark, sf_dir)).select("chunk_id", "place", F.coalesce(w.artefact(s), F.lit("prose")).alias("kind"), w.normalised(s).alias("prose"))


@query(f"{PROSE_} SELECT chunk_id, place, CASE WHEN x = '' OR regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END AS said FROM (SELECT chunk_id, place, {_plain} AS x FROM p)")
def paraphrased_sentences(spark, sf_dir):
    return r.evidence_sentences(chunks(spark, sf_dir)).select("chunk_id", "place", w.paraphrased(w.normalised(F.col("sentence"))).alias("said"))


def _jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


#: Evidence sentences of the ranked chunks, their clusters, and those that are new.
EVIDENCE_ = f"""evs AS (SELECT query_id AS group_id, rank * 10 + i AS place, paper_id, score, s FROM (SELECT query_id, rank, paper_id, score, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT *, list_filter({SENT_}, lambda x: {GOOD_})[1:4] AS ss FROM res))),
evr AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '[a-z]{{3,}}')) AS w, row_number() OVER (PARTITION BY group_id ORDER BY place) AS r, count(*) OVER (PARTITION BY group_id) AS size FROM evs)"""
_at = f"coalesce(list_position(list_transform(anchors, lambda k: {_jaccard('k', 'w')} >= 0.32::DOUBLE), true), 0)"
CLUSTERS_ = f"""cfold AS (SELECT DISTINCT group_id, size, 0::BIGINT AS r, []::VARCHAR[][] AS anchors, []::BIGINT[] AS part FROM evr UNION ALL SELECT f.group_id, f.size, e.r, CASE WHEN {_at} > 0 THEN anchors ELSE list_append(anchors, w) END, list_append(part, CASE WHEN {_at} > 0 THEN {_at} ELSE len(anchors) + 1 END) FROM cfold f JOIN evr e ON e.group_id = f.group_id AND e.r = f.r + 1),
clus AS (SELECT e.group_id, e.place, e.s, e.score, part[e.r]::INT AS cluster FROM evr e JOIN (SELECT * FROM cfold WHERE r = size) f USING (group_id))"""
_new = f"1 - coalesce(list_max(list_transform(ktoks, lambda k: {_jaccard('k', 'w')})), 0.0::DOUBLE) >= 0.28::DOUBLE"
NOVEL_ = f"""nfold AS (SELECT DISTINCT group_id, size, 0::BIGINT AS r, []::BIGINT[] AS places, []::VARCHAR[][] AS ktoks FROM evr UNION ALL SELECT f.group_id, f.size, e.r, CASE WHEN {_new} THEN list_append(places, e.place) ELSE places END, CASE WHEN {_new} THEN list_append(ktoks, w) ELSE ktoks END FROM nfold f JOIN evr e ON e.group_id = f.group_id AND e.r = f.r + 1),
novel AS (SELECT group_id, unnest(places)::INT AS place FROM nfold WHERE r = size)"""


def _lines(spark, sf_dir):
    """Each query's ranked evidence sentences: group_id, place, paper_id, score, sentence."""
    found = r.evidence_sentences(ranked(spark, sf_dir).select(F.struct("query_id", "rank", "paper_id", "score").alias("chunk_id"), "chunk_text"))
    return found.select(F.col("chunk_id.query_id").alias("group_id"), (F.col("chunk_id.rank") * 10 + F.col("place")).alias("place"), F.col("chunk_id.paper_id").alias("paper_id"), F.col("chunk_id.score").alias("score"), "sentence")


@query(recursive_(f"{RANKED_}, {EVIDENCE_}, {CLUSTERS_} SELECT group_id, place::INT AS place, cluster FROM clus"))
def evidence_clusters(spark, sf_dir):
    return r.clusters(_lines(spark, sf_dir))


@query(recursive_(f"{RANKED_}, {EVIDENCE_}, {NOVEL_} SELECT group_id, place FROM novel"))
def claim_novelty(spark, sf_dir):
    return r.novel(_lines(spark, sf_dir))


_near = f"len(list_filter(ktoks, lambda k: {_jaccard('k', 'w')} >= 0.55::DOUBLE)) > 0"


@query(recursive_(f"""{RANKED_}, {EVIDENCE_}, {CLUSTERS_}, ones AS (SELECT group_id, cluster, arg_min(s, place) AS anchor, max(score) AS score, count(*) AS members FROM clus GROUP BY 1, 2),
onr AS (SELECT *, list_distinct(regexp_extract_all(lower(anchor), '[a-z]{{3,}}')) AS w, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, members DESC, cluster) AS r, count(*) OVER (PARTITION BY group_id) AS size FROM ones),
afold AS (SELECT DISTINCT group_id, size, 0::BIGINT AS r, []::INT[] AS kept, []::VARCHAR[][] AS ktoks FROM onr UNION ALL SELECT f.group_id, f.size, o.r, CASE WHEN {_near} THEN kept ELSE list_append(kept, o.cluster) END, CASE WHEN {_near} THEN ktoks ELSE list_append(ktoks, w) END FROM afold f JOIN onr o ON o.group_id = f.group_id AND o.r = f.r + 1)
SELECT k.group_id, place, cluster, anchor, members FROM (SELECT group_id, unnest(range(least(8, len(kept))))::INT AS place, unnest(kept[1:8]) AS cluster FROM afold WHERE r = size) k JOIN ones USING (group_id, cluster)"""))
def claim_anchors(spark, sf_dir):
    """The anchors of each query's clusters, best first, without those too like a better one."""
    lines = _lines(spark, sf_dir)
    return w.anchors(r.clusters(lines).join(lines, ["group_id", "place"]))


REPORTS_ = f"""{EVIDENCE_}, {NOVEL_}, kept AS (SELECT e.group_id, e.place, e.paper_id, e.s FROM evr e JOIN novel n ON n.group_id = e.group_id AND n.place = e.place),
num AS (SELECT group_id, paper_id, row_number() OVER (PARTITION BY group_id ORDER BY min(place), paper_id) AS number FROM kept GROUP BY 1, 2),
md AS (SELECT group_id AS report_id, '## Evidence' || chr(10) || chr(10) || string_agg(s || ' [' || number || ']', chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || (SELECT string_agg('[' || number || '] ' || paper_id, chr(10) ORDER BY number) FROM num WHERE num.group_id = kept.group_id) || chr(10) AS markdown FROM kept JOIN num USING (group_id, paper_id) GROUP BY group_id)"""


@query(recursive_(f"{RANKED_}, {REPORTS_} SELECT report_id, markdown FROM md"))
def reports(spark, sf_dir):
    kept = _lines(spark, sf_dir)
    fresh = kept.join(r.novel(kept), ["group_id", "place"])
    return r.draft(fresh.withColumnRenamed("group_id", "report_id"))


_mw = "list_transform(regexp_extract_all(markdown, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))"


@query(recursive_(f"{RANKED_}, {REPORTS_} SELECT report_id, len(ws)::INT AS words, floor(len(list_distinct(ws))::DOUBLE / greatest(len(ws), 1) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS diversity, (len(g) - len(list_distinct(g)))::INT AS repeated, CASE WHEN p <= 10 THEN 0.55::DOUBLE WHEN p <= 24 THEN 0.9::DOUBLE WHEN p <= 34 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS readability FROM (SELECT *, list_transform(range(1, greatest(len(ws) - 2, 1)), lambda k: array_to_string(ws[k:k + 3], ' ')) AS g, len(ws)::DOUBLE / greatest({n_('[.!?]+', 'markdown')}, 1) AS p FROM (SELECT *, {_mw} AS ws FROM md))"))
def writer_evaluation(spark, sf_dir):
    """Words, diversity, repetition and readability of every report."""
    from ..functions import text as t

    c = F.col("markdown")
    rep = r.repetition(c)
    return reports(spark, sf_dir).select("report_id", t.count(c, t.WORD).alias("words"), rep["diversity"].alias("diversity"), rep["repeated"].alias("repeated"), r.readability(c).alias("readability"))


def _evidence(spark, sf_dir):
    return w.section_evidence(searcher(spark, sf_dir), w.plans(questions(spark, sf_dir)))


_said = f"list_concat([text], list_transform(more[1:4], lambda x: text || ' ' || x), CASE WHEN len(ents) > 0 THEN list_transform(more[1:2], lambda x: array_to_string(ents, ' ') || ' ' || x) ELSE []::VARCHAR[] END)"
_marked = "(" + " OR ".join(f"contains(lower({{0}}.chunk_text), '{x}')" for x in a.CONTRAST) + ")"
#: Sections of all reports, the forms of their queries, and their best chunks.
SECTIONS_ = f"""su AS (SELECT *, {EXPANDED_} AS more FROM (SELECT *, {_w} AS w FROM {understood_('qs')})), sl AS (SELECT *, {_said} AS l, list_concat(ents, topics) AS tt, {_titles} AS ts FROM su),
secs AS (SELECT query_id AS q, base, text, k, ({first_('l')})[1:3] AS subs, ({first_('tt')})[1:6] AS terms, unnest(range(len(ts))) AS place, unnest(ts) AS title FROM sl),
sf AS (SELECT *, list_concat([title || ' ' || text], list_transform(subs, lambda x: title || ' ' || x)) AS fl FROM secs), qss AS (SELECT (q * 10 + place) * 10 + i AS query_id, base, f AS text FROM (SELECT q, place, base, unnest(range(len({first_('fl')}))) AS i, unnest({first_('fl')}) AS f FROM sf)),
{search_sql('s')},
sbest AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id // 10 AS section, chunk_id, max(score) AS score, any_value(paper_id) AS paper_id, any_value(label) AS label, any_value(chunk_text) AS chunk_text FROM ress GROUP BY 1, 2) QUALIFY rank <= 8),
spair AS (SELECT x.section, count(*) AS pairs FROM sbest x JOIN sbest y ON x.section = y.section AND x.rank < y.rank AND y.rank <= 6 AND x.paper_id <> y.paper_id WHERE {_marked.format('x')} OR {_marked.format('y')} GROUP BY 1),
sev AS (SELECT section, string_agg(chunk_id, '|' ORDER BY rank) AS chunk_ids, list(lower(label || ' ' || chunk_text)) FILTER (rank <= 6) AS bodies, count(*) FILTER (rank <= 6) AS six FROM sbest GROUP BY 1)"""
_found = "len(list_filter(terms, lambda x: len(list_filter(bodies, lambda b: contains(b, lower(x)))) > 0))"


@query(f"{RANKED_}, {SECTIONS_} SELECT q AS query_id, place::INT AS place, title, {_kind} AS kind, chunk_ids, CASE WHEN len(terms) > 0 THEN floor({_found}::DOUBLE / len(terms) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE ELSE 0.0 END AS coverage, floor(least(coalesce(pairs, 0)::DOUBLE / greatest(six, 1), 1.0::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS conflict FROM secs JOIN sev ON sev.section = q * 10 + place LEFT JOIN spair ON spair.section = sev.section")
def section_evidence(spark, sf_dir):
    """The chunks of every section of every report, how many of its terms they hold, and how far they conflict."""
    hits = F.array_join(F.transform("hits", lambda h: h["chunk_id"].cast("string")), "|")
    return _evidence(spark, sf_dir).select("query_id", "place", "title", "kind", hits.alias("chunk_ids"), "coverage", "conflict")


@query()
def section_drafts(spark, sf_dir):
    return w.drafts(_evidence(spark, sf_dir)).select("query_id", "place", F.size("claims").alias("claims"), F.md5("answer").alias("content_md5"), "citations", "pieces", "score", "quality", F.array_join("gaps", "|").alias("gaps"))


@query()
def revised_sections(spark, sf_dir):
    return w.revise(w.drafts(_evidence(spark, sf_dir))).select("query_id", "place", F.md5("answer").alias("content_md5"), "score", "quality", "gain", "overlap", "coherence")


@query()
def writer_memory(spark, sf_dir):
    """What each report remembers: claims, sources, terms, gaps, and its sections' measures."""
    kept = w.memory(w.revise(w.drafts(_evidence(spark, sf_dir))))
    return kept.select("query_id", F.size("claim_memory").alias("claims"), F.size("citation_reuse").alias("sources"), F.size("terminology").alias("terms"), F.array_join("unresolved_gaps", "|").alias("gaps"), F.size("section_quality").alias("sections"), F.aggregate(F.map_values("section_quality"), F.lit(0.0), lambda s, x: s + x).alias("quality"))


@query()
def assembled_reports(spark, sf_dir):
    out = w.assembled(w.revise(w.drafts(_evidence(spark, sf_dir))))
    return out.select("report_id", "sections", "abstract", F.md5("markdown").alias("markdown_md5"))
