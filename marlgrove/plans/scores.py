"""Scores of texts, each over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.tables import table
from .registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def n_(p: str, c: str = "text") -> str:
    """SQL: matches of a pattern."""
    return f"len(regexp_extract_all({c}, '{p}'))"


def unit_(x: str, digits: int = 6) -> str:
    return f"(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x})) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE)"


def in_(words: list[str]) -> str:
    return "('" + "','".join(words) + "')"


STRIP_ = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORD_ = t.WORD
ALL_LINES_ = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP_.format('x')}), lambda x: x <> '')"
RAW_LINES_ = f"list_filter(string_split(text, chr(10)), lambda x: {STRIP_.format('x')} <> '')"


def with_(test: str, all_: str = "ls") -> str:
    return f"(CASE WHEN len({all_}) > 0 THEN len(list_filter({all_}, lambda x: {test}))::DOUBLE / len({all_}) ELSE 0.0 END)"


@query("SELECT doc_id, greatest(1, floor(" + n_(r"\S+") + " * 1.25::DOUBLE))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, sha256({STRIP_.format('text')}) AS text_hash, sha256(text) AS raw_hash FROM documents")
def text_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.text_hash(F.col("text")).alias("text_hash"), F.sha2("text", 256).alias("raw_hash"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug, replace(url, '/', '_') AS safe_id FROM (SELECT page_id, url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages)")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.slug(F.col("url")).alias("slug"), t.safe_id(F.col("url")).alias("safe_id"))


DENSITY_CHUNKER_ = f"""SELECT doc_id, CASE WHEN len(tok) = 0 THEN 0.0 ELSE floor(10000.0::DOUBLE * least(1.0::DOUBLE,
  len(list_distinct(con))::DOUBLE / greatest(len(con), 1) * 0.5::DOUBLE + len(list_filter(con, lambda x: length(x) >= 6))::DOUBLE / greatest(len(con), 1) * 0.35::DOUBLE
  + least(1.0::DOUBLE, digits / 20.0::DOUBLE) * 0.15::DOUBLE) + 0.5::DOUBLE) / 10000.0::DOUBLE END AS density
FROM (SELECT doc_id, tok, list_filter(list_transform(tok, lambda x: lower(x)), lambda x: x NOT IN {in_(t.STOP_CHUNK)}) AS con, digits
  FROM (SELECT doc_id, regexp_extract_all(text, '{t.LONG_WORD}') AS tok, {n_(chr(92) + 'd')} AS digits FROM documents))"""


@query(DENSITY_CHUNKER_)
def density_chunker(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.density_chunker(F.col("text")).alias("density"))


DENSITY_QUALITY_ = f"""SELECT doc_id, CASE WHEN len(lex) = 0 THEN 0.0 ELSE {unit_(f'''
  len(list_filter(lex, lambda x: x NOT IN {in_(t.STOP_QUALITY)}))::DOUBLE / len(lex) * 0.35::DOUBLE + len(list_distinct(lex))::DOUBLE / len(lex) * 0.25::DOUBLE
  + len(list_filter(lex, lambda x: length(x) >= 6))::DOUBLE / len(lex) * 0.20::DOUBLE + least(len(lex)::DOUBLE / (sent * 18), 1.0::DOUBLE) * 0.20::DOUBLE''')} END AS semantic_density
FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '{t.TOKEN}'), lambda x: regexp_matches(x, '[A-Za-z]')), lambda x: lower(x)) AS lex, greatest({n_('[.!?]+')}, 1) AS sent FROM documents)"""


@query(DENSITY_QUALITY_)
def density_quality(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.density_quality(F.col("text")).alias("semantic_density"))


ENTROPY_ = f"""SELECT d.doc_id, coalesce(e.language_entropy, 0.0) AS language_entropy FROM documents d LEFT JOIN (
 SELECT doc_id, CASE WHEN count(*) <= 1 THEN 0.0 ELSE {unit_("sum(-p * log2(p)) / log2(least(26, count(*))::DOUBLE)")} END AS language_entropy
 FROM (SELECT doc_id, ch, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}')) AS ch FROM documents) GROUP BY doc_id, ch) GROUP BY doc_id) e USING (doc_id)"""


@query(ENTROPY_)
def language_entropy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.language_entropy(F.col("text")).alias("language_entropy"))


ASL_ = f"""SELECT doc_id, CASE WHEN len(s) = 0 THEN 0.0 ELSE round(list_sum(list_transform(s, lambda x: {n_(t.TOKEN, 'x')}))::DOUBLE / len(s), 6) END AS average_sentence_length
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: {STRIP_.format('x')}), lambda x: x <> '') AS s FROM documents)"""


@query(ASL_)
def average_sentence_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.average_sentence_length(F.col("text")).alias("average_sentence_length"))


RATIOS_ = f"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN {n_(chr(92) + 'p{Nd}')}::DOUBLE / length(text) ELSE 0 END, 6) AS numeric_ratio, round(CASE WHEN length(text) > 0 THEN {n_(chr(92) + 'p{L}')}::DOUBLE / length(text) ELSE 0 END, 6) AS alphabetic_ratio FROM documents"


@query(RATIOS_)
def char_ratios(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.numeric_ratio(F.col("text")).alias("numeric_ratio"), t.alphabetic_ratio(F.col("text")).alias("alphabetic_ratio"))


DUP_ = f"SELECT doc_id, round(CASE WHEN len(ls) > 0 THEN (len(ls) - len(list_distinct(ls)))::DOUBLE / len(ls) ELSE 0.0 END, 6) AS duplicate_line_ratio FROM (SELECT doc_id, {ALL_LINES_} AS ls FROM documents)"


@query(DUP_)
def duplicate_line_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.duplicate_line_ratio(F.col("text")).alias("duplicate_line_ratio"))


@query(f"SELECT doc_id, round({n_(t.CITATION_MARK)}::DOUBLE / greatest({n_(WORD_)}, 1), 6) AS citation_density, round({n_(t.EQUATION_MARK)}::DOUBLE / greatest({n_(WORD_)}, 1), 6) AS equation_density FROM documents")
def citation_equation_density(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.citation_density_quality(F.col("text")).alias("citation_density"), t.equation_density_quality(F.col("text")).alias("equation_density"))


_dense = n_(chr(92) + "p{Nd}", "x") + "::DOUBLE / greatest(length(x), 1) > 0.22"
_bars = n_(chr(92) + "|", "x") + " >= 2 OR " + n_(chr(92) + "t", "x") + " >= 2"
TABLE_ = f"SELECT doc_id, {unit_(with_(f'''regexp_matches(x, '{t.ROW}')''') + ' * 0.5::DOUBLE + ' + with_(_bars) + ' * 0.25::DOUBLE + ' + with_(_dense) + ' * 0.25::DOUBLE')} AS table_probability FROM (SELECT doc_id, {ALL_LINES_} AS ls FROM documents)"


@query(TABLE_)
def table_probability(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.table_probability(F.col("text")).alias("table_probability"))


_rate = "contains(x, '%') OR regexp_matches(x, '\\b\\d+\\.\\d+\\b')"
BENCH_ = f"SELECT doc_id, {unit_(with_(f'''regexp_matches(x, '{'|'.join(t.BENCHMARK_TERMS)}')''') + ' * 0.55::DOUBLE + ' + with_(_rate) + ' * 0.45::DOUBLE')} AS benchmark_probability FROM (SELECT doc_id, list_transform({ALL_LINES_}, lambda y: lower(y)) AS ls FROM documents)"


@query(BENCH_)
def benchmark_probability(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.benchmark_probability(F.col("text")).alias("benchmark_probability"))


_short = n_(r"\S+", "x") + " <= 3"
_odd = " OR ".join(f"{n_(chr(92) + a, 'x')} <> {n_(chr(92) + b, 'x')}" for a, b in ("()", "[]"))
MALFORMED_ = f"SELECT doc_id, {unit_(with_(_short) + ' * 0.45::DOUBLE + ' + with_('''regexp_matches(x, '^[a-z].*[A-Z]')''') + ' * 0.25::DOUBLE + ' + with_(_odd) + ' * 0.30::DOUBLE')} AS malformed_structure_score FROM (SELECT doc_id, {RAW_LINES_} AS ls FROM documents)"


@query(MALFORMED_)
def malformed_structure(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.malformed_structure(F.col("text")).alias("malformed_structure_score"))


QUALITY_CTE = f"""m AS (SELECT * FROM ({DENSITY_QUALITY_}) JOIN ({TABLE_}) USING (doc_id) JOIN ({BENCH_}) USING (doc_id) JOIN ({DUP_}) USING (doc_id) JOIN ({RATIOS_}) USING (doc_id) JOIN ({MALFORMED_}) USING (doc_id) JOIN ({ENTROPY_}) USING (doc_id) JOIN ({ASL_}) USING (doc_id)),
noise AS (SELECT *, {unit_('(1 - semantic_density) * 0.25::DOUBLE + table_probability * 0.20::DOUBLE + benchmark_probability * 0.15::DOUBLE + duplicate_line_ratio * 0.15::DOUBLE + least(numeric_ratio / 0.35::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE + malformed_structure_score * 0.15::DOUBLE')} AS noise_score FROM m),
quality AS (SELECT *, {unit_('semantic_density * 0.30::DOUBLE + alphabetic_ratio * 0.12::DOUBLE + (1 - table_probability) * 0.15::DOUBLE + (1 - benchmark_probability) * 0.10::DOUBLE + (1 - duplicate_line_ratio) * 0.08::DOUBLE + (1 - malformed_structure_score) * 0.10::DOUBLE + least(language_entropy, 1.0::DOUBLE) * 0.05::DOUBLE + least(average_sentence_length / 24.0::DOUBLE, 1.0::DOUBLE) * 0.05::DOUBLE + (1 - least(numeric_ratio / 0.25::DOUBLE, 1.0::DOUBLE)) * 0.05::DOUBLE')} AS retrieval_quality_score FROM noise),
judged AS (SELECT *, (semantic_density < 0.35::DOUBLE OR table_probability > 0.55::DOUBLE OR noise_score > 0.60::DOUBLE OR retrieval_quality_score < 0.45::DOUBLE) AS retrieval_excluded FROM quality)"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quality columns of all documents, with noise_score, retrieval_quality_score, retrieval_excluded."""
    docs = _docs(spark, sf_dir).withColumns(t.quality_columns(F.col("text"))).drop("text")
    docs = docs.withColumn("noise_score", t.noise_score()).withColumn("retrieval_quality_score", t.chunk_quality())
    return docs.withColumn("retrieval_excluded", t.retrieval_excluded())


_labels = ", ".join(f"CASE WHEN {test.replace('D', '::DOUBLE')} THEN '{label}' END" for label, test in t.NOISE_LABELS)


@query(f"WITH {QUALITY_CTE} SELECT doc_id, noise_score, coalesce(array_to_string(list_filter([{_labels}], lambda x: x IS NOT NULL), '|'), '') AS labels FROM judged")
def noise_score_labels(spark, sf_dir):
    return quality(spark, sf_dir).select("doc_id", "noise_score", F.array_join(t.noise_labels(), "|").alias("labels"))


@query(f"WITH {QUALITY_CTE} SELECT doc_id, retrieval_quality_score, retrieval_excluded FROM judged")
def chunk_quality(spark, sf_dir):
    return quality(spark, sf_dir).select("doc_id", "retrieval_quality_score", "retrieval_excluded")


@query(f"WITH {QUALITY_CTE} SELECT count(*) AS chunks, sum(retrieval_excluded::INT)::BIGINT AS excluded, round(avg(retrieval_quality_score), 6) AS avg_quality, round(avg(noise_score), 6) AS avg_noise FROM judged")
def quality_summary(spark, sf_dir):
    return quality(spark, sf_dir).agg(F.count("*").alias("chunks"), F.sum(F.col("retrieval_excluded").cast("long")).alias("excluded"), F.round(F.avg("retrieval_quality_score"), 6).alias("avg_quality"), F.round(F.avg("noise_score"), 6).alias("avg_noise"))


@query(f"WITH {QUALITY_CTE} SELECT l.quality, j.retrieval_excluded, count(*) AS n FROM judged j JOIN labels l USING (doc_id) GROUP BY 1, 2")
def exclusion_confusion(spark, sf_dir):
    return quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "retrieval_excluded").agg(F.count("*").alias("n"))


@query(f"WITH {QUALITY_CTE} SELECT bin, count(*) AS n FROM (SELECT CASE WHEN retrieval_quality_score <= 0.4::DOUBLE THEN '0.0-0.4' WHEN retrieval_quality_score <= 0.55::DOUBLE THEN '0.4-0.55' WHEN retrieval_quality_score <= 0.7::DOUBLE THEN '0.55-0.7' WHEN retrieval_quality_score <= 0.85::DOUBLE THEN '0.7-0.85' ELSE '0.85-1.0' END AS bin FROM judged) GROUP BY bin")
def quality_histogram(spark, sf_dir):
    q = F.col("retrieval_quality_score")
    bin_ = F.when(q <= 0.4, "0.0-0.4").when(q <= 0.55, "0.4-0.55").when(q <= 0.7, "0.55-0.7").when(q <= 0.85, "0.7-0.85").otherwise("0.85-1.0")
    return quality(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {QUALITY_CTE} SELECT source, round(avg(retrieval_quality_score), 4) AS mean_quality, count(*) AS n FROM judged JOIN documents USING (doc_id) GROUP BY source")
def quality_by_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return quality(spark, sf_dir).join(docs, "doc_id").groupBy("source").agg(F.round(F.avg("retrieval_quality_score"), 4).alias("mean_quality"), F.count("*").alias("n"))


@query(f"WITH {QUALITY_CTE} SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([{_labels}], lambda x: x IS NOT NULL)) AS label FROM judged) GROUP BY label")
def noise_label_counts(spark, sf_dir):
    return quality(spark, sf_dir).select(F.explode(t.noise_labels()).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


TOPICS_ = f"""SELECT doc_id, string_agg(tok, '|' ORDER BY n DESC, first) AS topics FROM (
 SELECT doc_id, tok, count(*) AS n, min(pos) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r FROM (
  SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS tok FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]{{2,}}'), lambda x: lower(x)) AS ts FROM documents))
 WHERE tok NOT IN {in_(t.STOP_CHUNK)} GROUP BY doc_id, tok) WHERE r <= 6 GROUP BY doc_id"""


@query(TOPICS_)
def topic_signature(spark, sf_dir):
    from pyspark.sql import Window

    tokens = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.transform(t.found(F.col("text"), r"[A-Za-z][A-Za-z0-9_\-]{2,}"), F.lower)).alias("pos", "tok")).filter(~F.col("tok").isin(t.STOP_CHUNK))
    counted = tokens.groupBy("doc_id", "tok").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).filter("r <= 6")
    return ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tok"))), lambda x: x["tok"]), "|").alias("topics"))


@query("SELECT doc_id, doc_id AS chunk_id, round(noise, 4) AS noise_ratio, eq_broken, ocr FROM (SELECT doc_id, least(1.0::DOUBLE, " + n_(r"[^\p{L}\p{N}_\s.,;:()-]") + "::DOUBLE / greatest(length(text), 1) * 4) AS noise, (abs(" + n_(r"\(") + " - " + n_(r"\)") + ") >= 3) AS eq_broken, regexp_matches(text, '(cid:\\d+|[A-Za-z]\\s){5}') AS ocr FROM documents)")
def validator_predicates(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("chunk_id"), F.round(F.least(F.lit(1.0), t.count(c, r"[^\p{L}\p{N}_\s.,;:()-]") / F.greatest(F.length(c), F.lit(1)) * 4), 4).alias("noise_ratio"), (F.abs(t.count(c, r"\(") - t.count(c, r"\)")) >= 3).alias("eq_broken"), c.rlike(r"(cid:\d+|[A-Za-z]\s){5}").alias("ocr"))
