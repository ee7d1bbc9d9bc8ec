"""What is written comes back as it was: files, logs, stores and the corpus build; and what only needs a look at lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import udfs
from ..operators import compose as c
from ..operators import driver
from ..operators import equations as e
from ..operators import layout as o
from ..sources import artefacts
from ..sources.scratch import folder
from ..sources.tables import CHUNKS_SQL, LINES_SQL, chunks, lines, table
from .corpus import HEAD_, NORM_, PARA_, STRIP_, W_, _marks
from .registry import query
from .retrieval import vectors
from .scores import n_, unit_

#: Lines of a page of the files that are written for reading.
PAGE = 60


@query(f"SELECT doc_id, p::INT AS page_no, md5(trim(array_to_string(ls[p * {PAGE} + 1:(p + 1) * {PAGE}], chr(10)), chr(10))) AS text_md5, 'plain' AS backend FROM (SELECT doc_id, ls, unnest(range(greatest(1, ceil(len(ls) / {PAGE}.0::DOUBLE)::BIGINT))) AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g'), chr(10)) AS ls FROM documents))")
def pdf_pages(spark, sf_dir):
    """All documents as PDF files of pages of lines, and what the first reader that can gets out of them."""
    at = f"{folder(spark)}/pdf"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column("text").to_pylist():
                ls = text.split("\n")
                made.append(artefacts.plain_pdf(["\n".join(ls[k : k + PAGE]) for k in range(0, len(ls), PAGE)]))
            yield pa.record_batch({"name": pa.array([f"{d}.pdf" for d in batch.column("doc_id").to_pylist()]), "content": pa.array(made, pa.binary())})

    artefacts.write_binary(table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "name string, content binary"), at)
    pages, _ = artefacts.quarantine(artefacts.pdf_pages(spark, at))
    return pages.select(F.regexp_extract("file", r"(\d+)\.pdf$", 1).cast("long").alias("doc_id"), "page_no", F.md5("text").alias("text_md5"), "backend")


@query("SELECT page_id::VARCHAR AS arxiv_id, 'Page ' || page_id AS title, url AS summary, TIMESTAMP '2024-01-01' + to_days((page_id % 300)::INT) AS updated, regexp_extract(url, '^https?://([^/]+)', 1) AS category FROM pages")
def atom_feed(spark, sf_dir):
    """Feeds of all pages, an entry each, and the entries read from them."""
    escaped = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.date_format(F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, int(page_id % 300))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    entry = F.concat(F.lit("<entry><id>http://x/abs/"), "page_id", F.lit("v2</id><title>Page\n  "), "page_id", F.lit("</title><summary>"), escaped, F.lit("</summary><updated>"), day, F.lit("</updated><published>"), day, F.lit('</published><author><name>A</name></author><category term="'), host, F.lit('"/></entry>'))
    feeds = table(spark, sf_dir, "pages").select(entry.alias("e"), F.pmod("page_id", F.lit(97)).alias("feed")).groupBy("feed").agg(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("xml"))
    return artefacts.atom_entries(feeds).select("arxiv_id", "title", "summary", "updated", F.element_at("categories", 1).alias("category"))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id::VARCHAR AS chunk_id, paper_id, chunk_index::INT AS chunk_index, md5(chunk_text) AS text_md5 FROM chunks")
def json_envelopes(spark, sf_dir):
    """All chunks in JSON envelopes, one a paper, and back."""
    at = f"{folder(spark)}/json"
    artefacts.write_chunks(chunks(spark, sf_dir).select(F.col("chunk_id").cast("string"), "paper_id", F.col("chunk_index").cast("int"), "chunk_text"), at)
    return artefacts.read_chunks(spark, at).select("chunk_id", "paper_id", "chunk_index", F.md5("chunk_text").alias("text_md5"))


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, role, md5(text) FROM conversations WHERE role <> 'user'")
def jsonl_log(spark, sf_dir):
    """Turns appended to a log in two goes, and read from it."""
    at, turns = f"{folder(spark)}/log", table(spark, sf_dir, "conversations")
    for part in ("role = 'user'", "role <> 'user'"):
        artefacts.append_jsonl(turns.filter(part), at)
    return artefacts.read_or(spark, at, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT vec_id AS chunk_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings WHERE vec_id % 2 = 0")
def vector_store(spark, sf_dir):
    """Vectors of two namespaces in one store, and those of one of them."""
    at, v = f"{folder(spark)}/vectors", vectors(spark, sf_dir)
    for name, rest in (("even", 0), ("odd", 1)):
        artefacts.save_vectors(v.filter(F.col("chunk_id") % 2 == rest), f"{at}/{name}", "hash", name)
    return artefacts.load_vectors(spark, f"{at}/even", "hash", "even").select("chunk_id", F.round(t.norm(F.col("v")), 6).alias("norm"))


@query("SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def state_store(spark, sf_dir):
    """Events set as the state of their users in two goes, and the latest of each."""
    at = f"{folder(spark)}/state"
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    for rest in (0, 1):
        artefacts.set_state(events.filter(F.col("seq") % 2 == rest), at)
    return artefacts.get_state(spark, at)


@query(f"SELECT doc_id, greatest(1, floor({n_(chr(92) + 'S+')} * 1.25::DOUBLE))::BIGINT AS tokens FROM documents")
def read_through_cache(spark, sf_dir):
    """Token counts by the hash of the text: of half the documents first, then of all, when only the others are counted."""
    at = f"{folder(spark)}/cache"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("key"))
    count = lambda rows: rows.select("key", t.token_estimate(F.col("text")).alias("tokens"))
    artefacts.cached(docs.filter("doc_id % 2 = 0"), "key", at, count)
    return artefacts.cached(docs, "key", at, count).select("doc_id", "tokens")


@query("SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE role = 'user'")
def dataset_split(spark, sf_dir):
    """Conversations as a dataset with a split a role, and one split of it."""
    at = f"{folder(spark)}/data"
    artefacts.save_splits(table(spark, sf_dir, "conversations").withColumnRenamed("role", "split"), at, "turns", "plain")
    return artefacts.load_split(spark, at, "turns", "plain", "user").select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, CASE WHEN length(text) < 100 THEN 'too short' ELSE 'good' END AS state FROM documents")
def failure_log(spark, sf_dir):
    """Documents with and without an error; those with one go to a log that is read back."""
    at = f"{folder(spark)}/failures"
    good, bad = artefacts.quarantine(table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") < 100, "too short").alias("error")))
    artefacts.append_jsonl(bad, at)
    return good.select("doc_id", F.lit("good").alias("state")).union(artefacts.read_or(spark, at, "doc_id long, error string").select("doc_id", "error"))


@query("SELECT source AS report_id, md5(string_agg(doc_id || ' ' || lang, chr(10) ORDER BY doc_id)) AS markdown_md5 FROM documents GROUP BY 1")
def report_files(spark, sf_dir):
    """A list of its documents for each source as a text file, and what the files hold."""
    at = f"{folder(spark)}/reports"
    listed = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("report_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("ds"))
    artefacts.write_report(listed.select("report_id", F.array_join(F.transform("ds", lambda d: F.concat(d["doc_id"].cast("string"), F.lit(" "), d["lang"])), "\n").alias("markdown")), at)
    held = spark.read.text(f"{at}/markdown", wholetext=True)
    return held.select(F.regexp_replace("name", "^report-", "").alias("report_id"), F.md5(F.rtrim("value", F.lit("\n"))).alias("markdown_md5"))


_name = udfs._NAME.replace("'", "''")
_spans = " + ".join(n_(p.pattern.replace("'", "''")) for _, p in udfs.CITATIONS)


@query(f"SELECT doc_id, ({_spans})::INT AS spans, round(({_spans})::DOUBLE / greatest(1, floor({n_(chr(92) + 'S+')} * 1.25::DOUBLE)), 4) AS density FROM documents")
def citation_spans(spark, sf_dir):
    found = udfs.with_citations(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("spans").alias("spans"), F.col("citation_density").alias("density"))


@query(f"SELECT doc_id, md5({NORM_.format('nfc_normalize(text)')}) AS text_md5 FROM documents")
def normal_texts(spark, sf_dir):
    """Texts after compatibility normalisation; those of the test tables hold nothing but what canonical normalisation changes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.normal_line(udfs.nfkc("text"))).alias("text_md5"))


@query("SELECT l_suppkey AS paper_id, l_orderkey AS page_no, count(*) >= 2 AND max(x0) - min(x0) > 120 AS multi_column FROM (SELECT *, (l_quantity * 10)::DOUBLE AS x0 FROM lineitem) GROUP BY 1, 2")
def multi_column_pages(spark, sf_dir):
    """Order lines as blocks of pages: their left edges lie further apart than a column's width."""
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper_id"), F.col("l_orderkey").alias("page_no"), (F.col("l_quantity") * 10).cast("double").alias("x0"))
    return c.column_spread(blocks)


@query(f"WITH m AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) - min(l_quantity) > 12) SELECT source AS paper_id, doc_id AS page_no, doc_id AS ord FROM documents SEMI JOIN m ON l_orderkey = doc_id WHERE {n_(chr(92) + 'S+')} > 80 AND NOT contains(text, '  ')")
def column_risk(spark, sf_dir):
    """Documents as paragraphs of pages of their number."""
    blocks = table(spark, sf_dir, "lineitem").select(F.lit("x").alias("paper_id"), F.col("l_orderkey").alias("page_no"), (F.col("l_quantity") * 10).cast("double").alias("x0"))
    pages = c.column_spread(blocks).drop("paper_id")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_no"), F.col("doc_id").alias("ord"), "text")
    return e.column_risk(docs, docs.select("paper_id", "page_no").join(pages, "page_no"))


_s = STRIP_.format("line")
BLOCK_ = f"(NOT regexp_matches({_s}, '{e.ENUMERATED}') AND {n_(e.SYMBOL, 'line')} > 0 AND ((contains(line, '=') AND {n_(chr(92) + 'S+', 'line')} <= 40) OR ({n_(e.SYMBOL, 'line')} >= 2 AND regexp_matches({_s}, '{e.MADE_OF}'))))"


def runs_(source: str, test: str) -> str:
    return f"(SELECT paper_id, min(ord)::INT AS first_ord, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY ord) AS text FROM (SELECT *, ord - row_number() OVER {W_} AS run FROM (SELECT * FROM {source} WHERE {test})) GROUP BY paper_id, run)"


_integrity = unit_(f"greatest(0.0::DOUBLE, 1 - abs({n_('[(' + chr(92) + '[{]')} - {n_('[)' + chr(92) + ']}]')}) * 0.15::DOUBLE) * 0.55::DOUBLE + least(1.0::DOUBLE, {n_(e.SYMBOL)} / 3.0::DOUBLE) * 0.45::DOUBLE - CASE WHEN regexp_matches(text, '{e.TRUNCATED}') THEN 0.18::DOUBLE ELSE 0 END", 4)
_kind = "CASE WHEN contains(lower(text), '\\frac') OR contains(text, '/') THEN 'fractional' WHEN contains(lower(text), '\\sum') OR contains(text, 'Σ') THEN 'summation' WHEN contains(lower(text), '\\prod') OR contains(text, 'Π') THEN 'product' WHEN contains(text, '[') AND contains(text, ']') AND contains(text, ';') THEN 'matrix' ELSE 'display' END"


@query(f"WITH {LINES_SQL} SELECT *, CASE WHEN integrity >= 0.75::DOUBLE THEN 0.92::DOUBLE ELSE 0.74::DOUBLE END AS confidence FROM (SELECT paper_id, first_ord, n_lines, {_kind} AS kind, {n_(e.SYMBOL)}::INT AS symbols, {_integrity} AS integrity FROM {runs_('lines', BLOCK_)})")
def equation_blocks(spark, sf_dir):
    return e.blocks(lines(spark, sf_dir))


_mended = "{}"
for _bad, _good in e.MISREAD:
    _mended = f"replace({_mended}, '{_bad}', '{_good}')"


def math_(c_: str) -> str:
    joined = STRIP_.format(f"regexp_replace({_mended.format(c_)}, '\\s+', ' ', 'g')")
    return STRIP_.format(f"regexp_replace(regexp_replace({joined}, '\\s*({e.OPERATOR})\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g')")


@query(f"SELECT doc_id, md5({math_('text')}) AS plain_md5 FROM documents")
def plain_math(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(e.plain_math(F.col("text"))).alias("plain_md5"))


LOOKS_ = f"(regexp_matches(line, '{e.LOOSE}') AND ({n_(chr(92) + 'S+', 'line')} <= 40 OR contains(line, '=') OR {n_(chr(92) + '(', 'line')} >= 2 OR contains(line, '\\')))"


@query(f"WITH {LINES_SQL}, p AS (SELECT paper_id, ord, {math_('line')} AS line FROM lines) SELECT paper_id, first_ord, n_lines, flat AS text, {n_(e.OPERATOR, 'flat')}::INT AS operators, CASE WHEN n_lines > 1 THEN 0.92::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM (SELECT *, {math_(chr(114) + 'eplace(text, chr(10), chr(32))')} AS flat FROM {runs_('p', LOOKS_)})")
def equation_repair(spark, sf_dir):
    return e.repaired(lines(spark, sf_dir))


_bad = "list_filter(l, lambda x: x IN ('" + "','".join(e.CORRUPTION) + "'))"
_look = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in e.CORRUPTION.items()) + " END"


@query(f"WITH {LINES_SQL}, m AS (SELECT paper_id, list_filter({_marks}, lambda x: x IS NOT NULL) AS l, {BLOCK_} AS eq FROM lines), g AS (SELECT paper_id, list_sort(list_distinct(flatten(list({_bad})))) AS cs, avg(eq::INT) AS share FROM m GROUP BY 1) SELECT paper_id, array_to_string(cs, '|') AS categories, array_to_string(list_sort(list_concat(list_transform(cs, lambda x: {_look}), CASE WHEN share > 0.4 THEN ['equations'] ELSE []::VARCHAR[] END)), '|') AS look_at FROM g")
def corruption_categories(spark, sf_dir):
    return e.corruption(lines(spark, sf_dir))


_why = f"CASE WHEN list_contains(l, 'caption_candidate') AND NOT {HEAD_} THEN 'caption' WHEN list_contains(l, 'diagram_label') THEN 'diagram_label' WHEN list_contains(l, 'table_bleed') AND {n_(' ', 'line')} < 18 THEN 'table_bleed' END"
_raw = LINES_SQL.replace("lines AS", "raw AS", 1)
BUILT_ = f"""{_raw}, good AS (SELECT raw.* FROM raw SEMI JOIN (SELECT paper_id FROM raw GROUP BY 1 HAVING sum(length({_s})) > 0) USING (paper_id)),
norm AS (SELECT paper_id, ord, {NORM_.format('line')} AS line FROM good), fresh AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY paper_id, line ORDER BY ord) = 1 OR length(line) <= 20),
lines AS (SELECT paper_id, ord, line FROM (SELECT *, list_filter({_marks}, lambda x: x IS NOT NULL) AS l FROM fresh) WHERE {_why} IS NULL)"""


@query(f"""WITH {BUILT_}, {PARA_} SELECT 'lines' AS artefact, (SELECT count(*) FROM good) AS n UNION ALL SELECT 'paragraphs', (SELECT count(DISTINCT (paper_id, paragraph)) FROM para) UNION ALL SELECT 'sections', (SELECT count(DISTINCT (paper_id, section)) FROM (SELECT paper_id, sum({HEAD_}::INT) OVER {W_} AS section FROM lines))
UNION ALL SELECT 'equations', (SELECT count(*) FROM {runs_('lines', BLOCK_)}) UNION ALL SELECT 'regions', (SELECT count(*) FROM good WHERE regexp_matches(line, '{o.FIGURE}') OR regexp_matches(line, '{o.INLINE_FIGURE}') OR regexp_matches(line, '{o.TABLE}')) UNION ALL SELECT 'excluded', (SELECT count(*) FROM (SELECT *, list_filter({_marks}, lambda x: x IS NOT NULL) AS l FROM good) WHERE {_why} IS NOT NULL)""")
def corpus_build(spark, sf_dir):
    """Rows of the artefacts after a build in two runs, of which the second finds half of the papers done."""
    at, all_ = folder(spark), lines(spark, sf_dir)
    driver.run(all_.filter("paper_id % 2 = 0"), at)
    driver.run(all_, at)
    counts = [driver.read(spark, at, kind).agg(F.lit(kind).alias("artefact"), F.count("*").alias("n")) for kind in ("lines", "paragraphs", "sections", "equations", "regions", "excluded")]
    out = counts[0]
    for df in counts[1:]:
        out = out.union(df)
    return out
