"""Corpus queries over the lines of all documents, and blocks of all pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import layout as o
from ..sources.tables import LINES_SQL, lines, table
from .registry import query
from .scores import STRIP_, n_

W_ = "(PARTITION BY paper_id ORDER BY ord)"
NORM_ = STRIP_.format("regexp_replace(replace(replace(replace({}, '­', ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[ \\t]+', ' ', 'g')")
HEAD_ = f"(regexp_matches(line, '{o.HEADING}') OR lower({STRIP_.format('line')}) IN ('abstract', 'introduction', 'references'))"


def EQ_(c: str = "line") -> str:
    return f"(regexp_matches({c}, '{o.EQUATION}') AND ({n_(chr(92) + 'S+', c)} <= 25 OR contains({c}, '=') OR {n_(chr(92) + '(', c)} >= 2))"


def _docs_as_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), "text")


@query(f"WITH {LINES_SQL} SELECT paper_id, ord::INT AS ord, line FROM lines")
def doc_lines(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"""WITH p AS (SELECT source AS paper_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT paper_id, {NORM_.format('x')} AS line FROM (SELECT paper_id, unnest(list_concat(ls[1:2], ls[-2:])) AS x FROM p)),
c AS (SELECT paper_id, line, count(*) AS n FROM e WHERE length(line) BETWEEN 4 AND 120 GROUP BY 1, 2), s AS (SELECT paper_id, count(*) AS pages FROM p GROUP BY 1) SELECT paper_id, line, n FROM c JOIN s USING (paper_id) WHERE n >= greatest(2, floor(pages * 0.35::DOUBLE))""")
def repeated_header_lines(spark, sf_dir):
    return o.repeated_edge_lines(_docs_as_pages(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT paper_id, ord::INT AS ord FROM lines WHERE line = '' OR regexp_matches(line, '{t.PAGE_NUMBER}') OR regexp_matches(line, '^[^\\p{{L}}\\p{{N}}]+$')")
def noise_lines(spark, sf_dir):
    return lines(spark, sf_dir).filter(t.noise_line(F.col("line"), F.lit(False))).select("paper_id", "ord")


@query(f"WITH {LINES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, line ORDER BY ord) AS r FROM lines) SELECT paper_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY ord)) AS kept FROM k WHERE r = 1 OR length(line) <= 20 GROUP BY 1")
def line_dedup(spark, sf_dir):
    kept = o.without_repeats(lines(spark, sf_dir)).groupBy("paper_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ls"))
    return kept.select("paper_id", "n_lines", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("kept"))


@query("""WITH f AS (SELECT doc_id, source, sha1(array_to_string(list_transform(range(1, greatest(1, length(p) - 47) + 1, 16)[1:12], lambda k: substr(p, k, 48)), '|')) AS fp FROM (SELECT doc_id, source, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS p FROM documents))
SELECT doc_id, canonical, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, fp) AS canonical, count(*) OVER (PARTITION BY source, fp) AS n FROM f) WHERE n > 1""".replace("\\\\", "\\"))
def exact_dup_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", t.fingerprint(F.col("text")).alias("fp"))
    groups = docs.groupBy("source", "fp").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(groups, ["source", "fp"]).select("doc_id", "canonical", "n")


_jac = "CASE WHEN len(tk) = 0 OR len(lag(tk, {k}) OVER " + W_ + ") = 0 OR lag(tk, {k}) OVER " + W_ + " IS NULL THEN 0.0 ELSE len(list_intersect(tk, lag(tk, {k}) OVER " + W_ + "))::DOUBLE / len(list_distinct(list_concat(tk, lag(tk, {k}) OVER " + W_ + "))) END >= 0.96::DOUBLE AS c{k}"


@query(f"WITH {LINES_SQL}, tk AS (SELECT paper_id, ord, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{{3,}}')) AS tk FROM lines), c AS (SELECT paper_id, ord, " + ", ".join(_jac.format(k=k) for k in (1, 2, 3)) + " FROM tk) SELECT paper_id, ord::INT AS ord, CASE WHEN c1 THEN 1 WHEN c2 THEN 2 WHEN c3 THEN 3 END::INT AS nearest, (c1::INT + c2::INT + c3::INT)::INT AS hits FROM c WHERE c1 OR c2 OR c3")
def near_dup_adjacent(spark, sf_dir):
    return o.near_duplicate_lines(lines(spark, sf_dir))


PARA_ = f"""para AS (SELECT *, sum(s::INT) OVER {W_} AS paragraph FROM (SELECT paper_id, ord, line, (b IS NULL OR {HEAD_} OR length(b) > 85 OR (regexp_matches(line, '^\\p{{Lu}}') AND regexp_matches(b, '[.?:;]$')) OR (regexp_matches(line, '^\\p{{Nd}}') AND NOT regexp_matches(line, '^\\p{{Nd}}{{4}}')) OR {EQ_()} OR coalesce({EQ_('b')}, false)) AS s FROM (SELECT *, lag(line) OVER {W_} AS b FROM lines)))"""


@query(f"WITH {LINES_SQL}, {PARA_} SELECT paper_id, paragraph::BIGINT AS paragraph, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM para GROUP BY 1, 2")
def paragraph_islands(spark, sf_dir):
    return o.numbered_paragraphs(lines(spark, sf_dir)).groupBy("paper_id", "paragraph").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


#: Lines joined to a paragraph.
JOINED_ = "list_reduce(ls, lambda s, x: CASE WHEN s = '' THEN x WHEN ends_with(s, '-') AND regexp_matches(x, '^\\p{Ll}') THEN regexp_replace(s, '-$', '') || x ELSE s || ' ' || x END)"


@query(f"WITH {LINES_SQL}, {PARA_} SELECT paper_id, paragraph::BIGINT AS paragraph, len(ls) AS n_lines, {JOINED_} AS text FROM (SELECT paper_id, paragraph, list(line ORDER BY ord) AS ls FROM para GROUP BY 1, 2)")
def paragraph_texts(spark, sf_dir):
    return o.paragraphs(lines(spark, sf_dir))


@query(f"WITH {LINES_SQL}, e AS (SELECT paper_id, ord, line, {EQ_()} AS hit FROM lines), r AS (SELECT *, ord - row_number() OVER {W_} AS run FROM e WHERE hit) SELECT paper_id, min(ord)::INT AS first_ord, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY ord)) AS text_md5 FROM r GROUP BY paper_id, run")
def equation_islands(spark, sf_dir):
    return o.islands(lines(spark, sf_dir), o.is_equation(F.col("line"))).select("paper_id", "first_ord", "n_lines", F.md5("text").alias("text_md5"))


@query(f"WITH {LINES_SQL}, h AS (SELECT *, {HEAD_} AS h FROM lines), s AS (SELECT *, sum(h::INT) OVER {W_} AS section FROM h) SELECT paper_id, section::BIGINT AS section, coalesce(max(CASE WHEN h THEN line END), 'Front Matter') AS heading, sum((NOT h)::INT)::BIGINT AS n_lines, sum(CASE WHEN h THEN 0 ELSE length(line) END)::BIGINT AS chars FROM s GROUP BY 1, 2")
def section_segments(spark, sf_dir):
    return o.sections(lines(spark, sf_dir))


_label = "CASE " + " ".join(f"WHEN regexp_matches({{h}}, '^({p})$') THEN '{k}'" for k, p in t.SECTIONS) + " ELSE 'body' END"
_words = n_(r"\S+", "line")
_sem = "CASE WHEN " + _label.format(h="lower(plain)") + " <> 'body' THEN 0.99::DOUBLE ELSE 0.0 END"
_pw = n_(r"\S+", "plain")
_conf = f"""sem + CASE WHEN regexp_matches(plain, '^[A-Z0-9][A-Za-z0-9\\s\\-\\&:/,()]{{1,90}}$') THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(line, '{o.NUMBERED}') THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN {_pw} <= 8 THEN 0.2::DOUBLE ELSE -0.28::DOUBLE END - CASE WHEN {n_(',', 'plain')} >= 2 THEN 0.24::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(plain, '{o.INLINE_FIGURE}') THEN 0.45::DOUBLE ELSE 0 END - CASE WHEN {_pw} > 10 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(plain, '{o.BODY_VERB}') AND sem < 0.88::DOUBLE THEN 0.3::DOUBLE ELSE 0 END + (CASE WHEN ord < 4 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN {_words} <= 8 THEN 0.06::DOUBLE ELSE 0 END)"""
_plain = f"(SELECT *, trim(regexp_replace({STRIP_.format('line')}, '{o.NUMBERED}', ''), ' .:') AS plain FROM lines)"
CONF_ = f"conf AS (SELECT paper_id, ord, line, plain, sem, (floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_conf})) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE) AS confidence FROM (SELECT *, {_sem} AS sem FROM {_plain}))"


@query(f"WITH {LINES_SQL}, {CONF_} SELECT paper_id, ord::INT AS ord, confidence FROM conf")
def heading_confidence(spark, sf_dir):
    return lines(spark, sf_dir).select("paper_id", "ord", o.heading_confidence(F.col("line"), F.col("ord") < 4).alias("confidence"))


_num = f"regexp_matches(line, '{o.NUMBERED}')"
_title = f"CASE WHEN {_pw} > 0 THEN len(list_filter(regexp_extract_all(plain, '\\S+'), lambda x: regexp_matches(x, '^\\p{{Lu}}')))::DOUBLE / {_pw} ELSE 0.0 END"


@query(f"WITH {LINES_SQL}, {CONF_} SELECT paper_id, ord::INT AS ord, confidence FROM conf WHERE confidence >= 0.76::DOUBLE AND {_pw} <= CASE WHEN {_num} THEN 8 ELSE 6 END AND NOT (regexp_matches(line, '[.;]\\s*$') OR NOT regexp_matches(plain, '[A-Za-z]')) AND (({_num} AND {_title} >= 0.35::DOUBLE) OR (sem > 0 AND regexp_matches(plain, '^\\p{{Lu}}') AND {_title} >= 0.5::DOUBLE))")
def headings(spark, sf_dir):
    scored = lines(spark, sf_dir).withColumn("confidence", o.heading_confidence(F.col("line"), F.col("ord") < 4))
    return scored.filter(o.is_section_start(F.col("line"), F.col("confidence"))).select("paper_id", "ord", "confidence")


@query(f"SELECT page_id, title, {_label.format(h='''trim(lower(title), ' .:')''')} AS label FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def section_classifier(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), t.section_label(title).alias("label"))


_art = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in t.ARTEFACTS) + f" WHEN regexp_matches(line, '{t.WATERMARK}') AND length(line) < 120 THEN 'watermark' WHEN ord < 25 AND regexp_matches(lower(line), '{t.AFFILIATION}') THEN 'affiliation' END"


@query(f"WITH {LINES_SQL} SELECT paper_id, ord::INT AS ord, kind FROM (SELECT paper_id, ord, {_art} AS kind FROM lines) WHERE kind IS NOT NULL")
def artifact_types(spark, sf_dir):
    return lines(spark, sf_dir).select("paper_id", "ord", t.artefact_type(F.col("line"), F.col("ord") < 25).alias("kind")).filter("kind is not null")


@query(f"WITH {LINES_SQL} SELECT paper_id, ord::INT AS ord, kind, confidence FROM (SELECT *, CASE WHEN regexp_matches(line, '{o.FIGURE}') OR regexp_matches(line, '{o.INLINE_FIGURE}') THEN 'figure' WHEN regexp_matches(line, '{o.TABLE}') THEN 'table' END AS kind, CASE WHEN regexp_matches(line, '{o.FIGURE}') THEN 0.9::DOUBLE WHEN regexp_matches(line, '{o.INLINE_FIGURE}') THEN 0.76::DOUBLE WHEN regexp_matches(line, '{o.TABLE}') THEN 0.88::DOUBLE END AS confidence FROM lines) WHERE kind IS NOT NULL")
def region_isolation(spark, sf_dir):
    return lines(spark, sf_dir).select("paper_id", "ord", o.region(F.col("line")).alias("kind"), o.region_confidence(F.col("line")).alias("confidence")).filter("kind is not null")


_nums = n_(o.NUMBER, "line") + " >= 3"
_marks = f"""[CASE WHEN regexp_matches(line, '{o.OCR}') THEN 'ocr_artifact' END, CASE WHEN {_nums} OR ({n_(chr(92) + 'p{Nd}', 'line')} >= 8 AND {_words} <= 22) THEN 'table_bleed' END, CASE WHEN regexp_matches(line, '{o.CAPTION}') THEN 'caption_candidate' END, CASE WHEN regexp_matches(line, '{o.INLINE_FIGURE}') THEN 'inline_figure_marker' END, CASE WHEN regexp_matches(line, '{o.DIAGRAM}') THEN 'diagram_label' END, CASE WHEN {_words} <= 14 AND length(line) > 0 AND {n_('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]', 'line')}::DOUBLE / length(line) > 0.18::DOUBLE AND {n_(chr(92) + 'p{Lu}', 'line')} >= 2 THEN 'layout_contamination' END]"""


@query(f"WITH {LINES_SQL} SELECT paper_id, ord::INT AS ord, array_to_string(l, '|') AS labels FROM (SELECT paper_id, ord, list_filter({_marks}, lambda x: x IS NOT NULL) AS l FROM lines) WHERE len(l) > 0")
def noise_labels(spark, sf_dir):
    found = lines(spark, sf_dir).select("paper_id", "ord", o.noise_labels(F.col("line")).alias("l")).filter("size(l) > 0")
    return found.select("paper_id", "ord", F.array_join("l", "|").alias("labels"))


ROLE_ = f"CASE WHEN {EQ_()} THEN 'equation_block' WHEN {HEAD_} THEN 'section_heading' WHEN regexp_matches(line, '{o.LIST_ITEM}') THEN 'list_item' WHEN regexp_matches(line, '{o.CAPTION}') THEN 'caption' WHEN {_nums} THEN 'table_block' WHEN regexp_matches(line, '{o.THEOREM}') THEN 'theorem_block' END"


@query(f"WITH {LINES_SQL} SELECT coalesce({ROLE_}, 'none') AS role, count(*) AS n FROM lines GROUP BY 1")
def structural_roles(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.coalesce(o.structural_role(F.col("line")), F.lit("none")).alias("role")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL}, m AS (SELECT *, list_filter({_marks}, lambda x: x IS NOT NULL) AS l, {HEAD_} AS h FROM lines), r AS (SELECT CASE WHEN list_contains(l, 'caption_candidate') AND NOT h THEN 'caption' WHEN list_contains(l, 'diagram_label') THEN 'diagram_label' WHEN list_contains(l, 'table_bleed') AND {n_(' ', 'line')} < 18 THEN 'table_bleed' END AS reason FROM m) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def dropped_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(o.drop_reason(F.col("line")).alias("reason")).agg(F.count("*").alias("n")).filter("reason is not null")


_prot = "('equation_block', 'section_heading', 'list_item', 'table_block')"


@query(f"WITH {LINES_SQL}, r AS (SELECT *, coalesce({ROLE_}, '') AS role FROM lines), g AS (SELECT *, coalesce(role NOT IN {_prot} AND lag(role) OVER {W_} NOT IN {_prot} AND NOT regexp_matches(lag(line) OVER {W_}, '[.!?]\\)?[\"'']?$') AND regexp_matches(line, '^\\p{{Ll}}'), false) AS goes FROM r), f AS (SELECT *, sum((NOT goes)::INT) OVER {W_} AS fragment FROM g) SELECT paper_id, fragment::BIGINT AS fragment, count(*) AS n_lines FROM f GROUP BY 1, 2")
def fragment_merge(spark, sf_dir):
    return o.merged_fragments(lines(spark, sf_dir)).select("paper_id", "fragment", "n_lines")


@query(f"WITH {LINES_SQL}, e AS (SELECT paper_id, ord, line, row_number() OVER {W_} AS r FROM lines WHERE regexp_matches(line, '=|\\\\sum|\\\\int|\\\\alpha|\\\\beta|≤|≥|≈|O\\([^)]+\\)') AND length(line) <= 180) SELECT paper_id, ord::INT AS ord, line FROM e WHERE r <= 100")
def formula_lines(spark, sf_dir):
    hit = lines(spark, sf_dir).filter(F.col("line").rlike(r"=|\\sum|\\int|\\alpha|\\beta|≤|≥|≈|O\([^)]+\)") & (F.length("line") <= 180))
    return hit.withColumn("r", F.row_number().over(o.reading_order())).filter("r <= 100").drop("r")


@query(f"WITH {LINES_SQL}, c AS (SELECT paper_id, ord, line FROM lines WHERE ord < 12 AND length(line) > 20 AND NOT regexp_matches(line, '^[^\\p{{L}}]+$')) SELECT paper_id, arg_min(line, ord) AS title FROM c GROUP BY 1")
def title_lines(spark, sf_dir):
    return lines(spark, sf_dir).filter((F.col("ord") < 12) & (F.length("line") > 20) & ~F.col("line").rlike(r"^[^\p{L}]+$")).groupBy("paper_id").agg(F.min_by("line", "ord").alias("title"))


@query(f"WITH {LINES_SQL}, r AS (SELECT *, min(CASE WHEN regexp_matches({STRIP_.format('line')}, '(?i)^(references|bibliography)$') THEN ord END) OVER (PARTITION BY paper_id) AS r FROM lines) SELECT paper_id, ord::INT AS ord, line FROM r WHERE ord > r AND ord <= r + 80")
def reference_lines(spark, sf_dir):
    at = F.min(F.when(t.strip(F.col("line")).rlike("(?i)^(references|bibliography)$"), F.col("ord"))).over(Window.partitionBy("paper_id"))
    return lines(spark, sf_dir).withColumn("r", at).filter("ord > r and ord <= r + 80").drop("r")


@query(f"WITH {LINES_SQL}, l AS (SELECT source, avg((length(line) > 40)::INT) AS long_lines FROM lines JOIN documents ON doc_id = paper_id GROUP BY 1), d AS (SELECT source, sum({n_('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')})::DOUBLE / sum(length(text)) AS alnum, avg((length(text) > 200)::INT) AS full_pages FROM documents GROUP BY 1) SELECT source, round(0.4::DOUBLE * alnum + 0.35::DOUBLE * full_pages + 0.25::DOUBLE * long_lines, 4) AS quality FROM d JOIN l USING (source)")
def extraction_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "text")
    pages = docs.groupBy("source").agg((F.sum(t.count(F.col("text"), r"[\p{L}\p{N}]")) / F.sum(F.length("text"))).alias("alnum"), F.avg((F.length("text") > 200).cast("int")).alias("full_pages"))
    long_ = docs.select("source", F.explode(F.split("text", "\n")).alias("line")).groupBy("source").agg(F.avg((F.length("line") > 40).cast("int")).alias("long_lines"))
    return pages.join(long_, "source").select("source", F.round(F.col("alnum") * 0.4 + F.col("full_pages") * 0.35 + F.col("long_lines") * 0.25, 4).alias("quality"))


_strip = "regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"


@query(f"SELECT page_id, i AS block, trim({_strip}) AS text FROM (SELECT page_id, unnest(range(len(bs))) AS i, unnest(bs) AS x FROM (SELECT page_id, regexp_extract_all(html, '<p[^>]*>[^<]*(?:<[^/p][^>]*>[^<]*</[^>]+>[^<]*)*</p>') AS bs FROM pages))")
def html_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(t.found(F.col("html"), r"<p[^>]*>[^<]*(?:<[^/p][^>]*>[^<]*</[^>]+>[^<]*)*</p>")).alias("block", "x"))
    return blocks.select("page_id", F.col("block").cast("long"), F.btrim(F.regexp_replace(F.regexp_replace("x", "<[^>]+>", " "), r"\s+", " ")).alias("text"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS distinct_links FROM pages")
def html_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("links"), F.size(F.array_distinct(found)).cast("long").alias("distinct_links"))
