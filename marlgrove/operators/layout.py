"""Lines to paragraphs, sections and regions, by windows over reading order.

Every operator takes lines(paper_id, ord, line) and never looks across papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# What headings, equations, captions and lists look like.
HEADING = r"(?i)^(\d+(\.\d+)*|[IVXLC]+|Appendix\s+[A-Z])[\s\.:]+[A-Z]"
NUMBERED = r"(?i)^(\d+(\.\d+)*|[IVXLC]+|Appendix\s+[A-Z])[\s\.:]+"
PLAIN_HEADINGS = ("abstract", "introduction", "references")
EQUATION = r"=|\\sum|\\int|\\frac|\\alpha|\\beta|≤|≥|≈|\bO\([^)]+\)|\(\d+\)"
CAPTION = r"(?i)^(figure|fig\.|table|algorithm|scheme)\s+\d+[A-Za-z]?(?:[\s:.\-]|$)"
FIGURE = r"(?i)^(figure|fig\.)\s+\d+[a-z]?(?:[\s:.\-]|$)"
TABLE = r"(?i)^table\s+\d+[a-z]?(?:[\s:.\-]|$)"
INLINE_FIGURE = r"(?i)^\([a-z]\)\s+"
DIAGRAM = r"(?i)^(\(?[a-z]\)|left|right|top|bottom|ours|baseline|input|output)$"
LIST_ITEM = r"^(\d+\.|\([a-z]\)|[-*])\s+"
THEOREM = r"(?i)^(theorem|lemma|proof|proposition|corollary)\b"
SENTENCE_END = r"[.!?]\)?[\"']?$"
OCR = r"(cid:\d+|[A-Za-z]\s){5}|[^\p{L}\p{N}_\s]{4}"
NUMBER = r"\b\d+\b"
BODY_VERB = r"(?i)\b(is|are|was|were|shows|demonstrates|provide|proves|achieves|using|including|because)\b"
PROTECTED = ("equation_block", "section_heading", "list_item", "table_block")


def reading_order() -> Window:
    return Window.partitionBy("paper_id").orderBy("ord")


def words(c: Column) -> Column:
    return t.count(c, r"\S+")


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING) | F.lower(t.strip(line)).isin(*PLAIN_HEADINGS)


def is_equation(line: Column) -> Column:
    return line.rlike(EQUATION) & ((words(line) <= 25) | line.contains("=") | (t.count(line, r"\(") >= 2))


def repeated_edge_lines(pages: DataFrame, edge: int = 2, least: int = 4, most: int = 120) -> DataFrame:
    """paper_id, line, n: lines at the edges of at least two, and 35 %, of a paper's pages. pages: paper_id, text."""
    listed = pages.select("paper_id", F.split("text", "\n").alias("ls"))
    ends = F.concat(F.slice("ls", 1, edge), F.when(F.size("ls") >= edge, F.slice("ls", -edge, edge)).otherwise(F.col("ls")))
    lines = listed.select("paper_id", F.explode(ends).alias("line")).select("paper_id", t.normal_line(F.col("line")).alias("line")).filter(F.length("line").between(least, most))
    counted = lines.groupBy("paper_id", "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("paper_id").agg(F.count("*").alias("pages"))
    return counted.join(sizes, "paper_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.35))).select("paper_id", "line", "n")


def without_repeats(lines: DataFrame, longest_free: int = 20) -> DataFrame:
    """Lines longer than ``longest_free`` only where they first occur."""
    first = F.row_number().over(Window.partitionBy("paper_id", "line").orderBy("ord"))
    return lines.withColumn("__first", first).filter((F.col("__first") == 1) | (F.length("line") <= longest_free)).drop("__first")


def numbered_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with the number of their paragraph, from 1."""
    before, line = F.lag("line").over(reading_order()), F.col("line")
    starts = before.isNull() | is_heading(line) | (F.length(before) > 85) | (line.rlike(r"^\p{Lu}") & before.rlike(r"[.?:;]$")) | (line.rlike(r"^\p{Nd}") & ~line.rlike(r"^\p{Nd}{4}"))
    own = is_equation(line) | F.coalesce(is_equation(before), F.lit(False))
    return lines.withColumn("__start", (starts | own).cast("int")).withColumn("paragraph", F.sum("__start").over(reading_order())).drop("__start")


def paragraphs(lines: DataFrame) -> DataFrame:
    """paper_id, paragraph, n_lines, text: lines joined by a space, or without their hyphen before a small letter."""
    parts = numbered_paragraphs(lines).groupBy("paper_id", "paragraph").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ls"))
    join = lambda s, x: F.when(s == "", x["line"]).when(s.endswith("-") & x["line"].rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(s, "-$", ""), x["line"])).otherwise(F.concat(s, F.lit(" "), x["line"]))
    return parts.select("paper_id", "paragraph", "n_lines", F.aggregate("ls", F.lit(""), join).alias("text"))


def islands(lines: DataFrame, test: Column) -> DataFrame:
    """paper_id, first_ord, n_lines, text of each run of lines that pass the test."""
    hit = lines.withColumn("__hit", test)
    run = F.col("ord") - F.row_number().over(reading_order())
    return hit.filter("__hit").withColumn("__run", run).groupBy("paper_id", "__run").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ls")).select("paper_id", "first_ord", "n_lines", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def sections(lines: DataFrame) -> DataFrame:
    """paper_id, section, heading, n_lines, chars; lines before the first heading are section 0, Front Matter."""
    at = F.sum(is_heading(F.col("line")).cast("int")).over(reading_order())
    parts = lines.withColumn("section", at).withColumn("heading", is_heading(F.col("line")))
    return parts.groupBy("paper_id", "section").agg(F.coalesce(F.max(F.when(F.col("heading"), F.col("line"))), F.lit("Front Matter")).alias("heading"), F.sum((~F.col("heading")).cast("long")).alias("n_lines"), F.sum(F.when(F.col("heading"), 0).otherwise(F.length("line"))).alias("chars"))


def table_like(line: Column) -> Column:
    """Three numbers on a line."""
    return t.count(line, NUMBER) >= 3


def structural_role(line: Column) -> Column:
    return F.when(is_equation(line), "equation_block").when(is_heading(line), "section_heading").when(line.rlike(LIST_ITEM), "list_item").when(line.rlike(CAPTION), "caption").when(table_like(line), "table_block").when(line.rlike(THEOREM), "theorem_block")


def punctuation_density(c: Column) -> Column:
    return t.share(t.count(c, r"[^\p{L}\p{N}\s]"), F.length(c))


def noise_labels(line: Column) -> Column:
    marks = (
        ("ocr_artifact", line.rlike(OCR)),
        ("table_bleed", table_like(line) | ((t.count(line, r"\p{Nd}") >= 8) & (words(line) <= 22))),
        ("caption_candidate", line.rlike(CAPTION)),
        ("inline_figure_marker", line.rlike(INLINE_FIGURE)),
        ("diagram_label", line.rlike(DIAGRAM)),
        ("layout_contamination", (words(line) <= 14) & (punctuation_density(line) > 0.18) & (t.count(line, r"\p{Lu}") >= 2)),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in marks]))


def drop_reason(line: Column) -> Column:
    """Why a line leaves the text; null if it stays."""
    labels = noise_labels(line)
    return F.when(F.array_contains(labels, "caption_candidate") & ~is_heading(line), "caption").when(F.array_contains(labels, "diagram_label"), "diagram_label").when(F.array_contains(labels, "table_bleed") & (t.count(line, " ") < 18), "table_bleed")


def region(line: Column) -> Column:
    return F.when(line.rlike(FIGURE) | line.rlike(INLINE_FIGURE), "figure").when(line.rlike(TABLE), "table")


def region_confidence(line: Column) -> Column:
    return F.when(line.rlike(FIGURE), 0.9).when(line.rlike(INLINE_FIGURE), 0.76).when(line.rlike(TABLE), 0.88)


def heading_confidence(line: Column, first_lines: Column) -> Column:
    """first_lines: whether the line is one of the first four of its page."""
    plain = F.btrim(F.regexp_replace(t.strip(line), NUMBERED, ""), F.lit(" .:"))
    n = words(plain)
    semantic = F.when(t.section_label(plain) != "body", F.lit(0.99)).otherwise(F.lit(0.0))
    cased = F.when(plain.rlike(r"^[A-Z0-9][A-Za-z0-9\s\-\&:/,()]{1,90}$"), 0.14).otherwise(0.0)
    number = F.when(line.rlike(NUMBERED), 0.28).otherwise(0.0)
    length = F.when(n <= 8, 0.2).otherwise(-0.28)
    commas = F.when(t.count(plain, ",") >= 2, 0.24).otherwise(0.0)
    inline = F.when(plain.rlike(INLINE_FIGURE), 0.45).otherwise(0.0)
    long_ = F.when(n > 10, 0.35).otherwise(0.0)
    verb = F.when(plain.rlike(BODY_VERB) & (semantic < 0.88), 0.3).otherwise(0.0)
    layout = F.when(first_lines, 0.08).otherwise(0.0) + F.when(words(line) <= 8, 0.06).otherwise(0.0)
    return t.unit(semantic + cased + number + length - commas - inline - long_ - verb + layout, 4)


def is_section_start(line: Column, confidence: Column) -> Column:
    """A heading by confidence, length and case."""
    plain = F.btrim(F.regexp_replace(t.strip(line), NUMBERED, ""), F.lit(" .:"))
    numbered = line.rlike(NUMBERED)
    titled = t.share(t.count(plain, r"(?<!\S)\p{Lu}"), words(plain))
    body = line.rlike(r"[.;]\s*$") | ~plain.rlike("[A-Za-z]")
    known = (t.section_label(plain) != "body") & plain.rlike(r"^\p{Lu}") & (titled >= 0.5)
    return (confidence >= 0.76) & (words(plain) <= F.when(numbered, 8).otherwise(6)) & ~body & ((numbered & (titled >= 0.35)) | known)


def merged_fragments(lines: DataFrame) -> DataFrame:
    """paper_id, fragment, n_lines, text: a line goes on with the one before that ends no sentence, if it starts small and neither is protected."""
    role = F.coalesce(structural_role(F.col("line")), F.lit(""))
    own = lines.withColumn("__role", role)
    w = reading_order()
    goes_on = ~F.col("__role").isin(*PROTECTED) & ~F.lag("__role").over(w).isin(*PROTECTED) & ~F.lag("line").over(w).rlike(SENTENCE_END) & F.col("line").rlike(r"^\p{Ll}")
    parts = own.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("fragment", F.sum("__new").over(w))
    joined = parts.groupBy("paper_id", "fragment").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ls"))
    fold = F.aggregate("ls", F.lit(""), lambda s, x: F.when(s == "", x["line"]).when(s.endswith("-"), F.concat(F.regexp_replace(s, "-$", ""), x["line"])).otherwise(F.concat(s, F.lit(" "), x["line"])))
    return joined.select("paper_id", "fragment", "n_lines", fold.alias("text"))


def near_duplicate_lines(lines: DataFrame, least: float = 0.96, back: int = 3) -> DataFrame:
    """paper_id, ord, nearest (how far back), hits: lines whose words are nearly those of one of the lines before."""
    toks = lines.withColumn("__t", F.array_distinct(t.found(F.lower("line"), "[a-z0-9]{3,}")))
    close = [F.coalesce(t.jaccard(F.col("__t"), F.lag("__t", k).over(reading_order())), F.lit(0.0)) >= least for k in range(1, back + 1)]
    nearest = None
    for k, c in enumerate(close, 1):
        nearest = F.when(c, k) if nearest is None else nearest.when(c, k)
    hits = sum((c.cast("int") for c in close[1:]), close[0].cast("int"))
    return toks.select("paper_id", "ord", nearest.alias("nearest"), hits.alias("hits")).filter("hits > 0")
