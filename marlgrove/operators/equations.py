"""Equations: what a line of them looks like, runs of them, their kind and integrity, and plainer writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import layout as o

# Symbols of formulas, letters a line of them is made of, and lines that only enumerate.
SYMBOL = r"=|\\sum|\\prod|\\int|\\frac|Σ|Π|∂|∇|θ|λ|β|γ|→|←|≤|≥|≈|\|\||\barg\s+min\b|\barg\s+max\b"
MADE_OF = r"^[A-Za-z0-9_(),{}\[\]\s\\|<>≤≥≈ΣΠ∂∇θλβγ=+\-*/\.]+$"
ENUMERATED = r"^\(?\d+\)?[.)]\s+[A-Z]"
TRUNCATED = r"(=|\\sum|\\frac|≤|≥|≈)\s*$"
OPERATOR = r"[=+\-*/<>≤≥≈]"
# Text that was decoded wrongly, and what it stands for, in the order in which it is looked for.
MISREAD = (("â‰¤", "≤"), ("â‰¥", "≥"), ("â‰ˆ", "≈"), ("âˆ‘", "Σ"), ("âˆ‚", "∂"), ("âˆ‡", "∇"), ("âˆ’", "−"), ("âˆ", "Π"), ("Ã—", "×"), ("ﬁ", "fi"), ("ﬂ", "fl"))
# What a loose look takes for an equation.
LOOSE = r"=|\\sum|\\prod|\\int|\\frac|\\alpha|\\beta|\\gamma|\\lambda|\\theta|\\partial|\\nabla|Σ|Π|∂|∇|θ|λ|β|γ|→|←|≤|≥|≈|\bO\([^)]+\)"


def is_block(line: Column) -> Column:
    """A line of an equation: with a symbol and no enumeration, and either an equals sign among at most 40 words or made of formula letters throughout."""
    s = t.strip(line)
    n = t.count(line, SYMBOL)
    return ~s.rlike(ENUMERATED) & (n > 0) & ((line.contains("=") & (o.words(line) <= 40)) | ((n >= 2) & s.rlike(MADE_OF)))


def kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("\\frac") | text.contains("/"), "fractional").when(low.contains("\\sum") | text.contains("Σ"), "summation").when(low.contains("\\prod") | text.contains("Π"), "product").when(text.contains("[") & text.contains("]") & text.contains(";"), "matrix").otherwise("display")


def integrity(text: Column) -> Column:
    """From brackets that match, symbols that are there, and an end that isn't cut off."""
    apart = F.abs(t.count(text, r"[(\[{]") - t.count(text, r"[)\]}]"))
    cut = F.when(text.rlike(TRUNCATED), 0.18).otherwise(0.0)
    return t.unit(F.greatest(F.lit(0.0), 1 - apart * 0.15) * 0.55 + F.least(F.lit(1.0), t.count(text, SYMBOL) / 3.0) * 0.45 - cut, 4)


def blocks(lines: DataFrame) -> DataFrame:
    """paper_id, first_ord, n_lines, kind, symbols, integrity, confidence of each run of equation lines."""
    text = F.col("text")
    scored = o.islands(lines, is_block(F.col("line"))).withColumns({"kind": kind(text), "symbols": t.count(text, SYMBOL), "integrity": integrity(text)})
    return scored.withColumn("confidence", F.when(F.col("integrity") >= 0.75, 0.92).otherwise(0.74)).drop("text")


def plain_math(c: Column) -> Column:
    """Misread signs mended, blanks joined, one blank on each side of operators."""
    mended = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), MISREAD, c)
    joined = t.strip(F.regexp_replace(mended, r"\s+", " "))
    return t.strip(F.regexp_replace(F.regexp_replace(joined, rf"\s*({OPERATOR})\s*", r" $1 "), r"\s+", " "))


def looks_like(c: Column) -> Column:
    return c.rlike(LOOSE) & ((o.words(c) <= 40) | c.contains("=") | (t.count(c, r"\(") >= 2) | c.contains("\\"))


def repaired(lines: DataFrame) -> DataFrame:
    """paper_id, first_ord, n_lines, text, operators, confidence: runs of lines that look like equations once written plainly; lines of one paper are on one page."""
    plain = lines.withColumn("line", plain_math(F.col("line")))
    found = o.islands(plain, looks_like(F.col("line")))
    flat = plain_math(F.replace("text", F.lit("\n"), F.lit(" ")))
    return found.select("paper_id", "first_ord", "n_lines", flat.alias("text"), t.count(flat, OPERATOR).alias("operators"), F.when(F.col("n_lines") > 1, 0.92).otherwise(0.8).alias("confidence"))


#: Marks of lines that count as corruption of a text, and what to look at for each.
CORRUPTION = {"caption_candidate": "figures", "ocr_artifact": "scan", "table_bleed": "tables"}


def corruption(lines: DataFrame) -> DataFrame:
    """paper_id, categories, look_at: the kinds of corruption of each paper's lines, sorted, and what to look at; equations too where over two fifths of the lines are."""
    marks = F.filter(o.noise_labels(F.col("line")), lambda x: x.isin(*CORRUPTION))
    met = lines.select("paper_id", marks.alias("marks"), is_block(F.col("line")).cast("int").alias("equation")).groupBy("paper_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("marks")))).alias("categories"), F.avg("equation").alias("share"))
    names = F.create_map(*[F.lit(x) for kv in CORRUPTION.items() for x in kv])
    asks = F.concat(F.transform("categories", lambda x: F.element_at(names, x)), F.when(F.col("share") > 0.4, F.array(F.lit("equations"))).otherwise(F.array().cast("array<string>")))
    return met.select("paper_id", F.array_join("categories", "|").alias("categories"), F.array_join(F.array_sort(asks), "|").alias("look_at"))


def column_risk(paragraphs: DataFrame, pages: DataFrame, most_words: int = 80) -> DataFrame:
    """paper_id, page_no, ord of the paragraphs that may run across columns: on pages of several columns, long, and without a gap of two blanks.

    paragraphs: paper_id, page_no, ord, text; pages: paper_id, page_no, multi_column."""
    wide = pages.filter("multi_column").select("paper_id", "page_no")
    long_ = paragraphs.filter((o.words(F.col("text")) > most_words) & ~F.col("text").contains("  "))
    return long_.join(wide, ["paper_id", "page_no"], "left_semi").select("paper_id", "page_no", "ord")
